"""BPE encoding and decoding by a distinct-word table.

The tokenizer drops white space before it merges, so a word's ids don't depend on its
neighbours and each distinct word is encoded once by the library itself:

1. texts are split at ASCII white space in the map tasks, by Arrow's kernel, and
   gathered into blocks of bounded size, as many small rows; a block keeps its distinct
   words and, for each position, the number of the word there (the JVM's own ``split`` gives the same
   words, but its garbage fills the executor's heap beside the Python workers);
2. the blocks' words meet by a hash of the word, and each distinct word of a
   partition is encoded once;
3. the ids of the distinct words, one a row, are joined with the id-to-piece table
   (a broadcast, as large as the vocabulary), which decodes the words;
4. ids and decoded words go back to their blocks and are joined to the positions by
   word number.

A frequent word occurs once per block at most in the shuffle, so no key is hot.
Both readers of the blocks use one exchange, so positions travel once.  Blocks are
bounded by ``block_bytes`` (one longer text is a block of its own).

Defined cases: null text counts as empty; empty texts have no ids and decode to
""; repeated rows are encoded each for itself, whatever their ids; special tokens in
a text get their own ids, as in the library; only the two named columns are used, so
clashing extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.batches import batch_bytes, batch_rows, give_back
from quire.llm.packed import pack, pack_numbers, unpack, unpack_numbers
from quire.llm.vocab import vocabulary_path
from quire.llm.words import word_hashes
from quire.session import Scratch, ship, table

QUERY = "op8_bpe_words"
ORACLE_SQL = None

BLOCK_BYTES = 32 << 20
SLICE_WORDS = 1 << 18
MOST_PIECES = 1 << 20
BATCH_ROWS = 1000


def load(path: str):
    """The tokenizer of a JSON file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def pieces(path: str) -> list[str]:
    """The id-to-piece table; its size is the vocabulary's."""
    t = load(path)
    return [t.id_to_token(i) or "" for i in range(max(t.get_vocab(with_added_tokens=True).values()) + 1)]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of a vocabulary that this operator can serve."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table_ = pieces(path)
    if spec.get("decoder") is not None or any("\n" in p for p in table_) or len(table_) > MOST_PIECES:
        raise ValueError("the tokenizer must have no decoder, no line end in a piece and a vocabulary small enough to broadcast")
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(table_)), pa.int32()), "piece": pa.array(table_, pa.string())}))


#: A block's rows: word lists (bucket from 0 on), a row that meets the encoded lists, the words' buckets, and documents with their words' places.
MEET, ROUTE, PLACES = -1, -2, -3
_BLOCK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("packed", pa.binary()), ("ids", pa.list_(pa.int64())), ("spans", pa.binary()), ("at", pa.binary())])
_BLOCK_DDL = "block long, bucket int, packed binary, ids array<long>, spans binary, at binary"


def _joined(words: pa.Array, cuts: np.ndarray, separator: bytes) -> pa.Array:
    """Runs of a string array, between ``cuts``, each joined to one."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), words), pa.scalar(separator, words.type))


class _Block:
    """The documents of a block under way: distinct words, their counts, and the place of each word among them.

    Places stay in chunks of whole documents, so that no step holds a copy of them all.
    """

    def __init__(self):
        self.ids: list[list] = []
        self.spans: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.seen: dict[bytes, int] = {}
        self.count = np.zeros(0, np.int64)
        self.size = 0

    def add(self, doc_ids: list, spans: np.ndarray, words: pa.Array) -> None:
        coded = words.dictionary_encode()
        distinct, seen = coded.dictionary.cast(pa.binary()).to_pylist(), self.seen
        place = np.fromiter((seen.setdefault(w, len(seen)) for w in distinct), np.uint32, len(distinct))
        where = coded.indices.to_numpy()
        self.count = np.concatenate([self.count, np.zeros(len(seen) - len(self.count), np.int64)])
        self.count[place] += np.bincount(where, minlength=len(distinct))
        self.ids.append(doc_ids)
        self.spans.append(spans)
        self.at.append(place[where])

    def rows(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """Many small rows: one of a block's size would cost the executor several times that, as contiguous heap and as direct buffers."""
        distinct = pa.array(self.seen, pa.large_binary())
        hashes = word_hashes(list(self.seen))
        self.seen.clear()
        # numbered by frequency, then by spelling, so that numbers and word lists compress well
        order = pc.sort_indices(pa.table({"n": self.count, "w": distinct}), sort_keys=[("n", "descending"), ("w", "ascending")]).to_numpy()
        number = np.empty(len(distinct), np.uint32)
        number[order] = np.arange(len(distinct), dtype=np.uint32)
        bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets))[order]
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        lists = _joined(distinct.take(pa.array(order[by_bucket])), cuts, b" ")
        lists = [(b, pack(x.as_py())) for b, x in enumerate(lists) if x.as_py()] + [(MEET, None), (ROUTE, pack_numbers(bucket))]
        yield self._batch({"block": [block] * len(lists), "bucket": [b for b, _ in lists], "packed": [x for _, x in lists]})
        del distinct, hashes, order, bucket, by_bucket, lists
        while self.at:
            ids, spans, at = self.ids.pop(0), self.spans.pop(0), self.at.pop(0)
            yield self._batch({"block": [block], "bucket": [PLACES], "ids": [ids], "spans": [pack_numbers(spans)], "at": [pack_numbers(number[at])]})

    @staticmethod
    def _batch(columns: dict) -> pa.RecordBatch:
        n = len(columns["block"])
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in _BLOCK], schema=_BLOCK)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    some = pc.greater(pc.binary_length(flat), 0)  # the kernel gives empty words around white space at the ends
    kept = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(some), np.diff(kept[np.concatenate([[0], np.cumsum(n)])])


def _blocks(buckets: int, block_bytes: int):
    """Texts to blocks; a block is known by its partition and its place there."""

    def cut(batches):
        part, seq, block = TaskContext.get().partitionId() << 32, 0, _Block()
        for batch in (b.slice(k, BATCH_ROWS) for b in batches for k in range(0, b.num_rows, BATCH_ROWS)):
            doc_ids = batch.column(0).to_pylist()
            flat, n = _split(batch.column(1))
            ends = np.concatenate([[0], np.cumsum(n)])
            wide = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy().astype(np.int64) + 1)])[ends]
            first = 0
            for i in range(len(doc_ids)):
                own = int(wide[i + 1] - wide[i]) + 8
                if block.size and block.size + own > block_bytes:
                    if i > first:
                        block.add(doc_ids[first:i], n[first:i], flat.slice(ends[first], ends[i] - ends[first]))
                    yield from block.rows(part | seq, buckets)
                    seq, first, block = seq + 1, i, _Block()
                    give_back()
                block.size += own
            if first < len(doc_ids):
                block.add(doc_ids[first:], n[first:], flat.slice(ends[first]))
        if block.ids:
            yield from block.rows(part | seq, buckets)
            give_back()

    return cut


def _lists(batches):
    """The word lists among the blocks' rows."""
    for batch in batches:
        yield batch.filter(pc.greater_equal(batch.column("bucket"), 0)).select(["block", "bucket", "packed"])


_TOKENS = pa.schema([("id", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("sizes", pa.binary())])
_TOKENS_DDL = "id int, block long, bucket int, numbers binary, sizes binary"


def _encode(path: str):
    """Word lists to rows of two kinds: the ids of words not met before in the task, one a row, and
    after them the list itself, as numbers of the task's words, with the number of ids of each new word."""

    def run(batches):
        tokenizer, known = load(path), {}
        for batch in batches:
            for block, bucket, packed in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = unpack(packed.as_py()).split(b" ")
                new = [w for w in words if w not in known]
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                coded = [e.ids for e in tokenizer.encode_batch([w.decode() for w in new], add_special_tokens=False)]
                sizes = np.fromiter(map(len, coded), np.uint32, len(coded))
                flat = [i for ids in coded for i in ids]
                none = [None] * len(flat)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": [*flat, None], "block": [*none, block.as_py()], "bucket": [*none, bucket.as_py()],
                        "numbers": [*none, pack_numbers(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))], "sizes": [*none, pack_numbers(sizes)],
                    },
                    schema=_TOKENS,
                )
        del tokenizer, known
        give_back()

    return run


_ENCODED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary()), ("decoded", pa.binary())])


def _repack(batches):
    """Rows of ``_encode`` with their pieces, in the same order, to the ids and decoded words of each list."""
    ids: list[bytes] = []
    decoded: list[bytes] = []
    new_ids: list[pa.Array] = []
    new_pieces: list[pa.Array] = []
    for batch in batches:
        start = 0
        for at in np.flatnonzero(batch.column("block").is_valid().to_numpy(zero_copy_only=False)).tolist():
            new_ids.append(batch.column("id").slice(start, at - start))
            new_pieces.append(batch.column("piece").slice(start, at - start))
            start = at + 1
            flat = pa.concat_arrays(new_ids).to_numpy(zero_copy_only=False).astype("<u4")
            cuts = np.concatenate([[0], np.cumsum(unpack_numbers(batch.column("sizes")[at].as_py()), dtype=np.int64)])
            decoded += _joined(pa.concat_arrays(new_pieces).cast(pa.large_binary()), cuts, b" ").to_pylist()
            raw = flat.tobytes()
            ids += [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            new_ids, new_pieces = [], []
            own = unpack_numbers(batch.column("numbers")[at].as_py()).tolist()
            coded = [ids[i] for i in own]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": [batch.column("block")[at].as_py()], "bucket": [batch.column("bucket")[at].as_py()], "sizes": [pack_numbers(np.fromiter(map(len, coded), np.uint32, len(coded)) // 4)],
                    "ids": [pack_numbers(np.frombuffer(b"".join(coded), "<u4"))], "decoded": [pack(b"\n".join([decoded[i] for i in own]))],
                },
                schema=_ENCODED,
            )
        if start < batch.num_rows:
            new_ids.append(batch.column("id").slice(start))
            new_pieces.append(batch.column("piece").slice(start))
    ids.clear()
    decoded.clear()
    give_back()


def _cut_lines(text: bytes) -> pa.Array:
    """The lines of a text, cut without an object for each."""
    data = np.frombuffer(text, np.uint8)
    is_end = data == ord("\n")
    ends = np.flatnonzero(is_end)
    cuts = np.concatenate([[0], ends - np.arange(len(ends)), [len(data) - len(ends)]]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) + 1, [None, pa.py_buffer(cuts), pa.py_buffer(data[~is_end])])


def _word_table(encoded: list[dict], route: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Number of ids, ids and decoded text of a block's words, by word number."""
    encoded = sorted(encoded, key=lambda x: x["bucket"])
    place = np.empty(len(route), np.int64)  # lists hold a bucket's words by number
    place[np.argsort(route, kind="stable")] = np.arange(len(route))
    where = pa.array(place)
    decoded = _cut_lines(b"\n".join([unpack(x["decoded"]) for x in encoded])).take(where)
    sizes = np.concatenate([unpack_numbers(x["sizes"]) for x in encoded]).astype(np.int64)
    flat = np.concatenate([unpack_numbers(x["ids"]) for x in encoded]).astype(np.int32)
    ids = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64()), pa.array(flat)).take(where)
    return sizes[place], ids, decoded


def _join(want: str, out: pa.Schema):
    """Word ids to the positions of each block, a slice of documents at a time."""

    def rows(doc_ids: list, spans: np.ndarray, at: np.ndarray, sizes: np.ndarray, ids: pa.Array, decoded: pa.Array, coded: pa.Array):
        ends, first = np.concatenate([[0], np.cumsum(spans)]), 0
        while first < len(doc_ids):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_WORDS, "right")) - 1)
            here = at[ends[first] : ends[last]]
            some = sizes[here] > 0  # a word may have no ids
            cuts = np.concatenate([[0], np.cumsum(some)])[ends[first : last + 1] - ends[first]]
            tokens = np.concatenate([[0], np.cumsum(sizes[here])])[ends[first : last + 1] - ends[first]]
            take = pa.array(here[some])
            plain = _joined(decoded.take(take), cuts, b" ")
            if want == "digest":
                texts = _joined(coded.take(take), cuts, " ")
                columns = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in c]) for c in (texts, plain)]
            else:
                own = ids.take(take).flatten()
                columns = [pa.LargeListArray.from_arrays(pa.array(tokens, pa.int64()), own).cast(pa.list_(pa.int32())), plain.cast(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids[first:last], pa.int64()), pa.array(np.diff(tokens), pa.int64()), *columns], schema=out)
            first = last

    def joined(route: bytes, encoded: list[dict], places: list[tuple]):
        route = unpack_numbers(route)
        sizes, ids, decoded = _word_table(encoded, route) if len(route) else (np.empty(0, np.int64), pa.array([], pa.large_list(pa.int32())), pa.array([], pa.large_binary()))
        encoded.clear()
        give_back()  # what the tables were made from, before the slices are
        coded = pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets, ids.values.cast(pa.large_string())), pa.scalar(" ", pa.large_string()))
        while places:
            doc_ids, n, at = places.pop()
            yield from rows(doc_ids, unpack_numbers(n).astype(np.int64), unpack_numbers(at), sizes, ids, decoded, coded)
        del sizes, ids, decoded, coded
        give_back()

    def run(batches):
        now, route, encoded, places = None, b"", [], []
        for batch in batches:
            for i, (block, bucket) in enumerate(zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), strict=True)):
                if block != now and places:
                    yield from joined(route, encoded, places)
                now = block
                if bucket == PLACES:
                    places.append(tuple(batch.column(c)[i].as_py() for c in ("ids", "spans", "at")))
                elif bucket == ROUTE:
                    route = batch.column("packed")[i].as_py()
                elif bucket == MEET and batch.column("list")[i].is_valid:
                    encoded.append({"bucket": batch.column("list")[i].as_py()} | {c: batch.column(f"list_{c}")[i].as_py() for c in ("sizes", "ids", "decoded")})
        if places:
            yield from joined(route, encoded, places)

    return run


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_FULL = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def bpe(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", want: str = "full", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row, or the digests of both for ``want="digest"``.

    The tokenizer must drop white space and have no decoder (words end in a marker).
    """
    spark = df.sparkSession
    ship(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(_blocks(buckets, block_bytes), _BLOCK_DDL).repartition(buckets, "block")
    words = blocks.mapInArrow(_lists, "block long, bucket int, packed binary").repartitionById(buckets, "bucket")
    tokens = words.mapInArrow(_encode(path), _TOKENS_DDL).alias("t")
    decoded = tokens.join(F.broadcast(piece_table(spark, path)).alias("p"), F.col("t.id") == F.col("p.id"), "left").select("t.*", "p.piece")
    encoded = decoded.mapInArrow(_repack, "block long, bucket int, sizes binary, ids binary, decoded binary")
    encoded = encoded.select(F.col("block").alias("of"), F.col("bucket").alias("list"), *(F.col(c).alias(f"list_{c}") for c in ("sizes", "ids", "decoded")))
    out, ddl = (_DIGEST, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string") if want == "digest" else (_FULL, "doc_id long, n_tokens long, ids array<int>, decoded string")
    # one row of a block meets its lists, so no row holds them all; a merge join sorts by block already
    met = blocks.join(encoded, (F.col("block") == F.col("of")) & (F.col("bucket") == MEET), "left").sortWithinPartitions("block")
    return met.mapInArrow(_join(want, out), ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with Scratch(spark) as s, batch_rows(spark, BATCH_ROWS), batch_bytes(spark):  # keeps texts and other blocks of a batch few beside the block's words
        return s.keep(bpe(docs, vocabulary_path("word_bpe_49k.json"), want="digest"))
