"""Packing along a space-filling curve.

Every document is tokenized, its tokens' hashed vector is projected to three
dimensions and the point's place on a Hilbert curve becomes its key.  Documents
are range-partitioned and sorted by (key, doc_id) and laid end to end along the
curve; the stream is cut every 1024 tokens, so neighbours in content share
sequences and only the very last sequence is short.

Range bounds come from a random sample of about ``SAMPLE`` keys for each range (pairs
with the id, so equal keys are split too); the position of a range's first token is the
sum of the ranges before it: one number a range reaches the driver.

Defined cases: null and empty texts are one end token; copies have equal keys and
follow each other by id, null ids first; rows with a null or repeated id are packed each for itself; a text longer than a sequence spans several; no rows give
no pieces; only the named columns are read.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.vocab import vocabulary_path
from quire.session import Scratch, shared_dir, ship, table

QUERY = "op7_curve_packing"
ORACLE_SQL = None

LENGTH = 1024
DIMS, BITS = 3, 16
SAMPLE = 100
#: Null ids are sorted as this one.
NO_ID = -(1 << 63)
_CACHED = 300_000


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def is_plain(spec: dict) -> bool:
    """Is it byte-level BPE with the usual split, merges in the order of ids and plain special tokens?"""
    pre, model, letters = spec.get("pre_tokenizer") or {}, spec["model"], _byte_letters()
    if spec.get("normalizer") or spec.get("post_processor") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    special = {t["content"] for t in spec["added_tokens"]}
    if not all(t["special"] for t in spec["added_tokens"]) or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"].get(w, -1) for w in made]
    return ids == sorted(set(ids)) and set(model["vocab"]) - special == set(letters) | set(made)


class Encoder:
    """Ids of a byte-level BPE vocabulary file, equal to the tokenizers library's.

    The pre-tokenizer attaches white space to what follows, so a run of white
    space and the word after it is encoded alike wherever it stands: such units
    are encoded once and remembered (the memory is bounded).  Texts with unusual
    white space or special tokens are encoded whole.  A file of another kind
    (``is_plain``) is left to the library.
    """

    #: Fixed value: the split pattern of this family of vocabularies.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = None
        if not is_plain(spec):
            from quire.llm.bpe_words import load

            self.library = load(path)
            return
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.inner = tiktoken.Encoding("units", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.known: dict[str, bytes] = {}

    def _unit(self, unit: str, first: bool) -> bytes | None:
        """Ids of a word with the white space before it as uint32 bytes; None if it isn't of that form."""
        word = unit[1:] if unit[:1] == "\n" else unit
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        whole = unit if unit[0] == "\n" or first else " " + unit
        return np.array(self.inner.encode_ordinary(whole), np.uint32).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.library is not None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if not (self.special and self.special.search(text)):
            units = text.replace("\n", " \n").split(" ")
            head = b"" if units[0] == "" else self._unit(units[0], True)
            if units[0] == "" and text[0] != "\n":
                head = b""  # the text starts with one space; the next unit carries it
            known, out = self.known, [head]
            for u in units[1:]:
                ids = known.get(u)
                if ids is None:
                    ids = self._unit(u, False)
                    if ids is not None and len(known) < _CACHED:
                        known[u] = ids
                out.append(ids)
                if ids is None:
                    break
            if None not in out:
                return b"".join(out)
        return np.array(self.inner.encode(text, allowed_special="all"), np.uint32).tobytes()


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points [n, d] (Skilling's transpose method)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _project(ids: list[np.ndarray], basis: np.ndarray) -> np.ndarray:
    """Points of documents: the mean of their tokens' random directions, spread over the grid."""
    ends = np.cumsum([len(i) for i in ids])
    flat = np.concatenate(ids)
    sums = np.add.reduceat(basis[flat], np.concatenate([[0], ends[:-1]]), axis=0)
    mean = sums / np.array([len(i) for i in ids])[:, None]
    return np.clip((np.tanh(mean * 2) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def _tokenize(path: str, end: int):
    out = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encoder = Encoder(path)
        tail = np.array([end], np.uint32).tobytes()
        basis = np.random.default_rng(7).standard_normal((1 << 17, DIMS)).astype(np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                coded = [encoder.encode(t.as_py() or "") + tail for t in b.column("text")]
                ids = [np.frombuffer(c, np.uint32) for c in coded]
                key = hilbert_key(_project([i % (1 << 17) for i in ids], basis))
                small = [i.astype(np.uint16).tobytes() if i.max() < 65536 else i.tobytes() for i in ids]
                yield pa.RecordBatch.from_pydict({"key": key, "doc_id": b.column("doc_id"), "n": [len(i) for i in ids], "ids": small}, schema=out)

    return run


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pieces(first: dict[int, int], length: int, with_ids: bool):
    def run(batches):
        part, at = None, 0
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for r, doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "n", "ids")), strict=True):
                if r != part:  # several ranges may share a task; each has its own first position
                    part, at = r, first[r]
                wide = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4").tobytes()
                start = 0
                while start < n:
                    size = min(n - start, length - at % length)
                    piece = wide[4 * start : 4 * (start + size)]
                    for c, v in zip(cols, (doc, start, size, zlib.crc32(piece), n, at // length, at % length, piece if with_ids else None), strict=True):
                        c.append(v)
                    start += size
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECE, strict=True)], schema=_PIECE)

    return run


def curve_packing(df: DataFrame, path: str, scratch: Scratch | None = None, length: int = LENGTH, end: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences: where each lies, its length, its checksum and its ids.

    The tokens are written to ``scratch``; without one they are a checkpoint, which
    Spark removes when the result is no longer used.
    """
    spark = df.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(path, end), "key long, doc_id long, n long, ids binary")
    shared_dir(spark)
    tokens = scratch.save(tokens, "tokens") if scratch else tokens.checkpoint(eager=True)
    share = min(1.0, SAMPLE * parts / max(1, tokens.count()))
    sample = tokens.select("key", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")).sample(share, seed=5).collect()  # about SAMPLE rows a range
    points = sorted((r.key, r.doc_id) for r in sample)
    bounds = [points[len(points) * i // parts] for i in range(1, parts)] if points else []
    tokens = tokens.withColumn("range", _range_of(bounds))
    totals = {r["range"]: r.n for r in tokens.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # one row a range
    first, at = {}, 0
    for r in sorted(totals):
        first[r] = at
        at += totals[r]
    laid = tokens.repartitionById(parts, "range").sortWithinPartitions("range", "key", "doc_id")
    return laid.select("range", "doc_id", "n", "ids").mapInArrow(_pieces(first, length, with_ids), _DDL)


def _range_of(bounds: list[tuple[int, int]]):
    """The number of bounds at or below (key, doc_id), by binary search over batches of both."""
    keys, docs = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def search(key: pd.Series, doc: pd.Series) -> pd.Series:
        k, d = key.to_numpy(np.int64), doc.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for tied in np.unique(low[low < high]):  # rows with the key of some bounds
            at = np.flatnonzero((low == tied) & (high > low))
            low[at] += np.searchsorted(docs[tied : high[at[0]]], d[at], "right")
        return pd.Series(low.astype(np.int32))

    return search(F.col("key"), F.coalesce("doc_id", F.lit(NO_ID)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with Scratch(spark) as s:
        return s.keep(curve_packing(docs, vocabulary_path("byte_bpe_50k.json"), s, with_ids=False).drop("ids"))
