"""Line dedup: exact and nearly equal lines, by a segment-partition edit join.

Every line (cut at \\n) that isn't blank takes part, whatever its length.  Two lines
are nearly equal within ``edits`` edits, but no more than one for each
``CHARS_PER_EDIT`` characters of the shorter one; below that length only equal lines
are.  A line is cut into one segment more than it may have edits; if two lines are
nearly equal, some segment of the shorter one occurs unchanged in the longer one near
its place.  For each length that a partner may have, the longer line probes only the
positions that the multi-match-aware bounds leave.

1. Equal lines are folded by a 128-bit hash; its first half names a line in the
   steps that follow (of different lines with one first half, which 10^12 lines have
   a few ten thousand times, one takes part in them).
2. Segments and probes are hashed to keys; only lines that share a key with
   another line go on (chunks of lines are pre-aggregated in the map task, so a
   segment that many lines hold is no hot key).
3. Those lines meet per key, in blocks of bounded size; length and a letter-count
   sketch reject most pairs, and a block reports a forest of the rest, which gives
   clusters that hold every candidate pair.
4. Within a cluster, again in blocks, pairs are verified by a banded bit-parallel
   edit distance; a block reports a forest of links and each line's link count.
5. Links are grouped by union-find; of each class the first line, by (doc_id,
   line number), stays and the others are removed.

Defined cases: null text counts as empty and stays null; empty lines and lines of
white space alone are never touched; a repeated line inside one document counts as any other; ties are decided
by line number; rows with a null or repeated id are documents of their own, numbered in
the order of ids, nulls last; other columns aren't read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quire.llm.batches import batch_bytes
from quire.llm.blocks import Forest, block_pairs
from quire.llm.packed import pack, unpack
from quire.llm.ids import GIVEN, keyed
from quire.llm.near_dedup import components, grouped
from quire.llm.words import mix
from quire.session import Scratch, ship, table

QUERY = "op10_line_dedup"
ORACLE_SQL = None

MIN_CHARS = 1
EDITS = 2
CHARS_PER_EDIT = 5
CHUNK = 1 << 20
BLOCK, TEXT_BLOCK = 512, 128


_SIGN = 1 << 63


def line_hash(line: str) -> int:
    return (xxhash.xxh3_128_intdigest(line.encode()) >> 64) - _SIGN


def line_hashes(line: str) -> tuple[int, int]:
    """Both halves of a line's 128-bit hash, as signed numbers."""
    h = xxhash.xxh3_128_intdigest(line.encode())
    return (h >> 64) - _SIGN, (h & (2 * _SIGN - 1)) - _SIGN


def allowed(n, edits: int, per: int = CHARS_PER_EDIT):
    """The edits that a pair may have whose shorter line has n characters (a number or an array)."""
    return np.minimum(n // per, edits)


def segments(n: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the segments of a line of n characters; later ones take the remainder."""
    k = edits + 1
    size, longer = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        own = size + (i >= k - longer)
        out.append((at, own))
        at += own
    return out


def probes(n: int, length: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment, start, size) to look up in a line of n characters for partners of ``length`` <= n."""
    gap, out = n - length, []
    for i, (p, size) in enumerate(segments(length, edits)):
        low = max(0, p - (edits - gap) // 2, p - i, p + gap - (edits - i))
        high = min(n - size, p + (edits + gap) // 2, p + i, p + gap + (edits - i))
        out += [(i, s, size) for s in range(low, high + 1)]
    return out


@lru_cache(maxsize=4096)
def key_places(n: int, edits: int, per: int) -> tuple[tuple[int, int, int, int], ...]:
    """(start, end, seed, role) of the segments (1) and probes (2) of a line of n characters; 3 is both."""
    places: dict[tuple[int, int, int], int] = {}
    own = min(n // per, edits)
    if own:
        for i, (p, size) in enumerate(segments(n, own)):
            places[p, p + size, n * 64 + i] = 1
        for length in range(max(per, n - edits), n + 1):
            most = min(length // per, edits)
            if n - length <= most:
                for i, s, size in probes(n, length, most):
                    at = s, s + size, length * 64 + i
                    places[at] = places.get(at, 0) | 2
    return tuple((*at, role) for at, role in places.items())


def line_keys(line: str, edits: int, per: int = 1) -> dict[int, int]:
    """Key to role of a line's segments and probes."""
    places = key_places(len(line), edits, per)
    keys: dict[int, int] = {}
    if line.isascii():  # a character is a byte, so the line is encoded once
        data = line.encode()
        for start, end, seed, role in places:
            k = xxh3_64_intdigest(data[start:end], seed)
            keys[k] = keys.get(k, 0) | role
    else:
        for start, end, seed, role in places:
            k = xxh3_64_intdigest(line[start:end].encode(), seed)
            keys[k] = keys.get(k, 0) | role
    return keys


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most + 1`` if it is larger.

    Bit-parallel automaton: row d has a bit for each pattern prefix that matches
    the text so far with d edits, kept only in the band of 2 * most + 1 diagonals.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    start, ea, eb = 0, len(a), len(b)
    while start < min(ea, eb) and a[start] == b[start]:
        start += 1
    while ea > start and eb > start and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    a, b = a[start:ea], b[start:eb]
    where: dict[str, int] = {}
    for i, c in enumerate(a, 1):
        where[c] = where.get(c, 0) | 1 << i
    band = (1 << (2 * most + 1)) - 1
    rows = [((1 << (d + 1)) - 1) << most & band for d in range(most + 1)]
    for j, c in enumerate(b, 1):
        hit = where.get(c, 0)
        hit = (hit >> (j - most) if j >= most else hit << (most - j)) & band
        old = rows
        rows = [old[0] & hit]
        for d in range(1, most + 1):
            rows.append((old[d] & hit | old[d - 1] >> 1 | old[d - 1] | rows[d - 1] << 1) & band)
        if not rows[-1]:
            return most + 1
    end = 1 << (len(a) - len(b) + most)
    return next((d for d, r in enumerate(rows) if r & end), most + 1)


def sketch(line: str) -> bytes:
    """Counts of the line's characters in 16 bins, modulo 256."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount((codes * np.uint32(2654435761)) >> np.uint32(28), minlength=16).astype(np.uint8).tobytes()


def _lines(batch, least: int):
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        for i, line in enumerate((text.as_py() or "").split("\n")):
            if len(line) >= least and not line.isspace():
                yield doc_id, i, line


def _occurrences(least: int):
    out = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("line", pa.int64()), ("check", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = [(d, i, *line_hashes(x)) for d, i, x in _lines(batch, least)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 4, out, strict=True)], schema=out)

    return run


_KEYS = pa.schema([("key", pa.int64()), ("line", pa.int64()), ("known", pa.bool_())])


def _shared_keys(least: int, edits: int):
    """(key, line, known): keys of a chunk's distinct lines; lines that share a key in the chunk are known."""

    def flush(keys: list[int], owners: list[int]) -> pa.RecordBatch:
        k, line = np.array(keys, np.uint64).view(np.int64), np.array(owners, np.int64)
        order = np.argsort(k, kind="stable")
        k, line = k[order], line[order]
        same = k[1:] == k[:-1]  # lines are distinct and a line has a key once, so owners differ
        again = np.zeros(len(k), bool)
        again[1:] |= same
        again[:-1] |= same
        head = ~np.concatenate([[False], same])
        known = np.unique(line[again])
        spread = mix(known.view(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([k[head], spread])), pa.array(np.concatenate([line[head], known])), pa.array(np.arange(int(head.sum()) + len(known)) >= head.sum())], schema=_KEYS
        )

    def run(batches):
        keys, owners, seen = [], [], set()
        for batch in batches:
            for _, _, line in _lines(batch, least):
                h = line_hash(line)
                if h not in seen:
                    seen.add(h)
                    own = line_keys(line, edits, CHARS_PER_EDIT)
                    keys += own
                    owners += [h] * len(own)
                    if len(keys) >= CHUNK:
                        yield flush(keys, owners)
                        keys, owners, seen = [], [], set()
        if keys:
            yield flush(keys, owners)

    return run


def _met(batches):
    """Rows sorted by key to the lines that share a key with another line; a run may span batches."""
    out = pa.schema([("line", pa.int64())])
    key, first, told = None, 0, False
    for b in batches:
        k, line, known = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
        found = [line[known]]
        k, line = k[~known], line[~known]
        if len(k):
            if key is not None and k[0] == key:
                k, line = np.concatenate([[key], k]), np.concatenate([[first], line])
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.concatenate([starts, [len(k)]]))
            mixed = np.maximum.reduceat(line, starts) != np.minimum.reduceat(line, starts)
            if told and key is not None and k[0] == key:
                mixed[0] = True
            found.append(line[np.repeat(mixed, size)])
            key, first, told = k[-1], line[starts[-1]], bool(mixed[-1])
        found = np.unique(np.concatenate(found))
        yield pa.RecordBatch.from_arrays([pa.array(found)], schema=out)


_PACKED = pa.schema([("bucket", pa.int32()), ("lines", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
_PACKED_DDL = "bucket int, lines binary, sizes binary, data binary"
TEXT_BYTES = 8 << 20


def _by_bucket(lines: np.ndarray, buckets: int):
    """(bucket, places) of the line hashes that fall to each bucket."""
    to = (lines.view(np.uint64) >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    return [(b, order[lo:hi]) for b, lo, hi in zip(range(buckets), cuts[:-1], cuts[1:], strict=True) if lo < hi]


def _packed_texts(least: int, buckets: int):
    """A chunk's distinct lines, compressed together for each bucket."""

    def flush(held: dict[int, bytes]) -> pa.RecordBatch:
        lines, texts = np.array(list(held), np.int64), list(held.values())
        rows = []
        for b, at in _by_bucket(lines, buckets):
            own = [texts[i] for i in at]
            rows.append((b, lines[at].tobytes(), np.array([len(x) for x in own], np.uint32).tobytes(), pack(b"".join(own))))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for _, _, line in _lines(batch, least):
                h = line_hash(line)
                if h not in held:
                    held[h] = line.encode()
                    size += len(held[h])
                    if size >= TEXT_BYTES:
                        yield flush(held)
                        held, size = {}, 0
        if held:
            yield flush(held)

    return run


def _wanted(buckets: int):
    def run(batches):
        for batch in batches:
            lines = batch.column(0).to_numpy()
            rows = [(b, lines[at].tobytes(), None, None) for b, at in _by_bucket(lines, buckets)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)

    return run


def _pick(batches):
    """(line, text) of a partition's wanted lines, each once; the wanted ones come first, so texts pass by."""
    out = pa.schema([("line", pa.int64()), ("text", pa.string())])
    wanted: set[int] = set()
    for batch in batches:
        for lines, sizes, data in zip(*(batch.column(c) for c in ("lines", "sizes", "data")), strict=True):
            here = np.frombuffer(lines.as_py(), np.int64).tolist()
            if not data.is_valid:
                wanted.update(here)
                continue
            own = [(i, h) for i, h in enumerate(here) if h in wanted]
            if own:
                ends, text = np.cumsum(np.frombuffer(sizes.as_py(), np.uint32)), unpack(data.as_py())
                starts = ends - np.frombuffer(sizes.as_py(), np.uint32)
                wanted.difference_update(h for _, h in own)
                yield pa.RecordBatch.from_pydict({"line": [h for _, h in own], "text": [text[starts[i] : ends[i]].decode() for i, _ in own]}, schema=out)


def _members(edits: int):
    out = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("role", pa.int32()), ("chars", pa.int32()), ("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                rows = [
                    (k - (1 << 64) if k >> 63 else k, line, role, len(text), s)
                    for line, text in zip(b.column("line").to_pylist(), b.column("text").to_pylist(), strict=True)
                    for s in [sketch(text)]
                    for k, role in line_keys(text, edits, CHARS_PER_EDIT).items()
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 5, out, strict=True)], schema=out)

    return run


def _hinted(edits: int):
    """Block pairs to a forest of the lines whose roles, lengths and sketches allow the distance."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def matrix(side):
        return (
            np.array([x["doc_id"] for x in side], np.int64),
            np.array([x["role"] for x in side], np.int32),
            np.array([x["chars"] for x in side], np.int64),
            np.frombuffer(b"".join(x["sketch"] for x in side), np.uint8).reshape(-1, 16),
        )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = matrix(batch.column("left")[i].as_py())
                apart, n_left = batch.column("right")[i].is_valid, len(own[0])
                if apart:
                    own = tuple(np.concatenate(x) for x in zip(own, matrix(batch.column("right")[i].as_py()), strict=True))
                ids, role, chars, letters = own
                forest, found = Forest(len(ids)), []
                for k in range(n_left):
                    at = np.arange(n_left if apart else k + 1, len(ids))
                    at = at[(forest.label[at] != forest.label[k]) & ((role[at] | role[k]) == 3)]
                    most = allowed(np.minimum(chars[at], chars[k]), edits)
                    near = np.abs(chars[at] - chars[k]) <= most
                    at, most = at[near], most[near]
                    if len(at):
                        d = letters[at] - letters[k]  # modulo 256
                        at = at[np.minimum(d, 0 - d).astype(np.int32).sum(1) <= 2 * most]
                    if len(at):
                        found += [(ids[k], ids[x]) for x in forest.join(k, at)]
                if found:
                    yield pa.RecordBatch.from_pydict({"a": [min(x) for x in found], "b": [max(x) for x in found]}, schema=out)

    return run


def _verified(edits: int):
    """Block pairs to a forest of the links (a, b, 0) and the number of links of each line (a, a, n)."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                side = batch.column("left")[i].as_py()
                apart, n_left = batch.column("right")[i].is_valid, len(side)
                side += batch.column("right")[i].as_py() if apart else []
                chars = np.array([len(x["text"]) for x in side], np.int64)
                letters = np.frombuffer(b"".join(sketch(x["text"]) for x in side), np.uint8).reshape(-1, 16)
                forest, rows, degree = Forest(len(side)), [], np.zeros(len(side), np.int64)
                for k in range(n_left):
                    at = np.arange(n_left if apart else k + 1, len(side))
                    d, most = letters[at] - letters[k], allowed(np.minimum(chars[at], chars[k]), edits)
                    near = (np.abs(chars[at] - chars[k]) <= most) & (np.minimum(d, 0 - d).astype(np.int32).sum(1) <= 2 * most)
                    at, most = at[near], most[near].tolist()
                    at = at[[edit_distance(side[k]["text"], side[x]["text"], m) <= m for x, m in zip(at, most, strict=True)]] if len(at) else at
                    if len(at):
                        degree[k] += len(at)
                        degree[at] += 1
                        rows += [(side[k]["doc_id"], side[x]["doc_id"], 0) for x in forest.join(k, at)]
                rows += [(side[k]["doc_id"], side[k]["doc_id"], degree[k]) for k in np.flatnonzero(degree)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return run


def line_links(docs: DataFrame, scratch: Scratch, edits: int = EDITS, least: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(links, texts) of different lines that are nearly equal: a forest (a, b, 0) of their hashes and counts
    (a, a, n); the text that each hash stands for."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text").mapInArrow(_shared_keys(least, edits), "key long, line long, known boolean")
    met = keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_met, "line long").distinct()
    met = scratch.save(met, "met")
    packed = docs.select("doc_id", "text").mapInArrow(_packed_texts(least, parts), _PACKED_DDL).unionByName(met.mapInArrow(_wanted(parts), _PACKED_DDL))
    texts = packed.repartitionById(parts, "bucket").sortWithinPartitions(F.col("data").isNotNull()).mapInArrow(_pick, "line long, text string")
    texts = scratch.save(texts, "texts")
    members = scratch.save(texts.mapInArrow(_members(edits), "key long, doc_id long, role int, chars int, sketch binary"), "members")
    # a bucket needs a segment and a probe of two lines
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_or("role").alias("roles")).where("n > 1 AND roles = 3").select("key", "n")
    sizes = scratch.save(sizes, "sizes")
    hints = scratch.save(block_pairs(members.join(sizes, "key"), ["role", "chars", "sketch"], _hinted(edits), "a long, b long", BLOCK), "line-hints")
    groups = grouped(hints, scratch, "line").join(texts.withColumnRenamed("line", "doc_id"), "doc_id")
    return scratch.save(block_pairs(groups, ["text"], _verified(edits), "a long, b long, n long", TEXT_BLOCK), "line-links"), texts


def _checks(batches):
    """(node, check) of the lines that links name."""
    out = pa.schema([("node", pa.int64()), ("check", pa.int64())])
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([line_hashes(t)[1] for t in b.column(1).to_pylist()], pa.int64())], schema=out)


def line_classes(docs: DataFrame, scratch: Scratch, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, lines) with an entry for each line of a class of two or more lines: line number,
    the class's first line, its number of links to different lines, and whether it is removed.

    ``doc_id`` must be neither null nor repeated.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ship(docs.sparkSession)
    with batch_bytes(docs.sparkSession):  # a row of a block pair may hold hundreds of lines
        seen = scratch.save(docs.mapInArrow(_occurrences(least), "doc_id long, line_no int, line long, check long"), "occurrences")
        links, texts = line_links(docs, scratch, edits, least)
        degree = links.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
        classes = scratch.save(components(links.where("a <> b"), scratch, "line-class"), "line-components")
        classes = classes.select("node", "component").unionByName(classes.select(F.col("component").alias("node"), "component").distinct())
        checks = texts.join(classes.select(F.col("node").alias("line")), "line", "left_semi").select("line", "text").mapInArrow(_checks, "node long, check long")
        classes = scratch.save(classes.join(degree, "node").join(checks, "node").withColumnRenamed("node", "line"), "line-classes")
    # a class is named by its component, or by the whole hash of the one line that it holds
    joined = seen.join(classes, ["line", "check"], "left")
    placed = joined.select("doc_id", "line_no", F.coalesce("component", "line").alias("class"), F.when(F.col("component").isNull(), F.col("check")).alias("check"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    placed = scratch.save(placed, "placed")
    first = placed.groupBy("class", "check").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")).where("n > 1").select("class", "check", "first")
    first = scratch.save(first, "first-lines").alias("f")
    entry = F.struct(
        "line_no",
        F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.line_no").alias("class_line_no"),
        "n_links",
        ((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line_no") != F.col("first.line_no"))).alias("removed"),
    )
    same = (F.col("p.class") == F.col("f.class")) & F.col("p.check").eqNullSafe(F.col("f.check"))
    return placed.alias("p").join(first, same).select("doc_id", entry.alias("x")).groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("lines"))


def line_dedup(docs: DataFrame, scratch: Scratch, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """``docs``' doc_id with the kept text, ``n_lines``, ``n_removed`` and the classes of its lines.

    Where ids are null or repeated, ``class_doc_id`` is the id of the row that holds the class's first line.
    """
    docs, renumbered = keyed(docs.select("doc_id", "text"), scratch)
    classes = scratch.save(line_classes(docs, scratch, edits, least), "classes")
    if not renumbered:
        return apply_classes(docs, classes)
    given = docs.select(F.col("doc_id").alias("number"), F.col(GIVEN).alias("id"))
    entries = classes.select("doc_id", F.explode("lines").alias("x")).join(given, F.col("x.class_doc_id") == F.col("number"))
    named = entries.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.col("x").withField("class_doc_id", F.col("id")))).alias("lines"))
    out = apply_classes(docs, named, (GIVEN,))
    return out.select(F.col(GIVEN).alias("doc_id"), "text", "n_lines", "n_removed", "lines")


def apply_classes(docs: DataFrame, classes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document without its removed lines: columns doc_id, text, n_lines, n_removed, lines and those to carry."""
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).join(classes, "doc_id", "left")
    joined = joined.withColumn("__split", F.split("text", "\n")).withColumn(
        "__gone", F.transform(F.filter("lines", lambda x: x["removed"]), lambda x: x["line_no"])
    )
    left = F.array_except(F.sequence(F.lit(0), F.size("__split") - 1), "__gone")
    kept = F.when(F.size("__gone") > 0, F.array_join(F.transform(left, lambda i: F.get("__split", i)), "\n")).otherwise(F.col("text"))
    return joined.select(
        "doc_id", kept.alias("text"), F.coalesce(F.size("__split"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"), "lines", *carry
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with Scratch(spark) as s:
        out = line_dedup(docs, s)
        return s.keep(out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "lines"))
