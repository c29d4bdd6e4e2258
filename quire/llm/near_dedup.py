"""Near-duplicate texts: SuperMinHash signatures, banding, verification, union-find.

A document's set holds its distinct 5-word shingles.  SuperMinHash gives every
shingle a random permutation of the signature's slots; step k of the permutation
offers the value k + u in (k, k + 1) to its slot.  The ranks of one shingle are
correlated, which lowers the variance of the estimate, and once every slot holds
a value below k no later step can change anything, so the work stops early.

1. Texts are read once for their sets' hashes and signatures, so that they needn't travel;
   equal sets are folded first: one representative (smallest id) for each.
2. Representatives meet in a bucket when all rows of one band agree.  Members of
   a bucket are compared by their signatures in blocks of bounded size.  Pairs
   with as many equal slots as all but ``LOSS / 10`` of the links have are
   candidates; a block reports a forest of them, never all pairs, and forests give
   clusters that hold every candidate pair.
3. Within each cluster, again in blocks, all pairs are verified on the full
   shingle sets, and a block reports a forest of the links.
4. Links go through union-find: each task contracts its links to a spanning
   forest, then large-star and small-star rounds join the forests; once ``FEW``
   links or fewer are left, one task joins them.

Bands and the least number of equal slots follow from the threshold, so that a link
at it is missed with a probability below 1.1 * ``LOSS``: at 0.85 by 24 bands of 5 rows
(7.7e-7), at 0.8 by 30 bands of 4 (1.4e-7).  A threshold so low that even bands of one
row lose more gets those.  No bucket is capped: a large one is spread over block pairs.

Defined cases: null and wordless texts have empty sets and link with nothing;
texts of one to four words have their whole sequence as one shingle; rows with a null
or repeated id are documents of their own, numbered in the order of ids (nulls last):
one row of a group is kept, and its id, null if no row of the group has one, is the
component; other columns are not read.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.blocks import Forest, block_pairs
from quire.llm.ids import GIVEN, keyed
from quire.llm.words import mix, window_hashes, word_hashes
from quire.session import Scratch, ship, table

QUERY = "op6_near_dedup"

SHINGLE = 5
SLOTS = 120
LOSS = 1e-6
BLOCK, SET_BLOCK = 512, 128
FEW = 200_000


def banding(least: Fraction) -> tuple[int, int]:
    """(bands, rows): the longest bands that lose a link at the similarity with a probability of at most ``LOSS``."""
    fits = [r for r in range(1, SLOTS + 1) if SLOTS % r == 0 and (1 - float(least) ** r) ** (SLOTS // r) <= LOSS]
    rows = max(fits, default=1)
    return SLOTS // rows, rows


def fewest_equal(least: Fraction) -> int:
    """The number of equal slots that a link at the similarity falls short of with a probability of at most ``LOSS / 10``."""
    p, below = float(least), 0.0
    for k in range(SLOTS):
        below += comb(SLOTS, k) * p**k * (1 - p) ** (SLOTS - k)
        if below > LOSS / 10:
            return k
    return SLOTS


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return np.unique(window_hashes(h, min(size, len(words))))


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures [set, slot] of sets of 64-bit values, as 32-bit hashes of the winning (rank, u).

    All sets advance together, one permutation step at a time; a set leaves when
    its largest slot value is below the step (early stopping).
    """
    n = len(sets)
    best = np.full((n, slots), np.inf)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    perm: np.ndarray | None = None
    open_ = np.array([len(s) > 0 for s in sets], bool)
    for k in range(slots):
        if not open_.any():
            break
        if k == 1:  # most long sets are done; only the rest need their permutations
            keep = open_[owner]
            owner, values, first = owner[keep], values[keep], slot[keep]
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(values), 1))
            rows = np.arange(len(values))
            perm[rows, first], perm[:, 0] = perm[:, 0].copy(), first
        elif k > 1:
            keep = open_[owner]
            if not keep.all():
                owner, values, perm = owner[keep], values[keep], perm[keep]
                rows = np.arange(len(values))
        r = mix(values + np.uint64((k + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        u = (r >> np.uint64(32)).astype(np.float64) / 4294967296.0
        pick = k + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(slots - k) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = pick
        else:
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, k]
            perm[:, k] = slot
        np.minimum.at(best.reshape(-1), owner * slots + slot, k + u)
        open_ &= best.max(axis=1) > k + 1
    return (mix(best.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _sketch(size: int):
    """A text's number of shingles, their set's hash and signature (null without words); equal sets of a slice are signed once."""
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("signature", pa.binary())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):  # bounds the permutation matrix
                b = batch.slice(at, 128)
                own = [shingles((t.as_py() or "").encode(), size) for t in b.column("text")]
                hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in own]
                sets = {h: s for h, s in zip(hashes, own, strict=True) if h}
                signed = dict(zip(sets, map(np.ndarray.tobytes, superminhash(list(sets.values()))), strict=True))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": b.column("doc_id"), "n_shingles": [len(s) for s in own], "set_hash": hashes, "signature": [signed.get(h) for h in hashes]}, schema=out
                )

    return run


def _bands(bands: int, rows: int):
    """(band key, doc_id) for each band of each signature."""
    out = pa.schema([("key", pa.int64()), ("doc_id", pa.int64())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(-1, bands, rows).astype(np.uint64)
            key = np.zeros(sig.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                key = mix(key ^ sig[:, :, r]) + np.uint64(r)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).reshape(-1)), pa.array(np.repeat(b.column("doc_id").to_numpy(), bands))], schema=out)

    return run


def _candidates(least: Fraction):
    """Block pairs to a forest of the pairs whose sizes and signatures allow the similarity."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    ratio, low = float(least), fewest_equal(least)

    def matrix(side):
        ids = np.array([x["doc_id"] for x in side], np.int64)
        n = np.array([x["n_shingles"] for x in side], np.int64)
        return ids, n, np.frombuffer(b"".join(x["signature"] for x in side), np.uint32).reshape(len(side), SLOTS)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n, sig = matrix(batch.column("left")[i].as_py())
                apart = batch.column("right")[i].is_valid
                n_left = len(ids)
                if apart:
                    more = matrix(batch.column("right")[i].as_py())
                    ids, n, sig = (np.concatenate(x) for x in zip((ids, n, sig), more, strict=True))
                forest, found = Forest(len(ids)), []
                for k in range(n_left):
                    at = np.arange(n_left if apart else k + 1, len(ids))
                    at = at[(forest.label[at] != forest.label[k]) & (np.minimum(n[k], n[at]) >= ratio * np.maximum(n[k], n[at]) - 1e-9)]
                    if len(at):
                        at = at[(sig[at] == sig[k]).sum(1) >= low]
                    if len(at):
                        found += [(ids[k], ids[x]) for x in forest.join(k, at)]
                if found:
                    yield pa.RecordBatch.from_pydict({"a": [min(x) for x in found], "b": [max(x) for x in found]}, schema=out)

    return run


def _verified(least: Fraction):
    """Block pairs to a forest of the pairs whose full sets reach the similarity."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def common(sets: list[np.ndarray]) -> np.ndarray:
        """Sizes of all intersections: a product of the incidence matrix with itself, in slices of shingles."""
        own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = held[column] > 1
        own, column = own[keep], column[keep]
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        own, column = own[order], column[order]
        total, width = np.zeros((len(sets), len(sets)), np.float64), 8192
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, (start, start + width))
            part = np.zeros((len(sets), width), np.float32)
            part[own[lo:hi], column[lo:hi] - start] = 1
            total += part @ part.T
        return total.astype(np.int64)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                side = batch.column("left")[i].as_py()
                apart = batch.column("right")[i].is_valid
                n_left = len(side)
                side += batch.column("right")[i].as_py() if apart else []
                if len(side) < 2 or n_left == 0 or (apart and n_left == len(side)):
                    continue
                sets = [np.frombuffer(x["shingles"], np.uint64) for x in side]
                size = np.array([len(s) for s in sets])
                both = common(sets) if len(sets) > 2 else np.full((2, 2), len(np.intersect1d(*sets, assume_unique=True)))
                linked = least.denominator * both >= least.numerator * (size[:, None] + size[None, :] - both)
                forest, found = Forest(len(side)), []
                for k in range(n_left):
                    at = np.arange(n_left if apart else k + 1, len(side))
                    at = at[linked[k, at] & (forest.label[at] != forest.label[k])]
                    if len(at):
                        found += [(side[k]["doc_id"], side[x]["doc_id"]) for x in forest.join(k, at)]
                if found:
                    yield pa.RecordBatch.from_pydict({"a": [min(x) for x in found], "b": [max(x) for x in found]}, schema=out)

    return run


def _sets(size: int):
    out = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "shingles": [shingles((t.as_py() or "").encode(), size).tobytes() for t in b.column("text")]}, schema=out)

    return run


def _forest(batches):
    """Union-find over the links of one task: (node, root) of every node that isn't its root."""
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
    nodes = [(x, find(x)) for x in parent]
    nodes = [x for x in nodes if x[0] != x[1]]
    yield pa.RecordBatch.from_pydict({"a": [x[1] for x in nodes], "b": [x[0] for x in nodes]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def few(df: DataFrame) -> bool:
    """Are the rows of a written table few enough for one task?"""
    return df.count() <= FEW


def components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """(node, component) of all nodes of links (a, b); the component is its smallest node.

    Each round: large-star gives every node's larger neighbours the smallest
    neighbour; small-star does so for its smaller ones; then tasks contract what
    they hold.  The loop ends when links are stars (each a root's own), or when
    one task can contract all that is left, whose trees are stars then.
    """
    ddl = "a long, b long"
    edges = scratch.save(links.select("a", "b").where("a <> b").mapInArrow(_forest, ddl), f"{name}-0")
    k = 0
    while True:
        if few(edges):
            return edges.coalesce(1).mapInArrow(_forest, ddl).select(F.col("b").alias("node"), F.col("a").alias("component"))
        # a star forest: no root is also a leaf and no leaf has two roots
        tangled = edges.groupBy("b").agg(F.min("a").alias("a"), F.max("a").alias("z")).select(F.col("b").alias("node"), (F.col("a") != F.col("z")).cast("int").alias("x")).unionByName(
            edges.select(F.col("a").alias("node")).distinct().withColumn("x", F.lit(0))
        ).groupBy("node").agg(F.max("x").alias("x"), F.count("*").alias("n")).where("x = 1 OR n > 1").limit(1).count()
        if not tangled:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).distinct()
        k += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(F.col("a").alias("u"), "m")
        least = scratch.save(least, f"{name}-{k}-large-min")
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = scratch.save(large, f"{name}-{k}-large")
        small_min = scratch.save(large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m"), f"{name}-{k}-small-min")
        small = large.join(small_min, F.col("b") == F.col("u")).select("m", "a", "b")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        edges = scratch.save(small.mapInArrow(_forest, ddl), f"{name}-{k}")


def near_links(docs: DataFrame, scratch: Scratch, least: Fraction, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(folded, links): doc_id, n_shingles, representative of all; verified links (a, b) between representatives.

    ``doc_id`` must be neither null nor repeated.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = scratch.save(docs.mapInArrow(_sketch(size), "doc_id long, n_shingles long, set_hash binary, signature binary"), "sketch")
    first = sketch.where("set_hash IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    first = scratch.save(first.select("set_hash", "rep"), "first")
    folded = sketch.join(first, "set_hash", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    copies = scratch.save(folded, "folded")
    signed = sketch.where("set_hash IS NOT NULL").select("doc_id", "n_shingles", "signature")
    reps = signed.join(copies.where("doc_id <> rep").select("doc_id"), "doc_id", "left_anti")
    keys = scratch.save(reps.select("doc_id", "signature").mapInArrow(_bands(*banding(least)), "key long, doc_id long"), "keys")
    shared = scratch.save(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    member = scratch.save(keys.join(shared, "key").join(signed, "doc_id"), "member")
    hints = scratch.save(block_pairs(member, ["n_shingles", "signature"], _candidates(least), "a long, b long", BLOCK), "hints")
    return copies, verify(docs, hints, scratch, least, size)


def grouped(hints: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(key, n, doc_id) of the clusters that hints (a, b) connect, n being the cluster's size."""
    leaves = scratch.save(components(hints, scratch, f"{name}-forest").select(F.col("component").alias("key"), F.col("node").alias("doc_id")), f"{name}-leaves")
    if few(leaves):
        leaves = leaves.coalesce(1)  # no shuffle of a handful of rows
    sizes = leaves.groupBy("key").agg((F.count("*") + 1).alias("n"))
    roots = sizes.select("key", "n", F.col("key").alias("doc_id"))
    return scratch.save(leaves.join(sizes, "key").select("key", "n", "doc_id").unionByName(roots), f"{name}-groups")


def verify(docs: DataFrame, hints: DataFrame, scratch: Scratch, least: Fraction, size: int) -> DataFrame:
    """Links between documents of a cluster whose full shingle sets reach the similarity, as a forest.

    A cluster connects all candidates, so each link lies within one; every
    document's set is sent once for each block of its cluster.
    """
    groups = grouped(hints, scratch, "hint")
    sets = docs.join(groups.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id long, shingles binary")
    return scratch.save(block_pairs(groups.join(sets, "doc_id"), ["shingles"], _verified(least), "a long, b long", SET_BLOCK), "verified")


def near_dedup(docs: DataFrame, scratch: Scratch, least: Fraction = Fraction(4, 5), size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row, by links of at least the similarity."""
    docs, renumbered = keyed(docs.select("doc_id", "text"), scratch)
    folded, links = near_links(docs, scratch, least, size)
    joined = scratch.save(components(links, scratch), "components")
    out = folded.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if not renumbered:
        return out
    given = docs.select(F.col("doc_id").alias("component_id"), F.col(GIVEN).alias("component"))
    out = out.join(docs.select("doc_id", GIVEN), "doc_id").join(given, "component_id")
    return out.select(F.col(GIVEN).alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with Scratch(spark) as s:
        return s.keep(near_dedup(docs, s, Fraction(85, 100)))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
s AS MATERIALIZED (SELECT doc_id, gram FROM g),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, seen) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT doc_id, min(seen) AS lowest FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(m.lowest, t.doc_id)) AS component_id,
  t.doc_id <= coalesce(m.lowest, t.doc_id) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
