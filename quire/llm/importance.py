"""Quality classifier by importance resampling.

Two generative models over hashed word unigrams and bigrams: one of the target
(a bounded sample of the texts labelled good), one of all raw texts.  A text's importance is the log
ratio of its likelihoods; texts are sampled without replacement by adding Gumbel
noise, made from a hash of the id, and taking the top k keys.  The counts of both
models are sums of fixed-size vectors over all rows; the k-th key is found by
counting key digits (radix selection), so nothing is sorted or gathered.

k is the labelled share of good texts times the number of rows, unless given.

Defined cases: null and empty texts have importance 0; without labelled good
rows both models are equal and sampling is uniform; ties of keys go to the
smaller doc_id; repeated ids are sampled each for itself, with equal noise;
``k`` of no rows keeps none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import Scratch, ship, table

QUERY = "op2_importance"
ORACLE_SQL = None

BUCKETS = 1 << 14
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(raw: bytes) -> np.ndarray:
    """Bucket numbers of the hashed unigrams and bigrams of a lower-cased text."""
    import xxhash

    words = raw.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    grams = np.concatenate([h, (h[:-1] * _MIX) ^ (h[1:] >> np.uint64(7))])
    return ((grams * _MIX) >> np.uint64(50)).astype(np.int64)


def _count(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for text, good in zip(b.column("text"), b.column("good").to_pylist(), strict=True):
            f = features((text.as_py() or "").encode())
            for g in {0, 1} if good else {0}:
                if g not in total:
                    total[g] = np.zeros(BUCKETS, np.int64)
                total[g] += np.bincount(f, minlength=BUCKETS)
    for g, v in total.items():
        yield pa.RecordBatch.from_pydict({"model": np.full(BUCKETS, g, np.int32), "bucket": np.arange(BUCKETS, dtype=np.int32), "n": v})


def fit(documents: DataFrame, labels: DataFrame, target_rows: int = 20_000) -> tuple[np.ndarray, float]:
    """Log ratio of target over raw for each bucket, and the share of good texts among labelled ones.

    The raw model counts all texts, the target model at most ``target_rows`` good
    ones, chosen by a hash of the id; their ids are small enough to broadcast.
    """
    ship(documents.sparkSession)
    known = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("good"))
    share = known.agg(F.avg("good")).collect()[0][0]
    target = known.where("good = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)
    joined = documents.select("doc_id", "text").join(F.broadcast(target), "doc_id", "left").select("text", (F.col("good") == 1).alias("good"))
    counts = np.zeros((2, BUCKETS))
    for r in joined.mapInArrow(_count, "model int, bucket int, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n")).collect():  # 2 x BUCKETS rows
        counts[r.model, r.bucket] = r.n
    raw = (counts[0] + 1) / (counts[0].sum() + BUCKETS)
    weight = 5.0 * BUCKETS  # pseudo-counts that pull the target model to the raw one
    target = (counts[1] + weight * raw) / (counts[1].sum() + weight)
    return np.log(target / raw), 1.0 if share is None else float(share)


def importance(df: DataFrame, ratios: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, log_ratio, n_grams) of every row; the ratio is the sum over the text's n-grams."""
    ship(df.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("log_ratio", pa.float64()), ("n_grams", pa.int64())])

    def run(batches):
        for b in batches:
            f = [features((t.as_py() or "").encode()) for t in b.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "log_ratio": [float(ratios[x].sum()) for x in f], "n_grams": [len(x) for x in f]}, schema=out)

    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, log_ratio double, n_grams long")


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as longs of the same order, by their own bits: no two different ones become a tie."""
    bits = (np.where(np.isnan(x), -np.inf, x) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def kth_largest(df: DataFrame, column: str, k: int, bits: int = 16) -> int | None:
    """The k-th largest of a long column, by counting its digits from the highest; None if there are fewer."""
    digits = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    found, left = 0, k
    for shift in range(64 - bits, -1, -bits):
        digit = F.shiftrightunsigned(digits, shift).bitwiseAND((1 << bits) - 1)
        rows = df if shift == 64 - bits else df.where(F.shiftrightunsigned(digits, shift + bits) == found)
        counts = {r.d: r.n for r in rows.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()}  # at most 2 ** bits rows
        for d in sorted(counts, reverse=True):
            if left <= counts[d]:
                found = (found << bits) | d
                break
            left -= counts[d]
        else:
            return None
    return found - (1 << 63)


def gumbel_top_k(df: DataFrame, log_weight: str, k: int, scratch: Scratch, key: str = "doc_id", seed: int = 11) -> DataFrame:
    """``df`` with ``gumbel_key`` and ``kept``: a sample of k rows, without replacement, by weight.

    Of rows with the k-th key those of the smallest ids are kept, of rows with that id those that come
    first: three selections, each by counting, so that a key that many rows share is no hot group.
    """
    ship(df.sparkSession)

    @F.pandas_udf("long")
    def bits(x: pd.Series) -> pd.Series:
        return pd.Series(ordered(x.to_numpy(np.float64, na_value=np.nan)))

    # 53 bits of the hash make a uniform in (0, 1)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = df.withColumn("gumbel_key", F.col(log_weight) - F.log(-F.log(u)))
    keyed = scratch.save(keyed.withColumns({"__order": bits("gumbel_key"), "__row": F.monotonically_increasing_id()}), "keyed")
    # complements turn the smallest into the largest; a null id comes after all others
    ranks = {"__order": F.col("__order"), "__id": F.coalesce(F.bitwise_not(F.col(key).cast("long")), F.lit(-(1 << 63))), "__first": F.bitwise_not("__row")}
    kept, tied, left = F.lit(False), F.lit(True), k
    for name, rank in ranks.items():
        among = keyed.where(tied).select(rank.alias(name))
        cut = kth_largest(among, name, left) if left > 0 else None
        if cut is None:
            kept |= tied & F.lit(left > 0)
            break
        above, same = among.agg(F.count_if(F.col(name) > cut), F.count_if(F.col(name) == cut)).collect()[0]
        left -= above
        kept |= tied & (rank > cut)
        tied &= rank == cut
        if same == left:
            kept |= tied
            break
    return keyed.withColumn("kept", kept).drop("__order", "__row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios, share = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    with Scratch(spark) as s:
        scored = s.save(importance(docs, ratios), "scored")
        return s.keep(gumbel_top_k(scored, "log_ratio", round(share * scored.count()), s))
