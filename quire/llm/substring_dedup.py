"""Substring dedup by difference-cover anchors.

A window is ``window`` (35) consecutive words.  ``COVER`` is a difference cover
modulo ``PERIOD``: for any two positions i and j some shift below the period takes
both to cover positions.  Short anchors (window - period + 1 words) are hashed at
cover positions only, so two equal windows always share an aligned anchor.

1. Anchors that occur twice or more are found by their hashes (5 of 21 positions).
2. Around a repeated anchor every window that holds it is hashed in full (96
   bits): the extension of the match, which needs no pairs of positions.
3. Windows that occur twice or more cover the words to remove.

Defined cases: null and empty texts have no words; texts under 35 words lose
nothing; a text held by two documents is removed from both, as windows are judged
on the input; overlapping repeats inside a document count; rows with a null or
repeated id are documents of their own (``substring_dedup`` numbers them for its
joins); other columns pass by.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.ids import GIVEN, keyed
from quire.llm.repeats import repeated
from quire.llm.words import mix, window_hashes, word_hashes
from quire.session import Scratch, ship, table

QUERY = "op9_substring_dedup"

WINDOW = 35
PERIOD = 21
#: A perfect difference set modulo 21: every residue is a difference of two members.
COVER = (0, 1, 4, 14, 16)
_SECOND = np.uint64(0xA24BAED4963EE407)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _anchors(window: int):
    size = window - PERIOD + 1
    cover = np.array(COVER)

    def rows(batch):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            words = _words(text.as_py())
            n = len(words) - size + 1
            if len(words) < window:
                continue
            at = (np.arange(0, n, PERIOD)[:, None] + cover).reshape(-1)
            at = at[at < n]
            k = window_hashes(word_hashes(words), size, at)
            yield doc_id, k, np.zeros(len(k), np.uint64), at

    return rows


def unpack(lists) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(lists), np.int32)) if lists else np.empty(0, np.int32)


def _windows(window: int):
    def rows(batch):
        for doc_id, text, anchors, copy in zip(*(batch.column(c) for c in ("doc_id", "text", "positions", "copy")), strict=True):
            at = unpack(anchors.as_py())
            if not len(at) or copy.as_py() == 2:
                continue
            words = _words(text.as_py())
            n = len(words) - window + 1
            mark = np.zeros(len(words) + 1, np.int64)
            np.add.at(mark, np.maximum(at - PERIOD + 1, 0), 1)
            np.add.at(mark, at + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark)[:n] > 0)
            h = word_hashes(words)
            yield doc_id.as_py(), window_hashes(h, window, starts), window_hashes(mix(h ^ _SECOND), window, starts), starts

    return rows


def copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, copy) of documents whose text another one has too: 1 for the first of equal texts, 2 for others."""
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("text_hash")).where("text_hash IS NOT NULL")
    groups = scratch.save(hashed.groupBy("text_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("text_hash", "first"), "copies")
    return hashed.join(groups, "text_hash").select("doc_id", F.when(F.col("doc_id") == F.col("first"), 1).otherwise(2).alias("copy"))


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(doc_id, positions, copy): the starts of windows whose words also start elsewhere.

    ``doc_id`` must be neither null nor repeated.
    All windows of a text held twice repeat (copy > 0), so only the first of equal
    texts is hashed further, for the sake of the others.
    """
    if window <= PERIOD:
        raise ValueError(f"windows must be longer than the period {PERIOD}")
    ship(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = copies(docs, scratch).select("doc_id", F.lit(None).cast("binary").alias("positions"), "copy")
    gather = lambda found: found.withColumn("copy", F.lit(0)).unionByName(marks).groupBy("doc_id").agg(F.collect_list("positions").alias("positions"), F.max("copy").alias("copy"))
    anchors = gather(repeated(docs, _anchors(window), parts, 6))
    # A left join, like the one that cuts the texts: both then read one exchange of the texts
    return gather(repeated(docs.join(anchors, "doc_id", "left"), _windows(window), parts, 12))


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at ``starts``."""
    mark = np.zeros(n + 1, np.int64)
    mark[starts] += 1
    np.add.at(mark, np.minimum(starts + window, n), -1)
    return np.cumsum(mark)[:n] > 0


def _cut(window: int, digest: bool):
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for text, positions, copy in zip(b.column("text"), b.column("positions"), b.column("copy"), strict=True):
                raw = text.as_py()
                words = _words(raw)
                starts = unpack(positions.as_py()) if not copy.as_py() else np.arange(max(0, len(words) - window + 1))
                if len(starts):
                    gone = covered(len(words), starts, window)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    kept = words
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest() if digest else joined.decode() if len(starts) else raw))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], schema=out)

    return run


def substring_dedup(docs: DataFrame, scratch: Scratch, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space, or their SHA-256.

    A text that loses nothing stays as it is, white space included.
    """
    rows, renumbered = keyed(docs.select("doc_id", "text"), scratch)
    docs = rows.select("doc_id", "text")
    found = repeated_windows(docs, scratch, window)
    out = docs.join(found, "doc_id", "left").mapInArrow(_cut(window, digest), "doc_id long, n_words long, n_removed long, kept string")
    if not renumbered:
        return out
    return out.join(rows.select("doc_id", GIVEN), "doc_id").select(F.col(GIVEN).alias("doc_id"), "n_words", "n_removed", "kept")


def without(docs: DataFrame, starts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the words under the windows of ``starts`` (doc_id, positions) taken out of the text."""
    at = docs.schema.fieldNames().index("text")

    def run(batches):
        cut = _cut(window, False)
        for b in batches:
            kept = next(cut([b])).column("kept")
            yield pa.RecordBatch.from_arrays([kept if i == at else c for i, c in enumerate(b.columns[:-2])], names=b.schema.names[:-2])

    joined = docs.join(starts.select("doc_id", "positions", "copy"), "doc_id", "left").select(*docs.columns, "positions", "copy")
    return joined.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with Scratch(spark) as s:
        return s.keep(substring_dedup(docs, s, digest=True).withColumnRenamed("kept", "kept_sha256"))


ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t)),
d AS (SELECT win FROM g GROUP BY win HAVING count(*) > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS pos FROM g JOIN d USING (win)),
a AS (SELECT doc_id, pos, w[pos] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM t)),
k AS (SELECT a.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY a.pos) AS kept FROM a ANTI JOIN p ON a.doc_id = p.doc_id AND a.pos = p.pos GROUP BY a.doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""
