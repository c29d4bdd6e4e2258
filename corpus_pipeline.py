"""A corpus pipeline: five stages over ``documents``, each an operator of ``quire.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written
as Parquet and read again as the next one's input.  All but the last return the
columns of ``documents``.

A row is a document even if its doc_id is null or another row has it too: stages
that work by id then number the rows in the order of ids, nulls last.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import curve_packing, line_dedup, near_dedup, substring_dedup, toxicity
from quire.llm.ids import GIVEN, keyed
from quire.llm.vocab import vocabulary_path
from quire.session import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def _given(df: DataFrame) -> DataFrame:
    return _columns(df.withColumn("doc_id", F.col(GIVEN)))


def _columns(df: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it now is."""
    return df.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores below 0.5 stay."""
    model = toxicity.fit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.with_score(docs.select(*COLUMNS), model)
    return _columns(scored.where("score < 0.5"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines the first stays."""
    with Scratch(spark) as s:
        docs, _ = keyed(docs.select(*COLUMNS), s)
        classes = s.keep(line_dedup.line_classes(docs, s))
    return _given(line_dedup.apply_classes(docs, classes, (GIVEN, "lang", "source")))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, all without words too."""
    with Scratch(spark) as s:
        docs, _ = keyed(docs.select(*COLUMNS), s)
        kept = s.keep(near_dedup.near_dedup(docs, s, Fraction(4, 5)).where("kept").select("doc_id"))
    return _given(docs.join(kept, "doc_id", "left_semi"))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 35 words that occur more than once go."""
    with Scratch(spark) as s:
        docs, _ = keyed(docs.select(*COLUMNS), s)
        starts = s.keep(substring_dedup.repeated_windows(docs, s))
    return _given(substring_dedup.without(docs, starts))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return curve_packing.curve_packing(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near), ("substring_dedup", drop_passages), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table, each but the last written to the shared folder and read again.

    A stage's input goes once its result is written, as the stages' tables would add up on disk.
    """
    docs, read = table(spark, sf_dir, "documents"), None
    with Scratch(spark) as s:
        for name, stage in STAGES[:-1]:
            docs = s.save(stage(spark, docs, sf_dir), name)
            if read is not None:
                s.drop(read)
            read = name
        return s.keep(STAGES[-1][1](spark, docs, sf_dir))
