"""Streams of documents: files of one JSON document each are rendered as they come.

A document is a row, so rendering keeps no state; window counts of arrivals use a
watermark, and late rows beyond it are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import render
from quire.sources.files import parse_documents


def read_documents(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, value): whole JSON files of a folder."""
    return (
        spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(path).select(F.col("_metadata.file_path").alias("path"), "value")
    )


def render_stream(docs: DataFrame, mode: str = "mm") -> DataFrame:
    parsed = parse_documents(docs, "value")
    return parsed.select("path", render.markdown(F.col("document.pdf_info"), mode).alias("markdown"))


def arrivals(events: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events a window, by type."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
