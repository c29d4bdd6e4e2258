"""Rows as documents of their own, whatever their ids.

Operators that gather by id need a key that is neither null nor repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import Scratch

GIVEN = "__given_id"


def keyed(df: DataFrame, scratch: Scratch, key: str = "doc_id") -> tuple[DataFrame, bool]:
    """``df`` with the id it had in ``__given_id`` and a ``key`` that only one row has; was it renumbered?

    Ids that are neither null nor repeated stay.  Otherwise rows are numbered in the
    order of ids, nulls last, rows of one id in any order.  The numbered rows are a
    checkpoint, as a number must not change between jobs; rows of one id are spread
    over the sort's partitions.
    """
    df = df.withColumn(key, F.col(f"`{key}`").cast("long")).withColumn(GIVEN, F.col(f"`{key}`"))
    odd = df.select(F.col(f"`{key}`").alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("id IS NULL OR n > 1")
    if not odd.limit(1).count():
        return df, False
    numbered = df.withColumn("__row", F.monotonically_increasing_id()).orderBy(F.col(GIVEN).asc_nulls_last(), "__row")
    return scratch.keep(numbered.withColumn(key, F.monotonically_increasing_id()).drop("__row")), True
