"""Decoding and ordering of detector and recogniser outputs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.geom import overlaps_y


def merge_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Unions of x-intervals that touch or overlap: keys, x0, x1, n."""
    order = W.partitionBy(*keys).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.when(reach.isNull() | (reach < F.col("x0")), 1).otherwise(0))
    rows = rows.withColumn("__run", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n")).drop("__run")


def is_skewed(height: Column, left: Column) -> Column:
    """A quad whose left side isn't within 20 % of its height."""
    return ~((left >= 0.8 * height) & (left <= 1.2 * height))


def wide_lines(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of upright spans; where a line is over four times as wide as high, its x-intervals are merged.

    Spans with a true ``skewed`` column, if there is one, take no part and come last, without a line number.
    """
    if "skewed" in spans.columns:
        bent = F.coalesce("skewed", F.lit(False))
        aside = spans.where(bent).select(*keys, F.lit(None).cast("long").alias("line_no"), "x0", "y0", "x1", "y1", F.lit(1).cast("long").alias("n"))
        return wide_lines(spans.where(~bent).drop("skewed"), keys).unionByName(aside)
    order = W.partitionBy(*keys).orderBy("y0", "det_pos")
    before = lambda c: F.lag(c).over(order)
    rows = spans.withColumn("__new", F.when(before("y0").isNull() | ~overlaps_y(F.col("y0"), F.col("y1"), before("y0"), before("y1")), 1).otherwise(0))
    rows = rows.withColumn("line_no", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("__new")
    box = rows.groupBy(*keys, "line_no").agg(F.min("x0").alias("lx0"), F.max("x1").alias("lx1"), F.min("y0").alias("ly0"), F.max("y1").alias("ly1"))
    box = box.withColumn("wide", (F.col("lx1") - F.col("lx0")) > 4 * (F.col("ly1") - F.col("ly0")))
    rows = rows.join(box, [*keys, "line_no"])
    merged = merge_intervals(rows.where("wide"), [*keys, "line_no", "ly0", "ly1"]).select(*keys, "line_no", "x0", F.col("ly0").alias("y0"), "x1", F.col("ly1").alias("y1"), "n")
    return merged.unionByName(rows.where("NOT wide").select(*keys, "line_no", "x0", "y0", "x1", "y1", F.lit(1).cast("long").alias("n")))


def reading_sort(rows: DataFrame, keys: list[str], near: float = 10.0) -> DataFrame:
    """Boxes by (y, x), then each moves left past neighbours of nearly the same height.

    The exchange isn't transitive, so no sort key gives it: a page is one pandas group.
    """
    fields = rows.schema.simpleString()[7:-1] + ",order:int"

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y0", "x0"], kind="stable").reset_index(drop=True)
        ys, xs, at = pdf["y0"].to_numpy(), pdf["x0"].to_numpy(), list(range(len(pdf)))
        for i in range(len(at) - 1):
            j = i
            while j >= 0 and abs(ys[at[j + 1]] - ys[at[j]]) < near and xs[at[j + 1]] < xs[at[j]]:
                at[j], at[j + 1] = at[j + 1], at[j]
                j -= 1
        pdf = pdf.iloc[at].reset_index(drop=True)
        return pdf.assign(order=pd.RangeIndex(len(pdf)).astype("int32"))

    return rows.groupBy(*keys).applyInPandas(page, fields)


def recognition_batches(rows: DataFrame, keys: list[str], size: int = 6) -> DataFrame:
    """Boxes in groups of ``size`` of like aspect; ``batch_aspect`` is the widest of the group."""
    aspect = (F.col("x1") - F.col("x0")).cast("double") / (F.col("y1") - F.col("y0"))
    rows = rows.withColumn("aspect", aspect)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("aspect", "det_pos"))
    rows = rows.withColumn("batch", F.floor((rank - 1) / size).cast("int"))
    return rows.withColumn("batch_aspect", F.max("aspect").over(W.partitionBy(*keys, "batch")))


def ctc_decode(steps: DataFrame, keys: list[str], letters: Column) -> DataFrame:
    """Greedy decoding of (t, cls, p): best class a step, repeats and blanks (0) dropped; mean of kept p."""
    best = steps.groupBy(*keys, "t").agg(F.max_by("cls", F.struct("p", -F.col("cls"))).alias("cls"), F.max("p").alias("p"))
    order = W.partitionBy(*keys).orderBy("t")
    kept = best.withColumn("prev", F.lag("cls").over(order)).withColumn("keep", (F.col("cls") != 0) & (F.col("prev").isNull() | (F.col("cls") != F.col("prev"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("t", letters.alias("c"))))), lambda s: s["c"]), "")
    return kept.groupBy(*keys).agg(text.alias("text"), F.coalesce(F.avg(F.when(F.col("keep"), F.col("p"))), F.lit(0.0)).alias("score"))


def reading_votes(order: DataFrame, keys: list[str]) -> DataFrame:
    """Votes of a query from a matrix of pair logits (i, j, v): sigmoid of those above, its complement below.

    Ranks by the vote, ties by the query, are the reading order.
    """
    up = F.col("i") < F.col("j")
    p = 1 / (1 + F.exp(-F.col("v").cast("double")))
    told = order.where("i <> j").select(*keys, F.when(up, F.col("j")).otherwise(F.col("i")).alias("q_up"), "i", "j", p.alias("p"), up.alias("up")).where("up")
    votes = told.select(*keys, F.col("j").alias("q"), F.col("p").alias("vote")).unionByName(told.select(*keys, F.col("i").alias("q"), (1 - F.col("p")).alias("vote")))
    votes = votes.groupBy(*keys, "q").agg(F.round(F.sum("vote"), 9).alias("vote"))
    return votes.withColumn("order_seq", F.row_number().over(W.partitionBy(*keys).orderBy("vote", "q")) - 1)


def top_scores(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best (q, cls) of each page by sigmoid score, ties by flat position."""
    scores = scores.withColumn("score", 1 / (1 + F.exp(-F.col("v").cast("double"))))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "q", "cls"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def decode_boxes(rows: DataFrame, width: Column, height: Column, least: float = 0.45) -> DataFrame:
    """(cx, cy, w, h) in parts of the page to clipped integer corners, for scores of ``least`` and more."""
    clip = lambda c, top: F.greatest(F.lit(0), F.least(c, top)).cast("int")
    low = lambda c, s, size: F.floor((F.col(c) - F.col(s) / 2) * size)
    high = lambda c, s, size: F.ceil((F.col(c) + F.col(s) / 2) * size)
    return rows.where(F.col("score") >= least).withColumns(
        {
            "x0": clip(low("cx", "w", width), width), "y0": clip(low("cy", "h", height), height),
            "x1": clip(high("cx", "w", width), width), "y1": clip(high("cy", "h", height), height),
        }
    )


def reading_index(kept: DataFrame, keys: list[str]) -> DataFrame:
    return kept.withColumn("index", F.row_number().over(W.partitionBy(*keys).orderBy("order_seq", "rank")))


def confident(lines: DataFrame, least: float = 0.5) -> DataFrame:
    """Lines of a page recognised with a score of ``least`` or more (``filled_text`` asks for more)."""
    return lines.where(F.col("score") >= least)


def filled_text(text: Column, score: Column, least: float = 0.5) -> tuple[Column, Column]:
    """Recognised text and its score to three places, or "" and 0 up to ``least``."""
    good = score > least
    return F.when(good, text).otherwise(""), F.when(good, F.round(score, 3)).otherwise(0.0)
