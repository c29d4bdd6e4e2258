"""Equation numbers: a fold over each page's blocks in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.latex import formula_tag
from quire.functions.text import is_blank


def tag_formulas(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, index, type, text): numbers become ``\\tag{n}`` of the equation before, else of the one after.

    Runs of numbers after an equation all go to it.  A number before an equation goes
    to it unless another number follows that equation.  Otherwise, and beside blank
    equations, a number becomes text.
    """
    page = W.partitionBy(*keys)
    order = page.orderBy("index")
    is_eq, is_no = F.col("type") == "interline_equation", F.col("type") == "formula_number"
    rows = blocks.withColumns({"__eq": is_eq, "__no": is_no, "__tag": F.when(is_no, formula_tag(F.col("text")))})
    # the last block that isn't a number, at or before; it's the last kept one if numbers between were dropped
    rows = rows.withColumn("__at", F.last(F.when(~F.col("__no"), F.col("index")), True).over(order)).withColumn("__kind", F.last(F.when(~F.col("__no"), F.col("type")), True).over(order))
    rows = rows.withColumn("__full", F.last(F.when(~F.col("__no"), ~is_blank(F.coalesce("text", F.lit("")))), True).over(order))
    ahead = lambda c, k=1: F.lead(c, k).over(order)
    before = F.col("__no") & (F.col("__kind") == "interline_equation") & F.col("__full")
    beside = F.coalesce(F.lag("__eq").over(order), F.lit(False))  # a number beside a blank equation stays as text
    stuck = F.coalesce((F.col("__kind") == "interline_equation") & (F.col("__full") | beside), F.lit(False))
    after = F.col("__no") & ~stuck & F.coalesce(ahead("__eq"), F.lit(False)) & ~F.coalesce(ahead("__no", 2), F.lit(False)) & ~is_blank(F.coalesce(ahead("text"), F.lit("")))
    rows = rows.withColumn("__to", F.when(F.coalesce(before, F.lit(False)), F.col("__at")).when(after, ahead("index")))
    tags = rows.where("__to IS NOT NULL").groupBy(*keys, F.col("__to").alias("index")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("index").alias("i"), F.col("__tag").alias("t")))), lambda x: F.concat(F.lit("\\tag{"), x["t"], F.lit("}"))), "").alias("__tags")
    )
    kept = rows.where("__to IS NULL").join(tags, [*keys, "index"], "left")
    return kept.select(*keys, "index", F.when(F.col("__no"), "text").otherwise(F.col("type")).alias("type"), F.concat(F.coalesce("text", F.lit("")), F.coalesce("__tags", F.lit(""))).alias("text"))
