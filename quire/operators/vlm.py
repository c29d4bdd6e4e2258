"""Layout text of a vision-language model: parsing, checking and mapping of its blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Block types that the grammar may name, and rotation marks with their angles.
TYPES = (
    "text title table equation formula_number code algorithm aside_text ref_text index phonetic list_item table_caption image_caption code_caption "
    "table_footnote image_footnote header footer page_number page_footnote image chart list image_block equation_block unknown"
).split()
ANGLES = {"<|rotate_up|>": 0, "<|rotate_right|>": 90, "<|rotate_down|>": 180, "<|rotate_left|>": 270}
CONTINUED = "txt_contd_tgt"
_MARK = "|".join(m.replace("|", "\\|") for m in ANGLES)
#: A box, a type, a rotation mark right behind it, and all up to the next box.
BLOCK = r"(?s)<\|box_start\|>" + r"\s+".join([r"(\d+)"] * 4) + rf"<\|box_end\|><\|ref_start\|>(\w+?)<\|ref_end\|>({_MARK})?(.*?)(?=<\|box_start\|>|\z)"


def parse_layout(df: DataFrame, output: str, keys: list[str]) -> DataFrame:
    """One row a valid block: keys, pos, type, x0..y1 in parts of the page, angle, merge_prev."""
    pattern = F.lit(BLOCK)
    found = df.select(*keys, F.posexplode(F.regexp_extract_all(output, pattern, 0)).alias("pos", "m"))
    part = lambda i: F.regexp_extract("m", BLOCK, i)
    n = [part(i).try_cast("int") for i in range(1, 5)]  # a number beyond int is beyond the page as well
    kind, mark, tail = F.lower(part(5)), part(6), part(7)
    rows = found.select(*keys, "pos", *(c.alias(f"n{i}") for i, c in enumerate(n)), F.when(kind == "unknown", "image").otherwise(kind).alias("type"), mark.alias("mark"), tail.alias("tail"))
    rows = rows.where("n0 <= 1000 AND n1 <= 1000 AND n2 <= 1000 AND n3 <= 1000").where(F.col("type").isin(*TYPES) & (F.col("type") != "inline_formula"))
    low, high = lambda a, b: F.least(a, b) / 1000, lambda a, b: F.greatest(a, b) / 1000
    rows = rows.where("n0 <> n2 AND n1 <> n3")
    return rows.select(
        *keys, "pos", "type", low("n0", "n2").alias("x0"), low("n1", "n3").alias("y0"), high("n0", "n2").alias("x1"), high("n1", "n3").alias("y1"),
        angle(F.col("mark")).alias("angle"), ((F.col("type") == "text") & F.contains(F.col("tail"), F.lit(CONTINUED))).alias("merge_prev"),
    )


def angle(mark: Column) -> Column:
    """Degrees of a rotation mark, null without one."""
    return F.create_map(*(F.lit(x) for kv in ANGLES.items() for x in kv))[mark]


#: Types that leave the flow, and the prompt of each type's content (others: text).
DISCARDED = ("header", "footer", "page_number", "aside_text", "page_footnote")
PROMPTS = {"table": "table", "equation": "formula", "image": "image", "chart": "chart"}


def prompt_kind(kind: Column) -> Column:
    out = F.lit("text")
    for k, p in PROMPTS.items():
        out = F.when(kind == k, p).otherwise(out)
    return out


def middle_type(kind: Column) -> Column:
    """Type in the document tree; what has no form of its own is text."""
    return (
        F.when(kind.isin(*DISCARDED), "discarded").when(kind == "equation", "interline_equation").when(kind.isin("title", "table", "image", "chart"), kind).otherwise("text")
    )


def middle_content(kind: Column, content: Column) -> tuple[Column, Column]:
    """(content, html) of a block in the document tree: a table's cell tokens as HTML, or as they are if they give none."""
    from quire.operators.tables import otsl_html

    made = otsl_html(F.trim(content))
    is_table = kind == "table"
    return F.when(~is_table, F.trim(content)), F.when(is_table, F.when(F.coalesce(made, F.lit("")) != "", made).otherwise(content))


def page_points(rows: DataFrame, width: Column, height: Column) -> DataFrame:
    return rows.withColumns({"x0": F.col("x0") * width, "y0": F.col("y0") * height, "x1": F.col("x1") * width, "y1": F.col("y1") * height})
