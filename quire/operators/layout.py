"""From detections to blocks: scaling, splitting, matching, lines and visual parents.

Every join carries the page as its equality key, so a page is a hash partition and
the box predicate only a residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.geom import Box, centre_distance, gap_between, overlaps_y, share, touches
from quire.schema import DISCARDED, LABELS, VISUAL


def fix_axis(dets: DataFrame, scale: Column | None = None) -> DataFrame:
    """Boxes bx0.. in pixels as integer points x0.. (truncated); boxes of a side up to 2 are dropped."""
    scale = F.col("width") / F.col("page_w") if scale is None else scale
    out = dets.withColumns({c: (F.col(f"b{c}") / scale).cast("int") for c in ("x0", "y0", "x1", "y1")})
    return out.where("x1 - x0 > 2 AND y1 - y0 > 2")


def block_type(label: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[label]


def spans_of(fixed: DataFrame) -> DataFrame:
    return fixed.where("label = 'ocr_text'")


def regions_of(fixed: DataFrame) -> DataFrame:
    """Detections of a known label, numbered from 1 in page order."""
    known = fixed.withColumn("type", block_type(F.col("label"))).where("label <> 'ocr_text' AND type IS NOT NULL")
    return known.withColumn("index", F.row_number().over(W.partitionBy("page_id").orderBy("det_pos")))


def title_type(kind: Column) -> Column:
    return F.when(kind.isin("doc_title", "paragraph_title"), "title").when(kind == "vertical_text", "text").otherwise(kind)


def title_level(kind: Column) -> Column:
    return F.when(kind == "doc_title", 1).when(kind == "paragraph_title", 2)


def is_discarded(kind: Column) -> Column:
    return kind.isin(*DISCARDED)


def match_spans(spans: DataFrame, regions: DataFrame, least: float = 0.5) -> DataFrame:
    """Each span with the first region that covers more than ``least`` of it; visual regions take none.

    The first in order that fits is what a loop with a used-flag gives each span.
    """
    takers = regions.where(~F.col("type").isin("interline_equation", *VISUAL)).select("page_id", "index", *(F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")))
    hit = spans.join(takers, "page_id").where(share(Box.of(), Box.of("r_")) > least)
    return hit.groupBy("page_id", "det_pos", "x0", "y0", "x1", "y1", "text", "score").agg(F.min("index").alias("index"))


def span_lines(matched: DataFrame, keys: tuple[str, ...] = ("page_id", "index")) -> DataFrame:
    """Line numbers: a line ends where a span doesn't overlap the one before it by 0.6 of the smaller height."""
    down = W.partitionBy(*keys).orderBy("y0", "det_pos")
    before = lambda c: F.lag(c).over(down)
    breaks = F.when(before("y0").isNull() | ~overlaps_y(F.col("y0"), F.col("y1"), before("y0"), before("y1")), 1).otherwise(0)
    rows = matched.withColumn("__break", breaks).withColumn("__rank", F.row_number().over(down))
    rows = rows.withColumn("line_no", F.sum("__break").over(down.rowsBetween(W.unboundedPreceding, 0)) - 1)
    across = W.partitionBy(*keys, "line_no").orderBy("x0", "__rank")
    return rows.withColumn("span_no", F.row_number().over(across) - 1).drop("__break", "__rank")


def line_boxes(lined: DataFrame, keys: tuple[str, ...] = ("page_id", "index")) -> DataFrame:
    return lined.groupBy(*keys, "line_no").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), " ").alias("text"),
    )


def flow_boxes(lines: DataFrame, keys: tuple[str, ...] = ("page_id", "index")) -> DataFrame:
    """The union of a block's line boxes."""
    return lines.groupBy(*keys).agg(F.min("x0").alias("fs_x0"), F.min("y0").alias("fs_y0"), F.max("x1").alias("fs_x1"), F.max("y1").alias("fs_y1"), F.count("*").alias("n_lines"))


def assemble(dets: DataFrame, scale: Column | None = None) -> DataFrame:
    """Blocks of a page: type, level, box, lines joined, flow box, visual parent, discarded or not."""
    fixed = fix_axis(dets, scale)
    regions = regions_of(fixed)
    lines = line_boxes(span_lines(match_spans(spans_of(fixed), regions)))
    texts = lines.groupBy("page_id", "index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n").alias("text"))
    kind = F.col("type")
    blocks = regions.select("page_id", "index", "type", "x0", "y0", "x1", "y1", "score").join(texts, ["page_id", "index"], "left").join(flow_boxes(lines), ["page_id", "index"], "left")
    blocks = blocks.join(visual_parents(regions).select("page_id", F.col("child").alias("index"), F.col("parent")), ["page_id", "index"], "left")
    flow = lambda c: F.when(title_type(kind) == "text", F.col(c)).alias(c)
    return blocks.select("page_id", "index", title_type(kind).alias("type"), title_level(kind).alias("level"), "x0", "y0", "x1", "y1", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), flow("fs_x0"), flow("fs_y0"), flow("fs_x1"), flow("fs_y1"), "parent", is_discarded(kind).alias("discarded"))


def visual_parents(regions: DataFrame) -> DataFrame:
    """(page_id, child, parent): the table, image or chart that a caption or footnote belongs to.

    A main block is a candidate if no foreign block stands between in reading order,
    unless that one lies outside the gap of both.  Fewest blocks between win (its own
    kind not counted); then, if edge distances spread over 2, the nearest edge; else
    the last of several tables for captions, the first for footnotes, else the
    nearest centre.
    """
    b = regions.select("page_id", "index", "type", "x0", "y0", "x1", "y1")
    side = lambda p: b.select("page_id", *(F.col(c).alias(f"{p}_{c}") for c in ("index", "type", "x0", "y0", "x1", "y1")))
    child = side("c").where("c_type IN ('caption', 'footnote')")
    main = side("m").where(F.col("m_type").isin(*VISUAL))
    pair = child.join(main, "page_id").where("NOT (c_type = 'footnote' AND c_index < m_index)")
    c, m, o = Box.of("c_"), Box.of("m_"), Box.of("o_")
    top = F.when(c.y1 <= m.y0, c.y1).when(m.y1 <= c.y0, m.y1)
    low = F.when(c.y1 <= m.y0, m.y0).when(m.y1 <= c.y0, c.y0)
    between = side("o")
    inside = (F.col("o_index") > F.least("c_index", "m_index")) & (F.col("o_index") < F.greatest("c_index", "m_index"))
    outside = top.isNotNull() & ~(touches(o, c) | touches(o, m)) & ~((o.y0 < low) & (o.y1 > top))
    passes = (F.col("o_type") == "caption") | ((F.col("c_type") == "footnote") & (F.col("o_type") == "footnote"))
    mid = pair.join(between, "page_id").where(inside).groupBy("page_id", "c_index", "m_index").agg(
        F.max((~passes & ~outside).cast("int")).alias("blocked"), F.sum((F.col("o_type") == F.col("c_type")).cast("int")).alias("own")
    )
    pair = pair.join(mid, ["page_id", "c_index", "m_index"], "left").where("coalesce(blocked, 0) = 0")
    pair = pair.withColumn("diff", F.abs(F.col("c_index") - F.col("m_index")) - F.coalesce("own", F.lit(0)))
    of_child = W.partitionBy("page_id", "c_index")
    near = pair.withColumn("least", F.min("diff").over(of_child)).where("diff = least").withColumn("edge", gap_between(c, m)).withColumn("centre", centre_distance(c, m))
    near = near.withColumns(
        {"spread": F.max("edge").over(of_child) - F.min("edge").over(of_child), "tables": F.min((F.col("m_type") == "table").cast("int")).over(of_child)}
    )
    by_last = (F.col("c_type") == "caption") & (F.col("tables") == 1)
    first = F.when(F.col("spread") > 2, F.col("edge")).when(by_last, -F.col("m_index")).when(F.col("c_type") == "footnote", F.col("m_index")).otherwise(F.col("centre"))
    best = near.groupBy("page_id", F.col("c_index").alias("child")).agg(F.min_by("m_index", F.struct(F.round(first.cast("double"), 9), "m_index")).alias("parent"))
    return best


def inside_tables(blocks: DataFrame, least: float = 0.9) -> DataFrame:
    """Blocks without the texts and equations that a table of the page covers by ``least`` or more."""
    tables = blocks.where("type = 'table'").select("page_id", *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")))
    inner = F.col("type").isin("text", "equation", "equation_block")
    covered = (blocks["page_id"] == tables["page_id"]) & (share(Box.of(), Box.of("t_")) >= least)
    return blocks.where(~inner).unionByName(blocks.where(inner).join(tables, covered, "left_anti"))


def page_range(rows: DataFrame, start: int, end: int, pages: DataFrame) -> DataFrame:
    """Pages start to end of each document, both clamped to its pages; a negative end is the last."""
    s = F.greatest(F.least(F.lit(start), F.col("n_pages") - 1), F.lit(0))
    e = F.when(F.lit(end) < 0, F.col("n_pages") - 1).otherwise(F.greatest(F.least(F.lit(end), F.col("n_pages") - 1), s))
    return rows.join(pages.select("doc_id", s.alias("__s"), e.alias("__e")), "doc_id").where("page_idx BETWEEN __s AND __e").drop("__s", "__e")


def first_pages(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` pages of each document; all for 0."""
    return rows.where(F.col("page_idx") < most) if most > 0 else rows


#: Overlay buckets in drawing order with fill colours.
OVERLAY = (
    ("discarded", (158, 158, 158)), ("table_body", (204, 204, 0)), ("table_caption", (255, 255, 102)), ("table_footnote", (229, 255, 204)),
    ("image_body", (153, 255, 51)), ("image_caption", (102, 178, 255)), ("image_footnote", (255, 178, 102)), ("title", (102, 102, 255)),
    ("text", (153, 0, 76)), ("interline_equation", (0, 255, 0)), ("list", (40, 169, 92)), ("index", (40, 169, 92)),
)


def layout_overlay(blocks: DataFrame) -> DataFrame:
    """(page_id, z, rgb, box, number): what a layout overlay draws; numbers follow reading order."""
    parents = blocks.select("page_id", F.col("index").alias("parent"), F.col("type").alias("parent_type"))
    rows = blocks.join(parents, ["page_id", "parent"], "left")
    kind = F.col("type")
    family = F.when(F.col("parent_type") == "table", "table_").otherwise("image_")
    bucket = (
        F.when(F.col("discarded"), "discarded").when(kind.isin("image", "chart"), "image_body").when(kind == "table", "table_body")
        .when(kind.isin("caption", "footnote") & F.col("parent_type").isNotNull(), F.concat(family, kind)).otherwise(kind)
    )
    z = F.create_map(*(F.lit(x) for i, (k, _) in enumerate(OVERLAY) for x in (k, i)))
    rgb = F.create_map(*(F.lit(x) for k, c in OVERLAY for x in (k, "%d,%d,%d" % c)))
    rows = rows.withColumn("bucket", bucket).withColumn("z", z[F.col("bucket")]).where("z IS NOT NULL")
    number = F.when(~F.col("discarded"), F.row_number().over(W.partitionBy("page_id", "discarded").orderBy("index")))
    return rows.select("page_id", "index", "z", rgb[F.col("bucket")].alias("rgb"), "x0", "y0", "x1", "y1", number.alias("number"))


def span_overlay(spans: DataFrame) -> DataFrame:
    """Stroke colour of each span by its type; those of discarded blocks are grey."""
    colour = (
        F.when(F.col("discarded"), "158,158,158").when(F.col("type") == "text", "255,0,0").when(F.col("type") == "inline_equation", "0,255,0")
        .when(F.col("type") == "interline_equation", "0,0,255").when(F.col("type").isin("image", "chart"), "255,204,0").when(F.col("type") == "table", "204,0,255")
    )
    return spans.select("*", colour.alias("rgb")).where("rgb IS NOT NULL")
