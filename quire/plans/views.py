"""Deterministic relations over the driver's tables, and the same in DuckDB SQL.

The tables hold no page layouts, so detections, cells and token streams are
derived from ids by integer arithmetic that both engines do alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import table

PER_PAGE = 40
DET_LABELS = ("ocr_text", "text", "ocr_text", "paragraph_title", "ocr_text", "table", "ocr_text", "figure_title", "image", "ocr_text", "header", "text", "ocr_text", "vision_footnote", "inline_formula", "display_formula", "ocr_text", "number", "chart", "ocr_text", "doc_title", "formula_number")

DETS_SQL = f"""
SELECT event_id // {PER_PAGE} AS page_id, event_id % {PER_PAGE} AS det_pos,
  [{", ".join(f"'{x}'" for x in DET_LABELS)}][(event_id * 7 % {len(DET_LABELS)})::INT + 1] AS label, label = 'ocr_text' AS ocr,
  (CASE WHEN ocr THEN 110 + event_id * 37 % 1300 ELSE 100 + event_id % 2 * 760 + event_id * 37 % 20 END)::DOUBLE AS bx0,
  (CASE WHEN ocr THEN event_id * 71 % 2000 ELSE det_pos // 4 * 210 + event_id * 29 % 15 END)::DOUBLE AS by0,
  bx0 + CASE WHEN ocr THEN 4 + event_id * 53 % 160 ELSE 640 + event_id % 60 END AS bx1, by0 + CASE WHEN ocr THEN 4 + event_id * 29 % 40 ELSE 150 + event_id * 53 % 50 END AS by1,
  1700 AS width, 612 AS page_w, (event_id * 13 % 100) / 100.0::DOUBLE AS score, 'w' || (event_id % 97) AS text
FROM events"""


def dets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: page_id, det_pos, label, a box in pixels, page sizes, score and text."""
    e = F.col("event_id")
    d = lambda c: c.cast("double")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.expr(f"event_id div {PER_PAGE}").alias("page_id"), (e % PER_PAGE).alias("det_pos"), F.get(F.array(*map(F.lit, DET_LABELS)), (e * 7 % len(DET_LABELS)).cast("int")).alias("label")
    )
    ocr = F.col("label") == "ocr_text"
    rows = rows.withColumns(
        {
            "bx0": d(F.when(ocr, 110 + e * 37 % 1300).otherwise(100 + e % 2 * 760 + e * 37 % 20)),
            "by0": d(F.when(ocr, e * 71 % 2000).otherwise(F.expr("det_pos div 4") * 210 + e * 29 % 15)),
        }
    )
    return rows.select(
        "page_id", "det_pos", "label", "bx0", "by0",
        (F.col("bx0") + F.when(ocr, 4 + e * 53 % 160).otherwise(640 + e % 60)).alias("bx1"), (F.col("by0") + F.when(ocr, 4 + e * 29 % 40).otherwise(150 + e * 53 % 50)).alias("by1"),
        F.lit(1700).alias("width"), F.lit(612).alias("page_w"), (d(e * 13 % 100) / 100).alias("score"), F.concat(F.lit("w"), (e % 97).cast("string")).alias("text"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines: doc_id, line_no, line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES_SQL = "SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)"


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a page tree: three lines a block, every fifth block a title, commas part spans,
    every fourth span of a line an inline equation."""
    text = F.col("text")
    span = lambda s, k: F.struct(
        F.when(k % 4 == 3, "inline_equation").otherwise("text").alias("type"), s.alias("content"), F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("string").alias("html"),
        F.lit(None).cast("array<double>").alias("bbox"),
    )
    line = lambda x: F.struct(F.lit(None).cast("array<double>").alias("bbox"), F.transform(F.split(x, ","), span).alias("spans"))
    child = "array<struct<type:string,index:double,bbox:array<double>,lines:array<struct<bbox:array<double>,spans:array<struct<type:string,content:string,image_path:string,html:string,bbox:array<double>>>>>>>"
    block = lambda ls: lambda b: F.struct(
        F.when(b % 5 == 0, "title").when(b % 7 == 6, "header").otherwise("text").alias("type"), F.lit(None).cast("string").alias("sub_type"), F.lit(None).cast("string").alias("guess_lang"),
        (b % 6).cast("int").alias("level"), b.cast("double").alias("index"), F.array(F.lit(10.0), b.cast("double"), F.lit(300.0), b + F.lit(9.5)).alias("bbox"),
        F.transform(F.slice(ls, b * 3 + 1, F.lit(3)), line).alias("lines"), F.lit(None).cast(child).alias("blocks"),
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split(text, "\n").alias("ls"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / 3).cast("int")), block(F.col("ls")))
    out = rows.select("doc_id", blocks.alias("bs"))
    hidden = F.col("bs")
    return out.select(
        "doc_id",
        F.array(
            F.struct(
                F.lit(0).alias("page_idx"), F.array(F.lit(612.0), F.lit(792.0)).alias("page_size"),
                F.filter(hidden, lambda b: b["type"] != "header").alias("para_blocks"), F.filter(hidden, lambda b: b["type"] == "header").alias("discarded_blocks"),
            )
        ).alias("pdf_info"),
    )


#: Block texts of the page tree by relations instead of nested expressions.
BLOCKS_SQL = rf"""
ln AS ({LINES_SQL}),
bl AS (SELECT doc_id, line_no // 3 AS b, line_no % 3 AS i, line FROM ln),
sp AS (SELECT doc_id, b, i, j - 1 AS j, len(p) AS n, CASE WHEN (j - 1) % 4 = 3 THEN 'inline_equation' ELSE 'text' END AS kind, p[j] AS content
       FROM (SELECT *, string_split(line, ',') AS p FROM bl), unnest(range(1, len(p) + 1)) AS t(j)),
nx AS (SELECT *, regexp_matches(coalesce(first_value(content) OVER w, ''), '^[a-z]') AS lower_here,
         trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM sp
       WINDOW w AS (PARTITION BY doc_id, b, i ORDER BY j)),
fl AS (SELECT *, coalesce(max(bare <> '') OVER (PARTITION BY doc_id, b ORDER BY i, j ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS more,
         coalesce((SELECT any_value(y.lower_here) FROM nx y WHERE y.doc_id = x.doc_id AND y.b = x.b AND y.i = x.i + 1), false) AS lower_next FROM nx x),
pc AS (SELECT *, CASE WHEN kind = 'text' THEN trim(regexp_replace(content, '([*_`~$])', '\\\1', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE '$' || content || '$' END AS c FROM fl),
jo AS (SELECT doc_id, b, coalesce(string_agg(CASE WHEN kind = 'text' AND j = n - 1 AND regexp_matches(c, '[A-Za-z][-\x{{AD}}\x{{2010}}\x{{2011}}\x{{2043}}]$') THEN
           CASE WHEN lower_next THEN left(c, length(c) - 1) ELSE c END WHEN more THEN c || ' ' ELSE c END, '' ORDER BY i, j) FILTER (WHERE c <> ''), '') AS body FROM pc GROUP BY doc_id, b),
bk AS (SELECT doc_id, b, CASE WHEN b % 5 = 0 THEN 'title' WHEN b % 7 = 6 THEN 'header' ELSE 'text' END AS kind, least(b % 6, 4)::INT AS level, body FROM jo),
tx AS (SELECT *, CASE WHEN kind = 'text' AND regexp_matches(body, '^[ \t]{{0,3}}(#{{1,6}}|[+-])[ \t]') THEN regexp_replace(body, '^([ \t]*)', '\1\\') ELSE body END AS text FROM bk)
"""
