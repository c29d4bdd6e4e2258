"""Queries that render documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import render
from quire.plans import views
from quire.plans.registry import query

_MD = f"""
WITH {views.BLOCKS_SQL},
md AS (SELECT doc_id, b, trim(CASE WHEN kind = 'title' THEN repeat('#', level) || ' ' || text ELSE text END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS md FROM tx WHERE kind <> 'header')
SELECT d.doc_id, coalesce(m.markdown, '') AS markdown FROM documents d
LEFT JOIN (SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY b) FILTER (WHERE md <> '') AS markdown FROM md GROUP BY doc_id) m USING (doc_id)
"""


@query("doc_markdown", _MD)
def doc_markdown(spark, sf_dir):
    return views.page_tree(spark, sf_dir).select("doc_id", render.markdown(F.col("pdf_info")).alias("markdown"))


@query("doc_nlp_markdown", _MD)
def doc_nlp_markdown(spark, sf_dir):
    return views.page_tree(spark, sf_dir).select("doc_id", render.markdown(F.col("pdf_info"), "nlp").alias("markdown"))


@query(
    "doc_block_texts",
    f"WITH {views.BLOCKS_SQL} SELECT doc_id, b::INT AS index, kind AS type, CASE WHEN kind = 'title' THEN level END AS level, text FROM tx",
)
def doc_block_texts(spark, sf_dir):
    rows = render.explode_blocks(views.page_tree(spark, sf_dir))
    b = F.col("block")
    return rows.select("doc_id", b["index"].cast("int").alias("index"), b["type"].alias("type"), F.when(b["type"] == "title", F.least(b["level"], F.lit(4))).alias("level"), render.inline_text(b).alias("text"))


@query(
    "doc_content_list",
    f"""WITH {views.BLOCKS_SQL}, e AS (SELECT doc_id, kind = 'header' AS late, b, '{{"bbox":[16,' || (b * 1000 // 792) || ',490,' || trunc((b + 9.5) * 1000 / 792)::INT || '],"page_idx":0,"text":' || to_json(text)::VARCHAR
      || CASE WHEN kind = 'title' AND level <> 0 THEN ',"text_level":' || level ELSE '' END || ',"type":"' || CASE WHEN kind = 'title' THEN 'text' ELSE kind END || '"}}' AS j FROM tx)
    SELECT doc_id, '[' || string_agg(j, ',' ORDER BY late, b) || ']' AS content_list FROM e GROUP BY doc_id""",
)
def doc_content_list(spark, sf_dir):
    return views.page_tree(spark, sf_dir).select("doc_id", render.content_list(F.col("pdf_info")).alias("content_list"))


_OBJECT = """'{"content":' || to_json(content)::VARCHAR || ',"type":"' || kind || '"}'"""


@query(
    "doc_content_list_v2",
    rf"""WITH {views.BLOCKS_SQL},
    v0 AS (SELECT doc_id, b, i, j, kind, CASE WHEN kind = 'inline_equation' THEN content WHEN j = n - 1 AND regexp_matches(content, '[A-Za-z][-\x{{AD}}\x{{2010}}\x{{2011}}\x{{2043}}]\s*$')
        THEN CASE WHEN lower_next THEN left(content, length(content) - 1) ELSE content END WHEN more THEN content || ' ' ELSE content END AS c FROM fl WHERE bare <> ''),
    v1 AS (SELECT *, sum(CASE WHEN kind = 'text' AND lag(kind) OVER w = 'text' THEN 0 ELSE 1 END) OVER w AS run FROM (SELECT *, lag(kind) OVER w AS pk FROM v0 WINDOW w AS (PARTITION BY doc_id, b ORDER BY i, j)) WINDOW w AS (PARTITION BY doc_id, b ORDER BY i, j)),
    v2 AS (SELECT doc_id, b, run, CASE WHEN kind = 'text' THEN kind ELSE 'equation_inline' END AS kind, string_agg(c, '' ORDER BY i, j) AS content FROM v1 GROUP BY ALL),
    v3 AS (SELECT doc_id, b, '[' || string_agg({_OBJECT}, ',' ORDER BY run) || ']' AS spans FROM v2 GROUP BY ALL),
    e AS (SELECT doc_id, bk.kind = 'header' AS late, b, '{{"bbox":[16,' || (b * 1000 // 792) || ',490,' || trunc((b + 9.5) * 1000 / 792)::INT || '],"content":{{' || CASE WHEN bk.kind = 'title' AND level > 0 THEN '"level":' || level || ',"title_content":'
        WHEN bk.kind = 'header' THEN '"page_header_content":' ELSE '"paragraph_content":' END || coalesce(spans, '[]') || '}},"type":"' || CASE WHEN bk.kind = 'title' AND level > 0 THEN 'title' WHEN bk.kind = 'header' THEN 'page_header' ELSE 'paragraph' END || '"}}' AS j
      FROM bk LEFT JOIN v3 USING (doc_id, b))
    SELECT doc_id, '[[' || string_agg(j, ',' ORDER BY late, b) || ']]' AS content_list FROM e GROUP BY doc_id""".replace("lag(kind) OVER w = 'text'", "pk = 'text'"),
)
def doc_content_list_v2(spark, sf_dir):
    return views.page_tree(spark, sf_dir).select("doc_id", render.content_list_v2(F.col("pdf_info")).alias("content_list"))
