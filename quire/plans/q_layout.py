"""Queries over detections: scaling, splitting, matching, lines, parents, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout
from quire.plans import views
from quire.plans.registry import query
from quire.schema import DISCARDED, LABELS, VISUAL

_CASE = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"

FIXED = f"""
d AS ({views.DETS_SQL}),
f AS (SELECT * FROM (SELECT page_id, det_pos, label, trunc(bx0 / (width / page_w))::INT AS x0, trunc(by0 / (width / page_w))::INT AS y0,
        trunc(bx1 / (width / page_w))::INT AS x1, trunc(by1 / (width / page_w))::INT AS y1, score, text FROM d) WHERE x1 - x0 > 2 AND y1 - y0 > 2),
s AS (SELECT * FROM f WHERE label = 'ocr_text'),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY det_pos)::INT AS index FROM (SELECT *, {_CASE} AS type FROM f) WHERE label <> 'ocr_text' AND type IS NOT NULL)
"""


def _share(a: str, b: str) -> str:
    return f"greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))::DOUBLE * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)) / (({a}.x1 - {a}.x0)::DOUBLE * ({a}.y1 - {a}.y0))"


MATCHED = f"""{FIXED},
m AS (SELECT s.page_id, s.det_pos, s.x0, s.y0, s.x1, s.y1, s.text, s.score, min(r.index) AS index FROM s JOIN r ON s.page_id = r.page_id
      AND r.type NOT IN ('interline_equation', {", ".join(f"'{x}'" for x in VISUAL)}) AND {_share("s", "r")} > 0.5 GROUP BY ALL)
"""
LINED = f"""{MATCHED},
b0 AS (SELECT *, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, row_number() OVER w AS rk FROM m WINDOW w AS (PARTITION BY page_id, index ORDER BY y0, det_pos)),
b1 AS (SELECT *, CASE WHEN py0 IS NULL OR NOT (least(y1 - y0, py1 - py0) > 0 AND greatest(0, least(y1, py1) - greatest(y0, py0)) > 0.6 * least(y1 - y0, py1 - py0)) THEN 1 ELSE 0 END AS br FROM b0),
b2 AS (SELECT *, (sum(br) OVER (PARTITION BY page_id, index ORDER BY y0, det_pos ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS line_no FROM b1),
ln AS (SELECT *, (row_number() OVER (PARTITION BY page_id, index, line_no ORDER BY x0, rk) - 1)::INT AS span_no FROM b2),
lb AS (SELECT page_id, index, line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, ' ' ORDER BY span_no) AS text FROM ln GROUP BY ALL),
fb AS (SELECT page_id, index, min(x0) AS fs_x0, min(y0) AS fs_y0, max(x1) AS fs_x1, max(y1) AS fs_y1, count(*) AS n_lines FROM lb GROUP BY ALL)
"""
_DX = "greatest(m_x0 - c_x1, c_x0 - m_x1, 0)"
_DY = "greatest(m_y0 - c_y1, c_y0 - m_y1, 0)"
_BOX = lambda p: ", ".join(f"{c} AS {p}_{c}" for c in ("index", "type", "x0", "y0", "x1", "y1"))
_TOUCH = lambda a, b: f"NOT ({a}_x1 <= {b}_x0 OR {a}_x0 >= {b}_x1 OR {a}_y1 <= {b}_y0 OR {a}_y0 >= {b}_y1)"
PARENTS = f"""
p0 AS (SELECT * FROM (SELECT page_id, {_BOX("c")} FROM r WHERE type IN ('caption', 'footnote')) JOIN (SELECT page_id, {_BOX("m")} FROM r WHERE type IN {_IN(VISUAL)}) USING (page_id)
       WHERE NOT (c_type = 'footnote' AND c_index < m_index)),
p1 AS (SELECT *, CASE WHEN c_y1 <= m_y0 THEN c_y1 WHEN m_y1 <= c_y0 THEN m_y1 END AS g0, CASE WHEN c_y1 <= m_y0 THEN m_y0 WHEN m_y1 <= c_y0 THEN c_y0 END AS g1 FROM p0),
p2 AS (SELECT *, abs(c_index - m_index) - (SELECT count(*) FROM r o WHERE o.page_id = p1.page_id AND o.type = c_type AND o.index > least(c_index, m_index) AND o.index < greatest(c_index, m_index)) AS diff FROM p1
       WHERE NOT EXISTS (SELECT 1 FROM (SELECT page_id AS o_page, {_BOX("o")} FROM r) WHERE o_page = p1.page_id AND o_index > least(c_index, m_index) AND o_index < greatest(c_index, m_index)
         AND NOT (o_type = 'caption' OR (c_type = 'footnote' AND o_type = 'footnote'))
         AND NOT (g0 IS NOT NULL AND NOT ({_TOUCH("o", "c")} OR {_TOUCH("o", "m")}) AND NOT (o_y0 < g1 AND o_y1 > g0)))),
p3 AS (SELECT *, sqrt(({_DX})::DOUBLE ** 2 + ({_DY})::DOUBLE ** 2) AS edge, sqrt(((c_x0 + c_x1) / 2 - (m_x0 + m_x1) / 2) ** 2 + ((c_y0 + c_y1) / 2 - (m_y0 + m_y1) / 2) ** 2) AS centre
       FROM (SELECT *, min(diff) OVER (PARTITION BY page_id, c_index) AS low FROM p2) WHERE diff = low),
p4 AS (SELECT *, max(edge) OVER w - min(edge) OVER w AS spread, bool_and(m_type = 'table') OVER w AS tables FROM p3 WINDOW w AS (PARTITION BY page_id, c_index)),
vp AS (SELECT page_id, c_index AS child, m_index AS parent FROM p4 QUALIFY row_number() OVER (PARTITION BY page_id, c_index ORDER BY
        round(CASE WHEN spread > 2 THEN edge WHEN c_type = 'caption' AND tables THEN -m_index WHEN c_type = 'footnote' THEN m_index ELSE centre END::DOUBLE, 9), m_index) = 1)
"""


@query("fix_axis", f"WITH {FIXED} SELECT page_id, det_pos, label, x0, y0, x1, y1 FROM f")
def fix_axis(spark, sf_dir):
    return layout.fix_axis(views.dets(spark, sf_dir)).select("page_id", "det_pos", "label", "x0", "y0", "x1", "y1")


@query("split_regions", f'WITH {FIXED} SELECT page_id, det_pos, type, "index" FROM r')
def split_regions(spark, sf_dir):
    return layout.regions_of(layout.fix_axis(views.dets(spark, sf_dir))).select("page_id", "det_pos", "type", "index")


@query("split_spans", f"WITH {FIXED} SELECT page_id, det_pos, text FROM s")
def split_spans(spark, sf_dir):
    return layout.spans_of(layout.fix_axis(views.dets(spark, sf_dir))).select("page_id", "det_pos", "text")


@query("span_region_match", f'WITH {MATCHED} SELECT page_id, det_pos, "index" FROM m')
def span_region_match(spark, sf_dir):
    f = layout.fix_axis(views.dets(spark, sf_dir))
    return layout.match_spans(layout.spans_of(f), layout.regions_of(f)).select("page_id", "det_pos", "index")


def _lined(spark, sf_dir):
    f = layout.fix_axis(views.dets(spark, sf_dir))
    return layout.span_lines(layout.match_spans(layout.spans_of(f), layout.regions_of(f)))


@query("span_lines", f'WITH {LINED} SELECT page_id, "index", det_pos, line_no, span_no FROM ln')
def span_lines(spark, sf_dir):
    return _lined(spark, sf_dir).select("page_id", "index", "det_pos", "line_no", "span_no")


@query("line_boxes", f'WITH {LINED} SELECT page_id, "index", line_no, x0, y0, x1, y1, text FROM lb')
def line_boxes(spark, sf_dir):
    return layout.line_boxes(_lined(spark, sf_dir))


@query("flow_boxes", f'WITH {LINED} SELECT page_id, "index", fs_x0, fs_y0, fs_x1, fs_y1, n_lines FROM fb')
def flow_boxes(spark, sf_dir):
    return layout.flow_boxes(layout.line_boxes(_lined(spark, sf_dir)))


@query("caption_parent", f"WITH {FIXED}, {PARENTS} SELECT page_id, child, parent FROM vp")
def caption_parent(spark, sf_dir):
    return layout.visual_parents(layout.regions_of(layout.fix_axis(views.dets(spark, sf_dir))))


ASSEMBLED = f"""{LINED}, {PARENTS},
tt AS (SELECT page_id, index, string_agg(text, chr(10) ORDER BY line_no) AS text FROM lb GROUP BY ALL),
ab AS (SELECT r.page_id, r.index, CASE r.type WHEN 'doc_title' THEN 'title' WHEN 'paragraph_title' THEN 'title' WHEN 'vertical_text' THEN 'text' ELSE r.type END AS type,
  CASE r.type WHEN 'doc_title' THEN 1 WHEN 'paragraph_title' THEN 2 END AS level, r.x0, r.y0, r.x1, r.y1, coalesce(tt.text, '') AS text, coalesce(n_lines, 0) AS n_lines,
  CASE WHEN r.type IN ('text', 'vertical_text') THEN fs_x0 END AS fs_x0, CASE WHEN r.type IN ('text', 'vertical_text') THEN fs_y0 END AS fs_y0,
  CASE WHEN r.type IN ('text', 'vertical_text') THEN fs_x1 END AS fs_x1, CASE WHEN r.type IN ('text', 'vertical_text') THEN fs_y1 END AS fs_y1,
  vp.parent, r.type IN {_IN(DISCARDED)} AS discarded
  FROM r LEFT JOIN tt ON r.page_id = tt.page_id AND r.index = tt.index LEFT JOIN fb ON r.page_id = fb.page_id AND r.index = fb.index LEFT JOIN vp ON r.page_id = vp.page_id AND r.index = vp.child)
"""


@query("assemble_pages", f"WITH {ASSEMBLED} SELECT * FROM ab")
def assemble_pages(spark, sf_dir):
    return layout.assemble(views.dets(spark, sf_dir))


_Z = "CASE bucket " + " ".join(f"WHEN '{k}' THEN {i}" for i, (k, _) in enumerate(layout.OVERLAY)) + " END"
_RGB = "CASE bucket " + " ".join("WHEN '%s' THEN '%d,%d,%d'" % (k, *c) for k, c in layout.OVERLAY) + " END"


@query(
    "overlay_layout",
    f"""WITH {ASSEMBLED}, o AS (SELECT a.*, CASE WHEN a.discarded THEN 'discarded' WHEN a.type IN ('image', 'chart') THEN 'image_body' WHEN a.type = 'table' THEN 'table_body'
      WHEN a.type IN ('caption', 'footnote') AND p.type IS NOT NULL THEN CASE WHEN p.type = 'table' THEN 'table_' ELSE 'image_' END || a.type ELSE a.type END AS bucket
      FROM ab a LEFT JOIN (SELECT page_id, index, type FROM ab) p ON a.page_id = p.page_id AND a.parent = p.index)
    SELECT page_id, "index", {_Z} AS z, {_RGB} AS rgb, x0, y0, x1, y1, CASE WHEN NOT discarded THEN row_number() OVER (PARTITION BY page_id, discarded ORDER BY "index") END AS number
    FROM o WHERE {_Z} IS NOT NULL""",
)
def overlay_layout(spark, sf_dir):
    return layout.layout_overlay(layout.assemble(views.dets(spark, sf_dir)))


@query(
    "table_internal_filter",
    f"WITH {FIXED} SELECT page_id, index, type FROM r WHERE type NOT IN ('text', 'equation', 'equation_block') OR NOT EXISTS (SELECT 1 FROM r t WHERE t.page_id = r.page_id AND t.type = 'table' AND {_share('r', 't')} >= 0.9)",
)
def table_internal_filter(spark, sf_dir):
    return layout.inside_tables(layout.regions_of(layout.fix_axis(views.dets(spark, sf_dir)))).select("page_id", "index", "type")


@query(
    "page_range_scan",
    f"""WITH d AS ({views.DETS_SQL}), n AS (SELECT page_id // 5 AS doc_id, max(page_id % 5) + 1 AS n_pages FROM d GROUP BY ALL)
    SELECT d.page_id // 5 AS doc_id, (d.page_id % 5) AS page_idx, count(*) AS n FROM d JOIN n ON d.page_id // 5 = n.doc_id
    WHERE d.page_id % 5 BETWEEN least(1, n_pages - 1) AND greatest(least(3, n_pages - 1), least(1, n_pages - 1)) GROUP BY ALL""",
)
def page_range_scan(spark, sf_dir):
    rows = views.dets(spark, sf_dir).selectExpr("page_id div 5 AS doc_id", "page_id % 5 AS page_idx")
    pages = rows.groupBy("doc_id").agg((F.max("page_idx") + 1).alias("n_pages"))
    return layout.page_range(rows, 1, 3, pages).groupBy("doc_id", "page_idx").agg(F.count("*").alias("n"))


@query("max_pages_scan", f"SELECT page_id // 5 AS doc_id, page_id % 5 AS page_idx, count(*) AS n FROM ({views.DETS_SQL}) WHERE page_id % 5 < 2 GROUP BY ALL")
def max_pages_scan(spark, sf_dir):
    rows = views.dets(spark, sf_dir).selectExpr("page_id div 5 AS doc_id", "page_id % 5 AS page_idx")
    return layout.first_pages(rows, 2).groupBy("doc_id", "page_idx").agg(F.count("*").alias("n"))
