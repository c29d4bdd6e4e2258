"""Queries of scalar functions over documents, pages and literals joined to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geom, html, latex, text
from quire.plans import views
from quire.plans.registry import query
from quire.session import table

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _literals(spark, sf_dir, column, values):
    """Each literal beside some documents, so that functions run over a table's rows."""
    pick = F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(pick, F.lit(" "), (F.col("doc_id") % 5).cast("string")).alias(column))


def _literals_sql(column, values):
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"(SELECT doc_id, [{quoted}][(doc_id % {len(values)})::INT + 1] || ' ' || (doc_id % 5) AS {column} FROM documents)"


SCRIPTS = ("plain", "かな漢字", "한글", "汉字", "カタカナ한", "ＡＢＣ１２ｚ！", "é")


@query(
    "script_language",
    f"""SELECT doc_id, CASE WHEN regexp_matches(t, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(t, '[가-힣ᄀ-ᇿ]') THEN 'ko'
      WHEN regexp_matches(t, '[一-鿿㐀-䶿豈-﫿]') THEN 'zh' ELSE 'en' END AS lang FROM {_literals_sql("t", SCRIPTS)}""",
)
def script_language(spark, sf_dir):
    return _literals(spark, sf_dir, "t", SCRIPTS).select("doc_id", text.script_language(F.col("t")).alias("lang"))


@query(
    "half_width",
    f"SELECT doc_id, translate(t, 'ＡＢＣ１２ｚ', 'ABC12z') AS narrow, translate(t, 'ＡＢＣ１２ｚ！', 'ABC12z!') AS narrow_all FROM {_literals_sql('t', SCRIPTS)}",
)
def half_width(spark, sf_dir):
    return _literals(spark, sf_dir, "t", SCRIPTS).select("doc_id", text.half_width(F.col("t")).alias("narrow"), text.half_width_all(F.col("t")).alias("narrow_all"))


@query(
    "hyphen_lines",
    f"SELECT doc_id, line_no::INT AS line_no, regexp_matches(line || '-', '[A-Za-z][-\\x{{AD}}\\x{{2010}}\\x{{2011}}\\x{{2043}}]\\s*$') AS hyphen, left(line, greatest(length(line) - 1, 0)) AS shorter FROM ({views.LINES_SQL})",
)
def hyphen_lines(spark, sf_dir):
    dashed = F.concat(F.col("line"), F.lit("-"))
    return views.lines(spark, sf_dir).select("doc_id", "line_no", text.ends_in_hyphen(dashed).alias("hyphen"), text.without_last(F.col("line")).alias("shorter"))


@query(
    "escape_markdown",
    f"""SELECT doc_id, line_no::INT AS line_no, regexp_replace(line, '([*_`~$])', '\\\\\\1', 'g') AS escaped,
      CASE WHEN regexp_matches(line, '^[ \t]{{0,3}}(#{{1,6}}|[+-])[ \t]') THEN regexp_replace(line, '^([ \t]*)', '\\1\\\\') ELSE line END AS prefixed FROM ({views.LINES_SQL})""",
)
def escape_markdown(spark, sf_dir):
    return views.lines(spark, sf_dir).select("doc_id", "line_no", text.escape_markdown(F.col("line")).alias("escaped"), text.escape_prefix(F.col("line")).alias("prefixed"))


@query(
    "html_escape",
    """SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS plain,
      replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS quoted FROM pages""",
)
def html_escape(spark, sf_dir):
    c = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", text.html_escape(c).alias("plain"), text.html_escape_quotes(c).alias("quoted"))


@query(
    "table_unescape",
    "SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS decoded FROM pages",
)
def table_unescape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.table_unescape(F.col("html")).alias("decoded"))


_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "''", "#39": "''", "nbsp": "\u00a0"}


@query(
    "html_unescape",
    f"""WITH p AS (SELECT page_id, string_split(html, '&') AS ps FROM pages),
    d AS (SELECT page_id, ps[1] || coalesce(list_aggregate(list_transform(ps[2:], lambda p: CASE {" ".join(f"WHEN starts_with(p, '{k};') THEN '{v}' || p[{len(k) + 2}:]" for k, v in _ENTITIES.items())}
      WHEN regexp_matches(p, '^#[0-9]{{1,8}};') THEN chr(regexp_extract(p, '^#([0-9]+)', 1)::INT) || regexp_replace(p, '^#[0-9]+;', '')
      WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]{{1,7}};') THEN chr(('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1))::INT) || regexp_replace(p, '^#[xX][0-9a-fA-F]+;', '') ELSE '&' || p END), 'string_agg', ''), '') AS decoded FROM p)
    SELECT page_id, decoded FROM d""",
)
def html_unescape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.html_unescape(F.col("html")).alias("decoded"))


TABLES = (
    '<table><tr><td>a</td><th> b </th></tr><tr><td></td><td><img src="x.png"></td></tr></table>',
    '<html><body><table><tr><td colspan="2">1 <eq>x&lt;y</eq></td></tr></table></body></html>',
    "<table><thead><tr><td>k<table><tr><td>n</td></tr></table></td></tr></thead></table>",
    'no table <img src="data:image/png;base64,AA">',
)


@query(
    "table_html_counts",
    f"""WITH t AS {_literals_sql("h", TABLES)} SELECT doc_id, ((length(h) - length(replace(lower(h), '<td', ''))) // 3 + (length(h) - length(replace(lower(h), '<th', ''))) // 3)::INT AS cells,
      CASE WHEN (length(h) - length(replace(h, '<table', ''))) // 6 > 1 THEN 2 ELSE 1 END::INT AS nesting,
      contains(h, 'colspan') OR contains(h, 'rowspan') OR (length(h) - length(replace(h, '<table', ''))) // 6 > 1 AS complex,
      len(list_filter(list_transform(regexp_extract_all(h, '(?is)<t[dh](?:\\s[^>]*)?>(.*?)</t[dh]>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'gs'))), lambda x: x = ''))::INT AS blanks FROM t""",
)
def table_html_counts(spark, sf_dir):
    h = F.col("h")
    return _literals(spark, sf_dir, "h", TABLES).select(
        "doc_id", html.cell_count(h).cast("int").alias("cells"), html.table_nesting(h).alias("nesting"), html.is_complex_table(h).alias("complex"), html.blank_cells(h).alias("blanks")
    )


@query(
    "embedded_html",
    f"""WITH t AS {_literals_sql("h", TABLES)} SELECT doc_id, replace(replace(replace(replace(h, 'src="x', 'src="images/x'), '<eq>x&lt;y', ' $x<y'), '<eq>', ' $'), '</eq>', '$ ') AS embedded,
      CASE WHEN contains(h, '<table>') THEN regexp_extract(h, '(<table>.*</table>)', 1) ELSE h END AS body FROM t""",
)
def embedded_html(spark, sf_dir):
    h = F.col("h")
    return _literals(spark, sf_dir, "h", TABLES).select("doc_id", html.embedded(h, "images").alias("embedded"), html.body_of(h).alias("body"))


CAPTIONS = ("Table 1 (continued)", "Table 2", "表 3（续）", "Table continued", "discontinued", "（continued）", "Ｔable (cont.)", "x (continued) y")


#: Read off the rule by hand, caption by caption.
_GOES_ON = "[true, false, true, true, false, true, true, true]"


@query("continued_captions", f"SELECT doc_id, {_GOES_ON}[(doc_id % {len(CAPTIONS)})::INT + 1] AS continued FROM documents")
def continued_captions(spark, sf_dir):
    pick = F.get(F.array(*map(F.lit, CAPTIONS)), (F.col("doc_id") % len(CAPTIONS)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", html.is_continued(pick).alias("continued"))


FORMULAS = (r"see \[1, 2–3\] and \[x+y\]", r"\(a \tox b \in y\)", r"a \(b____c\) d", r"{a}} \{ {", r"\[ E = mc^2 \]", r"\(x \top \intx \inf\)")


@query(
    "latex_inline",
    f"""SELECT doc_id, regexp_replace(replace(replace(t, '\\[x+y\\]', '\\(x+y\\)'), '\\[ E = mc^2 \\]', '\\( E = mc^2 \\)'), '$^', '') AS inline,
      CASE WHEN starts_with(t, '\\[ E') THEN regexp_replace(t, '^\\\\\\[ ', '') ELSE t END AS opened FROM {_literals_sql("t", FORMULAS)}""",
)
def latex_inline(spark, sf_dir):
    return _literals(spark, sf_dir, "t", FORMULAS).select("doc_id", latex.display_to_inline(F.col("t")).alias("inline"), latex.strip_delimiters(F.col("t")).alias("opened"))


@query(
    "latex_clean",
    f"""SELECT doc_id, replace(replace(replace(replace(t, '\\[x+y\\]', '\\(x+y\\)'), '\\[ E = mc^2 \\]', '\\( E = mc^2 \\)'), '\\tox', '\\to x'), '(b____c\\)', '(b\\) ____ \\(c\\)') AS text,
      replace(replace(t, '{{a}}}} \\{{ {{', '{{a}} \\{{ '), '\\[ E', 'E') AS equation FROM {_literals_sql("t", FORMULAS)}""",
)
def latex_clean(spark, sf_dir):
    t = F.col("t")
    return _literals(spark, sf_dir, "t", FORMULAS).select("doc_id", latex.clean_text(t).alias("text"), latex.clean_equation(t).alias("equation"))


@query("formula_tag", "SELECT doc_id, trim(replace(replace(' (' || doc_id || ' ) ', '(', ''), ')', '')) AS tag FROM documents")
def formula_tag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", latex.formula_tag(F.concat(F.lit(" ("), F.col("doc_id"), F.lit(" ) "))).alias("tag"))


@query(
    "title_levels",
    "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 1 WHEN doc_id % 7 - 1 > 4 THEN 4 WHEN doc_id % 7 - 1 < 1 THEN 0 ELSE doc_id % 7 - 1 END::INT AS level, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'images/' || doc_id || '.jpg' END AS path FROM documents",
)
def title_levels(spark, sf_dir):
    level = F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") % 7 - 1)
    path = F.when(F.col("doc_id") % 3 != 0, F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")))
    return table(spark, sf_dir, "documents").select("doc_id", text.title_level(level).alias("level"), text.media_path("images", path).alias("path"))


@query(
    "bbox_per_mille",
    f"SELECT page_id, det_pos, trunc(bx0 * 1000 / 1700)::INT AS x0, trunc(by0 * 1000 / 2200)::INT AS y0, trunc(bx1 * 1000 / 1700)::INT AS x1, trunc(by1 * 1000 / 2200)::INT AS y1 FROM ({views.DETS_SQL})",
)
def bbox_per_mille(spark, sf_dir):
    sizes = {"x0": 1700, "y0": 2200, "x1": 1700, "y1": 2200}
    return views.dets(spark, sf_dir).select("page_id", "det_pos", *(geom.per_mille(F.col(f"b{c}"), F.lit(s)).alias(c) for c, s in sizes.items()))


@query(
    "raster_and_detector_sizes",
    """WITH s AS (SELECT p_partkey, (p_size * 37 + 200)::DOUBLE AS w, (p_partkey % 900 + 100)::DOUBLE AS h FROM part),
    k AS (SELECT *, least(200 / 72.0::DOUBLE, 3500.0::DOUBLE / greatest(w, h)) AS sc, least(1.0::DOUBLE, 960.0::DOUBLE / greatest(w, h)) AS dr FROM s)
    SELECT p_partkey, ceil(round(w * sc, 9))::INT AS raster_w, ceil(round(h * sc, 9))::INT AS raster_h,
      greatest(round_even(floor(w * dr) / 32, 0) * 32, 32)::INT AS det_w, greatest(round_even(floor(h * dr) / 32, 0) * 32, 32)::INT AS det_h FROM k""",
)
def raster_and_detector_sizes(spark, sf_dir):
    w, h = (F.col("p_size") * 37 + 200).cast("double"), (F.col("p_partkey") % 900 + 100).cast("double")
    return table(spark, sf_dir, "part").select(
        "p_partkey", geom.raster_size(w, h).alias("raster_w"), geom.raster_size(h, w).alias("raster_h"), geom.detector_side(w, h).alias("det_w"), geom.detector_side(h, w).alias("det_h")
    )


@query(
    "smart_resize",
    """WITH s AS (SELECT p_partkey, (p_size * 37 + 20)::DOUBLE AS w, (p_partkey % 900 + 10)::DOUBLE AS h FROM part WHERE greatest(p_size * 37 + 20, p_partkey % 900 + 10) <= 200 * least(p_size * 37 + 20, p_partkey % 900 + 10)),
    n AS (SELECT *, greatest(round_even(h / 28, 0) * 28, 28) AS hn, greatest(round_even(w / 28, 0) * 28, 28) AS wn FROM s)
    SELECT p_partkey, CASE WHEN hn * wn > 1003520 THEN greatest(floor(h / sqrt(h * w / 1003520) / 28) * 28, 28) WHEN hn * wn < 3136 THEN ceil(h * sqrt(3136.0::DOUBLE / (h * w)) / 28) * 28 ELSE hn END::INT AS new_h,
      CASE WHEN hn * wn > 1003520 THEN greatest(floor(w / sqrt(h * w / 1003520) / 28) * 28, 28) WHEN hn * wn < 3136 THEN ceil(w * sqrt(3136.0::DOUBLE / (h * w)) / 28) * 28 ELSE wn END::INT AS new_w FROM n""",
)
def smart_resize(spark, sf_dir):
    w, h = F.col("p_size") * 37 + 20, F.col("p_partkey") % 900 + 10
    new_h, new_w = geom.smart_resize(h, w)
    return table(spark, sf_dir, "part").where(F.greatest(w, h) <= 200 * F.least(w, h)).select("p_partkey", new_h.alias("new_h"), new_w.alias("new_w"))
