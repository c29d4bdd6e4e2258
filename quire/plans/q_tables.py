"""Queries over tables: token streams, cell matching, choice, columns and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import html
from quire.operators import tables
from quire.plans.registry import query
from quire.session import table

_GRID = "concat('<table>', string_agg('<tr><td>' || replace(replace(n_name, '&', '&amp;'), '<', '&lt;') || '</td><td>' || n_nationkey || '</td></tr>', '' ORDER BY n_nationkey), '</table>')"


def _streams(spark, sf_dir):
    cell = F.concat(F.lit("<fcel>"), "n_name", F.lit("<fcel> "), F.col("n_nationkey").cast("string"), F.lit(" <nl>"))
    rows = table(spark, sf_dir, "nation").select("n_regionkey", F.struct("n_nationkey", cell.alias("s")).alias("x"))
    return rows.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("stream"))


@query("otsl_to_html", f"SELECT n_regionkey, {_GRID} AS html FROM nation GROUP BY n_regionkey")
def otsl_to_html(spark, sf_dir):
    return _streams(spark, sf_dir).select("n_regionkey", tables.otsl_html(F.col("stream")).alias("html"))


@query("otsl_plain_html", f"SELECT n_regionkey, {_GRID} AS html FROM nation GROUP BY n_regionkey")
def otsl_plain_html(spark, sf_dir):
    return _streams(spark, sf_dir).select("n_regionkey", tables.plain_otsl_html(F.col("stream")).alias("html"))


#: Token streams of an order with joined cells, and the HTML of each; {k} and {s} are the order's key and status.
JOINED = (
    ("<fcel>{s}<lcel><fcel>{k}<nl><ucel><xcel><fcel>b<nl><fcel>x<ecel><nl>", '<table><tr><td rowspan="2" colspan="2">{s}</td><td>{k}</td></tr><tr><td>b</td></tr><tr><td>x</td><td></td><td></td></tr></table>', (3, 3, 3, 2)),
    ("<fcel>{k}<fcel>{s}<nl><ucel><fcel>< & ><nl><ucel><ecel><nl>", '<table><tr><td rowspan="3">{k}</td><td>{s}</td></tr><tr><td>&lt; &amp; &gt;</td></tr><tr><td></td></tr></table>', (2, 2, 1, 2)),
    ("<fcel>{k}<lcel><lcel><fcel>{s}<nl><fcel>a<fcel>b<fcel>c<fcel>d<nl>", '<table><tr><td colspan="3">{k}</td><td>{s}</td></tr><tr><td>a</td><td>b</td><td>c</td><td>d</td></tr></table>', (4, 4, 4, 2)),
    ("<fcel>{s}<lcel><nl><ucel><xcel><nl><fcel>{k}<nl>", '<table><tr><td rowspan="2" colspan="2">{s}</td></tr><tr></tr><tr><td>{k}</td><td></td></tr></table>', (2, 2, 2, 1)),
)


def _filled(pattern: str, k, s):
    out = F.replace(F.lit(pattern), F.lit("{k}"), k)
    return F.replace(out, F.lit("{s}"), s)


def _by_order(values: list[str]) -> str:
    return "CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _joined_streams(spark, sf_dir):
    k, s = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    stream = F.lit(None).cast("string")
    for i, (pattern, _, _) in enumerate(JOINED):
        stream = F.when(F.col("o_orderkey") % len(JOINED) == i, _filled(pattern, k, s)).otherwise(stream)
    return table(spark, sf_dir, "orders").select("o_orderkey", stream.alias("stream"))


_JOINED_HTML = _by_order(["replace(replace('" + h + "', '{k}', o_orderkey::VARCHAR), '{s}', o_orderstatus)" for _, h, _ in JOINED])


@query("otsl_joined_cells", f"SELECT o_orderkey, {_JOINED_HTML} AS html FROM orders")
def otsl_joined_cells(spark, sf_dir):
    return _joined_streams(spark, sf_dir).select("o_orderkey", tables.otsl_html(F.col("stream")).alias("html"))


@query(
    "table_column_counts",
    "SELECT o_orderkey, " + ", ".join(f"{_by_order([str(c[i]) for _, _, c in JOINED])} AS {n}" for i, n in enumerate(("columns", "last_effective", "last_actual", "segments"))) + " FROM orders",
)
def table_column_counts(spark, sf_dir):
    counted = _joined_streams(spark, sf_dir).select("o_orderkey", tables.column_counts(tables.otsl_html(F.col("stream"))).alias("c"))
    return counted.select("o_orderkey", *(F.col("c")[i].alias(n) for i, n in enumerate(("columns", "last_effective", "last_actual", "segments"))))


_WORDS = "[p_brand, 'w' || p_size, '', 'nowhere']"


@query(
    "table_html_choice",
    f"""WITH t AS (SELECT p_partkey, p_size % 7 AS a, p_partkey % 7 AS b, 'x' || p_brand AS full, {_WORDS} AS texts FROM part),
    h AS (SELECT *, '<table><tr>' || repeat('<td>' || p || '</td>', b) || repeat('<td> </td>', a) || '</tr></table>' AS ruled, '<table><tr>' || repeat('<td>' || p || '</td>', a + 1) || '<th></th></tr></table>' AS plain FROM (SELECT *, texts[1] AS p FROM t)),
    c AS (SELECT *, b AS rf, a + 1 AS pf, a + b AS rc, a + 2 AS pc, (b > 0)::INT AS rt, 1 AS pt, round_even(sqrt(b), 0) AS sc FROM h)
    SELECT p_partkey, CASE WHEN b % 7 = 6 THEN plain WHEN (pf > rf AND pf + 3 >= greatest(rf + sc * 2, sc * (sc + 2))) OR (pc - rc BETWEEN 0 AND 5 AND rc <= round_even(pc * 0.75, 0)) OR (pc = rc AND rc <= 4) OR rc = 0 OR (rt <= pt * 0.6 AND pt >= 10) THEN plain ELSE ruled END AS html FROM c""",
)
def table_html_choice(spark, sf_dir):
    a, b, p = (F.col("p_size") % 7).cast("int"), (F.col("p_partkey") % 7).cast("int"), F.col("p_brand")
    cell = F.concat(F.lit("<td>"), p, F.lit("</td>"))
    ruled = F.concat(F.lit("<table><tr>"), F.repeat(cell, b), F.repeat(F.lit("<td> </td>"), a), F.lit("</tr></table>"))
    plain = F.concat(F.lit("<table><tr>"), F.repeat(cell, a + 1), F.lit("<th></th></tr></table>"))
    texts = F.array(p, F.concat(F.lit("w"), F.col("p_size").cast("string")), F.lit(""), F.lit("nowhere"))
    return table(spark, sf_dir, "part").select("p_partkey", tables.choose_html(F.when(b % 7 == 6, "").otherwise(ruled), plain, texts).alias("html"))


_STRUCTURE = ("sos", "<tr>", "<td></td>", "eos")


@query(
    "structure_tokens",
    """WITH e AS (SELECT vec_id, (i - 1) // 4 AS t, (i - 1) % 4 AS cls, embedding[i]::DOUBLE AS p FROM embeddings, range(1, len(embedding) + 1) AS r(i)),
    b AS (SELECT vec_id, t, arg_max(cls, (p, -cls)) AS cls FROM e GROUP BY ALL), s AS (SELECT vec_id, min(t) FILTER (WHERE t > 0 AND cls = 3) AS stop FROM b GROUP BY vec_id),
    k AS (SELECT vec_id, t, CASE cls WHEN 1 THEN '<tr>' ELSE '<td></td>' END AS token FROM b JOIN s USING (vec_id) WHERE (stop IS NULL OR t < stop) AND cls IN (1, 2)),
    j AS (SELECT vec_id, string_agg(token, '' ORDER BY t) AS body, list(round(t * 0.01::DOUBLE * 300 * (488 / (300 * (488 / 300.0::DOUBLE))), 6) ORDER BY t) FILTER (WHERE token = '<td></td>') AS lefts FROM k GROUP BY vec_id)
    SELECT v.vec_id, '<html><body><table>' || coalesce(body, '') || '</table></body></html>' AS html, coalesce(lefts, []) AS lefts FROM embeddings v LEFT JOIN j USING (vec_id)""",
)
def structure_tokens(spark, sf_dir):
    flat = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    steps = flat.select("vec_id", F.expr("i div 4").alias("t"), (F.col("i") % 4).alias("cls"), F.col("v").cast("double").alias("p"))
    boxes = steps.where("cls = 0").select("vec_id", "t", F.lit(300.0).alias("w"), F.lit(200.0).alias("h"), *((F.col("t") * 0.01).alias(f"b{i}") for i in range(8)))
    tokens, cells = tables.decode_structure(steps, boxes, ["vec_id"], list(_STRUCTURE), 0, 3)
    shown = tokens.groupBy("vec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("html"))
    lefts = cells.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "c0"))), lambda x: F.round(x["c0"], 6)).alias("lefts"))
    return shown.join(lefts, "vec_id", "left").withColumn("lefts", F.coalesce("lefts", F.array().cast("array<double>")))


_ITEMS = """it AS (SELECT event_id // 30 AS t, event_id % 30 AS item, (event_id * 37 % 280)::DOUBLE AS x0, (event_id * 71 % 180)::DOUBLE AS y0, (event_id * 37 % 280 + 20 + event_id % 17)::DOUBLE AS x1, (event_id * 71 % 180 + 10 + event_id % 9)::DOUBLE AS y1 FROM events),
ce AS (SELECT DISTINCT event_id // 30 AS t, k AS cell, (k % 4 * 75)::DOUBLE AS x0, (k // 4 * 40 + 15)::DOUBLE AS y0, (k % 4 * 75 + 75)::DOUBLE AS x1, (k // 4 * 40 + 55)::DOUBLE AS y1 FROM events, range(0, 16) AS g(k))"""


def _items(spark, sf_dir):
    e = F.col("event_id")
    d = lambda c: c.cast("double")
    rows = table(spark, sf_dir, "events").select(
        F.expr("event_id div 30").alias("t"), (e % 30).alias("item"), d(e * 37 % 280).alias("x0"), d(e * 71 % 180).alias("y0"), d(e * 37 % 280 + 20 + e % 17).alias("x1"), d(e * 71 % 180 + 10 + e % 9).alias("y1")
    )
    k = F.col("cell")
    cells = rows.select("t").distinct().select("t", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("cell"))
    cells = cells.select("t", "cell", d(k % 4 * 75).alias("x0"), d(F.expr("cell div 4") * 40 + 15).alias("y0"), d(k % 4 * 75 + 75).alias("x1"), d(F.expr("cell div 4") * 40 + 55).alias("y1"))
    return rows, cells


_PAIR = """greatest(0, least(i.x1{p}, c.x1) - greatest(i.x0{m}, c.x0)) * greatest(0, least(i.y1{p}, c.y1) - greatest(i.y0{m}, c.y0))"""


@query(
    "ocr_cell_wireless",
    f"""WITH {_ITEMS}, p AS (SELECT i.t, i.item, c.cell, {_PAIR.format(p=" + 1", m=" - 1")} AS b, (i.x1 - i.x0 + 2) * (i.y1 - i.y0 + 2) AS ia, (c.x1 - c.x0) * (c.y1 - c.y0) AS ca,
      abs(c.x0 - i.x0 + 1) + abs(c.y0 - i.y0 + 1) AS near, abs(c.x1 - i.x1 - 1) + abs(c.y1 - i.y1 - 1) AS far FROM it i JOIN ce c USING (t) WHERE i.y1 + 1 >= 15),
    q AS (SELECT *, 1 - CASE WHEN b > 0 THEN b / (ia + ca - b) ELSE 0 END AS inv, near + far + least(near, far) AS dist FROM p)
    SELECT t, item, arg_min(cell, (inv, dist, cell)) AS cell FROM q GROUP BY t, item HAVING min(inv) < 1 - 1e-8""",
)
def ocr_cell_wireless(spark, sf_dir):
    return tables.match_cells(*_items(spark, sf_dir), ["t"])


@query(
    "ocr_cell_wired",
    f"""WITH {_ITEMS}, p AS (SELECT i.t, i.item, c.cell, {_PAIR.format(p="", m="")} AS b, (i.x1 - i.x0) * (i.y1 - i.y0) AS ia, (c.x1 - c.x0) * (c.y1 - c.y0) AS ca,
      ((i.x0 + i.x1) / 2 BETWEEN c.x0 AND c.x1 AND (i.y0 + i.y1) / 2 BETWEEN c.y0 AND c.y1)::INT AS centre FROM it i JOIN ce c USING (t)),
    q AS (SELECT *, b / ia AS cov, b / (ia + ca - b) AS iou FROM p WHERE b > 0 AND (1 - b / ia < 0.6 OR b / (ia + ca - b) > 0.8)),
    r AS (SELECT *, count(*) OVER g AS n, sum(centre) OVER g AS hits, row_number() OVER o AS rk, cov - lead(cov) OVER o AS margin FROM q WINDOW g AS (PARTITION BY t, item), o AS (PARTITION BY t, item ORDER BY cov DESC, iou DESC, cell))
    SELECT t, item, cell FROM r WHERE rk = 1 AND (n = 1 OR (centre = 1 AND hits = 1 AND cov >= 0.55 AND margin >= 0.15) OR (cov >= 0.65 AND margin >= 0.2))""",
)
def ocr_cell_wired(spark, sf_dir):
    return tables.match_wired_cells(*_items(spark, sf_dir), ["t"])


@query(
    "structure_html",
    f"""WITH {_ITEMS}, p AS (SELECT i.t, i.item, c.cell, {_PAIR.format(p=" + 1", m=" - 1")} AS b, (i.x1 - i.x0 + 2) * (i.y1 - i.y0 + 2) AS ia, (c.x1 - c.x0) * (c.y1 - c.y0) AS ca,
      abs(c.x0 - i.x0 + 1) + abs(c.y0 - i.y0 + 1) AS near, abs(c.x1 - i.x1 - 1) + abs(c.y1 - i.y1 - 1) AS far FROM it i JOIN ce c USING (t) WHERE i.y1 + 1 >= 15),
    q AS (SELECT *, 1 - CASE WHEN b > 0 THEN b / (ia + ca - b) ELSE 0 END AS inv, near + far + least(near, far) AS dist FROM p),
    m AS (SELECT t, item, arg_min(cell, (inv, dist, cell)) AS cell FROM q GROUP BY t, item HAVING min(inv) < 1 - 1e-8),
    j AS (SELECT t, cell, string_agg('w' || item, ' ' ORDER BY item) AS body FROM m GROUP BY ALL)
    SELECT ce.t, '<table>' || string_agg(CASE WHEN ce.cell % 4 = 0 THEN '<tr>' ELSE '' END || '<td>' || coalesce(body, '') || '</td>' || CASE WHEN ce.cell % 4 = 3 THEN '</tr>' ELSE '' END, '' ORDER BY ce.cell) || '</table>' AS html
    FROM ce LEFT JOIN j ON ce.t = j.t AND ce.cell = j.cell GROUP BY ce.t""",
)
def structure_html(spark, sf_dir):
    items, cells = _items(spark, sf_dir)
    matched = tables.match_cells(items, cells, ["t"]).withColumn("text", F.concat(F.lit("w"), F.col("item").cast("string")))
    row = "'<tr>', '<td></td>', '<td></td>', '<td></td>', '<td></td>', '</tr>'"
    tokens = cells.select("t").distinct().select("t", F.posexplode(F.expr(f"array('<table>', '<tbody>', {row}, {row}, {row}, {row}, '</tbody>', '</table>')")).alias("pos", "token"))
    return tables.structure_html(tokens, matched, ["t"])


@query(
    "wired_rows",
    f"""WITH {_ITEMS}, o AS (SELECT *, lag(y0) OVER (PARTITION BY t ORDER BY y0, x0, item) AS py FROM it),
    r AS (SELECT *, (sum(CASE WHEN py IS NULL OR abs(y0 - py) > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY t ORDER BY y0, x0, item ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS row FROM o)
    SELECT t, item, "row", (row_number() OVER (PARTITION BY t, "row" ORDER BY x0, item) - 1)::INT AS col FROM r""",
)
def wired_rows(spark, sf_dir):
    items, _ = _items(spark, sf_dir)
    return tables.cell_rows(items.withColumnRenamed("item", "cell"), ["t"]).select("t", F.col("cell").alias("item"), "row", "col")


@query(
    "table_choice",
    """SELECT p_partkey, b = 0 OR a % 7 = 0 OR (a - b BETWEEN 0 AND 5 AND b <= round_even(a * 0.75, 0)) OR (a = b AND b <= 4) OR (d <= c * 0.6 AND c >= 10) AS wireless
    FROM (SELECT p_partkey, p_size AS a, p_partkey % 50 AS b, p_size % 23 AS c, p_partkey % 19 AS d FROM part)""",
)
def table_choice(spark, sf_dir):
    a, b, c, d = F.col("p_size"), F.col("p_partkey") % 50, F.col("p_size") % 23, F.col("p_partkey") % 19
    return table(spark, sf_dir, "part").select("p_partkey", tables.take_wireless(b, a, d, c, a % 7 == 0).alias("wireless"))


@query(
    "cross_page_tables",
    """WITH r AS (SELECT n_regionkey, n_nationkey % 2 AS page, '<tr><td>' || n_name || '</td><td>' || n_nationkey || '</td></tr>' AS r FROM nation)
    SELECT n_regionkey, '<table><tr><td>name</td><td>key</td></tr>' || string_agg(r, '' ORDER BY page, r) || '</table>' AS html, (2 * count(*) + 2)::INT AS cells FROM r GROUP BY n_regionkey""",
)
def cross_page_tables(spark, sf_dir):
    """Every region's nations as a document of two pages with a repeated header, merged."""
    head = F.lit("<tr><td>name</td><td>key</td></tr>")
    rows = table(spark, sf_dir, "nation").select("n_regionkey", (F.col("n_nationkey") % 2).alias("page"), F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td>"), F.col("n_nationkey").cast("string"), F.lit("</td></tr>")).alias("r"))
    pages = rows.groupBy("n_regionkey", "page").agg(F.concat(F.lit("<table>"), head, F.array_join(F.array_sort(F.collect_list("r")), ""), F.lit("</table>")).alias("h"))
    box = F.array(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(50.0)).alias("bbox")
    span = F.struct(F.lit("table").alias("type"), F.col("h").alias("html"))
    body = F.struct(F.lit("table_body").alias("type"), F.lit(1).alias("index"), box, F.array(F.struct(F.array(span).alias("spans"))).alias("lines"))
    block = F.struct(F.lit("table").alias("type"), box, F.array(body).alias("blocks"))
    docs = pages.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", F.array(block).alias("b")))), lambda p: F.struct(p["page"].alias("page_idx"), p["b"].alias("para_blocks"))).alias("pages"))
    merged = docs.select("n_regionkey", tables.merged_pages(F.to_json("pages")).alias("pages"))
    return merged.select("n_regionkey", F.get_json_object("pages", "$[0].para_blocks[0].blocks[0].lines[0].spans[0].html").alias("html"), html.cell_count(F.col("html")).cast("int").alias("cells"))


#: What becomes of a table that goes on: its second page's rows, caption, footnote and width, by part key.
GATES = ("repeated header", "other header", "plain caption", "continued caption", "footnote behind", "three columns", "footnote before", "narrow")


@query(
    "table_merge_gates",
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 8 AS g, '<tr><td>name</td><td>size</td></tr>' AS head, '<tr><td>' || p_brand || '</td><td>' || p_size || '</td></tr>' AS a,
      CASE WHEN p_partkey % 8 = 5 THEN '<tr><td>x</td><td>y</td><td>' || p_partkey || '</td></tr>' ELSE '<tr><td>k</td><td>' || p_partkey || '</td></tr>' END AS b FROM part),
    q AS (SELECT *, CASE WHEN g = 1 THEN b || a WHEN g = 5 THEN b || b ELSE head || b END AS second, g IN (0, 1, 3, 4) AS joins FROM p)
    SELECT k AS p_partkey, '<table>' || head || a || CASE WHEN joins THEN CASE WHEN g = 1 THEN b || a ELSE b END ELSE '' END || '</table>' AS html, CASE WHEN NOT joins THEN '<table>' || second || '</table>' END AS left_over,
      joins AS lines_deleted, CASE WHEN g = 4 THEN 2 WHEN g = 6 THEN 7 END AS footnote_index, CASE WHEN g = 4 THEN true END AS cross_page FROM q""",
)
def table_merge_gates(spark, sf_dir):
    """Two pages of each part, a table at the break, and what joins them or keeps them apart (``GATES``)."""
    k, gate = F.col("p_partkey").cast("string"), F.col("p_partkey") % len(GATES)
    row = lambda *cells: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c if not isinstance(c, str) else F.lit(c), F.lit("</td>")) for c in cells), F.lit("</tr>"))
    head, a = row("name", "size"), row(F.col("p_brand"), F.col("p_size").cast("string"))
    b = F.when(gate == 5, row("x", "y", k)).otherwise(row("k", k))
    second = F.when(gate == 1, F.concat(b, a)).when(gate == 5, F.concat(b, b)).otherwise(F.concat(head, b))
    tab = lambda rows: F.concat(F.lit("<table>"), rows, F.lit("</table>"))
    box = lambda x1: F.array(F.lit(0.0), F.lit(20.0), x1, F.lit(50.0)).alias("bbox")
    wide = F.lit(100.0)

    def child(kind, index, spans):
        return F.struct(F.lit(kind).alias("type"), F.lit(index).alias("index"), box(wide), F.array(F.struct(F.array(spans).alias("spans"))).alias("lines"))

    body = lambda html_: child("table_body", 1, F.struct(F.lit("table").alias("type"), html_.alias("html"), F.lit(None).cast("string").alias("content")))
    text = lambda t: F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("html"), t.alias("content"))
    # the caption stands above the body, or it would count as the next text
    above = lambda t: child("table_caption", 0, text(t)).withField("bbox", F.array(F.lit(0.0), F.lit(0.0), wide, F.lit(10.0)))
    of = lambda html_, more, x1: F.array(F.struct(F.lit("table").alias("type"), box(x1), more(body(html_)).alias("blocks")))
    before = of(tab(F.concat(head, a)), lambda t: F.when(gate == 6, F.array(t, child("table_footnote", 7, text(F.lit("note"))))).otherwise(F.array(t)), wide)
    caption = F.when(gate == 3, F.concat(F.lit("Table "), k, F.lit(" (continued)"))).otherwise(F.concat(F.lit("Table "), k))
    behind = of(
        tab(second), lambda t: F.when(gate.isin(2, 3), F.array(above(caption), t)).when(gate == 4, F.array(t, child("table_footnote", 9, text(F.lit("note"))))).otherwise(F.array(t)), F.when(gate == 7, 80.0).otherwise(100.0)
    )
    page = lambda i, blocks: F.struct(F.lit(i).alias("page_idx"), blocks.alias("para_blocks"))
    docs = table(spark, sf_dir, "part").select("p_partkey", gate.alias("g"), F.array(page(0, before), page(1, behind)).alias("pages"))
    merged = docs.select("p_partkey", "g", tables.merged_pages(F.to_json("pages")).alias("pages"))
    known = F.from_json("pages", "array<struct<para_blocks:array<struct<blocks:array<struct<type:string,index:int,cross_page:boolean,lines_deleted:boolean,lines:array<struct<spans:array<struct<html:string>>>>>>>>>>")
    child_of = lambda p, kind: F.get(F.filter(F.get(F.get(F.col("p"), F.lit(p))["para_blocks"], F.lit(0))["blocks"], lambda c: c["type"] == kind), F.lit(0))
    html_of = lambda p: F.get(F.get(child_of(p, "table_body")["lines"], F.lit(0))["spans"], F.lit(0))["html"]
    note = child_of(0, "table_footnote")
    return merged.withColumn("p", known).select(
        "p_partkey", html_of(0).alias("html"), html_of(1).alias("left_over"), F.coalesce(child_of(1, "table_body")["lines_deleted"], F.lit(False)).alias("lines_deleted"), note["index"].alias("footnote_index"), note["cross_page"].alias("cross_page")
    )


@query(
    "wired_table_html",
    f"""WITH {_ITEMS}, p AS (SELECT i.t, i.item, c.cell, i.x0, i.y0, i.x1, {_PAIR.format(p="", m="")} AS b, (i.x1 - i.x0) * (i.y1 - i.y0) AS ia, (c.x1 - c.x0) * (c.y1 - c.y0) AS ca,
      ((i.x0 + i.x1) / 2 BETWEEN c.x0 AND c.x1 AND (i.y0 + i.y1) / 2 BETWEEN c.y0 AND c.y1)::INT AS centre FROM it i JOIN ce c USING (t)),
    q AS (SELECT *, b / ia AS cov, b / (ia + ca - b) AS iou FROM p WHERE b > 0 AND (1 - b / ia < 0.6 OR b / (ia + ca - b) > 0.8)),
    r AS (SELECT *, count(*) OVER g AS n, sum(centre) OVER g AS hits, row_number() OVER o AS rk, cov - lead(cov) OVER o AS margin FROM q WINDOW g AS (PARTITION BY t, item), o AS (PARTITION BY t, item ORDER BY cov DESC, iou DESC, cell)),
    m AS (SELECT *, max(x1) OVER (PARTITION BY t, cell ORDER BY y0, x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE rk = 1 AND (n = 1 OR (centre = 1 AND hits = 1 AND cov >= 0.55 AND margin >= 0.15) OR (cov >= 0.65 AND margin >= 0.2))),
    j AS (SELECT t, cell, string_agg(repeat(' ', floor(greatest(coalesce(x0 - reach, 0), 0) / 10)::INT) || 'w' || item, '' ORDER BY y0, x0) AS body FROM m GROUP BY ALL)
    SELECT ce.t, '<html><body><table>' || string_agg(CASE WHEN ce.cell % 4 = 0 THEN '<tr>' ELSE '' END || '<td rowspan=1 colspan=1>' || coalesce(body, '') || '</td>' || CASE WHEN ce.cell % 4 = 3 THEN '</tr>' ELSE '' END, '' ORDER BY ce.cell) || '</table></body></html>' AS html
    FROM ce LEFT JOIN j ON ce.t = j.t AND ce.cell = j.cell GROUP BY ce.t""",
)
def wired_table_html(spark, sf_dir):
    """Texts matched to a ruled 4 x 4 grid and written as HTML."""
    from quire.operators import wired

    items, cells = _items(spark, sf_dir)
    matched = tables.match_wired_cells(items, cells, ["t"]).join(items, ["t", "item"]).withColumn("text", F.concat(F.lit("w"), F.col("item").cast("string")))
    return wired.table_html(cells, matched, ["t"])
