"""Tables: token streams to HTML, cell matching, column counts, choice and merging over pages."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.geom import Box, intersection
from quire.functions.udf import over_text

# ---- token streams -------------------------------------------------------------

#: Cell tokens: new, empty, joined left, joined up, joined both, end of row.
FULL, EMPTY, LEFT, UP, BOTH, ROW_END = "<fcel>", "<ecel>", "<lcel>", "<ucel>", "<xcel>", "<nl>"
_TOKEN = re.compile("(<fcel>|<ecel>|<lcel>|<ucel>|<xcel>|<nl>)")
_SPACE = " \t\n\r\x0b\x0c"


def _escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#x27;")


def tokens_to_html(s: str) -> str:
    """A cell-token stream as an HTML table; HTML tables pass through, blank text gives ""."""
    if len(s) >= 15 and s.startswith("<table") and s.endswith("</table>"):
        return s
    parts = _TOKEN.split(s)
    rows: list[list[tuple[str, str]]] = [[]]
    for token, after in zip(parts[1::2], parts[2::2], strict=True):
        if token == ROW_END:
            rows.append([])
        else:
            rows[-1].append((token, after.strip(_SPACE) if token == FULL else ""))
    if not rows[-1]:
        rows.pop()
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [(EMPTY, "")] * (width - len(r)) for r in rows]
    kind = lambda y, x: rows[y][x][0] if y < len(rows) and x < width else ""

    owner: dict[tuple[int, int], tuple[int, int]] = {}
    spans: dict[tuple[int, int], tuple[int, int]] = {}
    for y in range(len(rows)):
        for x in range(width):
            if kind(y, x) in (FULL, EMPTY):
                right = next((k for k in range(1, width) if kind(y, x + k) not in (LEFT, BOTH)), width)
                down = next((k for k in range(1, len(rows) + 1) if kind(y + k, x) not in (UP, BOTH)), 1)
                spans[y, x] = down, right
                owner.update({(y + i, x + j): (y, x) for i in range(down) for j in range(right) if y + i < len(rows) and x + j < width})
    if not spans:
        return ""
    out = ["<table>"]
    for y in range(len(rows)):
        out.append("<tr>")
        for x in range(width):
            if owner.get((y, x), (y, x)) != (y, x):
                continue
            down, right = spans.get((y, x), (1, 1))
            text = _escape(rows[y][x][1]) if (y, x) in spans else ""
            out.append("<td" + (f' rowspan="{down}"' if down > 1 else "") + (f' colspan="{right}"' if right > 1 else "") + f">{text}</td>")
        out.append("</tr>")
    return "".join(out) + "</table>"


otsl_html = over_text(tokens_to_html)


def plain_otsl_html(c: Column) -> Column:
    """``tokens_to_html`` of a stream without joined cells and with equal rows, by built-in expressions."""
    from quire.functions.text import html_escape_quotes, strip

    rows = F.filter(F.split(c, ROW_END), lambda r: r != "")
    cells = lambda r: F.slice(F.split(r, "(?=<fcel>|<ecel>)"), 1, 1000000)
    cell = lambda x: F.concat(F.lit("<td>"), html_escape_quotes(strip(F.regexp_replace(x, "^<[fe]cel>", ""))), F.lit("</td>"))
    shown = F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.filter(cells(r), lambda x: x != ""), cell), ""), F.lit("</tr>")))
    return F.concat(F.lit("<table>"), F.array_join(shown, ""), F.lit("</table>"))


# ---- recognised text into cells -----------------------------------------------


def match_cells(items: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, cell): each text box (padded by 1) with the cell of largest IoU, then least corner distance.

    Boxes wholly above the first cell and boxes that touch no cell have none.
    """
    d, c = Box.of("d_"), Box.of("c_")
    side = lambda rows, p, i: rows.select(*keys, i, *(F.col(k).cast("double").alias(f"{p}_{k}") for k in ("x0", "y0", "x1", "y1")))
    top = cells.groupBy(*keys).agg(F.min("y0").cast("double").alias("top"))
    padded = items.withColumns({"x0": F.col("x0") - 1, "y0": F.col("y0") - 1, "x1": F.col("x1") + 1, "y1": F.col("y1") + 1})
    pair = side(padded, "d", "item").join(top, keys).where("d_y1 >= top").join(side(cells, "c", "cell"), keys)
    both = intersection(d, c)
    inverse = 1 - F.when(both > 0, both / (d.area + c.area - both)).otherwise(0.0)
    near = F.abs(c.x0 - d.x0) + F.abs(c.y0 - d.y0)
    far = F.abs(c.x1 - d.x1) + F.abs(c.y1 - d.y1)
    pair = pair.withColumns({"inv": inverse, "dist": near + far + F.least(near, far)})
    best = pair.groupBy(*keys, "item").agg(F.min(F.struct("inv", "dist", "cell")).alias("b"))
    return best.where(F.col("b.inv") < 1 - 1e-8).select(*keys, "item", F.col("b.cell").alias("cell"))


def match_wired_cells(items: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, cell) for ruled tables: a lone candidate, or the best by coverage with a clear margin."""
    d, c = Box.of("d_"), Box.of("c_")
    side = lambda rows, p, i: rows.select(*keys, i, *(F.col(k).cast("double").alias(f"{p}_{k}") for k in ("x0", "y0", "x1", "y1")))
    both = intersection(d, c)
    cx, cy = (d.x0 + d.x1) / 2, (d.y0 + d.y1) / 2
    pair = side(items, "d", "item").join(side(cells, "c", "cell"), keys)
    pair = pair.withColumns({"cov": F.when(d.area > 0, both / d.area).otherwise(0.0), "iou": both / (d.area + c.area - both), "centre": ((c.x0 <= cx) & (cx <= c.x1) & (c.y0 <= cy) & (cy <= c.y1)).cast("int")})
    pair = pair.where((F.col("cov") > 0) & ((1 - F.col("cov") < 0.6) | (F.col("iou") > 0.8)))
    w = W.partitionBy(*keys, "item")
    order = w.orderBy(F.desc("cov"), F.desc("iou"), "cell")
    pair = pair.withColumns(
        {"n": F.count("*").over(w), "rank": F.row_number().over(order), "margin": F.col("cov") - F.lead("cov").over(order), "hits": F.sum("centre").over(w)}
    ).where("rank = 1")
    sure = (F.col("n") == 1) | ((F.col("centre") == 1) & (F.col("hits") == 1) & (F.col("cov") >= 0.55) & (F.col("margin") >= 0.15)) | ((F.col("cov") >= 0.65) & (F.col("margin") >= 0.2))
    return pair.where(sure).select(*keys, "item", "cell")


def structure_html(tokens: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, html) of structure tokens (pos, token) with matched texts (cell, item, text) before each ``</td>``."""
    order = W.partitionBy(*keys).orderBy("pos")
    closes = F.contains("token", F.lit("</td>"))
    rows = tokens.where(~F.col("token").isin("<thead>", "</thead>", "<tbody>", "</tbody>"))
    rows = rows.withColumn("cell", F.when(closes, F.sum(closes.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1))
    n = W.partitionBy(*keys, "cell")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "^ ", ""), "^<b>", ""), "</b>$", "")
    parts = texts.withColumns({"m": F.count("*").over(n), "k": F.row_number().over(n.orderBy("item"))})
    last = F.col("k") == F.col("m")
    piece = F.when(F.col("m") == 1, F.col("text")).when(bare == "", "").when(last | bare.endswith(" "), bare).otherwise(F.concat(bare, F.lit(" ")))
    bold = F.max(F.when(F.col("k") == 1, F.contains("text", F.lit("<b>")) & (F.col("m") > 1)))
    joined = parts.select(*keys, "cell", "k", "m", "text", piece.alias("p")).groupBy(*keys, "cell").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]), "").alias("body"), bold.alias("bold")
    )
    joined = joined.select(*keys, "cell", F.when(F.col("bold"), F.concat(F.lit("<b>"), "body", F.lit("</b>"))).otherwise(F.col("body")).alias("body"))
    filled = rows.join(joined, [*keys, "cell"], "left")
    body = F.coalesce("body", F.lit(""))
    shown = F.when(F.col("cell").isNull(), F.col("token")).when(F.col("token") == "<td></td>", F.concat(F.lit("<td>"), body, F.lit("</td>"))).otherwise(F.concat(body, "token"))
    return filled.select(*keys, "pos", shown.alias("s")).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "").alias("html"))


def cell_rows(cells: DataFrame, keys: list[str], apart: float = 10.0) -> DataFrame:
    """Row numbers of ruled cells: a new row where the top lies over ``apart`` from the one before."""
    order = W.partitionBy(*keys).orderBy("y0", "x0", "cell")
    jump = F.coalesce(F.abs(F.col("y0") - F.lag("y0").over(order)) > apart, F.lit(True))
    rows = cells.withColumn("__new", jump.cast("int"))
    rows = rows.withColumn("row", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("__new")
    return rows.withColumn("col", F.row_number().over(W.partitionBy(*keys, "row").orderBy("x0", "cell")) - 1)


def take_wireless(wired_cells: Column, wireless_cells: Column, wired_texts: Column, wireless_texts: Column, switched: Column) -> Column:
    """Is the unruled reading of a table better than the ruled one?"""
    gap = wireless_cells - wired_cells
    return (
        switched
        | ((gap >= 0) & (gap <= 5) & (wired_cells <= F.bround(wireless_cells * 0.75, 0)))
        | ((gap == 0) & (wired_cells <= 4))
        | ((wired_texts <= wireless_texts * 0.6) & (wireless_texts >= 10))
        | (wired_cells == 0)
    )


def found_texts(html_: Column, texts: Column) -> Column:
    """How many of the recognised texts the HTML holds; blank ones don't count."""
    return F.size(F.filter(texts, lambda t: (t != "") & F.contains(html_, t)))


def choose_html(wired: Column, wireless: Column, texts: Column) -> Column:
    """The better of a table's two readings, by cells, cells with text and recognised texts found.

    An empty ruled reading loses.  ``texts`` are those recognised in the table.
    """
    from quire.functions.html import blank_cells, cell_count, cell_texts

    full = lambda c: F.size(cell_texts(c)) - blank_cells(c)
    ruled, plain = full(wired), full(wireless)
    scale = F.bround(F.sqrt(ruled.cast("double")), 0)
    switched = (plain > ruled) & (plain + 3 >= F.greatest(ruled + scale * 2, scale * (scale + 2)))
    better = take_wireless(cell_count(wired), cell_count(wireless), found_texts(wired, texts), found_texts(wireless, texts), switched)
    return F.when((F.coalesce(wired, F.lit("")) == "") | better, wireless).otherwise(wired)


def tries_wired(label: Column, score: Column, n_texts: Column) -> Column:
    """Is a table worth a ruled reading? It is classed as ruled, or as unruled without much certainty, and holds text."""
    return (n_texts > 0) & ((label == "wired_table") | ((label == "wireless_table") & (score < 0.9)))


def decode_structure(steps: DataFrame, boxes: DataFrame, keys: list[str], letters: list[str], start: int, end: int, side: float = 488.0) -> tuple[DataFrame, DataFrame]:
    """(tokens (keys, pos, token), cells (keys, cell, c0..c7)) of a structure recogniser's output.

    ``steps`` are (keys, t, cls, p), of which the best class a step counts, the first of equal ones; decoding
    stops at the first ``end`` behind step 0, and ``start`` and ``end`` are no tokens.  ``boxes`` are (keys, t,
    w, h, b0..b7) in parts of a picture of w x h; cells are those of steps with a ``<td`` token, in the square of
    ``side`` that the picture was padded to.
    """
    best = steps.groupBy(*keys, "t").agg(F.max_by("cls", F.struct("p", -F.col("cls"))).alias("cls"))
    stop = F.min(F.when((F.col("t") > 0) & (F.col("cls") == end), F.col("t"))).over(W.partitionBy(*keys))
    kept = best.withColumn("stop", stop).where("stop IS NULL OR t < stop").where(~F.col("cls").isin(start, end))
    kept = kept.select(*keys, "t", F.get(F.array(*map(F.lit, letters)), F.col("cls").cast("int")).alias("token"))
    head, tail = ("<html>", "<body>", "<table>"), ("</table>", "</body>", "</html>")
    order = W.partitionBy(*keys).orderBy("t")
    placed = kept.select(*keys, (F.row_number().over(order) + len(head) - 1).alias("pos"), "token")
    ends = steps.select(*keys).distinct().join(placed.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    outer = ends.select(*keys, F.posexplode(F.array(*map(F.lit, (*head, *tail)))).alias("i", "token"), "n")
    outer = outer.select(*keys, F.when(F.col("i") < len(head), F.col("i")).otherwise(F.col("i") + F.col("n")).cast("int").alias("pos"), "token")
    td = kept.where(F.contains("token", F.lit("<td"))).join(boxes, [*keys, "t"])
    size = lambda i: F.col("h") if i % 2 else F.col("w")
    fit = F.least(F.lit(side) / F.col("h"), F.lit(side) / F.col("w"))
    cells = td.select(*keys, (F.row_number().over(order) - 1).alias("cell"), *((F.col(f"b{i}") * size(i) * (F.lit(side) / (size(i) * fit))).alias(f"c{i}") for i in range(8)))
    return placed.unionByName(outer), cells


# ---- HTML tables ----------------------------------------------------------------

_ROW = re.compile(r"<tr\b[^>]*>(.*?)</tr\s*>", re.S | re.I)
_CELL = re.compile(r"<(t[dh])\b([^>]*)>(.*?)</t[dh]\s*>", re.S | re.I)
_ATTR = re.compile(r"""([^\s=<>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
_ENTITY = re.compile("|".join(map(re.escape, _NAMED)))
MOST_HEADERS = 5


@dataclass
class Cell:
    tag: str
    attrs: list[tuple[str, str]]
    inner: str

    def span(self, name: str) -> int:
        value = next((v for k, v in self.attrs if k.lower() == name), "1")
        return max(1, int(value)) if value.strip().isdigit() else 1

    def widen(self, n: int) -> None:
        self.attrs = [(k, v) for k, v in self.attrs if k.lower() != "colspan"] + [("colspan", str(n))] if all(k.lower() != "colspan" for k, _ in self.attrs) else [
            (k, str(n) if k.lower() == "colspan" else v) for k, v in self.attrs
        ]

    def text(self) -> str:
        return _ENTITY.sub(lambda m: _NAMED[m[0]], re.sub(r"<[^>]*>", "", self.inner))

    def key(self) -> str:
        return re.sub(r"[ \t\r\n]", "", self.text().translate(_WIDE))

    def html(self) -> str:
        return f"<{self.tag}" + "".join(f' {k}="{v}"' for k, v in self.attrs) + f">{self.inner}</{self.tag}>"


@dataclass
class HtmlTable:
    rows: list[list[Cell]]
    body: bool = False
    grid: list[dict[int, tuple[int, int]]] = field(default_factory=list)

    @staticmethod
    def parse(html: str) -> HtmlTable | None:
        if "<table" not in html.lower():
            return None
        rows = []
        for row in _ROW.findall(html):
            rows.append([Cell(t, [(k, v[1:-1] if v[:1] in ('"', "'") else v) for k, v in _ATTR.findall(a)], inner) for t, a, inner in _CELL.findall(row)])
        return HtmlTable(rows, "<tbody" in html.lower()).scan()

    def scan(self) -> HtmlTable:
        """Lays the cells on a grid: ``grid[row][column]`` is the (row, cell) that covers it."""
        self.grid = [{} for _ in self.rows]
        self.actual = [sum(c.span("colspan") for c in r) for r in self.rows]
        for y, row in enumerate(self.rows):
            x = 0
            for i, cell in enumerate(row):
                while x in self.grid[y]:
                    x += 1
                wide, high = cell.span("colspan"), cell.span("rowspan")
                for g in self.grid[y : y + high]:
                    g.update(dict.fromkeys(range(x, x + wide), (y, i)))
                x += wide
        self.effective = [max(g, default=-1) + 1 for g in self.grid]
        self.columns = max([*self.effective, 0])
        return self

    def segments(self, y: int) -> int:
        """Runs of one cell along a row."""
        seen, last = 0, None
        for x in range(self.columns):
            here = self.grid[y].get(x)
            seen += here is not None and here != last
            last = here
        return seen

    def last_row(self) -> int | None:
        return next((y for y in reversed(range(len(self.rows))) if self.rows[y]), None)

    def html(self) -> str:
        rows = "".join("<tr>" + "".join(c.html() for c in r) + "</tr>" for r in self.rows)
        return f"<table><tbody>{rows}</tbody></table>" if self.body else f"<table>{rows}</table>"


def header_rows(a: HtmlTable, b: HtmlTable) -> int:
    """Leading rows that both tables share: by structure and text, else by text and drawn segments."""

    def run(same) -> int:
        most = min(len(a.rows), len(b.rows), MOST_HEADERS)
        return next((y for y in range(most) if not same(y)), most)

    spans = lambda t, y: [(c.span("colspan"), c.span("rowspan"), c.key()) for c in t.rows[y]]
    keys = lambda t, y: [c.key() for c in t.rows[y]]
    n = run(lambda y: a.effective[y] == b.effective[y] and spans(a, y) == spans(b, y))
    n = n or run(lambda y: keys(a, y) == keys(b, y) and a.segments(y) == b.segments(y))
    y = 0
    while n and y < n:  # rows that a header cell reaches belong to the header
        n = min(len(b.rows), max([n, *(y + c.span("rowspan") for c in b.rows[y] if c.span("rowspan") > 1)]))
        y += 1
    return n


def _fit(rows: list[list[Cell]], effective: list[int], model: list[Cell], other: list[Cell], columns: int) -> None:
    """Rows short of ``columns`` take the model row's spans, or widen their last cell."""
    for row, now in zip(rows, effective, strict=True):
        if not row or now >= columns or sum(c.span("colspan") for c in row) >= columns:
            continue
        if len(row) == len(model) and [c.span("colspan") for c in row] == [c.span("colspan") for c in other]:
            for cell, like in zip(row, [c.span("colspan") for c in model], strict=True):
                if like > 1:
                    cell.widen(like)
        else:
            row[-1].widen(row[-1].span("colspan") + columns - now)


def _continued(caption: dict) -> bool:
    text = " ".join(s["content"] for ln in caption.get("lines", []) for s in ln.get("spans", []) if s.get("content"))
    t = text.strip(" \t\r\n").translate(_WIDE).lower()
    from quire.functions.html import CONTINUED

    return t.endswith(CONTINUED) or bool(re.search(r"(?:^|[^a-z])continued$", t)) or "(continued)" in t


def _body_span(block: dict) -> tuple[dict | None, dict | None]:
    body = next((b for b in block.get("blocks", []) if b.get("type") == "table_body"), None)
    try:
        return body, body["lines"][0]["spans"][0] if body else None
    except (KeyError, IndexError):
        return body, None


def merge_pages(pages: list[dict]) -> list[dict]:
    """Joins tables that go on over a page break, from the last page to the first; changes ``pages``."""
    tables: dict[int, HtmlTable | None] = {}

    def table_of(block: dict) -> HtmlTable | None:
        if id(block) not in tables:
            span = _body_span(block)[1]
            tables[id(block)] = HtmlTable.parse(span["html"]) if span and span.get("html") else None
        return tables[id(block)]

    for before, page in reversed(list(zip(pages, pages[1:], strict=False))):
        if not page.get("para_blocks") or not before.get("para_blocks"):
            continue
        block, target = page["para_blocks"][0], before["para_blocks"][-1]
        if block.get("type") != "table" or target.get("type") != "table":
            continue
        cur, prev = table_of(block), table_of(target)
        if cur is None or prev is None:
            continue
        of = lambda b, kind: [x for x in b["blocks"] if x.get("type") == kind]
        body = _body_span(block)[0]
        under = lambda c: not _continued(c) and "bbox" in c and body and "bbox" in body and c["bbox"][1] >= body["bbox"][3]
        below = [c for c in of(block, "table_caption") if under(c)]
        above = [c for c in of(block, "table_caption") if not under(c)]
        notes = len(of(target, "table_footnote"))
        if (above and (not any(map(_continued, above)) or notes > 1)) or (not above and notes):
            continue
        w1, w2 = (b["bbox"][2] - b["bbox"][0] for b in (block, target))
        if min(w1, w2) <= 0 or abs(w1 - w2) / min(w1, w2) >= 0.1:
            continue
        n = header_rows(prev, cur)
        last = prev.last_row()
        if prev.columns != cur.columns:
            if last is None or n >= min(len(cur.rows), MOST_HEADERS + 1):
                continue
            if prev.effective[last] != cur.effective[n] and prev.actual[last] != cur.actual[n] and prev.segments(last) != cur.segments(n):
                continue
        if prev.rows and n < len(cur.rows):
            if prev.columns > cur.columns:
                _fit(cur.rows[n:], cur.effective[n:], prev.rows[-1], cur.rows[n], prev.columns)
            elif cur.columns > prev.columns:
                _fit(prev.rows, prev.effective, cur.rows[n], prev.rows[-1], cur.columns)
        prev.rows += cur.rows[n:]
        prev.scan()
        own_body, span = _body_span(target)
        index = own_body.get("index") if own_body else None
        kept = [b for b in target["blocks"] if b.get("type") != "table_footnote"]
        for k, note in enumerate(of(block, "table_footnote"), 1):
            moved = {**note, "cross_page": True}
            if isinstance(index, (int, float)):
                moved["index"] = int(index) + k
            else:
                moved.pop("index", None)
            kept.append(moved)
        target["blocks"] = kept
        span["html"] = prev.html()
        if below:
            page["para_blocks"][1:1] = [{**c, "type": "text"} for c in below]
            block["blocks"] = [b for b in block["blocks"] if b not in below]
        for b in block["blocks"]:
            b["lines"], b["lines_deleted"] = [], True
    return pages


def merge_json(s: str) -> str:
    """``merge_pages`` over a document's pages as JSON text."""
    return json.dumps(merge_pages(json.loads(s)), ensure_ascii=False)


_merged = over_text(merge_json)


def merged_pages(pages: Column, enabled: bool = True) -> Column:
    """``merge_json`` of a column, or the column as it is where merging is switched off."""
    return _merged(pages) if enabled else pages


def column_counts(html: Column) -> Column:
    """(columns, last effective, last actual, segments of the first row) of an HTML table, null without one."""

    def count(s: str):
        t = HtmlTable.parse(s)
        if t is None or not t.rows:
            return None
        y = t.last_row()
        return f"{t.columns},{t.effective[y] if y is not None else 0},{t.actual[y] if y is not None else 0},{t.segments(0)}"

    return F.transform(F.split(over_text(count)(html), ","), lambda x: x.cast("int"))
