"""Scenarios of the operators on hand-written input."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quire.functions import html, latex, text
from quire.functions.register import register
from quire.operators import chars, formula, layout, ocr, render, tables, vlm
from quire.schema import DOCUMENT
from quire.sources import artifacts, files, runner
from quire.streaming import documents


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).collect()[0].r


# ---- text ------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.half_width, "ＡＢ１！", "AB1！"),
        (text.half_width_all, "ＡＢ１！", "AB1!"),
        (text.strip, " \t\x0b a b\x0c\n", "a b"),
        (text.escape_markdown, r"a*b \* \\* $", r"a\*b \* \\\* \$"),
        (text.escape_prefix, "  # x", r"  \# x"),
        (text.escape_prefix, "####### x", "####### x"),
        (text.escape_prefix, "+x", "+x"),
        (text.ends_in_hyphen, "word-  ", True),
        (text.ends_in_hyphen, "1-", False),
        (text.script_language, "漢字かな", "ja"),
        (text.script_language, "漢字", "zh"),
        (text.script_language, "한글漢", "ko"),
        (text.script_language, "", ""),
        (text.html_escape_quotes, "<a href='x'>&\"", "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"),
        (html.html_unescape, "&lt;&#65;&#x42;&amp;lt;&unknown;&#8364;", "<AB&lt;&unknown;€"),
        (html.table_unescape, "&amp;lt;&#65;", "&lt;&#65;"),
        (lambda c: html.image_prefix(c, "b"), '<img src="x.png"><img src="data:y">', '<img src="b/x.png"><img src="data:y">'),
        (html.equation_tags, "a<eq>x &lt; y</eq>b<eq>z</eq>", "a $x < y$ b $z$ "),
        (html.is_continued, "Table 3（Continued）", True),
        (html.is_continued, "discontinued", False),
        (html.is_continued, "续表", True),
        (lambda c: html.attribute(c, "colspan"), '<td class="x" colspan=3>', "3"),
        (latex.display_to_inline, r"\[1, 2–3\] \[x\]", r"\[1, 2–3\] \(x\)"),
        (latex.strip_delimiters, r" \[ x \] ", "x"),
        (latex.formula_tag, " （ 12 ) ", "12"),
        (latex.space_macros, r"\(a \tox \inf \int \top \subseta\) \tox", r"\(a \to x \inf \int \top \subset a\) \tox"),
        (latex.move_underscores, r"\(a___b\)", r"\(a\) ___ \(b\)"),
        (latex.balance_braces, r"{a}} \} {b", r"{a} \} b"),
        (latex.balance_braces, r"\\{a", r"\\a"),
    ],
)
def test_functions(spark, f, value, want):
    assert one(spark, value, f) == want
    assert one(spark, None, f) is None or f is text.script_language


def test_sql_functions(spark):
    assert "quire_otsl_html" in register(spark)
    row = spark.sql("SELECT quire_strip(' a ') AS a, quire_escape_markdown('x*y') AS b, quire_otsl_html('<fcel>1<nl>') AS c, quire_title_level(9) AS d").collect()[0]
    assert tuple(row) == ("a", r"x\*y", "<table><tr><td>1</td></tr></table>", 4)


# ---- rendering ---------------------------------------------------------------------


def span(content, kind="text", **more):
    return {"type": kind, "content": content, **more}


def block(kind, *lines, **more):
    return {"type": kind, "lines": [{"spans": list(x)} for x in lines], "bbox": [10, 20, 110, 220], **more}


DOC = {
    "pdf_info": [
        {
            "page_idx": 0,
            "page_size": [200, 400],
            "para_blocks": [
                block("title", [span("Head*line")], level=2),
                block("text", [span("An exam-")], [span("ple of ＡＢ "), span("x^2", "inline_equation"), span("end")]),
                block("text", [span("漢字")], [span("続き")]),
                block("text", [span("# not a heading")]),
                block("interline_equation", [span("E=mc^2", "interline_equation")]),
                {"type": "image", "bbox": [0, 0, 1, 1], "blocks": [block("image_caption", [span("Fig 1")], index=2), block("image_body", [span("a chart", "image", image_path="p.jpg")], index=1)]},
                {"type": "table", "bbox": [0, 0, 1, 1], "blocks": [block("table_caption", [span("T")], index=1), block("table_body", [span("", "table", html="<table></table>")], index=2)]},
                {"type": "list", "sub_type": "text", "bbox": [0, 0, 1, 1], "blocks": [block("text", [span("- one")]), block("text", [span("two")])]},
                {"type": "code", "sub_type": "code", "guess_lang": "py", "bbox": [0, 0, 1, 1], "blocks": [block("code_body", [span("a*b")], [span("c")])]},
                {"type": "code", "sub_type": "algorithm", "bbox": [0, 0, 1, 1], "blocks": [block("code_body", [span("if <x>"), span("y", "inline_equation"), span("z", "inline_equation")])]},
                block("abstract", [span("vanishes")]),
            ],
            "discarded_blocks": [block("header", [span("Journal")])],
            "extra": {"kept": None},
        },
        {"page_idx": 1, "page_size": [200, 400]},
    ],
    "_backend": "pipeline",
}
MARKDOWN = """## Head\\*line

An example of AB $x^2$ end

漢字続き

\\# not a heading

$$
E=mc^2
$$

![](images/p.jpg)

<details>
<summary>image content</summary>

a chart
</details>

Fig 1

T

<table></table>

- one  
two

```py
a*b c
```

<div class="algorithm" style="white-space: pre-wrap; font-family:monospace;">
if &lt;x&gt;$y$ $z$
</div>"""


@pytest.fixture(scope="module")
def tree(spark):
    return files.parse_documents(spark.createDataFrame([(json.dumps(DOC),)], "j string"), "j")


def test_markdown(tree):
    o = render.Options(bucket="images")
    got = tree.select(render.markdown(F.col("document.pdf_info"), "mm", o).alias("m")).collect()[0].m
    assert got == MARKDOWN
    plain = tree.select(render.markdown(F.col("document.pdf_info"), "nlp", o).alias("m")).collect()[0].m
    assert "Fig 1" not in plain and "<table>" not in plain and "```py" in plain


def test_content_list(tree):
    got = json.loads(tree.select(render.content_list(F.col("document.pdf_info"), render.Options(bucket="images")).alias("c")).collect()[0].c)
    assert len(got) == 12
    assert got[0] == {"type": "text", "text": "Head\\*line", "text_level": 2, "bbox": [50, 50, 550, 550], "page_idx": 0}
    assert got[4]["type"] == "equation" and got[4]["text_format"] == "latex"
    assert got[5]["img_path"] == "images/p.jpg" and got[5]["image_caption"] == ["Fig 1"] and got[5]["image_footnote"] == []
    assert got[6]["table_body"] == "<table></table>" and got[6]["img_path"] == ""
    assert got[7]["list_items"] == ["- one", "two"]
    assert set(got[10]) == {"bbox", "page_idx"}
    assert got[11]["type"] == "header" and got[11]["text"] == "Journal"


def test_content_list_v2(tree):
    got = json.loads(tree.select(render.content_list_v2(F.col("document.pdf_info"), render.Options(bucket="images")).alias("c")).collect()[0].c)
    assert len(got) == 2 and got[1] == [] and len(got[0]) == 12
    page = got[0]
    assert page[0] == {"type": "title", "content": {"level": 2, "title_content": [{"type": "text", "content": "Head*line"}]}, "bbox": [50, 50, 550, 550]}
    assert page[1]["content"]["paragraph_content"] == [
        {"type": "text", "content": "An example of AB  "}, {"type": "equation_inline", "content": "x^2"}, {"type": "text", "content": "end"},
    ]
    assert page[4]["content"] == {"image_source": {"path": "images/"}, "math_content": "E=mc^2", "math_type": "latex"}
    assert page[5]["content"]["image_caption"] == [{"type": "text", "content": "Fig 1"}] and page[5]["content"]["content"] == "a chart"
    assert page[6]["content"]["table_type"] == "simple_table" and page[6]["content"]["table_nest_level"] == 1
    assert [i["item_content"][0]["content"] for i in page[7]["content"]["list_items"]] == ["- one", "two"]
    assert page[8]["content"]["code_language"] == "py" and page[9]["type"] == "algorithm"
    assert set(page[10]) == {"bbox"} and page[11]["type"] == "page_header"


def test_unknown_code_raises(spark):
    bad = {"pdf_info": [{"page_idx": 0, "page_size": [1, 1], "para_blocks": [{"type": "code", "sub_type": "odd", "blocks": [block("code_body", [span("x")])]}]}]}
    rows = files.parse_documents(spark.createDataFrame([(json.dumps(bad),)], "j string"), "j")
    with pytest.raises(Exception, match="unknown code sub_type"):
        rows.select(render.markdown(F.col("document.pdf_info"))).collect()


def test_json_keeps_unknown_keys(tree):
    got = json.loads(tree.select(files.dump_document(F.col("raw")).alias("r")).collect()[0].r)
    assert got == DOC
    row = tree.select("document").collect()[0].document
    assert row.pdf_info[1].para_blocks == [] and row.pdf_info[1].preproc_blocks is None


# ---- layout ------------------------------------------------------------------------


def regions(spark, rows):
    return spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], "page_id long, index int, type string, x0 int, y0 int, x1 int, y1 int")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("caption", 0, 0, 10, 2), ("table", 0, 3, 10, 9), ("text", 0, 10, 10, 20)], {1: 2}),
        ([("table", 0, 0, 10, 5), ("caption", 0, 6, 10, 7), ("table", 0, 8, 10, 13)], {2: 3}),
        ([("table", 0, 0, 10, 5), ("footnote", 0, 6, 10, 7), ("table", 0, 8, 10, 13)], {2: 1}),
        ([("footnote", 0, 0, 10, 2), ("table", 0, 3, 10, 9)], {}),
        ([("caption", 0, 0, 10, 2), ("text", 0, 3, 10, 5), ("image", 0, 6, 10, 9)], {}),
        ([("caption", 0, 0, 10, 2), ("text", 50, 30, 60, 35), ("image", 0, 6, 10, 9)], {1: 3}),
        ([("image", 0, 0, 10, 5), ("caption", 0, 20, 10, 22), ("image", 0, 23, 10, 30)], {2: 3}),
        ([("caption", 0, 0, 10, 2), ("caption", 0, 2, 10, 4), ("chart", 0, 5, 10, 9)], {1: 3, 2: 3}),
        ([("caption", 0, 0, 10, 2)], {}),
    ],
)
def test_visual_parents(spark, rows, want):
    assert {r.child: r.parent for r in layout.visual_parents(regions(spark, rows)).collect()} == want


boxes = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(3, 30), st.integers(3, 30)), min_size=1, max_size=12)


@settings(max_examples=8, deadline=None)
@given(st.lists(boxes, min_size=1, max_size=12))
def test_lines_equal_the_loop(spark, pages):
    rows = [(p, i, x, y, x + w, y + h) for p, page in enumerate(pages) for i, (x, y, w, h) in enumerate(page)]
    df = spark.createDataFrame(rows, "page_id long, det_pos int, x0 int, y0 int, x1 int, y1 int").withColumn("index", F.lit(1))
    got = {(r.page_id, r.det_pos): (r.line_no, r.span_no) for r in layout.span_lines(df).collect()}
    for p in range(len(pages)):
        own = sorted((r for r in rows if r[0] == p), key=lambda r: r[3])
        lines = [[own[0]]]
        for r in own[1:]:
            last = lines[-1][-1]
            height, both = min(r[5] - r[3], last[5] - last[3]), max(0, min(r[5], last[5]) - max(r[3], last[3]))
            if both > 0.6 * height:
                lines[-1].append(r)
            else:
                lines.append([r])
        want = {(p, r[1]): (n, k) for n, line in enumerate(lines) for k, r in enumerate(sorted(line, key=lambda r: r[2]))}
        assert {k: v for k, v in got.items() if k[0] == p} == want


def test_reading_sort(spark):
    df = spark.createDataFrame([(1, 0, 50.0, 4.0), (1, 1, 10.0, 9.0), (1, 2, 5.0, 30.0)], "page_id long, det_pos int, x0 double, y0 double")
    got = {r.det_pos: r.order for r in ocr.reading_sort(df, ["page_id"]).collect()}
    assert got == {1: 0, 0: 1, 2: 2}


# ---- formulas, layout text, characters ----------------------------------------------------


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("interline_equation", "E"), ("formula_number", "(1)")], [("interline_equation", r"E\tag{1}")]),
        ([("text", "t"), ("formula_number", "（2）"), ("interline_equation", "E")], [("text", "t"), ("interline_equation", r"E\tag{2}")]),
        ([("formula_number", "(3)"), ("text", "t")], [("text", "(3)"), ("text", "t")]),
        ([("interline_equation", "E"), ("formula_number", "(1)"), ("formula_number", "(2)")], [("interline_equation", r"E\tag{1}\tag{2}")]),
        ([("formula_number", "(1)"), ("interline_equation", "E"), ("formula_number", "(2)")], [("text", "(1)"), ("interline_equation", r"E\tag{2}")]),
        ([("interline_equation", " "), ("formula_number", "(1)")], [("interline_equation", " "), ("text", "(1)")]),
    ],
)
def test_formula_numbers(spark, rows, want):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "page_id long, index int, type string, text string")
    got = formula.tag_formulas(df, ["page_id"]).orderBy("index").collect()
    assert [(r.type, r.text) for r in got] == want


def test_layout_text(spark):
    s = (
        "<|box_start|>10 20 5 40<|box_end|><|ref_start|>TEXT<|ref_end|>txt_contd_tgt<|box_start|>0 0 1001 5<|box_end|><|ref_start|>text<|ref_end|>"
        "<|box_start|>1 1 2 2<|box_end|><|ref_start|>unknown<|ref_end|><|rotate_down|>\n<|box_start|>1 1 2 2<|box_end|><|ref_start|>other<|ref_end|>"
    )
    got = vlm.parse_layout(spark.createDataFrame([(1, s)], "p int, s string"), "s", ["p"]).orderBy("pos").collect()
    assert [(r.type, r.x0, r.x1, r.angle, r.merge_prev) for r in got] == [("text", 0.005, 0.01, None, True), ("image", 0.001, 0.002, 180, False)]


def test_code_points():
    assert chars.code_points([0x41, 0, 0xD835, 0xDC00, 0xD800, 0x110000]) == "A𝐀��"


# ---- tables --------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("stream", "want"),
    [
        ("<fcel>a<fcel>b<nl><fcel>c<ecel><nl>", "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td></td></tr></table>"),
        ("<fcel>a<lcel><nl><fcel>b<fcel>c<nl>", '<table><tr><td colspan="2">a</td></tr><tr><td>b</td><td>c</td></tr></table>'),
        ("<fcel>a<fcel>b<nl><ucel><fcel>c<nl>", '<table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table>'),
        ("<fcel>a<lcel><nl><ucel><xcel><nl>", '<table><tr><td rowspan="2" colspan="2">a</td></tr><tr></tr></table>'),
        ("<fcel>a<nl><fcel>b<fcel><&><nl>", "<table><tr><td>a</td><td></td></tr><tr><td>b</td><td>&lt;&amp;&gt;</td></tr></table>"),
        ("  ", ""),
        ("no cells", ""),
        ("<table>x</table>", "<table>x</table>"),
    ],
)
def test_otsl(stream, want):
    assert tables.tokens_to_html(stream) == want


def table_page(html_rows, caption=None, footnotes=(), width=100, index=5):
    body = {"type": "table_body", "bbox": [0, 10, width, 50], "index": index, "lines": [{"spans": [{"type": "table", "html": f"<table>{html_rows}</table>"}]}]}
    blocks = [body]
    if caption:
        blocks.insert(0, {"type": "table_caption", "bbox": [0, 0, width, 9], "lines": [{"spans": [{"type": "text", "content": caption}]}]})
    blocks += [{"type": "table_footnote", "bbox": [0, 51, width, 60], "lines": [{"spans": [{"type": "text", "content": f}]}]} for f in footnotes]
    return {"para_blocks": [{"type": "table", "bbox": [0, 0, width, 60], "blocks": blocks}]}


def rows_of(*rows):
    return "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r.split()) + "</tr>" for r in rows)


def merged_html(*pages):
    done = json.loads(tables.merge_json(json.dumps(list(pages))))
    return [next(b for b in p["para_blocks"][0]["blocks"] if b["type"] == "table_body")["lines"] for p in done], done


def test_merge_drops_the_repeated_header():
    lines, done = merged_html(table_page(rows_of("h k", "1 2")), table_page(rows_of("h k", "3 4"), footnotes=["note"]))
    assert lines[0][0]["spans"][0]["html"] == f"<table>{rows_of('h k', '1 2', '3 4')}</table>"
    assert lines[1] == [] and done[1]["para_blocks"][0]["blocks"][0]["lines_deleted"]
    note = done[0]["para_blocks"][0]["blocks"][-1]
    assert note["cross_page"] and note["index"] == 6 and note["type"] == "table_footnote"


def test_merge_chain_of_three():
    lines, _ = merged_html(*(table_page(rows_of("h k", f"{i} {i}")) for i in range(3)))
    assert lines[0][0]["spans"][0]["html"] == f"<table>{rows_of('h k', '0 0', '1 1', '2 2')}</table>"


@pytest.mark.parametrize(
    ("first", "second", "joins"),
    [
        (table_page(rows_of("a b")), table_page(rows_of("c d"), caption="Table 2"), False),
        (table_page(rows_of("a b")), table_page(rows_of("c d"), caption="Table 1 (continued)"), True),
        (table_page(rows_of("a b"), footnotes=["n"]), table_page(rows_of("c d")), False),
        (table_page(rows_of("a b")), table_page(rows_of("c d e")), False),
        (table_page(rows_of("a b")), table_page(rows_of("c d"), width=150), False),
        (table_page("<tr><td colspan='2'>a</td><td>b</td></tr>"), table_page(rows_of("c d")), True),
    ],
)
def test_merge_gates(first, second, joins):
    lines, _ = merged_html(first, second)
    assert (lines[1] == []) is joins


def test_merge_widens_the_narrow_table():
    lines, _ = merged_html(table_page('<tr><td colspan="2">a</td><td>b</td></tr>'), table_page(rows_of("c d")))
    assert lines[0][0]["spans"][0]["html"].endswith('<tr><td colspan="2">c</td><td>d</td></tr></table>')


def test_table_grid():
    t = tables.HtmlTable.parse('<table><tr><td rowspan="2">a</td><td colspan=2>b</td></tr><tr><td>c</td></tr></table>')
    assert (t.columns, t.effective, t.actual, t.segments(0), t.segments(1)) == (3, [3, 2], [3, 1], 2, 2)


# ---- files, runner, streams -----------------------------------------------------------------


def test_hash_offset():
    assert artifacts.fnv_hex(b"") == f"{1469598103934665603:016x}"
    assert len(artifacts.fnv_hex(b"abc")) == 16


def test_pictures_leave_the_tree(spark):
    df = spark.createDataFrame([(1, "data:image/png;base64,QUJD"), (1, "data:image/png;base64,QUJD"), (2, "x.jpg"), (3, None)], "d int, p string")
    rows, pictures = artifacts.externalise(df, "d", "p")
    assert pictures.count() == 1
    assert sorted(str(r.p) for r in rows.collect()) == sorted([artifacts.fnv_hex(b"QUJD") + ".jpg"] * 2 + ["x.jpg", "None"])


def test_jpeg_in_pdf(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04xx\xff\xc0\x00\x0b\x08\x00\x64\x00\xc8\x01\x01\x11\x00\xff\xd9"
    (tmp_path / "a.jpg").write_bytes(jpeg)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 x")
    got = {r.kind: bytes(r.content) for r in files.as_pdf(files.accept(files.read_files(spark, str(tmp_path)))).collect()}
    assert got["pdf"] == b"%PDF-1.4 x" and jpeg in got["jpeg"] and b"MediaBox [0 0 72.0000 36.0000]" in got["jpeg"]
    (tmp_path / "c.txt").write_text("no")
    with pytest.raises(Exception, match="neither PDF nor image"):
        files.accept(files.read_files(spark, str(tmp_path))).collect()


def test_runner_falls_back(spark):
    class Fails:  # local, so that it travels by value
        def load(self):
            pass

        def run(self, rows):
            raise RuntimeError("no device")

    df = spark.range(5)
    assert runner.apply_runner(df, runner.Identity, "same", "id long").count() == 5
    assert runner.apply_runner(df, Fails, "fails", "id long", runner.Identity).count() == 5
    with pytest.raises(Exception, match="no device"):
        runner.apply_runner(df, Fails, "fails2", "id long").collect()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(DOC))
    out = documents.render_stream(documents.read_documents(spark, str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("rendered").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rendered").collect()[0].markdown.startswith("## Head")


def test_artefacts_are_written(spark, tmp_path, tree):
    rows = artifacts.artefacts(tree.select(F.lit("doc").alias("stem"), F.col("document.pdf_info").alias("pages")), "stem", "pages")
    artifacts.write_artefacts(rows, str(tmp_path / "out"))
    back = {r.artefact: r.value for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()}
    assert back[".md"].startswith("## Head") and len(json.loads(back["_content_list.json"])) == 12


def test_schema_parses(spark):
    assert spark.sql(f"SELECT from_json('{{}}', '{DOCUMENT}') AS d").count() == 1


# ---- ruled tables and pixels ------------------------------------------------------------------


def test_wired_grid():
    import numpy as np
    from quire.operators import wired

    boxes = np.array([[0, 0, 100, 30], [100, 0, 200, 60], [0, 30, 50, 60], [50, 30, 100, 60], [0, 60, 200, 90]], float)
    order = wired.cell_order(boxes)
    grid = wired.recover_grid(boxes[order])
    assert dict(zip(order, grid, strict=True)) == {0: (0, 0, 0, 1), 1: (0, 1, 2, 2), 2: (1, 1, 0, 0), 3: (1, 1, 1, 1), 4: (2, 2, 0, 2)}
    got = wired.grid_html(boxes[order], grid, [f"t{i}" for i in order])
    assert got == (
        "<html><body><table><tr><td rowspan=1 colspan=2>t0</td><td rowspan=2 colspan=1>t1</td></tr><tr><td rowspan=1 colspan=1>t2</td><td rowspan=1 colspan=1>t3</td></tr>"
        "<tr><td rowspan=1 colspan=3>t4</td></tr></table></body></html>"
    )
    assert wired.recover_grid(np.empty((0, 4))) == [] and "<table></table>" in wired.grid_html(np.empty((0, 4)), [], [])
    assert wired.cell_text([(40, 0, 60, 9, "b"), (0, 0, 10, 9, "a")]) == "a   b"


def test_pixels():
    import numpy as np
    from quire.operators import pixels

    image = np.arange(60, dtype=np.uint8).reshape(6, 10)
    assert pixels.crop(image, (1.2, 0.5, 3.1, 2)).tolist() == image[0:2, 1:4].tolist()
    assert pixels.turn_tall(np.zeros((6, 2))).shape == (2, 6)
    assert pixels.quad_crop(image, [[1, 1], [9, 1], [9, 4], [1, 4]]).tolist() == image[1:4, 1:9].tolist()
    mask = np.zeros((5, 6), bool)
    mask[0, 0] = mask[1, 1] = mask[4, 3:6] = True
    assert sorted(len(r) for r in pixels.regions(mask)) == [2, 3]
    prob = np.zeros((20, 40))
    prob[5:10, 5:30] = 0.9
    (box, score), = pixels.text_boxes(prob, 80, 40)
    assert abs(score - 0.9) < 1e-9 and box == [4, 4, 66, 26]
    matrix, grid = pixels.patches(np.zeros((3, 56, 28)))
    assert matrix.shape == (8, 1176) and grid == (4, 2)


def test_text_fill_recognises_what_characters_leave(spark):
    spans = spark.createDataFrame([(1, 0, 0, 0, 40, 10), (1, 1, 0, 20, 40, 30), (2, 0, 0, 0, 40, 10), (2, 1, 0, 20, 40, 30)], "page_id int, span_pos int, x0 int, y0 int, x1 int, y1 int")
    letters = spark.createDataFrame([(1, 0, "a", 1.0, 1.0, 6.0, 9.0), (1, 1, "b", 12.0, 1.0, 17.0, 9.0)], "page_id int, idx int, c string, x0 double, y0 double, x1 double, y1 double")
    said = lambda left: left.select("page_id", "span_pos", F.lit("seen").alias("text"), F.when(F.col("span_pos") == 1, 0.5).otherwise(0.9).alias("score"))
    got = {(r.page_id, r.span_pos): (r.text, r.score) for r in chars.fill_text(letters, spans, said).collect()}
    assert got == {(1, 0): ("a b", 1.0), (1, 1): ("", 0.0), (2, 0): ("seen", 0.9), (2, 1): ("", 0.0)}
    assert {r.text for r in chars.fill_text(letters, spans).collect()} == {"a b", ""}


def test_grid_edges_near_the_last_column():
    import numpy as np
    from quire.operators import wired

    boxes = np.array([[0, 0, 50, 10], [100, 0, 110, 10], [0, 12, 50, 30], [112, 12, 130, 30]], float)
    assert wired.recover_grid(boxes)[-1][2] == 3
