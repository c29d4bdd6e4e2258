"""Queries over documents with every kind of block: pictures, tables, lists, code, charts and equations.

``visual_tree`` makes a document of three pages (the last one empty) of each part.  The SQL builds the
expected texts by concatenation, block by block, not by the rules' expressions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import render
from quire.plans.registry import query
from quire.schema import PAGE
from quire.session import table
from quire.sources import artifacts

OPTIONS = render.Options(bucket="images")


def visual_tree(spark, sf_dir):
    """(p_partkey, pdf_info) of each part."""
    k = F.col("p_partkey")
    s = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    none = F.lit(None)

    def span(kind, content=none, path=none, html=none):
        return F.struct(F.lit(kind).alias("type"), content.cast("string").alias("content"), path.cast("string").alias("image_path"), html.cast("string").alias("html"), none.cast("array<double>").alias("bbox"))

    line = lambda *spans: F.struct(none.cast("array<double>").alias("bbox"), F.array(*spans).alias("spans"))
    child = lambda kind, index, *lines: F.struct(
        F.lit(kind).alias("type"), (none if index is None else F.lit(float(index))).cast("double").alias("index"), none.cast("array<double>").alias("bbox"), F.array(*lines).alias("lines")
    )
    said = lambda kind, index, *parts: child(kind, index, line(span("text", s(*parts))))

    def block(kind, at, lines=(), blocks=(), sub=none, lang=none, level=none):
        x0 = F.when(k % 2 == 0, F.lit(-3.7)).otherwise(F.lit(10.0))
        children = F.array(*blocks) if blocks else none.cast("array<struct<type:string,index:double,bbox:array<double>,lines:array<struct<bbox:array<double>,spans:array<struct<type:string,content:string,image_path:string,html:string,bbox:array<double>>>>>>>")
        return F.struct(
            F.lit(kind).alias("type"), sub.cast("string").alias("sub_type"), lang.cast("string").alias("guess_lang"), level.cast("int").alias("level"), F.lit(float(at)).alias("index"),
            F.array(x0, F.lit(at * 9.0), F.lit(300.0), F.lit(at * 9.0 + 8.5)).alias("bbox"), (F.array(*lines) if lines else none.cast("array<struct<bbox:array<double>,spans:array<struct<type:string,content:string,image_path:string,html:string,bbox:array<double>>>>>")).alias("lines"), children.alias("blocks"),
        )

    html = F.when(k % 5 != 0, s('<table><tr><td colspan="2">', F.col("p_brand"), "</td></tr><tr><td><eq>x&lt;", k, '&#955;</eq></td><td><img src="s.png"></td></tr></table>'))
    first = [
        block("title", 0, [line(span("text", F.col("p_name")))], level=k % 6),
        block(
            "image", 1, sub=F.when(k % 3 == 0, "photo"),
            blocks=[said("image_caption", 2, "Figure ", k), child("image_body", 1, line(span("image", F.when(k % 4 == 0, s("seen ", F.col("p_brand"))), s("i", k, ".jpg")))), said("image_footnote", None, "note of ", F.col("p_brand"))],
        ),
        block("table", 2, blocks=[said("table_footnote", 3, "after ", k), said("table_caption", 1, "Table ", k), child("table_body", 2, line(span("table", path=s("t", k, ".png"), html=html)))]),
        block("list", 3, sub=F.when(k % 2 == 0, "text").otherwise("ref_text"), blocks=[said("text", 0, "item ", F.col("p_brand")), child("text", 1, line(span("text", F.when(k % 7 == 0, "   ").otherwise(s("* ", k)))))]),
        block(
            "code", 4, sub=F.when(k % 2 == 0, "code").otherwise("algorithm"), lang=F.when(k % 3 != 0, "py"),
            blocks=[said("code_caption", 0, "Listing ", k), child("code_body", 1, line(span("text", s("a_b = ", k))), line(span("text", F.lit("if x < 3:"))))],
        ),
    ]
    second = [
        block("interline_equation", 0, [line(span("interline_equation", s("E_", k), s("e", k, ".jpg")))]),
        block("chart", 1, blocks=[child("chart_body", 0, line(span("chart", F.lit("x,y"), s("c", k, ".jpg")))), said("chart_caption", 1, "Chart ", k)]),
        block("ref_text", 2, [line(span("text", s("Ref ", F.col("p_brand"))))]),
        block("phonetic", 3, [line(span("text", s("ph ", k)))]),
        block("abstract", 4, [line(span("text", F.lit("no form")))]),
        block("text", 5, [line(span("text", F.lit("# multi-"))), line(span("text", F.lit("part")), span("inline_equation", s("x_", k)), span("text", F.lit("end")))]),
    ]
    discarded = [block("header", 6, [line(span("text", s("head ", k)))])]
    empty = lambda: F.slice(F.array(*discarded), 1, 0)
    page = lambda i, para, gone: F.struct(
        F.lit(i).alias("page_idx"), F.array(F.lit(612.0), F.lit(792.0)).alias("page_size"), para.alias("para_blocks"), gone.alias("discarded_blocks"), empty().alias("preproc_blocks")
    )
    pages = F.array(page(0, F.array(*first), empty()), page(1, F.array(*second), F.array(*discarded)), page(2, empty(), empty()))
    return table(spark, sf_dir, "part").select("p_partkey", pages.cast(f"array<{PAGE}>").alias("pdf_info"))


_NL, _BR = "chr(10)", "'  ' || chr(10)"
_TABLE = "'<table><tr><td colspan=\"2\">' || p_brand || '</td></tr><tr><td> $x<' || k || 'λ$ </td><td><img src=\"images/s.png\"></td></tr></table>'"
_FENCE = f"'```' || CASE WHEN k % 3 <> 0 THEN 'py' ELSE 'txt' END || {_NL} || 'a_b = ' || k || ' if x < 3:' || {_NL} || '```'"
_DIV = f"'<div class=\"algorithm\" style=\"white-space: pre-wrap; font-family:monospace;\">' || {_NL} || 'a_b = ' || k || 'if x &lt; 3:' || {_NL} || '</div>'"
_DETAILS = f"'<details>' || {_NL} || '<summary>' || {{s}} || '</summary>' || {_NL} || {_NL} || {{c}} || {_NL} || '</details>'"
_PHOTO = "CASE WHEN k % 3 = 0 THEN 'photo' ELSE 'image content' END"

#: The Markdown of each block.
_PARTS = f"""v AS (SELECT p_partkey AS k, p_name, p_brand, least(greatest(CASE WHEN p_partkey % 6 < 1 THEN 0 ELSE p_partkey % 6 END, 0), 4)::INT AS lv FROM part),
m AS (SELECT k, trim(repeat('#', lv) || ' ' || p_name) AS title,
  '![](images/i' || k || '.jpg)' || CASE WHEN k % 4 = 0 THEN {_NL} || {_NL} || {_DETAILS.format(s=_PHOTO, c="'seen ' || p_brand")} || {_NL} || {_NL} ELSE {_BR} END || 'Figure ' || k || {_BR} || 'note of ' || p_brand AS image,
  'Table ' || k || CASE WHEN k % 5 = 0 THEN {_BR} || '![](images/t' || k || '.png)' || {_BR} ELSE {_NL} || {_NL} || {_TABLE} || {_NL} || {_NL} END || 'after ' || k AS tab,
  'item ' || p_brand || CASE WHEN k % 7 = 0 THEN '' ELSE {_BR} || '\\* ' || k END AS list,
  'Listing ' || k || CASE WHEN k % 2 = 0 THEN {_BR} || {_FENCE} ELSE {_NL} || {_NL} || {_DIV} END AS code,
  '$$' || {_NL} || 'E_' || k || {_NL} || '$$' AS eq,
  '![](images/c' || k || '.jpg)' || {_NL} || {_NL} || {_DETAILS.format(s="'chart content'", c="'x,y'")} || {_NL} || {_NL} || 'Chart ' || k AS chart,
  'Ref ' || p_brand AS ref, 'ph ' || k AS ph, '\\# multipart $x_' || k || '$ end' AS para FROM v)"""


def _joined(*names: str) -> str:
    return f"WITH {_PARTS} SELECT k AS p_partkey, " + f" || {_NL} || {_NL} || ".join(names) + " AS markdown FROM m"


@query("visual_markdown", _joined("title", "image", "tab", "list", "code", "eq", "chart", "ref", "ph", "para"))
def visual_markdown(spark, sf_dir):
    return visual_tree(spark, sf_dir).select("p_partkey", render.markdown(F.col("pdf_info"), "mm", OPTIONS).alias("markdown"))


@query("visual_nlp_markdown", _joined("title", "list", "code", "eq", "ref", "ph", "para"))
def visual_nlp_markdown(spark, sf_dir):
    return visual_tree(spark, sf_dir).select("p_partkey", render.markdown(F.col("pdf_info"), "nlp", OPTIONS).alias("markdown"))


@query("visual_plain_markdown", _joined("title", "image", "plain", "list", "code", "picture", "chart", "ref", "ph", "para").replace(" AS para FROM v", f" AS para, 'Table ' || k || {_BR} || '![](images/t' || k || '.png)' || {_BR} || 'after ' || k AS plain, '![](images/e' || k || '.jpg)' AS picture FROM v"))
def visual_plain_markdown(spark, sf_dir):
    """Tables and display formulas as pictures."""
    o = render.Options(bucket="images", formula=False, table=False)
    return visual_tree(spark, sf_dir).select("p_partkey", render.markdown(F.col("pdf_info"), "mm", o).alias("markdown"))


def _box(at: int) -> str:
    return f"'\"bbox\":[' || CASE WHEN k % 2 = 0 THEN -6 ELSE 16 END || ',{at * 9000 // 792},490,{int((at * 9 + 8.5) * 1000 / 792)}]'"


_J = "to_json({})::VARCHAR"
_KEY = lambda name, value: f"'\"{name}\":' || {_J.format(value)}"
_ARR = lambda name, value: f"'\"{name}\":[' || {_J.format(value)} || ']'"

#: Entries of the flat list: parts of each object, keys in alphabetical order.
_FLAT = [
    [_box(0), "'\"page_idx\":0'", _KEY("text", "p_name"), "CASE WHEN lv > 0 THEN '\"text_level\":' || lv END", "'\"type\":\"text\"'"],
    [_box(1), _KEY("content", "CASE WHEN k % 4 = 0 THEN 'seen ' || p_brand ELSE '' END"), _ARR("image_caption", "'Figure ' || k"), _ARR("image_footnote", "'note of ' || p_brand"), _KEY("img_path", "'images/i' || k || '.jpg'"), "'\"page_idx\":0'", "CASE WHEN k % 3 = 0 THEN '\"sub_type\":\"photo\"' END", "'\"type\":\"image\"'"],
    [_box(2), _KEY("img_path", "'images/t' || k || '.png'"), "'\"page_idx\":0'", f"CASE WHEN k % 5 <> 0 THEN {_KEY('table_body', _TABLE)} END", _ARR("table_caption", "'Table ' || k"), _ARR("table_footnote", "'after ' || k"), "'\"type\":\"table\"'"],
    [_box(3), f"'\"list_items\":[' || {_J.format(chr(39) + 'item ' + chr(39) + ' || p_brand')} || CASE WHEN k % 7 = 0 THEN '' ELSE ',' || {_J.format(chr(39) + chr(92) + '* ' + chr(39) + ' || k')} END || ']'", "'\"page_idx\":0'", _KEY("sub_type", "CASE WHEN k % 2 = 0 THEN 'text' ELSE 'ref_text' END"), "'\"type\":\"list\"'"],
    [_box(4), _KEY("code_body", f"CASE WHEN k % 2 = 0 THEN {_FENCE} ELSE {_DIV} END"), _ARR("code_caption", "'Listing ' || k"), "'\"page_idx\":0'", _KEY("sub_type", "CASE WHEN k % 2 = 0 THEN 'code' ELSE 'algorithm' END"), "'\"type\":\"code\"'"],
    [_box(0), "'\"page_idx\":1'", _KEY("text", f"'$$' || {_NL} || 'E_' || k || {_NL} || '$$'"), "'\"text_format\":\"latex\"'", "'\"type\":\"equation\"'"],
    [_box(1), _ARR("chart_caption", "'Chart ' || k"), "'\"chart_footnote\":[]'", _KEY("content", "'x,y'"), _KEY("img_path", "'images/c' || k || '.jpg'"), "'\"page_idx\":1'", "'\"type\":\"chart\"'"],
    [_box(2), "'\"page_idx\":1'", _KEY("text", "'Ref ' || p_brand"), "'\"type\":\"ref_text\"'"],
    [_box(3), "'\"page_idx\":1'", _KEY("text", "'ph ' || k"), "'\"type\":\"phonetic\"'"],
    [_box(4), "'\"page_idx\":1'"],
    [_box(5), "'\"page_idx\":1'", _KEY("text", "'\\# multipart $x_' || k || '$ end'"), "'\"type\":\"text\"'"],
    [_box(6), "'\"page_idx\":1'", _KEY("text", "'head ' || k"), "'\"type\":\"header\"'"],
]


def _object(parts: list[str]) -> str:
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


_HEAD = _PARTS.split("),\nm AS")[0] + ")"
_FLAT_LIST = "'[' || " + " || ',' || ".join(map(_object, _FLAT)) + " || ']'"


@query("visual_content_list", f"WITH {_HEAD} SELECT k AS p_partkey, {_FLAT_LIST} AS content_list FROM v")
def visual_content_list(spark, sf_dir):
    return visual_tree(spark, sf_dir).select("p_partkey", render.content_list(F.col("pdf_info"), OPTIONS).alias("content_list"))


def _spans(*spans: tuple[str, str]) -> str:
    return "'[' || " + " || ',' || ".join(f"'{{\"content\":' || {_J.format(c)} || ',\"type\":\"{kind}\"}}'" for c, kind in spans) + " || ']'"


_K = lambda name, value: f"'\"{name}\":' || {value}"
_TEXTS = lambda value: _spans((value, "text"))
_NESTED = "CASE WHEN k % 5 = 0 THEN '' ELSE {} END"
_ITEM = lambda value: "'{\"item_content\":' || " + _TEXTS(value) + " || ',\"item_type\":\"text\"}'"

#: Entries of the nested list: content, further keys and type.
_V2 = [
    (0, [f"CASE WHEN lv > 0 THEN {_K('level', 'lv')} END", f"CASE WHEN lv = 0 THEN {_K('paragraph_content', _TEXTS('p_name'))} END", f"CASE WHEN lv > 0 THEN {_K('title_content', _TEXTS('p_name'))} END"], "CASE WHEN lv > 0 THEN 'title' ELSE 'paragraph' END"),
    (1, [_KEY("content", "CASE WHEN k % 4 = 0 THEN 'seen ' || p_brand ELSE '' END"), _K("image_caption", _TEXTS("'Figure ' || k")), _K("image_footnote", _TEXTS("'note of ' || p_brand")), "'\"image_source\":{\"path\":\"images/i' || k || '.jpg\"}'"], "'image'"),
    (2, [_KEY("html", f"CASE WHEN k % 5 = 0 THEN '' ELSE {_TABLE} END"), "'\"image_source\":{\"path\":\"images/t' || k || '.png\"}'", _K("table_caption", _TEXTS("'Table ' || k")), _K("table_footnote", _TEXTS("'after ' || k")), "'\"table_nest_level\":1'", _KEY("table_type", "CASE WHEN k % 5 = 0 THEN 'simple_table' ELSE 'complex_table' END")], "'table'"),
    (3, [f"'\"list_items\":[' || {_ITEM(chr(39) + 'item ' + chr(39) + ' || p_brand')} || CASE WHEN k % 7 = 0 THEN '' ELSE ',' || {_ITEM(chr(39) + '* ' + chr(39) + ' || k')} END || ']'", _KEY("list_type", "CASE WHEN k % 2 = 0 THEN 'text_list' ELSE 'reference_list' END")], "'list'"),
    (4, ["CASE WHEN k % 2 = 1 THEN " + _K("algorithm_caption", _TEXTS("'Listing ' || k")) + " END", "CASE WHEN k % 2 = 1 THEN " + _K("algorithm_content", _TEXTS("'a_b = ' || k || ' if x < 3:'")) + " END", "CASE WHEN k % 2 = 0 THEN " + _K("code_caption", _TEXTS("'Listing ' || k")) + " END", "CASE WHEN k % 2 = 0 THEN " + _K("code_content", _TEXTS("'a_b = ' || k || ' if x < 3:'")) + " END", "CASE WHEN k % 2 = 0 THEN " + _KEY("code_language", "CASE WHEN k % 3 <> 0 THEN 'py' ELSE 'txt' END") + " END"], "CASE WHEN k % 2 = 0 THEN 'code' ELSE 'algorithm' END"),
    (0, ["'\"image_source\":{\"path\":\"images/e' || k || '.jpg\"}'", _KEY("math_content", "'E_' || k"), "'\"math_type\":\"latex\"'"], "'equation_interline'"),
    (1, [_K("chart_caption", _TEXTS("'Chart ' || k")), "'\"chart_footnote\":[]'", "'\"content\":\"x,y\"'", "'\"image_source\":{\"path\":\"images/c' || k || '.jpg\"}'"], "'chart'"),
    (2, [f"'\"list_items\":[' || {_ITEM(chr(39) + 'Ref ' + chr(39) + ' || p_brand')} || ']'", "'\"list_type\":\"reference_list\"'"], "'list'"),
    (3, [_K("paragraph_content", _spans(("'ph ' || k", "phonetic")))], "'paragraph'"),
    (4, None, None),
    (5, [_K("paragraph_content", _spans(("'# multipart '", "text"), ("'x_' || k", "equation_inline"), ("'end'", "text")))], "'paragraph'"),
    (6, [_K("page_header_content", _TEXTS("'head ' || k"))], "'page_header'"),
]


def _object_v2(at: int, content: list[str] | None, kind: str | None) -> str:
    if content is None:
        return _object([_box(at)])
    sub = ["CASE WHEN k % 3 = 0 THEN '\"sub_type\":\"photo\"' END"] if kind == "'image'" else []
    return _object([_box(at), "'\"content\":' || " + _object(content), *sub, _KEY("type", kind)])


_PAGE_1, _PAGE_2 = ("'[' || " + " || ',' || ".join(_object_v2(*e) for e in part) + " || ']'" for part in (_V2[:5], _V2[5:]))
_V2_LIST = f"'[' || {_PAGE_1} || ',' || {_PAGE_2} || ',[]]'"


@query("visual_content_list_v2", f"WITH {_HEAD} SELECT k AS p_partkey, {_V2_LIST} AS content_list FROM v")
def visual_content_list_v2(spark, sf_dir):
    return visual_tree(spark, sf_dir).select("p_partkey", render.content_list_v2(F.col("pdf_info"), OPTIONS).alias("content_list"))


@query(
    "visual_response",
    f"""WITH {_HEAD}, md AS ({_joined("title", "image", "tab", "list", "code", "eq", "chart", "ref", "ph", "para")})
    SELECT k AS p_partkey, '{{"md_content":' || to_json(markdown)::VARCHAR || ',"content_list":' || {_FLAT_LIST} || ',"images":{{"i' || k || '.jpg":"AAAA"}},"layout_pdf":"JVBERi0=","timing":{{"total":' || k || '}}}}' AS response FROM v JOIN md ON k = p_partkey""",
)
def visual_response(spark, sf_dir):
    images = F.create_map(F.concat(F.lit("i"), F.col("p_partkey").cast("string"), F.lit(".jpg")), F.lit("AAAA"))
    rows = visual_tree(spark, sf_dir)
    return artifacts.response(rows, "pdf_info", images, F.lit("JVBERi0="), F.create_map(F.lit("total"), F.col("p_partkey")), OPTIONS).select("p_partkey", "response")
