"""Rendering of the document tree: Markdown and content lists.

A page's blocks are nested columns, so rendering is one expression for each
document: no shuffle, no user function.  ``following`` (does a later span in the
block join?) is the comparison of a position with the last joinable one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import html, text
from quire.functions.text import let


@dataclass(frozen=True)
class Options:
    bucket: str = ""
    formula: bool = True
    table: bool = True
    inline: tuple[str, str] = ("$", "$")
    display: tuple[str, str] = ("$$", "$$")
    algorithm_class: str = "algorithm"


def _lines(block: Column) -> Column:
    return F.coalesce(block["lines"], F.array().cast("array<struct<bbox:array<double>,spans:array<struct<type:string,content:string,image_path:string,html:string,bbox:array<double>>>>>"))


def _spans(block: Column) -> Column:
    """All spans of a block in order, each with its place in the line and what the next line starts with."""
    lines = _lines(block)

    def of_line(line, i):
        spans = F.coalesce(line["spans"], F.array().cast("array<struct<type:string,content:string,image_path:string,html:string,bbox:array<double>>>"))
        head = F.get(F.get(lines, i + 1)["spans"], F.lit(0))
        lower = F.coalesce((head["type"] == "text") & head["content"].rlike("\\A[a-z]"), F.lit(False))
        return F.transform(
            spans,
            lambda s, j: F.struct(
                s["type"].alias("type"),
                F.when(s["type"] == "text", text.half_width(F.coalesce(s["content"], F.lit("")))).otherwise(F.coalesce(s["content"], F.lit(""))).alias("content"),
                F.coalesce(s["image_path"], F.lit("")).alias("image_path"),
                F.coalesce(s["html"], F.lit("")).alias("html"),
                (j == F.size(spans) - 1).alias("last"),
                lower.alias("lower_next"),
            ),
        )

    return F.flatten(F.transform(lines, of_line))


def _last_joinable(spans: Column) -> Column:
    join = lambda s: s["type"].isin("text", "inline_equation") & ~text.is_blank(s["content"])
    return F.coalesce(F.array_max(F.transform(spans, lambda s, k: F.when(join(s), k).otherwise(-1))), F.lit(-1))


def _cjk(spans: Column) -> Column:
    return text.is_cjk(F.array_join(F.transform(F.filter(spans, lambda s: s["type"] == "text"), lambda s: s["content"]), ""))


def inline_text(block: Column, o: Options = Options(), escape: bool = True, prefix: bool = True, formula: bool = True) -> Column:
    """The spans of a block as one text: escapes, equations, hyphenation and spacing between spans."""

    def shown(s):
        plain = text.escape_markdown(s["content"]) if escape else s["content"]
        display = (
            F.concat(F.lit(f"\n{o.display[0]}\n"), s["content"], F.lit(f"\n{o.display[1]}\n"))
            if formula
            else F.when(s["image_path"] != "", F.concat(F.lit("![]("), text.media_path(o.bucket, s["image_path"]), F.lit(")"))).otherwise("")
        )
        own = (
            F.when(s["type"] == "text", plain)
            .when(s["type"] == "inline_equation", F.concat(F.lit(o.inline[0]), s["content"], F.lit(o.inline[1])))
            .when(s["type"] == "interline_equation", display)
            .otherwise("")
        )
        return text.strip(own)

    def spaced(spans):
        def bound(x):
            last, cjk = x["last"], x["cjk"]

            def piece(s, k):
                def ended(c):
                    more = last > k
                    spacious = F.when(more, F.concat(c, F.lit(" "))).otherwise(c)
                    inline_eq = s["type"] == "inline_equation"
                    hyphen = s["last"] & (s["type"] == "text") & text.ends_in_hyphen(c)
                    return (
                        F.when((c == "") | (s["type"] == "interline_equation"), c)
                        .when(cjk, F.when(more & (~s["last"] | inline_eq), F.concat(c, F.lit(" "))).otherwise(c))
                        .when(~s["type"].isin("text", "inline_equation"), "")
                        .when(hyphen, F.when(s["lower_next"], text.without_last(c)).otherwise(c))
                        .otherwise(spacious)
                    )

                return let(shown(s), ended)

            return F.array_join(F.transform(spans, piece), "")

        return let(F.struct(_last_joinable(spans).alias("last"), _cjk(spans).alias("cjk")), bound)

    joined = let(_spans(block), spaced)
    if prefix:
        joined = let(joined, lambda t: F.when(block["type"] == "text", text.escape_prefix(t)).otherwise(t))
    return joined


def algorithm_html(block: Column, o: Options) -> Column:
    """Text and inline equations in a preformatted div; a space parts neighbouring equations."""
    spans = F.filter(_spans(block), lambda s: ((s["type"] == "text") & (s["content"] != "")) | ((s["type"] == "inline_equation") & ~text.is_blank(s["content"])))

    def body(own):
        part = lambda s, k: F.concat(
            F.when((s["type"] == "inline_equation") & (F.coalesce(F.get(own, k - 1)["type"], F.lit("")) == "inline_equation"), " ").otherwise(""),
            F.when(s["type"] == "text", text.html_escape(s["content"])).otherwise(F.concat(F.lit(o.inline[0]), text.html_escape(s["content"]), F.lit(o.inline[1]))),
        )
        return F.array_join(F.transform(own, part), "")

    wrap = lambda b: F.when(text.is_blank(b), "").otherwise(
        F.concat(F.lit(f'<div class="{o.algorithm_class}" style="white-space: pre-wrap; font-family:monospace;">\n'), b, F.lit("\n</div>"))
    )
    return let(let(spans, body), wrap)


def _unknown(what: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("")))).cast("string")


def code_text(child: Column, block: Column, o: Options) -> Column:
    fence = F.concat(F.lit("```"), F.coalesce(block["guess_lang"], F.lit("txt")), F.lit("\n"), inline_text(child, o, escape=False, prefix=False), F.lit("\n```"))
    return F.when(block["sub_type"] == "algorithm", algorithm_html(child, o)).when(block["sub_type"] == "code", fence).otherwise(_unknown("code sub_type", block["sub_type"]))


def _in_order(blocks: Column) -> Column:
    keyed = F.transform(blocks, lambda b, i: F.struct(F.coalesce(b["index"], F.lit(float("inf"))).alias("at"), i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(F.transform(keyed, lambda k: F.struct(k["at"].alias("at"), k["i"].alias("i")))), lambda k: F.get(blocks, k["i"]))


_SEGMENT = "array<struct<text:string,kind:string>>"


def _segments(child: Column, block: Column, o: Options) -> Column:
    """(text, kind) pieces of a child block; kind is line or html."""
    none = F.array().cast(_SEGMENT)
    seg = lambda t, kind: F.struct(t.alias("text"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))
    one = lambda t, kind: let(t, lambda x: F.when(text.is_blank(x), none).otherwise(F.array(seg(x, kind))))

    def media(s):
        path = text.media_path(o.bucket, s["image_path"])
        summary = F.when(F.coalesce(block["sub_type"], F.lit("")) != "", block["sub_type"]).otherwise(F.concat(s["type"], F.lit(" content")))
        details = F.concat(F.lit("<details>\n<summary>"), summary, F.lit("</summary>\n\n"), s["content"], F.lit("\n</details>"))
        picture = F.when(path != "", F.array(seg(F.concat(F.lit("![]("), path, F.lit(")")), "line"))).otherwise(none)
        return F.concat(picture, F.when(text.is_blank(s["content"]), none).otherwise(F.array(seg(details, "html"))))

    def table(s):
        picture = F.when(s["image_path"] != "", F.array(seg(F.concat(F.lit("![]("), text.media_path(o.bucket, s["image_path"]), F.lit(")")), "line"))).otherwise(none)
        return F.when(s["html"] != "", F.array(seg(html.embedded(s["html"], o.bucket, *o.inline), "html"))).otherwise(picture) if o.table else picture

    of = lambda kind, f: F.flatten(F.transform(F.filter(_spans(child), lambda s: s["type"] == kind), f))
    kind = child["type"]
    return (
        F.when(kind.rlike("^(image|table|code|chart)_(caption|footnote)$"), one(inline_text(child, o, prefix=False), "line"))
        .when(kind == "image_body", of("image", media))
        .when(kind == "chart_body", of("chart", media))
        .when(kind == "table_body", of("table", table))
        .when(kind == "code_body", one(code_text(child, block, o), F.when(block["sub_type"] == "algorithm", "html").otherwise("line")))
        .otherwise(none)
    )


def visual_text(block: Column, o: Options) -> Column:
    """Child blocks in index order; an empty line around HTML, a line break otherwise."""
    blocks = F.coalesce(block["blocks"], F.array().cast("array<struct<type:string,index:double,bbox:array<double>,lines:array<struct<bbox:array<double>,spans:array<struct<type:string,content:string,image_path:string,html:string,bbox:array<double>>>>>>>"))
    segments = F.flatten(F.transform(_in_order(blocks), lambda b: _segments(b, block, o)))

    def joined(segs):
        before = lambda s, k: F.when(k == 0, "").when((s["kind"] == "html") | (F.get(segs, k - 1)["kind"] == "html"), "\n\n").otherwise("  \n")
        return F.array_join(F.transform(segs, lambda s, k: F.concat(before(s, k), s["text"])), "")

    return let(segments, joined)


def block_markdown(block: Column, mode: str = "mm", o: Options = Options()) -> Column:
    """One block as Markdown, stripped; "" for blank ones and types without a form."""
    kind = block["type"]
    level = text.title_level(block["level"])
    items = F.array_join(F.transform(block["blocks"], lambda b: F.concat(inline_text(b, o, prefix=False, formula=o.formula), F.lit("  \n"))), "")
    own = inline_text(block, o, formula=o.formula)
    heading = own if o.formula else inline_text(block, o)
    drawn = ("image", "table", "chart", "code") if mode == "mm" else ("code",)
    shown = (
        F.when(kind.isin("text", "interline_equation", "phonetic", "ref_text"), own)
        .when(kind == "list", F.coalesce(items, F.lit("")))
        .when(kind == "title", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), heading))
        .when(kind.isin(*drawn), visual_text(block, o))
        .otherwise("")
    )
    return text.strip(shown)


def markdown(pages: Column, mode: str = "mm", o: Options = Options()) -> Column:
    """A document's pages as Markdown: ``mm`` with pictures and tables, ``nlp`` without."""
    if mode not in ("mm", "nlp"):
        raise ValueError(f"unknown mode: {mode}")
    blocks = F.flatten(F.transform(pages, lambda p: F.coalesce(p["para_blocks"], F.slice(p["para_blocks"], 1, 0))))
    shown = F.filter(F.transform(blocks, lambda b: block_markdown(b, mode, o)), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.array_join(shown, "\n\n")


def body_data(block: Column) -> Column:
    """(path, content) of the first body span that has either."""
    of = lambda s: F.struct(
        F.when(s["type"] == "text", "").otherwise(s["image_path"]).alias("path"), F.when(s["type"] == "table", s["html"]).otherwise(s["content"]).alias("content")
    )
    known = lambda s: s["type"].isin("table", "chart", "image", "interline_equation", "text")
    first = lambda b: F.get(F.transform(F.filter(_spans(b), known), of), F.lit(0))
    empty = F.struct(F.lit("").alias("path"), F.lit("").alias("content"))
    bodies = F.filter(F.coalesce(block["blocks"], F.slice(block["blocks"], 1, 0)), lambda b: b["type"].isin("image_body", "table_body", "chart_body", "code_body"))
    full = F.filter(F.transform(bodies, first), lambda x: (x["path"] != "") | (x["content"] != ""))
    return F.when(block["blocks"].isNotNull(), F.coalesce(F.get(full, F.lit(0)), empty)).otherwise(F.coalesce(first(block), empty))


def content_entry(block: Column, page: Column, o: Options = Options()) -> Column:
    """A block as a flat JSON object (keys in alphabetical order; absent keys left out)."""
    kind = block["type"]
    size, box = page["page_size"], block["bbox"]
    mille = F.when(box.isNotNull(), F.array(*(F.try_divide(F.get(box, F.lit(i)) * 1000, F.get(size, F.lit(i % 2))).cast("int") for i in range(4))))
    level = text.title_level(block["level"])
    plain = ("text", "ref_text", "phonetic", "header", "footer", "page_number", "aside_text", "page_footnote")
    sub = F.when(F.coalesce(block["sub_type"], F.lit("")) != "", block["sub_type"])
    tables = F.filter(F.flatten(F.transform(F.filter(block["blocks"], lambda b: b["type"] == "table_body"), _spans)), lambda s: s["type"] == "table")
    last = lambda xs: F.when(F.size(xs) > 0, F.element_at(xs, -1))
    table_html = last(F.transform(F.filter(tables, lambda s: s["html"] != ""), lambda s: html.embedded(s["html"], o.bucket, *o.inline)))
    table_path = F.coalesce(last(F.transform(F.filter(tables, lambda s: s["image_path"] != ""), lambda s: F.concat(F.lit(o.bucket + "/"), s["image_path"]))), F.lit(""))
    codes = last(F.transform(F.filter(block["blocks"], lambda b: b["type"] == "code_body"), lambda b: code_text(b, block, o)))
    when = lambda k, c: F.when(kind == k, c)
    children = F.transform(block["blocks"], lambda b: F.struct(b["type"].alias("type"), inline_text(b, o, prefix=False).alias("text")))

    def entry(x):
        body = x["body"]
        texts = lambda name: F.transform(F.filter(x["children"], lambda c: c["type"] == name), lambda c: c["text"])
        fields = {
            "bbox": mille,
            "chart_caption": when("chart", texts("chart_caption")),
            "chart_footnote": when("chart", texts("chart_footnote")),
            "code_body": when("code", codes),
            "code_caption": when("code", texts("code_caption")),
            "content": F.when(kind.isin("image", "chart"), body["content"]),
            "image_caption": when("image", texts("image_caption")),
            "image_footnote": when("image", texts("image_footnote")),
            "img_path": F.when(kind.isin("image", "chart"), text.media_path(o.bucket, body["path"])).when(kind == "table", table_path),
            "list_items": when("list", F.filter(F.transform(x["children"], lambda c: c["text"]), lambda t: ~text.is_blank(t))),
            "page_idx": F.coalesce(page["page_idx"], F.lit(0)),
            "sub_type": F.when(kind.isin("image", "chart"), sub).when(kind == "list", F.coalesce(block["sub_type"], F.lit(""))).when(kind == "code", block["sub_type"]),
            "table_body": when("table", table_html),
            "table_caption": when("table", texts("table_caption")),
            "table_footnote": when("table", texts("table_footnote")),
            "text": F.when(kind.isin(*plain, "title", "interline_equation"), inline_text(block, o)),
            "text_format": when("interline_equation", F.lit("latex")),
            "text_level": F.when((kind == "title") & (level != 0), level),
            "type": F.when(kind.isin(*plain, "list", "image", "table", "chart", "code"), kind).when(kind == "title", "text").when(kind == "interline_equation", "equation"),
        }
        return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))

    return let(F.struct(children.alias("children"), body_data(block).alias("body")), entry)


def _flow(page: Column) -> Column:
    none = lambda c: F.coalesce(c, F.slice(F.coalesce(c, page["discarded_blocks"], page["para_blocks"]), 1, 0))
    return F.concat(none(page["para_blocks"]), none(page["discarded_blocks"]))


def content_list(pages: Column, o: Options = Options()) -> Column:
    """Flat list over all pages, as JSON text; discarded blocks follow the others of their page."""
    entries = F.flatten(F.transform(pages, lambda p: F.transform(_flow(p), lambda b: content_entry(b, p, o))))
    return F.concat(F.lit("["), F.array_join(entries, ","), F.lit("]"))


def explode_blocks(df: DataFrame, pages: str = "pdf_info") -> DataFrame:
    """One row a block: the document's columns, ``page``, ``block_no`` and ``block``."""
    keys = [c for c in df.columns if c != pages]
    paged = df.select(*keys, F.explode(pages).alias("page"))
    return paged.select(*keys, "page", F.posexplode(_flow(F.col("page"))).alias("block_no", "block"))


def spans_v2(block: Column) -> Column:
    """Spans as (content, type): neighbouring texts joined and spaced, equations and phonetics apart."""
    kind = F.when(block["type"] == "phonetic", "phonetic").otherwise("text")

    def pieces(spans):
        def bound(x):
            def piece(s, k):
                c, more = s["content"], x["last"] > k
                spaced = F.when(more, F.concat(c, F.lit(" "))).otherwise(c)
                hyphen = s["last"] & text.ends_in_hyphen(c)
                shown = (
                    F.when(x["cjk"], F.when(more & ~s["last"], F.concat(c, F.lit(" "))).otherwise(c))
                    .when(hyphen, F.when(s["lower_next"], text.without_last(c)).otherwise(c))
                    .otherwise(spaced)
                )
                plain = (s["type"] == "text") & (kind == "text")
                return F.struct(
                    F.when(plain, shown).otherwise(c).alias("content"), F.when(s["type"] == "text", kind).when(s["type"] == "inline_equation", "equation_inline").alias("type"), text.is_blank(c).alias("blank")
                )

            return F.filter(F.transform(spans, piece), lambda p: ~p["blank"] & p["type"].isNotNull())

        return let(F.struct(_last_joinable(spans).alias("last"), _cjk(spans).alias("cjk")), bound)

    none = F.array().cast("array<struct<content:string,type:string>>")

    def join(done, p):
        last = F.element_at(done, -1)
        one = lambda c: F.array(F.struct(c.alias("content"), p["type"].alias("type")))
        merged = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), one(F.concat(last["content"], p["content"])))
        together = (F.size(done) > 0) & (p["type"] == "text") & (F.try_element_at(done, F.lit(-1))["type"] == "text")
        return F.when(together, merged).otherwise(F.concat(done, one(p["content"])))

    return F.aggregate(let(_spans(block), pieces), none, join)


#: Entry types of furniture blocks.
FURNITURE = {"header": "page_header", "footer": "page_footer", "aside_text": "page_aside_text", "page_number": "page_number", "page_footnote": "page_footnote"}


def content_entry_v2(block: Column, page: Column, o: Options = Options()) -> Column:
    """A block as a nested JSON object: type, content by type, box; keys in alphabetical order."""
    kind, size, box = block["type"], page["page_size"], block["bbox"]
    mille = F.when(box.isNotNull(), F.array(*(F.try_divide(F.get(box, F.lit(i)) * 1000, F.get(size, F.lit(i % 2))).cast("int") for i in range(4))))
    level, sub = text.title_level(block["level"]), F.coalesce(block["sub_type"], F.lit(""))
    own = lambda name: F.flatten(F.transform(F.filter(block["blocks"], lambda b: b["type"] == name), spans_v2))
    code = F.element_at(F.concat(F.array(F.array().cast("array<struct<content:string,type:string>>")), F.transform(F.filter(block["blocks"], lambda b: b["type"] == "code_body"), spans_v2)), -1)
    items = F.filter(F.transform(block["blocks"], lambda b: F.struct(spans_v2(b).alias("item_content"), F.lit("text").alias("item_type"))), lambda i: F.size(i["item_content"]) > 0)
    codes = F.when(sub.isin("code", "algorithm"), sub).otherwise(_unknown("code sub_type", block["sub_type"]))
    lists = F.when(block["sub_type"].isNull() | (sub == "text"), "text_list").when(sub == "ref_text", "reference_list").otherwise(_unknown("list sub_type", block["sub_type"]))
    entry = F.when(kind == "title", F.when(level != 0, "title").otherwise("paragraph")).when(kind.isin("text", "phonetic"), "paragraph").when(kind == "interline_equation", "equation_interline")
    entry = entry.when(kind.isin("image", "table", "chart"), kind).when(kind == "code", codes).when(kind.isin("ref_text", "list"), "list")
    for k, v in FURNITURE.items():
        entry = entry.when(kind == k, v)

    def shown(x):
        spans, body, what = x["spans"], x["body"], x["what"]
        html_body = html.embedded(body["content"], o.bucket, *o.inline)
        source = F.when(what.isin("table", "equation_interline"), F.concat(F.lit(o.bucket + "/"), body["path"])).when(what.isin("image", "chart"), text.media_path(o.bucket, body["path"]))
        fields = {
            **{f"{k}_caption": F.when(what == k, own(f"{k}_caption")) for k in ("chart", "image", "table")},
            **{f"{k}_footnote": F.when(what == k, own(f"{k}_footnote")) for k in ("chart", "image", "table")},
            **{f"{k}_caption": F.when(what == k, own("code_caption")) for k in ("algorithm", "code")},
            **{f"{k}_content": F.when(what == k, code) for k in ("algorithm", "code")},
            **{f"{v}_content": F.when(what == v, spans) for v in FURNITURE.values()},
            "code_language": F.when(what == "code", F.coalesce(block["guess_lang"], F.lit("txt"))),
            "content": F.when(what.isin("image", "chart"), body["content"]),
            "html": F.when(what == "table", html_body),
            "image_source": F.when(source.isNotNull(), F.struct(source.alias("path"))),
            "level": F.when(what == "title", level),
            "list_items": F.when(kind == "ref_text", F.array(F.struct(spans.alias("item_content"), F.lit("text").alias("item_type")))).when(kind == "list", items),
            "list_type": F.when(kind == "ref_text", "reference_list").when(kind == "list", lists),
            "math_content": F.when(what == "equation_interline", body["content"]),
            "math_type": F.when(what == "equation_interline", "latex"),
            "paragraph_content": F.when(what == "paragraph", spans),
            "table_nest_level": F.when(what == "table", html.table_nesting(html_body)),
            "table_type": F.when(what == "table", F.when(html.is_complex_table(html_body), "complex_table").otherwise("simple_table")),
            "title_content": F.when(what == "title", spans),
        }
        content = F.when(what.isNotNull(), F.struct(*(fields[k].alias(k) for k in sorted(fields))))
        tail = F.when(what.isin("image", "chart") & (sub != ""), sub)
        return F.to_json(F.struct(mille.alias("bbox"), content.alias("content"), tail.alias("sub_type"), what.alias("type")))

    return let(F.struct(spans_v2(block).alias("spans"), body_data(block).alias("body"), entry.alias("what")), shown)


def content_list_v2(pages: Column, o: Options = Options()) -> Column:
    """A list for each page, empty pages too, as JSON text."""
    page = lambda p: F.concat(F.lit("["), F.array_join(F.transform(_flow(p), lambda b: content_entry_v2(b, p, o)), ","), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(pages, page), ","), F.lit("]"))
