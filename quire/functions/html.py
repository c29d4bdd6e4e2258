"""HTML helpers as Column expressions; numeric entities need a user function."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import half_width_all, strip_table
from quire.functions.udf import over_text

#: The named entities understood.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": "\u00a0"}
_ENTITY = re.compile(r"&([^;&]{0,9});")


def unescape_text(s: str) -> str:
    """Named entities and numeric references of up to ten bytes; anything else stays."""

    def one(m: re.Match) -> str:
        e = m[1]
        if len(e.encode()) > 9:
            return m[0]
        if e == "amp":
            return "&"
        if e in NAMED:
            return NAMED[e]
        if e[:1] == "#":
            try:
                code = int(e[2:], 16) if e[1:2] in ("x", "X") else int(e[1:])
                return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0] if code < 0 else "" if code == 0 else "\ufffd"
            except ValueError:
                return m[0]
        return m[0]

    return _ENTITY.sub(one, s)


html_unescape = over_text(unescape_text)


def table_unescape(c: Column) -> Column:
    """Named entities without numeric ones; & comes last, so nothing is decoded twice."""
    for name, value in NAMED.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(value))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def _entity(name: Column) -> Column:
    """The character of an entity's name, null if unknown: names and numeric references, by built-in expressions."""
    number = F.when(name.rlike("^#[0-9]{1,8}$"), F.substring(name, F.lit(2), F.lit(8)).try_cast("int")).when(
        name.rlike("^#[xX][0-9a-fA-F]{1,7}$"), F.conv(F.substring(name, F.lit(3), F.lit(7)), 16, 10).try_cast("int")
    )
    legal = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    letter = F.decode(F.unhex(F.lpad(F.hex(F.when(legal, number)), 8, "0")), "UTF-32")
    out = F.when(name == "amp", "&").when(legal, letter).when(number == 0, "").when(number.isNotNull(), "\ufffd")
    for k, v in NAMED.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def text_unescape(c: Column) -> Column:
    """``unescape_text`` by built-in expressions: pieces between ampersands, each with its entity replaced."""

    def piece(p: Column) -> Column:
        rest = F.regexp_replace(p, "(?s)^&[^;]{0,9};", "")
        return F.coalesce(F.when(p.rlike("^&[^;]{0,9};"), F.concat(_entity(F.regexp_extract(p, "^&([^;]{0,9});", 1)), rest)), p)

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "(?=&)"), piece), "")).otherwise(c)


def image_prefix(c: Column, bucket: str) -> Column:
    """``bucket/`` before relative img sources; data URIs stay."""
    if not bucket:
        return c
    safe = bucket.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, 'src="(?!data:)([^"]+)"', f'src="{safe}/$1"')


def equation_tags(c: Column, left: str = "$", right: str = "$") -> Column:
    """``<eq>x</eq>`` as `` $x$ ``, with entities of x decoded, named and numeric ones."""
    parts = F.split(c, "(?s)(?=<eq>)|(?<=</eq>)")
    quoted = lambda x: F.concat(F.lit(f" {left}"), text_unescape(F.regexp_extract(x, "(?s)^<eq>(.*)</eq>$", 1)), F.lit(f"{right} "))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("(?s)^<eq>.*</eq>$"), quoted(x)).otherwise(x)), "")


def embedded(c: Column, bucket: str, left: str = "$", right: str = "$") -> Column:
    return equation_tags(image_prefix(c, bucket), left, right)


def cell_count(c: Column) -> Column:
    """Occurrences of <td and <th; <thead counts too."""
    return F.regexp_count(F.lower(c), F.lit("<td")) + F.regexp_count(F.lower(c), F.lit("<th"))


def cell_texts(c: Column) -> Column:
    """Texts of the td and th cells, tags removed and stripped."""
    cells = F.regexp_extract_all(c, F.lit("(?is)<t[dh](?:\\s[^>]*)?>(.*?)</t[dh]>"), 1)
    return F.transform(cells, lambda x: strip_table(F.regexp_replace(x, "(?s)<[^>]*>", "")))


def blank_cells(c: Column) -> Column:
    return F.size(F.filter(cell_texts(c), lambda x: x == ""))


def table_nesting(c: Column) -> Column:
    return F.when(F.regexp_count(c, F.lit("<table")) > 1, 2).otherwise(1)


def is_complex_table(c: Column) -> Column:
    return F.contains(c, F.lit("colspan")) | F.contains(c, F.lit("rowspan")) | (table_nesting(c) > 1)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted or bare, of an opening tag; null if absent."""
    hit = lambda k: F.regexp_extract(tag, f"(?i)\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s>\"']+))", k)
    value = F.concat(hit(1), hit(2), hit(3))
    return F.when(value != "", value)


def body_of(c: Column) -> Column:
    """The <table>...</table> inside an <html><body> wrapper, the text itself without one."""
    whole = F.regexp_extract(c, "(?s)(<table>.*</table>)", 1)
    return F.when(whole != "", whole).otherwise(c)


#: Endings that mark a continued caption, narrow and lower-case.
CONTINUED = ("(续)", "(续表)", "(续上表)", "(continued)", "(cont.)", "(cont’d)", "(…continued)", "续表")


def is_continued(caption: Column) -> Column:
    """Does the caption say that its table goes on? A bare word needs no letter before it."""
    c = F.lower(half_width_all(strip_table(caption)))
    ends = F.lit(False)
    for e in CONTINUED:
        ends |= c.endswith(e)
    return ends | c.rlike("(^|[^a-z])continued\\z") | F.contains(c, F.lit("(continued)"))
