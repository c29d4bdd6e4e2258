"""Text functions as Column expressions (no user functions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that ``strip`` removes, and hyphens that may end a line.
SPACE = " \\t\\n\\r\\x0c\\x0b"
HYPHENS = "\\x{2D}\\x{AD}\\x{2010}\\x{2011}\\x{2043}"

_WIDE = "".join(chr(c) for r in ((0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF10, 0xFF19)) for c in range(r[0], r[1] + 1))
_WIDE_ALL = "".join(map(chr, range(0xFF01, 0xFF5F)))
_narrow = lambda s: "".join(chr(ord(c) - 0xFEE0) for c in s)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_width(c: Column) -> Column:
    """Full-width letters and digits as ASCII; punctuation stays."""
    return F.translate(c, _WIDE, _narrow(_WIDE))


def half_width_all(c: Column) -> Column:
    """All of U+FF01 to U+FF5E as ASCII."""
    return F.translate(c, _WIDE_ALL, _narrow(_WIDE_ALL))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def strip_table(c: Column) -> Column:
    """Only space, tab, CR and LF."""
    return F.regexp_replace(c, "^[ \\t\\r\\n]+|[ \\t\\r\\n]+\\z", "")


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, "[ \\t\\r\\n]", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(f"[^{SPACE}]")


def ends_in_hyphen(c: Column) -> Column:
    """An ASCII letter and a hyphen end the text, white space aside."""
    return c.rlike(f"[A-Za-z][{HYPHENS}][{SPACE}]*\\z")


def without_last(c: Column) -> Column:
    return F.substring(c, F.lit(1), F.greatest(F.length(c) - 1, F.lit(0)))


def script_language(c: Column) -> Column:
    """ja, ko, zh by the scripts present (in this order), else en; "" for empty text."""
    return (
        F.when(c == "", "")
        .when(c.rlike("[\\x{3040}-\\x{30FF}]"), "ja")
        .when(c.rlike("[\\x{AC00}-\\x{D7A3}\\x{1100}-\\x{11FF}]"), "ko")
        .when(c.rlike("[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{F900}-\\x{FAFF}]"), "zh")
        .otherwise("en")
    )


def is_cjk(c: Column) -> Column:
    return script_language(c).isin("zh", "ja", "ko")


def escape_markdown(c: Column) -> Column:
    """Backslash before * _ ` ~ $ unless an odd number of backslashes precedes."""
    return F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)([*_`~$])", r"$1\\$2")


def escape_prefix(c: Column) -> Column:
    """Backslash before a heading or list marker at the start of a text."""
    return F.regexp_replace(c, r"\A([ \t]{0,3})(#{1,6}|[+-])(?=[ \t])", r"$1\\$2")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_escape_quotes(c: Column) -> Column:
    return F.replace(F.replace(html_escape(c), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def title_level(level: Column) -> Column:
    """1 if missing, at most 4, 0 below 1."""
    return F.when(level.isNull(), 1).when(level > 4, 4).when(level < 1, 0).otherwise(level).cast("int")


def media_path(bucket: str, path: Column) -> Column:
    path = F.coalesce(path, F.lit(""))
    return path if not bucket else F.when(path == "", "").otherwise(F.concat(F.lit(bucket + "/"), path))
