"""Clean-up of LaTeX in recognised text: built-in regular expressions, user functions where matches nest."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.functions.udf import over_text


def display_to_inline(c: Column) -> Column:
    r"""``\[x\]`` as ``\(x\)`` unless x is a citation: digits, dashes, commas, spaces."""
    return F.regexp_replace(c, r"\\\[(?![–\d\-,\s]+\\\])([\s\S]*?)\\\]", r"\\($1\\)")


#: Macros that a letter may stick to, and the longer macros that this makes.
MACROS = ("cong", "to", "times", "subset", "in")
LONGER = ("top", "int", "inf")
_INLINE = re.compile(r"\\\(([\s\S]*?)\\\)")
_STUCK = [re.compile(rf"\\{m}(?!(?:{'|'.join(x[len(m):] for x in LONGER if x.startswith(m)) or '[^a-zA-Z]'})(?![a-zA-Z]))([a-zA-Z])(?![a-zA-Z])") for m in MACROS]


def space_macros_text(s: str) -> str:
    r"""``\tox`` as ``\to x`` inside ``\( \)``."""
    def inner(m: re.Match) -> str:
        body = m[1]
        for name, stuck in zip(MACROS, _STUCK, strict=True):
            body = stuck.sub(lambda x, name=name: f"\\{name} {x[1]}", body)
        return f"\\({body}\\)"

    return _INLINE.sub(inner, s)


def move_underscores_text(s: str) -> str:
    r"""Runs of three or more underscores leave ``\( \)``, which closes around them."""
    def split(m: re.Match) -> str:
        parts = re.split(r"(_{3,})", m[1])
        if len(parts) == 1:
            return m[0]
        return " ".join(p if p.startswith("___") and not p.strip("_") else f"\\({p}\\)" for p in parts if p.strip(" \t\n\r\f\v"))

    return re.sub(r"\\\(([\s\S]+?)\\\)", split, s)


space_macros = over_text(space_macros_text)


move_underscores = over_text(move_underscores_text)


def clean_text(c: Column) -> Column:
    return move_underscores(space_macros(display_to_inline(c)))


def strip_delimiters(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"\A\\\[", ""), r"\\\]\z", ""))


def balance_text(s: str) -> str:
    """Without the unescaped braces that have no partner."""
    open_, drop = [], set()
    for m in re.finditer(r"\\.|[{}]", s, re.S):
        if m[0] == "{":
            open_.append(m.start())
        elif m[0] == "}" and open_:
            open_.pop()
        elif m[0] == "}":
            drop.add(m.start())
    drop.update(open_)
    return "".join(c for i, c in enumerate(s) if i not in drop)


balance_braces = over_text(balance_text)


def clean_equation(c: Column) -> Column:
    return balance_braces(strip_delimiters(c))


def formula_tag(c: Column) -> Column:
    """A formula's number without white space around and one pair of brackets, narrow or wide."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), "\\A[(（]", ""), "[)）]\\z", ""))
