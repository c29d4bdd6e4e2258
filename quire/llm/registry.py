"""Queries ``opN_<name>``: each operator over its whole table."""

from __future__ import annotations

from quire.llm import (
    bpe_words,
    curve_packing,
    importance,
    line_dedup,
    media,
    near_dedup,
    quality_rules,
    substring_dedup,
    toxicity,
    warc,
)

MODULES = (
    toxicity,
    importance,
    media,
    quality_rules,
    warc,
    near_dedup,
    curve_packing,
    bpe_words,
    substring_dedup,
    line_dedup,
)


def queries() -> dict:
    return {m.QUERY: m.query for m in MODULES}


def oracle_sql() -> dict:
    return {m.QUERY: m.ORACLE_SQL for m in MODULES if m.ORACLE_SQL is not None}
