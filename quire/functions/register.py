"""Functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quire.functions import html, latex
from quire.session import ship

#: SQL bodies of the functions that built-in expressions express.
SQL = {
    "quire_strip(s STRING)": r"regexp_replace(s, '^[ \\t\\n\\r\\x0c\\x0b]+|[ \\t\\n\\r\\x0c\\x0b]+\\z', '')",
    "quire_html_escape(s STRING)": "replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')",
    "quire_escape_markdown(s STRING)": r"regexp_replace(s, '(?<!\\\\)((?:\\\\\\\\)*)([*_`~$])', '$1\\\\$2')",
    "quire_title_level(n INT)": "CASE WHEN n IS NULL THEN 1 WHEN n > 4 THEN 4 WHEN n < 1 THEN 0 ELSE n END",
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions of the session; gives their names."""
    ship(spark)
    names = []
    for head, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])
    from quire.operators.tables import merge_json, tokens_to_html

    loops = {
        "quire_html_unescape": html.unescape_text, "quire_space_macros": latex.space_macros_text, "quire_move_underscores": latex.move_underscores_text,
        "quire_balance_braces": latex.balance_text, "quire_otsl_html": tokens_to_html, "quire_merge_tables": merge_json,
    }
    for name, f in loops.items():
        spark.udf.register(name, lambda s, f=f: None if s is None else f(s))
        names.append(name)
    return names
