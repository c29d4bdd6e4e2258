"""Quality rules: a threshold table compiled into one Spark projection.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``.  Every figure is a ratio of two
counted columns and every rule a closed interval for one ratio; the verdict is
the conjunction of the rules, compiled from ``RULES`` into DataFrame expressions
only (no Python runs on the executors).

Defined cases: a null text counts as empty and fails the base rule; a text of
one enormous word is one word; repeated rows are judged each for itself; other
columns of the input pass through ``quality_rules`` untouched, whatever their
names, as the operator works on columns prefixed ``__qr_`` inside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import table

QUERY = "op4_quality_rules"

#: Fixed value: the symbols counted.
SYMBOLS = "[#*$%&|<>]"

#: Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which "
    "le la les des et de du un une est que qui dans pour sur par au avec pas ou "
    "der die das und den von zu mit sich auf für ist nicht ein eine dem im "
    "el los las y del se por una con no para es al lo como más"
).split()

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``, for texts of at least ``from_words`` words."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float
    from_words: int = 0


#: The threshold table. Ratios are of the counted columns of ``measures``.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.25),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.02, 1.0, from_words=50),
    Rule("dup_lines_per_line", "n_dup_lines", "n_lines", 0.0, 0.3),
    Rule("words_per_line", "n_words", "n_lines", 2.0, float("inf"), from_words=50),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts that rules are made of, as ``__qr_<count>`` columns (long)."""
    c = F.col
    out = df.withColumn("__qr_text", F.coalesce(c(f"`{text}`"), F.lit("")))
    out = out.withColumn("__qr_words", _words(c("__qr_text"))).withColumn(
        "__qr_lines", F.filter(F.split("__qr_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    )
    n = F.size("__qr_words")
    # A window is a row of the zipped slices, so that one lambda call hashes it.
    slices = F.arrays_zip(*(F.slice("__qr_words", k + 1, n - (WINDOW - 1)) for k in range(WINDOW)))
    out = out.withColumn("__qr_windows", F.when(n >= WINDOW, F.transform(slices, lambda w: F.xxhash64(w))))
    # Only texts that hold some window twice pay for the second hash and the sort that finds where.
    out = out.withColumn(
        "__qr_sorted",
        F.when(
            F.size(F.array_distinct("__qr_windows")) < F.size("__qr_windows"),
            F.sort_array(F.transform(slices, lambda w, i: F.struct(F.xxhash64(w).alias("h"), F.hash(w).alias("g"), i.alias("i")))),
        ),
    )
    at = lambda i: F.get("__qr_sorted", i)
    same = lambda x, y: (x["h"] == y["h"]) & (x["g"] == y["g"])
    out = out.withColumn(
        "__qr_repeats",
        F.sort_array(
            F.transform(
                F.filter("__qr_sorted", lambda x, i: F.coalesce(same(x, at(i - 1)), F.lit(False)) | F.coalesce(same(x, at(i + 1)), F.lit(False))),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        "__qr_repeats",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n")),
        lambda a: a["n"],
    )
    chars = F.length("__qr_text")
    out = out.withColumns(
        {
            "__qr_n_words": n.cast("long"),
            "__qr_word_chars": F.length(F.array_join("__qr_words", "")).cast("long"),
            "__qr_n_symbols": (chars - F.length(F.regexp_replace("__qr_text", SYMBOLS, ""))).cast("long"),
            "__qr_n_lines": F.size("__qr_lines").cast("long"),
            "__qr_n_dup_lines": (F.size("__qr_lines") - F.size(F.array_distinct("__qr_lines"))).cast("long"),
            "__qr_n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "__qr_n_stop_words": F.size(F.filter("__qr_words", lambda w: w.isin(STOP_WORDS))).cast("long"),
        }
    )
    return out.drop("__qr_text", "__qr_words", "__qr_lines", "__qr_windows", "__qr_sorted", "__qr_repeats")


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression over the columns of ``measures``; an empty table of rules keeps all."""
    kept = F.lit(True)
    for r in rules:
        top, below = F.col(f"__qr_{r.numerator}").cast("double"), F.col(f"__qr_{r.denominator}").cast("double")
        fits = top >= r.low * below
        if r.high != float("inf"):
            fits &= top <= r.high * below
        kept &= fits | (F.col("__qr_n_words") < r.from_words)
    return kept


def quality_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with measured columns (``__qr_*``), ``__qr_base_failed`` and ``__qr_kept``."""
    out = measures(df, text)
    n, repeats = F.col("__qr_n_words"), F.col("__qr_n_repeat_words")
    out = out.withColumn("__qr_base_failed", (n < 10) | (100 * repeats > 20 * n))
    return out.withColumn("__qr_kept", ~F.col("__qr_base_failed") & compile_rules(rules))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", *(F.col(f"__qr_{c}").alias(c) for c in (*COUNTS, "base_failed", "kept")))


def _rules_sql() -> str:
    parts = []
    for r in RULES:
        fits = f"{r.numerator} >= {r.low} * {r.denominator}"
        if r.high != float("inf"):
            fits += f" AND {r.numerator} <= {r.high} * {r.denominator}"
        parts.append(f"(n_words < {r.from_words} OR ({fits}))")
    return " AND ".join(parts)


ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words
      FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS pos FROM d WHERE n >= 2) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], x)))::BIGINT AS n_stop_words
      FROM w LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_rules_sql()} AS kept FROM b
"""
