"""Null, negative and repeated ids: every row counts once, whatever its id."""

from collections import Counter

import corpus_pipeline
import pytest
from quire.llm import media, warc
from quire.llm.registry import MODULES

from .data import write

PASSAGE = " ".join(f"word{i}" for i in range(40))
LONG = " ".join(f"other{i}" for i in range(90))
ROWS = [
    (None, LONG), (None, "A line that no other text has."), (-5, "One more text, with a minus before its id."), (3, LONG), (3, LONG.replace("other7 ", "another ")),
    (3, f"head of it {PASSAGE}"), (7, f"{PASSAGE} and a tail"), (-(1 << 63), ""), (None, None), ((1 << 63) - 1, "The last of all ids."), (7, "A line that no other text has."),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("ids")
    path = write(spark, at, [], [(3, 1, 0), (3, 0, 1), (None, 1, 1), (-5, 1, 0), (7, 1, 0)])
    docs = [(i, t, "en", "s", 0) for i, t in ROWS]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, "u", t) for i, t in ROWS], "page_id long, url string, html string").repartition(3).write.parquet(f"{path}/pages.parquet")
    return path


WANT = Counter(i for i, _ in ROWS)


@pytest.mark.parametrize("module", MODULES, ids=lambda m: m.QUERY)
def test_each_row_counts_once(spark, folder, module):
    rows = module.query(spark, folder).collect()
    if module.QUERY == "op7_curve_packing":
        rows = [r for r in rows if r.start == 0]
    assert Counter(r[0] for r in rows) == WANT


def test_near_dedup_keeps_one_row_of_a_group(spark, folder):
    from quire.llm import near_dedup

    rows = near_dedup.query(spark, folder).collect()
    assert sum(r.kept for r in rows) == len(ROWS) - 4  # copies of the long text, of the passage and of the line
    group = [r for r in rows if r.n_shingles == 86]
    assert [r.component_id for r in group] == [3, 3, 3] and sorted(r.kept for r in group) == [False, False, True]


def test_substrings_of_rows_with_one_id(spark, folder):
    from quire.llm import substring_dedup

    got = Counter((r.doc_id, r.n_removed) for r in substring_dedup.query(spark, folder).collect() if r.n_removed)
    assert got == Counter({(None, 90): 1, (3, 90): 1, (3, 82): 1, (3, 40): 1, (7, 40): 1})  # 82 words follow the changed one


def test_one_response_for_equal_payloads(spark, folder):
    rows = [r for r in warc.query(spark, folder).collect() if r.payload_bytes == len(LONG)]
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows) == [("3", "response", None), ("None", "revisit", 3)]


def test_sampling_keeps_k_rows_of_repeated_ids(spark):
    from quire.llm import importance
    from quire.session import Scratch

    df = spark.createDataFrame([(i, 0.0) for i in [1] * 6 + [2] * 2 + [None, -4, -(1 << 63)]], "doc_id long, w double").repartition(3)
    with Scratch(spark) as s:
        for k in (0, 1, 3, 7, 11, 20):
            assert importance.gumbel_top_k(df, "w", k, s.__class__(spark)).where("kept").count() == min(k, 11)


def test_pipeline_loses_no_row(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_lines, corpus_pipeline.drop_passages):
        assert Counter(r.doc_id for r in stage(spark, docs, folder).collect()) == WANT
    near = Counter(r.doc_id for r in corpus_pipeline.drop_near(spark, docs, folder).collect())
    assert sum(near.values()) == len(ROWS) - 4 and not near - WANT
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} <= set(WANT)


def test_clashing_names_of_media(spark):
    import numpy as np

    df = spark.createDataFrame([(media.encode_bmp(np.zeros((3, 4), np.uint8)), 9, "x", "y")], "media binary, Height int, dhash string, other string")
    got = media.media_columns(df)
    assert got.columns == ["media", "other", "height", "width", "dhash", "tiles"] and got.collect()[0].height == 3
