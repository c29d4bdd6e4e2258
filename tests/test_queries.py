"""Every query against its SQL over the smallest tables; those without SQL give rows."""

import base64

import pytest
from quire.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(compare, name):
    compare(name)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"document_artefacts", "document_response"}))
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_no_cartesian_products(spark):
    for name in ("span_region_match", "caption_parent", "assemble_pages", "ocr_cell_wireless", "ocr_cell_wired", "char_span_fill", "table_internal_filter"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_rendering_does_not_shuffle(spark):
    plan = registry.queries()["doc_markdown"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_externalised_pictures_hold_whole_texts(spark, tmp_path):
    texts = ["same start " * 9 + end for end in ("one", "other")] + ["é" * 5000, "", None]
    docs = [(None if k == 1 else k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.queries()["externalised_pictures"](spark, str(tmp_path)).collect()}
    for k, t in docs[:3]:
        assert base64.b64decode(got[k].data).decode() == t
    assert len({got[k].image_path for k, _ in docs[:3]}) == 3 and len(got) == 5
