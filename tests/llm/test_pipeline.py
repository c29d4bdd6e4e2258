"""The corpus pipeline: stage by stage on hard cases, clean documents stay."""

from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from quire.session import Scratch

from .data import frame, texts, write


def test_stages_keep_clean_documents(spark, tmp_path):
    rows = texts()
    folder = write(spark, tmp_path, rows, [(i, 1, 0) for i in range(len(rows))])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            sizes.append(docs.count())
    assert sizes[1] == sizes[2] and sizes[4] == sizes[3]
    assert len(rows) - sizes[1] == 1  # the one that insults
    assert 0 < sizes[2] - sizes[3] < 12
    assert docs.count() == corpus_pipeline.run(spark, folder).count()


def test_a_stage_finds_only_its_input_on_disk(spark, tmp_path, monkeypatch):
    folder = write(spark, tmp_path, texts(), [(i, 1, 0) for i in range(len(texts()))])
    tables, found, init = [], {}, Scratch.__init__

    def noted(self, session):
        init(self, session)
        tables.append(Path(self.root.removeprefix("file:")))

    def watched(name, stage):
        def run(*args):
            found[name] = sorted(x.name for x in tables[0].iterdir()) if tables[0].exists() else []  # the pipeline's own folder is the first one made
            return stage(*args)

        return name, run

    names, want = [name for name, _ in corpus_pipeline.STAGES], corpus_pipeline.run(spark, folder).count()
    monkeypatch.setattr(Scratch, "__init__", noted)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*x) for x in corpus_pipeline.STAGES])
    assert corpus_pipeline.run(spark, folder).count() == want
    assert found == {name: names[max(k - 1, 0) : k] for k, name in enumerate(names)}


def test_empty_table(spark, tmp_path):
    folder = write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_duplicate_and_null_ids_of_labels(spark, tmp_path):
    folder = write(spark, tmp_path, texts(), [(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None)])
    docs = frame(spark, texts()).select(*corpus_pipeline.COLUMNS)
    assert corpus_pipeline.drop_toxic(spark, docs, folder).count() == docs.count() - 1


@pytest.mark.parametrize("ids", [(None, 1, None, 2, 3), (4, 1, 4, 4, 3)])
def test_null_and_repeated_ids_of_documents(spark, tmp_path, ids):
    passage = " ".join(f"word{i}" for i in range(40))
    head, tail = (" ".join(f"{w}{i}" for i in range(30)) for w in ("head", "tail"))
    rows = ["Words of a first text, unlike all others.", "A line that two of the texts have in common.\nAnd more of it here.", "Something else altogether is said in this one.\nA line that two of the texts have in common.", f"{head} {passage} one", f"{passage} {tail}"]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(zip(ids, rows, strict=True))], "doc_id long, text string, lang string, source string, n_chars long")

    def got(df):
        return sorted((r.source, r.doc_id, r.text) for r in df.collect())

    same = [(f"s{k}", i, t) for k, (i, t) in enumerate(zip(ids, rows, strict=True))]
    assert got(corpus_pipeline.drop_near(spark, docs, "")) == same
    lines = got(corpus_pipeline.drop_lines(spark, docs, ""))
    assert [x[:2] for x in lines] == [x[:2] for x in same]
    assert lines[0] == same[0] and lines[1] == same[1] and lines[2][2] == "Something else altogether is said in this one."
    cut = got(corpus_pipeline.drop_passages(spark, docs, ""))
    assert cut[:3] == same[:3] and [x[:2] for x in cut] == [x[:2] for x in same]
    assert [x[2] for x in cut[3:]] == [f"{head} one", tail]
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert sorted((r.doc_id for r in packed), key=str) == sorted(ids, key=str)


def test_packing_bounds_with_null_ids(spark):
    from quire.llm import curve_packing

    docs = frame(spark, ["the same text"] * 6).withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))
    got = [r.doc_id for r in corpus_pipeline.pack(spark, docs, "").collect()]
    assert sorted(got, key=str) == [3, 4, 5, None, None, None]
    at = spark.createDataFrame([(1, None), (1, -7), (1, 4), (2, None)], "key long, doc_id long")
    assert sorted(r[0] for r in at.select(curve_packing._range_of([(1, curve_packing.NO_ID), (1, 4)])).collect()) == [1, 1, 2, 2]
