"""Characters that come with their page: the same spans and texts as by rows, and no shuffle."""

import random

import numpy as np

from quire.operators import chars
from quire.plans import registry

LETTERS = "ab é日🙂 \n\r.!)”—(“《xyz"


def page(seed: int):
    """Characters as (idx, c, box), spans as (pos, box): overlapping, reversed and out of reach, some chars overhanging."""
    r = random.Random(seed)
    box = lambda w, h: (lambda x, y: (x, y, x + w, y + h))(r.uniform(-5, 90), r.choice([0, 7, 20, 33, 40]) + r.uniform(-3, 3))
    spans = [(k, box(r.uniform(5, 60), r.choice([10, 14, 40, -4]))) for k in r.sample(range(50), 8)]
    return [(i, r.choice(LETTERS), box(r.choice([3, 5, 8]), r.choice([6, 9]))) for i in range(200)], spans


def arrays(seed: int):
    letters, spans = page(seed)
    return np.array([ord(c) for _, c, _ in letters]), np.array([b for *_, b in letters]).T, np.array([k for k, _ in spans]), np.array([b for _, b in spans]).T


def test_pages_equal_rows(spark):
    seeds, most = range(30), "page_id long, idx int, c string, x0 double, y0 double, x1 double, y1 double"
    rows = spark.createDataFrame([(s, i, c, *map(float, b)) for s in seeds for i, c, b in page(s)[0]], most)
    spans = spark.createDataFrame([(s, k, *map(float, b)) for s in seeds for k, b in page(s)[1]], "page_id long, span_pos int, x0 double, y0 double, x1 double, y1 double")
    want = sorted(map(tuple, chars.fill_spans(rows, spans).collect()))
    pages = spark.createDataFrame([(s, str(s)) for s in seeds] + [(99, None)], "page_id long, seed string")
    made = {str(s): arrays(s) for s in seeds}  # workers can't import this file
    assert len(want) > 60 and sorted(map(tuple, chars.fill_pages(pages, "seed", lambda x: made[x]).collect())) == want


def test_char_span_fill_does_not_shuffle(spark):
    plan = registry.queries()["char_span_fill"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_odd_documents(spark, tmp_path):
    import duckdb

    texts = ["", None, "one (line) of text.", "日本 🙂 é\r\n" * 20, "word " * 400]
    spark.createDataFrame([*enumerate(texts), (None, "no id"), (4, "same id, (other) text " * 9)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.queries()["char_span_fill"](spark, str(tmp_path)).where("page_id < 4").collect()))
    rows = registry.queries()["char_span_fill"](spark, str(tmp_path)).where("page_id = 4 OR page_id IS NULL").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE doc_id < 4")
    assert got == sorted(con.sql(registry.oracle_sql()["char_span_fill"]).fetchall())
    assert len(rows) == 201 and {r.page_id for r in rows} == {4}
