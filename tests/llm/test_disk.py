"""What travels between the jobs of the operators."""

from fractions import Fraction

from quire.llm import near_dedup
from quire.session import Scratch

from .data import texts, write

BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


def test_texts_are_signed_where_they_are_read(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{write(spark, tmp_path, texts())}/documents.parquet")
    plans, save, before = {}, Scratch.save, spark.conf.get(BROADCAST)

    def noted(self, df, name, *more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return save(self, df, name, *more)

    monkeypatch.setattr(Scratch, "save", noted)
    spark.conf.set(BROADCAST, "-1")  # as over large tables
    try:
        with Scratch(spark) as s:
            near_dedup.near_links(docs, s, Fraction(85, 100))
    finally:
        spark.conf.set(BROADCAST, before)
    assert {name for name, plan in plans.items() if "text#" in plan and "Exchange" in plan} == {"verified"}
