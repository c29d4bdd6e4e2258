"""A few links are joined by one task, not by rounds of shuffles; more than that by rounds, with the same classes."""

from quire.llm import near_dedup
from quire.session import Scratch


def links(spark):
    """Chains whose nodes are spread over the tasks, a star and a ring."""
    chains = [(i * 7919 % 1000 * 10 + j, i * 7919 % 1000 * 10 + j + 1) for i in range(60) for j in range(0, 8, 2)]
    chains += [(b, b + 1) for a, b in chains if b % 10 < 8]
    star = [(20_000, 20_000 + i) for i in range(1, 40)]
    ring = [(30_000 + i, 30_000 + (i + 1) % 25) for i in range(25)]
    return spark.createDataFrame(chains + star + ring, "a long, b long").repartition(7, "a")


def plain(pairs):
    label = {x: x for p in pairs for x in p}
    while True:
        old = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == old:
            return {x: c for x, c in label.items() if x != c}


def run(spark, monkeypatch):
    """Components, and the names of the tables written for them."""
    made, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, *a: made.append(name) or save(self, df, name, *a))
    with Scratch(spark) as s:
        got = [tuple(r) for r in near_dedup.components(links(spark), s).collect()]
    assert len(got) == len(dict(got))
    return dict(got), made


def test_few_links_take_one_task(spark, monkeypatch):
    want = plain([tuple(r) for r in links(spark).collect()])
    got, made = run(spark, monkeypatch)
    assert got == want
    assert made == ["links-0"]


def test_more_links_take_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "FEW", 0)
    want = plain([tuple(r) for r in links(spark).collect()])
    got, made = run(spark, monkeypatch)
    assert got == want
    assert len(made) > 1


def test_groups(spark, monkeypatch):
    found = []
    for limit in (near_dedup.FEW, 0):
        monkeypatch.setattr(near_dedup, "FEW", limit)
        with Scratch(spark) as s:
            found.append(sorted(tuple(r) for r in near_dedup.grouped(links(spark), s, "t").collect()))
    assert found[0] == found[1]
    assert sum(key == 20_000 and n == 40 for key, n, _ in found[0]) == 40


def test_no_links(spark, monkeypatch):
    with Scratch(spark) as s:
        assert near_dedup.components(spark.createDataFrame([], "a long, b long"), s).collect() == []
        assert near_dedup.grouped(spark.createDataFrame([], "a long, b long"), s, "t").collect() == []
