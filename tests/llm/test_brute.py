"""Operators without SQL against plain loops."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from quire.llm import importance, toxicity, vocab

from .data import texts, write
from .test_contracts import levenshtein, library_ids, shingles, words


def test_clauses_against_a_loop():
    """Each insult or threat looks around itself in its clause."""
    g = toxicity.Grammar(frozenset(["blur"]))
    r = random.Random(4)
    said = ["idiot", "blurgh", "kill", "you", "not", "said", "word", "river", ",", ".", "?"]
    for _ in range(400):
        tokens = [r.choice(said) for _ in range(r.randint(0, 30))]
        clauses, want = [[]], Counter()
        for t in tokens:
            if t in ".?":
                clauses.append([])
            else:
                clauses[-1].append(t)
        for c in clauses:
            kinds = set()
            for k, t in enumerate(c):
                if t in ("idiot", "blurgh", "kill"):
                    near = [x for i, x in enumerate(c) if 1 <= abs(i - k) <= 5]
                    kinds.add(("H" if t == "kill" else "I") + ("n" if "not" in c[max(0, k - 3) : k] else "") + ("r" if "said" in c[:k] else "") + ("t" if "you" in near else ""))
            want.update(kinds)
        got = Counter({e: n for e, n in zip(toxicity.EVENTS, g.events(" ".join(tokens)), strict=True) if n})
        assert got == want, tokens


def test_toxicity_scores_follow_the_model(spark, tmp_path):
    rows = texts() + ["you idiot", "not an idiot, he said", "I will kill you. You scum"]
    folder = write(spark, tmp_path, rows)
    model = toxicity.fit(spark, spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    g = toxicity.Grammar(model.stems)
    for r in toxicity.query(spark, folder).collect():
        z = sum(w * np.log1p(n) for w, n in zip(model.weights, g.events(rows[r.doc_id]), strict=True)) + model.bias
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_accuracy(spark):
    """Labels of the fold that learning doesn't see; some labelled texts hold no toxic word at all."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    got = [(r.predicted, labels[r.doc_id]) for r in toxicity.query(spark, sf).collect() if r.held_out and r.doc_id in labels]
    right = Counter(got)
    assert right[1, 1] >= 0.8 * (right[1, 1] + right[0, 1]) and right[1, 0] <= 0.02 * (right[1, 0] + right[0, 0])


def test_importance_against_counts(spark, tmp_path):
    rows = texts()
    folder = write(spark, tmp_path, rows, [(i, int(i % 3 == 0), 0) for i in range(0, len(rows), 2)])
    good = [i for i in range(0, len(rows), 2) if i % 3 == 0]
    grams = [importance.features((t or "").encode()) for t in rows]
    raw, target = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for i, f in enumerate(grams):
        for b in f:
            raw[b] += 1
            target[b] += i in good
    p = (raw + 1) / (raw.sum() + importance.BUCKETS)
    q = (target + 5 * importance.BUCKETS * p) / (target.sum() + 5 * importance.BUCKETS)
    got = {r.doc_id: r for r in importance.query(spark, folder).collect()}
    for i, f in enumerate(grams):
        assert abs(got[i].log_ratio - np.log(q / p)[f].sum()) < 1e-6
    noise = {r.id: (r.u + 0.5) / (1 << 53) for r in spark.range(len(rows)).select("id", F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col("id")), 11).alias("u")).collect()}
    keys = {i: got[i].log_ratio - np.log(-np.log(noise[i])) for i in got}
    k = round(len(good) / len(range(0, len(rows), 2)) * len(rows))
    assert {i for i in got if got[i].kept} == set(sorted(keys, key=lambda i: (-keys[i], i))[:k])


def find(root, x):
    return x if root[x] == x else find(root, root[x])


def test_pipeline_stage_by_stage(spark, tmp_path):
    """All stages over hard texts, each stage done again by plain loops."""
    rows = [t for t in texts() if t is None or len(t) < 3000]
    folder = write(spark, tmp_path, rows, [(i, 1, 0) for i in range(len(rows))])
    docs = {i: t for i, t in enumerate(rows) if "you are an idiot" not in (t or "")}

    lines = [(i, k, x) for i, t in docs.items() for k, x in enumerate((t or "").split("\n")) if x and not x.isspace()]
    kinds = list(dict.fromkeys(x for _, _, x in lines))
    root = {x: x for x in kinds}
    for a in range(len(kinds)):
        for b in range(a):
            x, y = kinds[a], kinds[b]
            most = min(min(len(x), len(y)) // 5, 2)
            if abs(len(x) - len(y)) <= most and sum((Counter(x) - Counter(y)).values()) <= most and levenshtein(x, y) <= most:
                root[find(root, x)] = find(root, y)
    seen, gone = set(), set()
    for i, k, x in sorted(lines, key=lambda v: v[:2]):
        c = find(root, x)
        if c in seen:
            gone.add((i, k))
        seen.add(c)
    docs = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs.items()}

    sets, top = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}
    for a in docs:
        for b in docs:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(top, a), find(top, b)))
                top[y] = x
    docs = {i: t for i, t in docs.items() if find(top, i) == i}

    at = {}
    for i, t in docs.items():
        w = words(t)
        for k in range(len(w) - 34):
            at.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    cut = {(i, k + d) for v in at.values() if len(v) > 1 for i, k in v for d in range(35)}
    touched = {i for i, _ in cut}
    docs = {i: b" ".join(w for k, w in enumerate(words(t)) if (i, k) not in cut).decode() if i in touched else t for i, t in docs.items()}

    _, ids = library_ids("byte_bpe_50k.json", list(docs.values()))
    want = {i: len(x) + 1 for i, x in zip(docs, ids, strict=True)}
    pieces = corpus_pipeline.run(spark, folder).collect()
    got = Counter()
    for r in pieces:
        got[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == Counter(want)
    assert vocab.vocabulary_path("byte_bpe_50k.json")
    for r in pieces:
        own = [*ids[list(docs).index(r.doc_id)], 0][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())


def test_near_dedup_recall_at_both_thresholds():
    """Pairs at the threshold and just above share a band and pass the count of equal slots."""
    from fractions import Fraction

    from quire.llm import near_dedup

    r = np.random.default_rng(5)
    for least in (Fraction(4, 5), Fraction(85, 100)):
        n, low = near_dedup.banding(least), near_dedup.fewest_equal(least)
        met = 0
        for _ in range(300):
            both = int(r.integers(60, 400))
            each = int(both * (1 - float(least)) / float(least) / 2)  # union = both + 2 * each
            pool = r.integers(0, 1 << 63, both + 2 * each).astype(np.uint64)
            sig = near_dedup.superminhash([pool[: both + each], np.concatenate([pool[:both], pool[both + each :]])])
            same = sig[0] == sig[1]
            met += bool(same.reshape(*n).all(axis=1).any() and same.sum() >= low)
        assert met == 300
