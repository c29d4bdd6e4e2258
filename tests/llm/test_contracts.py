"""Each query against a brute-force version of its contract."""

import hashlib
import zlib
from itertools import combinations

import pytest
from quire.llm import bpe_words, curve_packing, importance, line_dedup, media, near_dedup, quality_rules, substring_dedup, toxicity, vocab, warc

from .data import frame, texts, write


def words(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    return write(spark, tmp_path_factory.mktemp("docs"), rows)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("none"), [], [])


ALL = (toxicity, importance, media, quality_rules, near_dedup, curve_packing, bpe_words, substring_dedup, line_dedup)


@pytest.mark.parametrize("module", ALL, ids=lambda m: m.__name__)
def test_empty_tables(spark, empty, module):
    assert module.query(spark, empty).collect() == []


def test_toxicity_learns_outside_the_fold(spark, tmp_path):
    said = ["you are a blurgh today", "such a blurghen thing", "the quiet river runs", "a house by the river", "he said you idiot", "kein Wort zu viel"]
    rows = [said[i % 6] for i in range(120)]
    folder = write(spark, tmp_path, rows, [(i, 1, int(i % 6 in (0, 1, 4))) for i in range(120)])
    got = {r.doc_id: r for r in toxicity.query(spark, folder).collect()}
    assert len(got) == 120
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.predicted == int(i % 6 in (0, 1, 4))


def test_toxicity_edge_cases(spark, folder, rows):
    got = {r.doc_id: r for r in toxicity.query(spark, folder).collect()}
    assert sorted(got) == list(range(len(rows)))
    assert got[0].score == got[1].score


def test_grammar_composition():
    g = toxicity.Grammar()
    kinds = lambda t: {e for e, n in zip(toxicity.EVENTS, g.events(t), strict=True) if n}
    assert kinds("you are an idiot") == {"It"}
    assert kinds("what an idiot") == {"I"}
    assert kinds("not an idiot") == {"In"}
    assert kinds("they wrote: nothing. He said you are an idiot") == {"Irt"}
    assert kinds("he said so. idiot") == {"I"}
    assert kinds("I will kill you") == {"Ht"}
    assert kinds("idiots like you") == {"It"}
    assert kinds("an idiot. You there") == {"I"}
    assert kinds("you will not hurt me") == {"Hnt"}
    assert kinds(None) == kinds("") == set()


def test_importance_sampling(spark, folder, rows):
    got = importance.query(spark, folder).collect()
    share = sum(i % 2 for i in range(len(rows))) + 1
    assert len(got) == len(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == round(share / (len(rows) + 1) * len(rows))
    assert min(r.gumbel_key for r in kept) >= max(r.gumbel_key for r in got if not r.kept) - 1e-6
    assert all(r.log_ratio == 0 for r in got if r.doc_id in (0, 1, 2))


def test_kth_largest_with_ties(spark):
    df = spark.createDataFrame([(x,) for x in [5, 5, 5, 1 << 40, 0, 7, (1 << 62) + 3]], "v long")
    assert [importance.kth_largest(df, "v", k) for k in (1, 2, 3, 4, 6, 7, 8)] == [(1 << 62) + 3, 1 << 40, 7, 5, 5, 0, None]


def test_media_round_trip(spark, folder, rows):
    got = {r.doc_id: r for r in media.query(spark, folder).collect()}
    for i, t in enumerate(rows):
        raw = (t or "").encode()
        pad = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(pad))
        assert r.payload_sha256 == hashlib.sha256(pad).hexdigest()
        assert r.tail_crc32 == zlib.crc32(pad[-64:])
    assert got[7][1:] == got[8][1:]


def test_media_formats(spark):
    import numpy as np

    grey = np.random.default_rng(0).integers(0, 256, (37, 53), np.uint8)
    assert (media.decode(media.encode_bmp(grey)) == grey).all()
    plain = b"P2 # note\n53 37 255\n" + " ".join(map(str, grey.reshape(-1))).encode()
    assert (media.decode(plain) == grey).all()
    assert media.decode(b"P1\n3 2\n101\n010").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 1, 0]]
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert (media.untile(media.npy_tiles(grey, 16)) == grey).all()
    small = media.area_resize(grey, 5, 7)
    assert abs(small.mean() - grey.mean()) < 1e-9
    whole = media.area_resize(np.arange(16).reshape(4, 4), 2, 2)
    assert whole.tolist() == [[2.5, 4.5], [10.5, 12.5]]
    for bad in (b"", None, b"P5 9 9 255\nxx", b"BM", b"PNG"):
        with pytest.raises(ValueError):
            media.decode(bad)
    df = spark.createDataFrame([(media.encode_bmp(grey), "h"), (b"bad", "h"), (None, None)], "media binary, height2 string")
    got = media.media_columns(df).collect()
    assert (got[0].height, got[0].width, len(got[0].tiles)) == (37, 53, 1)
    assert got[1].dhash is None and got[2].tiles is None


def test_quality_rules_brute_force(spark, folder, rows):
    got = {r.doc_id: r for r in quality_rules.query(spark, folder).collect()}
    for i, t in enumerate(rows):
        w = words(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        hit = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(5)} if len(w) < 500 else set()
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i]
        assert r.n_words == len(w)
        assert r.word_chars == sum(len(x.decode()) for x in w)
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(hit)
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_rules_run_no_python(spark, folder):
    plan = quality_rules.query(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_warc(spark, tmp_path):
    body = "é" * 60
    rows = [(i, u, h) for i, (u, h) in enumerate([("http://a\n/x", body), ("http://b", body), (None, None), ("c", ""), ("d", "short"), ("e", "short"), ("f", body + "!"), ("g", "WARC/1.1\r\n\r\n" * 30), ("h", body)])]
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in warc.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min(j for j, _, x in rows if (x or "").encode() == raw) if len(raw) >= 100 else i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))


def test_warc_pushdown_and_empty(spark, tmp_path):
    from quire.session import Scratch

    pages = spark.createDataFrame([(i, f"u{i}", "p" * 200) for i in range(5)], "page_id long, url string, html string")
    with Scratch(spark) as s:
        warc.write_archive(pages, s.path("x"), s)
        back = spark.read.format("quire_warc").option("payload", "false").load(s.path("x")).where("rec_type = 'revisit'")
        rows = back.select("record_id", "payload", "headers").collect()
        assert sorted(r.record_id for r in rows) == [f"urn:page:{i}" for i in range(1, 5)]
        assert all(r.payload is None and r.headers["warc-type"] == "revisit" for r in rows)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.query(spark, str(tmp_path)).collect() == []


def shingles(t):
    w = [x.lower() for x in words(t)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_brute_force(spark, folder, rows):
    sets = [shingles(t) for t in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r for r in near_dedup.query(spark, folder).collect()}
    assert {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(rows))} == {i: tuple(r)[1:] for i, r in got.items()}


def test_superminhash_estimates():
    import numpy as np

    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 63, 900).astype(np.uint64)
    sets = [a[:600], a[100:700], a[:3], a[:2], np.empty(0, np.uint64), a]
    sig = near_dedup.superminhash(sets)
    assert abs((sig[0] == sig[1]).mean() - 500 / 700) < 0.15
    assert abs((sig[2] == sig[3]).mean() - 2 / 3) < 0.15
    assert (near_dedup.superminhash([a])[0] == sig[5]).all()


def test_components_of_a_long_chain(spark):
    from quire.session import Scratch

    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 300), (300, 250)], "a long, b long").repartition(8)
    with Scratch(spark) as s:
        got = {r.node: r.component for r in near_dedup.components(links, s).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 300: 200, 250: 200}


def library_ids(name, rows):
    t = bpe_words.load(vocab.vocabulary_path(name))
    return t, [t.encode(x or "", add_special_tokens=False).ids for x in rows]


HARD = [" lead", "trail ", "two  spaces", "tab\there", "line\nbreak\n", "\n\nblank", "a<|endoftext|>b <|startoftext|> C", "ΣΑΣ İstanbul ǅ ﬁ", "é àb ́c", "don't I'LL x's", "日本語 テスト", "🙂 🙂🙂 a🙂", " nbsp 　wide", "1234 5 a1b2", "\x00\x1f\x85"]


def test_bpe_words_equals_the_library(spark, tmp_path, rows):
    rows = rows + HARD
    folder = write(spark, tmp_path, rows)
    t, ids = library_ids("word_bpe_49k.json", rows)
    got = {r.doc_id: r for r in bpe_words.query(spark, folder).collect()}
    for i, own in enumerate(ids):
        assert got[i].n_tokens == len(own), rows[i]
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), rows[i]
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(own, skip_special_tokens=False).encode()).hexdigest(), rows[i]
    full = bpe_words.bpe(frame(spark, rows), vocab.vocabulary_path("word_bpe_49k.json"), block_bytes=300).collect()
    assert {r.doc_id: r.ids for r in full} == dict(enumerate(ids))
    assert {r.doc_id: r.decoded for r in full} == {i: t.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}


def test_curve_packing_round_trip(spark, tmp_path, rows):
    import struct

    rows = rows + HARD
    folder = write(spark, tmp_path, rows)
    _, ids = library_ids("byte_bpe_50k.json", rows)
    got = curve_packing.query(spark, folder).collect()
    pieces, full = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        full.setdefault(r.sequence_id, []).append(r)
    for i, own in enumerate(ids):
        own, at = own + [0], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own), rows[i]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *own[at : at + r.length])), rows[i]
            at += r.length
        assert at == len(own)
    sizes = []
    for k in sorted(full):
        at = 0
        for r in sorted(full[k], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert sorted(full) == list(range(len(full))) and set(sizes[:-1]) <= {1024}


def test_hilbert_neighbours_touch():
    import numpy as np

    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = curve_packing.hilbert_key(grid, bits=3)
    assert sorted(key) == list(range(512))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_substring_dedup_brute_force(spark, folder, rows):
    seen = {}
    for i, t in enumerate(rows):
        w = words(t)
        for k in range(len(w) - 34):
            seen.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    gone = {(i, k + d) for at in seen.values() if len(at) > 1 for i, k in at for d in range(35)}
    got = {r.doc_id: r for r in substring_dedup.query(spark, folder).collect()}
    for i, t in enumerate(rows):
        kept = [w for k, w in enumerate(words(t)) if (i, k) not in gone]
        assert got[i].n_words == len(words(t)) and got[i].n_removed == len(words(t)) - len(kept)
        assert got[i].kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
    assert any(r.n_removed for r in got.values())


def test_cover_takes_any_two_positions_to_an_anchor():
    p, cover = substring_dedup.PERIOD, set(substring_dedup.COVER)
    for i in range(p):
        for j in range(p):
            assert any((i + d) % p in cover and (j + d) % p in cover for d in range(p))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance():
    import random

    r = random.Random(5)
    for _ in range(3000):
        a = "".join(r.choice("ab") for _ in range(r.randint(0, 12)))
        b = "".join(r.choice("ab") for _ in range(r.randint(0, 12)))
        for most in (0, 1, 2, 3):
            assert line_dedup.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1), (a, b, most)


def test_segments_meet_probes():
    import random

    r = random.Random(6)
    for edits in (1, 2, 3):
        for _ in range(400):
            a = list("".join(r.choice("abc") for _ in range(r.randint(8, 40))))
            b = list(a)
            for _ in range(edits):
                at = r.randrange(len(b))
                r.choice([lambda: b.pop(at), lambda: b.insert(at, "x"), lambda: b.__setitem__(at, "y")])()
            ka, kb = (line_dedup.line_keys("".join(x), edits) for x in (a, b))
            assert any(ka[k] | kb[k] == 3 for k in ka.keys() & kb.keys())


def test_line_dedup_brute_force(spark, folder, rows):
    at = [(i, k, x) for i, t in enumerate(rows) for k, x in enumerate((t or "").split("\n")) if len(x) >= line_dedup.MIN_CHARS]
    root = list(range(len(at)))

    def find(x):
        return x if root[x] == x else find(root[x])

    links = {}
    for a, b in combinations(range(len(at)), 2):
        if abs(len(at[a][2]) - len(at[b][2])) <= 2 and levenshtein(at[a][2], at[b][2]) <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
            if at[a][2] != at[b][2]:
                links.setdefault(at[a][2], set()).add(at[b][2])
                links.setdefault(at[b][2], set()).add(at[a][2])
    want = {}
    for k, (i, n, x) in enumerate(at):
        if sum(find(j) == find(k) for j in range(len(at))) > 1:
            first = at[find(k)]
            want.setdefault(i, []).append((n, first[0], first[1], len(links.get(x, ())), find(k) != k))
    got = {r.doc_id: r for r in line_dedup.query(spark, folder).collect()}
    for i, t in enumerate(rows):
        own = want.get(i, [])
        assert [tuple(x) for x in got[i].lines or []] == own
        gone = {x[0] for x in own if x[4]}
        kept = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert any(x[3] and x[4] for own in want.values() for x in own)


def test_line_dedup_short_lines(spark, tmp_path):
    rows = ["And ornd.\nno\n\n \nfirst one here", "And ornd.\nno\n\n \nno", "And orxd.\non\nfirst one hers.", "短い行です。\nAnd\nAnt", "短い行てす。\nAnx orxd."]
    got = {r.doc_id: r for r in line_dedup.query(spark, write(spark, tmp_path, rows)).collect()}

    def most(a, b):
        return min(2, min(len(a), len(b)) // 5)

    at = [(i, k, x) for i, t in enumerate(rows) for k, x in enumerate(t.split("\n")) if x.strip()]
    root = list(range(len(at)))
    for _ in at:  # labels spread until none changes
        for a, b in combinations(range(len(at)), 2):
            if levenshtein(at[a][2], at[b][2]) <= most(at[a][2], at[b][2]):
                root[a] = root[b] = min(root[a], root[b])
    gone = {at[k][:2] for k in range(len(at)) if root[k] != k}
    assert gone == {(1, 0), (1, 1), (1, 4), (2, 0), (2, 2), (4, 0), (4, 1)}
    for i, t in enumerate(rows):
        assert {x.line_no for x in got[i].lines or [] if x.removed} == {n for d, n in gone if d == i}
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_short_segments_meet_probes():
    import random

    r = random.Random(7)
    for _ in range(4000):
        a = "".join(r.choice("ab") for _ in range(r.randint(3, 16)))
        b = list(a)
        for _ in range(r.randint(1, 2)):
            at = r.randrange(len(b))
            r.choice([lambda: b.pop(at), lambda: b.insert(at, "x"), lambda: b.__setitem__(at, "y")])()
        b = "".join(b)
        if a != b and levenshtein(a, b) <= line_dedup.allowed(min(len(a), len(b)), 2):
            ka, kb = (line_dedup.line_keys(x, 2, line_dedup.CHARS_PER_EDIT) for x in (a, b))
            assert any(ka[k] | kb[k] == 3 for k in ka.keys() & kb.keys()), (a, b)


def test_near_dedup_loss_by_threshold():
    from fractions import Fraction
    from math import comb

    for least in (Fraction(85, 100), Fraction(4, 5)):
        s, (bands, per) = float(least), near_dedup.banding(least)
        assert bands * per == near_dedup.SLOTS and (1 - s**per) ** bands < 1e-6
        assert sum(comb(120, k) * s**k * (1 - s) ** (120 - k) for k in range(near_dedup.fewest_equal(least))) <= 1e-7


def test_near_dedup_low_estimate_is_a_candidate():
    from fractions import Fraction

    import numpy as np
    import pyarrow as pa

    one = np.arange(120, dtype=np.uint32)
    other = one.copy()
    other[85:] += 1000  # 85 of 120 equal: under 0.85 - 0.12, as 3.0e-4 of the links at 0.85 are
    left = [{"doc_id": i, "n_shingles": 100, "signature": x.tobytes()} for i, x in enumerate((one, other))]
    batch = pa.RecordBatch.from_pydict({"left": pa.array([left]), "right": pa.array([None], pa.list_(pa.int64()))})
    assert [b.to_pylist() for b in near_dedup._candidates(Fraction(85, 100))([batch])] == [[{"a": 0, "b": 1}]]
