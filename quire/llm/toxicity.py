"""Toxicity by a weighted finite-state pattern grammar.

Words are classed into symbols: insult, threat, target, negation, reported
speech, clause end, other.  Five small transducers read the symbols: one each for
insults and threats, and three that keep a scope (a negation covers the next
three words, a report the rest of its sentence, a target reaches five words).
``compose`` multiplies them into one deterministic machine; a second one reads each
clause from its end, so that a target behind an insult ("idiots like you") counts as
one before it.  Together they give the kinds of a clause: an insult aimed at someone
is another event than a negated or a quoted one, and a clause counts once for each
kind, however many words of it match.  A logistic layer over the clause counts,
fitted on the labelled rows, weighs the events and gives the score.

The insult lexicon is the fixed list below and stems learned from labelled rows:
prefixes of 4 to 8 letters that are far likelier in toxic than in other texts and
stand in at least three and in one of a hundred toxic texts.  Learning uses at most
``train_rows`` labelled rows (chosen by a hash of the id) and never a row whose
crc32(doc_id) mod 5 is 0; within that sample no prefix is left out.

Defined cases: null and empty texts have no events and get the score of the
intercept, which is below 0.5; without labelled rows of both kinds the prior weights below hold;
repeated rows are scored each for itself; only the named columns are read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.session import ship, table

QUERY = "op1_toxicity"
ORACLE_SQL = None

INSULT, THREAT, TARGET, NEGATION, REPORT, END, OTHER = range(7)

#: The lexicon of each symbol, in English, French, German and Spanish.
LEXICON = {
    INSULT: (
        "idiot idiots moron morons imbecile fool loser losers scum trash garbage clown pathetic worthless disgusting stupid dumb "
        "ugly filthy vermin pig swine coward liar bastard jerk creep freak degenerate parasite retard bitch "
        "imbécile crétin abruti connard salaud ordure débile minable dégoûtant "
        "arschloch dummkopf schwachkopf trottel abschaum widerlich erbärmlich versager "
        "idiota imbécil estúpido basura escoria asqueroso inútil payaso cretino"
    ),
    THREAT: "kill murder hurt destroy shoot stab strangle beat burn hang tuer frapper détruire töten schlagen umbringen vernichten matar golpear destruir",
    TARGET: (
        "you your he she they them him her this that these those we it people everyone "
        "tu toi vous il elle ils elles ce ces du sie er ihr dich dir diese dieser ese esa esos ellos ella usted ustedes"
    ),
    NEGATION: "not no never don't isn't aren't wasn't without ne pas jamais sans nicht kein keine nie ohne nunca sin tampoco",
    REPORT: "said says say told quoted wrote claims claimed reported according a-t-il dit selon écrit sagte sagt laut schrieb dijo dice según escribió",
}
TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|[.!?\n;:,]")
ENDS = frozenset(".!?\n;:")
PREFIXES = range(4, 9)


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer: ``step(state, symbol) -> (state, tag)``."""

    start: int
    step: dict[tuple[int, int], tuple[int, str]] = field(hash=False)


def _scope(opener: int, reach: int, tag: str, closes: bool = True) -> Transducer:
    """Reads ``opener``, then tags the next ``reach`` symbols; a clause end closes the scope."""
    step = {}
    for state, symbol in itertools.product(range(reach + 1), range(7)):
        left = reach if symbol == opener else 0 if symbol == END and closes else max(0, state - 1)
        step[state, symbol] = (left, tag if state else "")
    return Transducer(0, step)


def _report() -> Transducer:
    step = {(s, x): (1 if x == REPORT else 0 if x == END else s, "r" if s else "") for s in (0, 1) for x in range(7)}
    return Transducer(0, step)


def _kind(symbol: int, tag: str) -> Transducer:
    return Transducer(0, {(0, x): (0, tag if x == symbol else "") for x in range(7)})


def compose(*parts: Transducer) -> tuple[np.ndarray, list[list[str]]]:
    """The product machine: next states [state, symbol] and the joined tags of each step."""
    start = tuple(p.start for p in parts)
    number, todo, to, tags = {start: 0}, [start], [], []
    while todo:
        state = todo.pop(0)
        row, said = [], []
        for x in range(7):
            moved = [p.step[s, x] for p, s in zip(parts, state, strict=True)]
            nxt = tuple(m[0] for m in moved)
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append(number[nxt])
            said.append("".join(m[1] for m in moved))
        to.append(row)
        tags.append(said)
    return np.array(to, np.int32), tags


#: Tags: I insult, H threat, n negated, r reported, t aimed at a target. Prior weights of their events.
PRIOR = {"I": 2.0, "It": 3.0, "In": 0.5, "Int": 0.5, "Ir": 0.7, "Irt": 1.0, "Inr": 0.2, "Inrt": 0.2, "H": 0.5, "Ht": 2.0, "Hn": 0.1, "Hnt": 0.3, "Hr": 0.1, "Hrt": 0.5, "Hnr": 0.0, "Hnrt": 0.0}
EVENTS = tuple(PRIOR)
BIAS = -1.5


class Grammar:
    """The composed machine with a lexicon; ``events`` counts the matched clauses of a text."""

    def __init__(self, stems: frozenset[str] = frozenset()):
        self.symbol = {w: s for s, words in LEXICON.items() for w in words.split()}
        self.stems = stems
        self.to, tags = compose(_kind(INSULT, "I"), _kind(THREAT, "H"), _scope(NEGATION, 3, "n"), _report(), _scope(TARGET, 5, "t"))
        self.back, aims = compose(_scope(TARGET, 5, "t"))
        at = {t: i for i, t in enumerate(EVENTS)}
        self.out = [[at.get(t, -1) if t[:1] in ("I", "H") else -1 for t in row] for row in tags]
        self.aims = [[bool(t) for t in row] for row in aims]
        #: Each event with a target added.
        self.aimed = [at[t if t.endswith("t") else t + "t"] for t in EVENTS]
        self.cache: dict[str, int] = {}

    def classify(self, word: str) -> int:
        s = self.cache.get(word)
        if s is None:
            s = self.symbol.get(word, OTHER)
            if s == OTHER and word in ENDS:
                s = END
            if s == OTHER and any(word[:k] in self.stems for k in PREFIXES if k <= len(word)):
                s = INSULT
            if len(self.cache) < 200_000:
                self.cache[word] = s
        return s

    def events(self, text: str | None) -> list[int]:
        counts = [0] * len(EVENTS)
        symbols = [self.classify(w) for w in TOKEN.findall((text or "").lower())]
        if INSULT not in symbols and THREAT not in symbols:
            return counts
        to, out, state, start = self.to.tolist(), self.out, 0, 0
        found: list[tuple[int, int]] = []  # places and events of the clause under way
        for k, x in enumerate([*symbols, END]):
            if x == END:
                if found:
                    for e in self._clause(symbols[start:k], found, start):
                        counts[e] += 1
                    found = []
                start = k + 1
            elif (e := out[state][x]) >= 0:
                found.append((k, e))
            state = to[state][x]
        return counts

    def _clause(self, symbols: list[int], found: list[tuple[int, int]], start: int) -> set[int]:
        """The kinds of a clause: events found from the left, aimed if the machine from the right says so too."""
        back, state, aimed = self.back.tolist(), 0, [False] * len(symbols)
        for k in range(len(symbols) - 1, -1, -1):
            aimed[k] = self.aims[state][symbols[k]]
            state = back[state][symbols[k]]
        return {self.aimed[e] if aimed[k - start] else e for k, e in found}


@dataclass(frozen=True)
class Model:
    stems: frozenset[str]
    weights: tuple[float, ...]
    bias: float


def score(model: Model, counts: np.ndarray) -> np.ndarray:
    z = np.log1p(counts) @ np.array(model.weights) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _prefix_counts(batches):
    """Number of texts that each prefix occurs in, by label; the sum over a partition."""
    found = {0: Counter(), 1: Counter()}
    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = {w for w in TOKEN.findall((text or "").lower()) if len(w) >= PREFIXES[0]}
            found[toxic].update({w[:k] for w in words for k in PREFIXES if k <= len(w)})
    rows = [(p, n, y) for y, c in found.items() for p, n in c.items()]
    yield pa.RecordBatch.from_pydict({"prefix": [r[0] for r in rows], "n": [r[1] for r in rows], "toxic": [r[2] for r in rows]}, schema=pa.schema([("prefix", pa.string()), ("n", pa.int64()), ("toxic", pa.int32())]))


def learn_stems(train: DataFrame, n_toxic: int, n_clean: int, odds: float = 2.4, least: int = 3, share: float = 0.01) -> frozenset[str]:
    """Prefixes whose log ratio of smoothed rates, less its standard error, is over ``odds``, in at least ``least``
    toxic texts and a ``share`` of them.

    All prefixes are judged where they are counted.  A passing prefix stands in a ``share`` of the
    toxic texts, so those that reach the driver are bounded by the length of the bounded sample's texts.
    """
    sums = train.select("text", "toxic").mapInArrow(_prefix_counts, "prefix string, n long, toxic int").groupBy("prefix").agg(
        *(F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(name) for y, name in ((1, "bad"), (0, "good")))
    )
    rate = lambda n, of: (F.col(n) + 0.5) / (of + 1)
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    judged = sums.where((F.col("bad") >= max(least, int(share * n_toxic))) & (F.log(rate("bad", n_toxic) / rate("good", n_clean)) - error > odds))
    return frozenset(r.prefix for r in judged.select("prefix").collect())


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, train_rows: int = 20_000) -> Model:
    """Stems and event weights from labelled rows outside the held-out fold."""
    ship(spark)
    known = (
        labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    train = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")
    sizes = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    prior = Model(frozenset(), tuple(PRIOR.values()), BIAS)
    if len(sizes) < 2:
        return prior
    stems = learn_stems(train, sizes[1], sizes[0])

    def tally(batches):
        g = Grammar(stems)
        for b in batches:
            seen = Counter((y, *g.events(t)) for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True))
            yield pa.RecordBatch.from_pydict({"event": [list(k) for k in seen], "n": list(seen.values())}, schema=pa.schema([("event", pa.list_(pa.int32())), ("n", pa.int64())]))

    rows = train.mapInArrow(tally, "event array<int>, n long").groupBy("event").agg(F.sum("n").alias("n")).collect()  # at most train_rows rows
    x = np.log1p(np.array([r.event[1:] for r in rows], np.float64))
    y, n = np.array([r.event[0] for r in rows], np.float64), np.array([r.n for r in rows], np.float64)
    x = np.hstack([x, np.ones((len(x), 1))])
    centre = np.array([*PRIOR.values(), BIAS])
    w, shrink = centre.copy(), np.array([1.0] * len(EVENTS) + [0.01])
    for _ in range(50):  # Newton steps; the penalty pulls to the prior weights
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + shrink * (w - centre)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(curve, slope)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return Model(stems, tuple(w[:-1]), min(float(w[-1]), -0.01))  # a text without a matched clause isn't toxic, however many labels are


def toxicity(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_events) of every row."""
    ship(df.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_events", pa.int32())])

    def run(batches):
        g = Grammar(model.stems)
        for b in batches:
            counts = np.array([g.events(t.as_py()) for t in b.column("text")], np.float64).reshape(-1, len(EVENTS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score(model, counts)), pa.array(counts.sum(1).astype(np.int32))], schema=out)

    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, score double, n_events int")


def with_score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``df`` with the score of its text as another column."""
    ship(df.sparkSession)

    def run(batches):
        g = Grammar(model.stems)
        for b in batches:
            counts = np.array([g.events(t.as_py()) for t in b.column(text)], np.float64).reshape(-1, len(EVENTS))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(model, counts))], names=[*b.schema.names, column])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(column, DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(spark, docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_events",
    )
