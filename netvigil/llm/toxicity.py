"""Toxicity by a weighted finite-state pattern grammar.

Words get a class: insult, threat, target, negation, reported speech or none. Insults
are a small fixed list and words and productive stems that the labels teach. Four
transducers read a clause's classes one after the other, each reading what the one
before it wrote: negation weakens a core word shortly after it, reported speech marks
core words after it, target marks a core word near an address, and the last sums up
the clause as its strongest pattern. A document's score is a logistic function of how
many clauses match each pattern; its weights are fitted to the labels by Newton steps
that are drawn to the fixed weights ``PRIOR``.

At most ``MAX_TRAIN`` labelled rows, those with the smallest hash of doc_id, are fitted
on; held-out rows never are. Lexicon features count clusters of alike texts, not rows,
and must be very unlikely (G2) and precise.

Defined results: a null or empty text has no clauses and gets the base score; rows with
equal doc_id are scored each; a null doc_id is not held out; without labels the fixed
lexicon and weights are used; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.llm.common import only, stored, table

MAX_TRAIN = 40_000
#: Least evidence for a lexicon feature: G2 statistic, precision, clusters; words that a stem must have.
LEAST_G2, LEAST_PRECISION, LEAST_CLUSTERS, LEAST_WORDS = 24.0, 0.8, 4, 5
STEMS = (3, 4, 5, 6, 7, 8)

# Word lists of the grammar in four languages.
INSULTS = "idiot moron imbecile stupid loser scum worthless pathetic disgusting".split()
THREATS = "kill hurt destroy murder strangle shoot umbringen töten tuer matar".split()
TARGETS = "you your yours u he she they du dich dir ihr euch sie tu te toi vous ton ta il elle usted tú ti tus él ella".split()
NEGATIONS = "not never no nobody isn't aren't don't nicht kein keine nie pas jamais aucun nunca ni ningún".split()
REPORTS = "said says say claimed wrote quoted called sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()

O, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Core words after the transducers: plain, targeted, negated, reported, for insults and threats.
PATTERNS = ["insult", "targeted insult", "negated insult", "reported insult", "threat", "targeted threat", "negated threat", "reported threat"]
#: Fixed weights: the base and one for each pattern.
PRIOR = np.array([-3.0, 4.0, 5.0, 2.0, 2.0, 2.0, 4.0, 1.0, 1.0])

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass
class Transducer:
    """States with (state, symbol) -> (state, written symbol); unnamed symbols are copied."""

    start: int
    rules: dict[tuple[int, int], tuple[int, int]]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.rules.get((state, symbol), (state, symbol))


#: Core symbols beyond the six classes: 10 + place in PATTERNS.
def _core(threat: bool, kind: int) -> int:
    return 10 + 4 * threat + kind


def _negation() -> Transducer:
    """A core word up to three words after a negation is negated."""
    rules = {}
    for left in range(4):
        after = max(0, left - 1)
        for symbol in (O, TARGET, REPORT):
            rules[left, symbol] = (after, symbol)
        rules[left, NEGATION] = (3, NEGATION)
        for symbol, threat in ((INSULT, False), (THREAT, True)):
            rules[left, symbol] = (after, _core(threat, 2 if left else 0))
    return Transducer(0, rules)


def _report() -> Transducer:
    """Core words after a verb of saying are reported."""
    rules = {(s, REPORT): (1, REPORT) for s in (0, 1)}
    for threat in (False, True):
        for kind in (0, 2):
            rules[1, _core(threat, kind)] = (1, _core(threat, 3))
    return Transducer(0, rules)


def _target() -> Transducer:
    """A plain core word up to four words after an address is aimed at someone."""
    rules = {}
    for left in range(5):
        after = max(0, left - 1)
        rules |= {(left, symbol): (after, symbol) for symbol in (O, NEGATION, REPORT)}
        rules[left, TARGET] = (4, TARGET)
        for threat in (False, True):
            for kind in range(4):
                rules[left, _core(threat, kind)] = (after, _core(threat, 1 if left and kind == 0 else kind))
    return Transducer(0, rules)


#: Stronger patterns first.
STRENGTH = [_core(False, 1), _core(True, 1), _core(False, 0), _core(True, 0), _core(False, 2), _core(False, 3), _core(True, 2), _core(True, 3)]


def _summary() -> Transducer:
    """The state is the strongest pattern so far; it is written nowhere but read at the end."""
    order = {symbol: len(STRENGTH) - k for k, symbol in enumerate(STRENGTH)}
    return Transducer(0, {(state, symbol): (max(state, rank), symbol) for state in range(len(STRENGTH) + 1) for symbol, rank in order.items()})


def compose(parts: list[Transducer]) -> tuple[list[list[int]], list[int]]:
    """One automaton for a cascade: next state by (state, class), and each state's pattern or -1."""
    states = {tuple(p.start for p in parts): 0}
    todo, table_, out = [tuple(p.start for p in parts)], [], []
    while len(table_) < len(todo):
        now = todo[len(table_)]
        out.append(-1 if not now[-1] else STRENGTH[len(STRENGTH) - now[-1]] - 10)
        row = []
        for symbol in range(6):
            nexts, passed = [], symbol
            for part, state in zip(parts, now, strict=True):
                state, passed = part.step(state, passed)
                nexts.append(state)
            key = tuple(nexts)
            if key not in states:
                states[key] = len(todo)
                todo.append(key)
            row.append(states[key])
        table_.append(row)
    return table_, out


GRAMMAR, PATTERN_OF = compose([_negation(), _report(), _target(), _summary()])


@dataclass
class Model:
    """Learnt insults (words, stems) and the weights of the patterns."""

    words: set[str] = field(default_factory=set)
    stems: set[str] = field(default_factory=set)
    weights: np.ndarray = field(default_factory=PRIOR.copy)


class _Classes(dict):
    """The class of each word, worked out when it first comes."""

    def __init__(self, model: Model):
        self.model = model
        super().__init__()
        for words, kind in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT), (INSULTS, INSULT), (model.words, INSULT)):
            self.update(dict.fromkeys(words, kind))

    def __missing__(self, word: str) -> int:
        kind = INSULT if any(word[:k] in self.model.stems for k in STEMS if len(word) > k) else O
        if len(self) < 500_000:
            self[word] = kind
        return kind


def pattern_counts(text: str, classes: _Classes) -> list[int]:
    """How many clauses match each pattern."""
    out = [0] * len(PATTERNS)
    low = text.lower()
    if not {INSULT, THREAT} & set(map(classes.__getitem__, set(_WORD.findall(low)))):
        return out
    for clause in _CLAUSE.split(low):
        state = 0
        for word in _WORD.findall(clause):
            state = GRAMMAR[state][classes[word]]
        if (found := PATTERN_OF[state]) >= 0:
            out[found] += 1
    return out


def scores(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic scores of pattern counts."""
    z = weights[0] + np.log2(1 + np.minimum(counts, 3)) @ weights[1:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def is_held_out(doc_id: F.Column) -> F.Column:
    """crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sketch(words: list[str]) -> int:
    """Alike texts mostly get one number: the least hash of their word pairs."""
    from xxhash import xxh32_intdigest

    return min((xxh32_intdigest(f"{a} {b}") for a, b in zip(words, words[1:] or [""])), default=0)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns lexicon and weights from labelled rows that are not held out."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    sample = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = stored(rows.join(F.broadcast(sample), "doc_id").select("text", "toxic"), "labelled")  # MAX_TRAIN small rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                names: list[str] = []
                clusters: list[int] = []
                for text in batch.column(0).slice(at, 256).to_pylist():
                    words = _WORD.findall(text.lower())
                    own = set(words)
                    own |= {w[:k] + "*" for w in own for k in STEMS if len(w) > k}
                    names += own
                    clusters += [sketch(words)] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(clusters, pa.int64())], ["name", "cluster"])

    toxic = known.where("toxic = 1").select("text").mapInArrow(features, "name string, cluster long").distinct()
    toxic = stored(toxic, "toxic-features")
    n_toxic = toxic.select("cluster").distinct().count()
    least = max(LEAST_CLUSTERS, n_toxic // 500)  # so that at most 500 times a text's features remain
    seen = {r["name"]: r["n"] for r in toxic.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}
    stem = F.explode(F.array(*[F.when(F.length("name") > k, F.concat(F.substring("name", 1, k), F.lit("*"))) for k in STEMS]))
    productive = {r["stem"] for r in toxic.where(~F.col("name").endswith("*")).select("name").distinct().select(stem.alias("stem")).groupBy("stem").agg(F.count("*").alias("n")).where((F.col("n") >= LEAST_WORDS) & F.col("stem").isNotNull()).join(F.broadcast(known.sparkSession.createDataFrame([(s,) for s in seen if s.endswith("*")] or [("",)], "stem string")), "stem").collect()}
    names = {n for n in seen if not n.endswith("*") or n in productive}

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = set(_WORD.findall(text.lower()))
                for name in (own | {w[:k] + "*" for w in own for k in STEMS if len(w) > k}) & names:
                    found[name] = found.get(name, 0) + 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["name", "n"])

    clean = known.where("toxic = 0")
    n_clean = clean.count()
    against = {r["name"]: r["n"] for r in clean.select("text").mapInArrow(clean_counts, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).collect()}
    chosen = [n for n in names if _telling(seen[n], n_toxic, against.get(n, 0), n_clean)]
    model = Model({n for n in chosen if n[-1] != "*"}, {n[:-1] for n in chosen if n[-1] == "*"})
    counted = known.mapInArrow(_counting(model, 0, "toxic"), "toxic int, counts string").groupBy("toxic", "counts").agg(F.count("*").alias("n")).collect()
    model.weights = _fitted([(r["toxic"], [int(x) for x in r["counts"].split(",")], r["n"]) for r in counted])
    return model


def _telling(toxic: int, n_toxic: int, clean: int, n_clean: int) -> bool:
    """Whether a feature is far too frequent in toxic texts, and rare elsewhere."""
    if toxic / (toxic + clean) < LEAST_PRECISION:
        return False
    share = (toxic + clean) / (n_toxic + n_clean)
    cells = [(toxic, n_toxic * share), (clean, n_clean * share), (n_toxic - toxic, n_toxic * (1 - share)), (n_clean - clean, n_clean * (1 - share))]
    return 2 * sum(x * math.log(x / e) for x, e in cells if x > 0 and e > 0) >= LEAST_G2


def _counting(model: Model, text_at: int, keep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(toxic, counts of at most 3 each) of each labelled text: few distinct rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(model)
        for batch in batches:
            counts = [",".join(str(min(3, c)) for c in pattern_counts(t, classes)) for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(keep).cast(pa.int32()), pa.array(counts, pa.string())], ["toxic", "counts"])

    return run


def _fitted(rows: list[tuple[int, list[int], int]], draw: float = 0.05) -> np.ndarray:
    """Newton's method on the log-likelihood of grouped rows, drawn to the fixed weights."""
    weights = PRIOR.copy()
    if not rows:
        return weights
    y, n = np.array([r[0] for r in rows], float), np.array([r[2] for r in rows], float)
    x = np.concatenate([np.ones((len(rows), 1)), np.log2(1 + np.array([r[1] for r in rows], float))], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (y - p)) - draw * (weights - PRIOR)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + draw * np.eye(len(PRIOR)), slope)
        weights = weights + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return weights


def score_texts(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """All columns of docs and one more, the score (0 to 1)."""
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts = np.array([pattern_counts(t or "", classes) for t in part.column(names.index("text")).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(counts, sent.value.weights))], [*names, name])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents with a model learnt from the rows that are not held out."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
