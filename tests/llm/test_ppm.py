"""Language-model scores against a model of dictionaries, byte by byte."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netvigil.llm import ppm

ORDER = 5
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small(text):
    return (text or "").translate(LOWER)


def symbols(text):
    return [255] * ORDER + list(small(text).encode()) + [255]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", small(text))


class ByHand:
    def __init__(self, texts):
        self.seen = collections.defaultdict(collections.Counter)
        self.words = collections.Counter()
        for t in texts:
            x = symbols(t)
            for i in range(ORDER, len(x)):
                for k in range(ORDER + 1):
                    self.seen[tuple(x[i - k : i])][x[i]] += 1
            self.words.update([*words(t), ""])

    def p(self, context, s):
        out, excluded = 1.0, set()
        for k in range(ORDER, -1, -1):
            here = {a: n for a, n in self.seen.get(tuple(context[len(context) - k :]), {}).items() if a not in excluded}
            if not here:
                continue
            total = sum(here.values())
            if s in here:
                return out * (here[s] - 0.5) / total
            out *= 0.5 * len(here) / total
            excluded |= set(here)
        return out / (256 - len(excluded))

    def score(self, text):
        x = symbols(text)
        return sum(math.log10(self.p(x[i - ORDER : i], x[i])) for i in range(ORDER, len(x)))

    def base(self, text):
        below = sum(self.words.values()) + len(self.words) + 1
        return sum(math.log10((self.words[w] + 1) / below) for w in [*words(text), ""])


def corpus(seed=1):
    rnd = random.Random(seed)
    bits = ["the ", "cat", "Cats ", "été ", "日本", "\n", "  ", "a", "😀", "\x00", "zzz", "The end.", "\t"]
    texts = ["".join(rnd.choices(bits[: rnd.randint(1, len(bits))], k=rnd.randint(0, 40))) for _ in range(120)]
    return [None, "", " ", "x" * 5000, "the the the", "the the the", *texts]


@pytest.mark.parametrize("chunk", [200, 10**9])
def test_equals_the_dictionaries(spark, chunk, monkeypatch, tmp_path):
    monkeypatch.setattr(ppm, "CHUNK_BYTES", chunk)
    rows = [*enumerate(corpus()), (None, "no id"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    model = ByHand([t for i, t in rows if not held(i)])
    got = ppm.op12_lm_score(spark, str(tmp_path)).collect()
    want = [(i, held(i), len(words(t)) + 1, sum(model.words[w] > 0 for w in [*words(t), ""]), sum(model.words.values()), model.base(t), model.score(t)) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[5], r[6])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    model = ByHand(corpus(2))
    for context in list(model.seen)[:300]:
        if len(context) == ORDER:
            assert sum(model.p(context, s) for s in range(256)) == pytest.approx(1)


def test_words_whose_hashes_meet_get_another_salt(spark, monkeypatch):
    real = ppm.hashes
    monkeypatch.setattr(ppm, "hashes", lambda words, salt: real(words, salt) & (255 if salt < 2 else -1))
    df = spark.createDataFrame([(i, f"w{i} x{i % 7} y") for i in range(60)], "doc_id long, text string").coalesce(1)
    model = ByHand([r.text for r in df.collect()])
    for r in ppm.score_texts(df, F.lit(True)).collect():
        assert r.base_score == pytest.approx(model.base(f"w{r.doc_id} x{r.doc_id % 7} y")) and r.n_known == 4


@pytest.mark.parametrize("n", [1, 5, 1000, 60_000])
def test_table(n):
    rng = np.random.default_rng(n)
    keys = np.unique(np.concatenate([[0, -1][: min(n, 2)], rng.integers(-(2**63), 2**63 - 1, n), np.arange(n) << 40]))
    values = rng.random(len(keys))
    asked = rng.integers(0, len(keys), 3 * n)
    assert (ppm.Table(keys, values).of(keys[asked]) == values[asked]).all()


def test_no_training_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score_texts(df, F.lit(False)).collect()}
    assert got[1].score == pytest.approx(-3 * math.log10(256)) and got[1].base_score == 0 and got[1].n_known == 0 and got[2].n_tokens == 1
    assert ppm.score_texts(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).collect() == []


def test_beats_the_base_on_texts_that_it_has_not_seen(spark):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randint(4, 9))) for _ in range(300)]
    follows = {w: rnd.choices(vocabulary, k=2) for w in vocabulary}  # words that depend on the one before

    def text():
        word, out = rnd.choice(vocabulary), []
        for _ in range(60):
            out.append(word)
            word = rnd.choice(follows[word])
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    done = ppm.score_texts(df, ~ppm.is_held_out(F.col("doc_id"))).where(ppm.is_held_out(F.col("doc_id"))).agg(F.avg("score"), F.avg("base_score")).first()
    assert done[0] > 0.9 * done[1]
