"""Pipeline stages against brute force on a small table with odd rows."""

import re

import corpus_pipeline as pipeline
import numpy as np
import pytest
from netvigil.llm import alike


def _words(seed, n):
    letters = np.random.default_rng(seed).integers(97, 123, (n, 7), dtype=np.uint8)
    return " ".join(bytes(w).decode() for w in letters)


ITEM, PASSAGE = _words(90, 14), _words(91, 60)
NEAR = _words(1, 400)
TEXTS = [
    (1, NEAR),
    (2, NEAR),
    (3, NEAR.rsplit(" ", 1)[0] + " otherword"),
    (4, _words(4, 80) + " é " + PASSAGE + " " + _words(5, 90)),
    (5, _words(6, 70) + " ü " + PASSAGE + "é " + _words(7, 80)),
    (6, _words(8, 50) + " " + ITEM.upper() + " " + _words(9, 60)),
    (7, None),
    (8, ""),
    (9, "short"),
    (10, " \n"),
    (10, _words(10, 30)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in TEXTS], SCHEMA)


def _texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_near_duplicates(spark, docs, tables):
    kept = pipeline.drop_near_duplicates(spark, docs, tables)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 8, 9, 10, 10]  # both unlike rows of 10


def test_near_duplicates_are_rows(spark, tables):
    """Unlike rows of one doc_id stay, alike ones are one, and a row without doc_id gives way to one with it."""
    a, b, c, d = (_words(200 + k, 60) for k in range(4))
    rows = [(1, a), (2, b), (2, c), (3, a), (3, d), (None, d), (5, b), (2, b), (None, _words(300, 40))]
    kept = pipeline.drop_near_duplicates(spark, spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA), tables)
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == sorted([(1, a), (2, b), (2, c), (3, d), (0, rows[-1][1])])


def _clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(7).alias(n) for n in ("row", "spans", "toxicity", "class", "node", "fp", "hash", "start", "end")])


def test_toxic_documents_go(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    rows = [(k, " ".join(rng.choice(words, 25)) + (" grunkle" if k % 3 == 0 else "") + " " + " ".join(rng.choice(words, 9)), "en", "s", 9) for k in range(300)]
    rows += [(900, None, "en", "s", None), (901, "", "en", "s", 0), (901, "", "en", "s", 0), (None, "plain words", "en", "s", 11)]
    labels = [(k, 1, int(k % 3 == 0)) for k in range(300)] + [(0, 1, 0)]  # a doc_id with two labels is toxic
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = _clashing(spark.createDataFrame(rows, SCHEMA))
    kept = pipeline.drop_toxic(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted([k for k in range(300) if k % 3] + [900, 901, 901, -1])
    assert pipeline.drop_toxic(spark, df.where("false"), str(tmp_path)).count() == 0


def test_clashing_columns(spark, docs, tables):
    df = _clashing(docs)
    for stage in (pipeline.drop_near_duplicates, pipeline.cut_repeats, pipeline.cut_benchmark):
        got = stage(spark, df, tables)
        assert got.columns == df.columns
        rows = got.collect()
        assert {r.row for r in rows} == {r.spans for r in rows} == {7}
        assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r.doc_id, r.text or "") for r in stage(spark, docs, tables).collect())


def test_run(spark, docs, tables, tmp_path):
    """All stages one after the other equal the stages called by hand, and every kept document is packed whole."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = pipeline.run(spark, str(tmp_path)).collect()
    own = docs
    for _, stage in pipeline.STAGES[:-1]:
        own = stage(spark, own, str(tmp_path))
    from netvigil.llm import tokens

    t = tokens.tokenizer(tokens.vocabulary_path("word_bpe_49k.json"))
    want = sorted((r.doc_id, len(t.encode(r.text or "")) + 1) for r in own.collect())
    assert sorted((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == want
    assert sum(p.length for p in pieces) == sum(n for _, n in want)


def test_repeats(spark, docs, tables):
    once = docs.where("doc_id not in (2, 10)")
    seen, want = set(), {}
    for doc_id, text in TEXTS:
        if doc_id in (2, 10):
            continue
        data = (text or "").encode()
        hit = [data[k : k + 50] in seen for k in range(len(data) - 49)]
        gone = {k + i for k, h in enumerate(hit) if h for i in range(50)}
        keep = b"".join(c.encode() for c, at in _places(text or "") if not gone.issuperset(at))
        want[doc_id] = None if text is None else keep.decode()
        seen |= {data[k : k + 50] for k in range(len(data) - 49)}
    got = pipeline.cut_repeats(spark, once, tables)
    assert got.columns == docs.columns and _texts(got) == want
    assert all(r.text is None or r.n_chars == len(r.text) for r in got.collect())
    assert PASSAGE not in want[5] and PASSAGE in want[4]


def _places(text):
    at = 0
    for c in text:
        n = len(c.encode())
        yield c, range(at, at + n)
        at += n


def test_benchmark(spark, docs, tables):
    got = pipeline.cut_benchmark(spark, docs.where("doc_id < 10"), tables)
    assert got.columns == docs.columns
    found = _texts(got)
    for doc_id, text in TEXTS[:9]:
        if doc_id != 6:
            assert found[doc_id] == text
    left = re.findall(r"[a-z]+", found[6])
    assert left == (_words(8, 50) + " " + _words(9, 60)).split()


def test_pack_and_empty(spark, docs, tables):
    pieces = pipeline.pack(spark, docs.where("doc_id < 10"), tables).collect()
    for doc_id in range(1, 10):
        own = sorted((p.start, p.length, p.doc_tokens) for p in pieces if p.doc_id == doc_id)
        assert own[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:], strict=False)) and sum(own[-1][:2]) == own[-1][2]
    none = docs.where("false")
    for stage in (pipeline.drop_near_duplicates, pipeline.cut_repeats, pipeline.cut_benchmark, pipeline.pack):
        assert stage(spark, none, tables).count() == 0


def test_near_duplicates_are_exact(spark, tables):
    rng = np.random.default_rng(3)
    word = lambda: bytes(rng.integers(97, 123, 6, dtype=np.uint8)).decode()
    line = " ".join(word() for _ in range(12))
    texts = []
    for k in range(60):  # copies on both sides of the limit, and chains of them
        base = [word() for _ in range(int(rng.integers(60, 300)))]
        texts.append(" ".join(base))
        for _ in range(3):
            base = list(base)
            for at in rng.choice(len(base), max(1, len(base) * int(rng.integers(15, 32)) // 1000), False):
                base[at] = word()
            texts.append(" ".join(base))
        if k % 4 == 0:  # one much repeated line, else nothing in common
            texts.append(" ".join([line] * 30 + [word() for _ in range(60)]))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    alike = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = np.arange(len(texts))
    while True:
        new = np.array([label[row].min() for row in alike])
        if (new == label).all():
            break
        label = new
    assert 60 < len(set(label.tolist())) < 0.8 * len(texts)
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    got = sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, df, tables).collect())
    assert got == sorted(set(label.tolist()))


@pytest.mark.parametrize("hot", [20_000, 7])
def test_few_pairs_of_a_large_group_are_counted(spark, monkeypatch, hot):
    """Without SimHash, one group of alike texts and one just apart: pairs in proportion to the texts, and exact classes."""
    handed, counted = [], alike._counted
    monkeypatch.setattr(alike, "_counted", lambda pairs, *more: handed.append(pairs.count()) or counted(pairs, *more))
    monkeypatch.setattr(alike, "LIMIT", -1)
    monkeypatch.setattr(alike, "HOT", hot)
    rng = np.random.default_rng(11)
    texts = []
    for group, (n, changed) in enumerate([(30, 8), (40, 40)]):
        base = _words(500 + group, 2000).split()
        for k in range(n):
            own = list(base)
            for at in rng.choice(len(base), changed, False):
                own[at] = f"w{group}x{k}x{at}"
            texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id as row", "doc_id", "text")
    got = {r.row: r["class"] for r in alike.copies(df).collect()}
    assert len({got[k] for k in range(30)}) == 1
    assert len(set(got.values())) == 41
    assert handed[0] == 0 and (hot == 7 or sum(handed) <= len(texts))


def test_stored_tables_leave_no_shuffle_files(spark):
    """They stayed until the driver collected garbage, so that those of earlier stages filled the disk of later ones."""
    import time

    from netvigil.llm.common import CLEANUP, stored

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_") and name.endswith(".data")}

    before = files()
    out = stored(spark.range(1000).repartition(3, "id").groupBy("id").count(), "shuffled")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and out.count() == 1000 and spark.conf.get(CLEANUP) == "false"
