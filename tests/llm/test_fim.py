"""Fill-in-the-middle against a loop over Python strings."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netvigil.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "\t\n", "a", " a", "a ", "a  b\n", "<P>x y z", "x <S", "S> y <M", "é ß 日本語 😀 z y   ", "😀" * 50, "word " * 30_000, "no_space" * 20_000, "\x00 \x01", "same same", "same same"]


def by_hand(doc_id, text, unit="token"):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 100 + j, t, "x", 7) for j, t in enumerate(TEXTS) for k in range(12)] + [(None, "null id here", "y", 1), (5, "twice", "z", 1), (5, "twice", "z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n int")  # clashing extra columns


@pytest.mark.parametrize("unit", ["token", "char"])
def test_equals_the_loop_and_comes_back(docs, unit):
    from pyspark.sql import functions as F

    made = fim.transform(docs.repartition(3), unit=unit)
    rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [by_hand(r.doc_id, r.text, unit) for r in docs.collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:6] for r in rows), key=key) == sorted(want, key=key)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    texts = {(d, fm, o): t for (d, _, fm, _, _, o), t in zip(want, (r.text or "" for r in docs.collect()), strict=True)}
    assert all(r.back == texts[r.doc_id, r.form, r.output] for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_index_turns_cuts_both_ways(texts):
    text = "".join(texts)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    index = fim.ExceptionIndex(data)
    places = np.arange(len(text) + 1)
    in_bytes = np.array([len(text[:k].encode("utf-8", "surrogatepass")) for k in places])
    assert index.bytes(places).tolist() == in_bytes.tolist() and index.chars(in_bytes).tolist() == places.tolist()
    assert len(index.at_byte) == sum(ord(c) > 127 for c in text)


def test_query_gives_digests(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = fim.op11_fill_in_middle(spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(*(w := by_hand(r.doc_id, r.text))[:5], sha(w[5]), sha(r.text)) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_empty_table_and_wrong_unit(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.transform(none).collect() == []
    with pytest.raises(ValueError):
        fim.transform(none, unit="word")
