"""Corpus operators against brute force, round trips and odd rows."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netvigil.llm import chat, decontam, grouping, html, huffman, license, neighbours, packing, simhash, substrings, tokens, toxicity

ODD = [(1, None, "a"), (2, "", "b"), (3, "x", "c"), (4, "The same words over and over again. " * 8, "d"), (5, "The same words over and over again. " * 8, "e"), (6, "日本語 é\n\n  two  spaces\tand tabs", "f"), (7, "long " * 20000, "g")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, spans string")  # a clashing extra column


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_the_library(name):
    t = tokens.PieceTokenizer(tokens.vocabulary_path(name))
    texts = ["", " ", "a  b", " x", "x ", "don't we'll", "foo<|endoftext|> bar", "Ünï café\n12 34", "word, word.\nNext", "İ ß ẞ Σς ﬁ", "a b"] * 2
    assert [list(x) for x in t.encode_all(texts)] == [t.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_the_library_on_random_texts(name, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_UNITS", 50)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 500)
    rng = np.random.default_rng(11)
    bits = ["a", "the", "Größe", "ÿ", "İ", "ß", "'", "'s", ",", ".", "!?", "\n", "\n\n", "\t", "\r\n", " ", "  ", "\u00a0", "\u2028", "日本", "é", "e\u0301", "😀", "12", "3.5", "_", "-", "<|endoftext|>", "\0", "Ġ", "x\ny", "Word.", "And\nThen,"]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 12)))) if k % 2 else " ".join(rng.choice(bits, int(rng.integers(0, 12)))) for k in range(4000)]
    t = tokens.PieceTokenizer(tokens.vocabulary_path(name))
    want = [t.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    for _ in range(2):
        got = t.encode_all(texts)
        assert [k for k in range(len(texts)) if got[k].tolist() != want[k]] == []
    ends = [(ids, e) for ids, e in t.encode_column(pa.array([None, *texts]), 2)]
    whole = [x.tolist() for ids, e in ends for x in np.split(ids, e[:-1])]
    assert whole == [[2], *[w + [2] for w in want]]


def test_packing(docs, none):
    rows = packing.pack_pieces(docs).collect()
    t = tokens.tokenizer(tokens.vocabulary_path("word_bpe_49k.json"))
    for doc_id, text, _ in ODD:
        ids, at = np.append(t.encode(text or ""), 2).astype("<u4"), 0
        for r in sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert all(o == sum(n for _, n in own[:k]) for k, (o, _) in enumerate(own)) and sum(n for _, n in own) <= packing.WINDOW
    assert packing.pack_pieces(none).count() == 0


def test_simhash(docs, none, spark):
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert found[4].component_id == found[5].component_id == 4 and found[1].component_id == found[2].component_id == 1 and found[1].fp == [0]
    assert simhash.near_duplicates(none).count() == 0
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ sum((np.uint64(1) << np.uint64(int(b)) for b in rng.choice(64, 3, False)), np.uint64(0)) for _ in range(30)]))
    rows = [(k, [int(c.view(np.int64))]) for k, c in enumerate(codes)]
    got = {r.fp[0]: r.component_id for r in simhash.linked_classes(spark.createDataFrame(rows, "doc_id long, fp array<long>"), 4).collect()}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
    label = np.arange(len(codes))
    for _ in range(len(codes)):
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    assert [got[int(c.view(np.int64))] for c in codes] == label.tolist()


def test_html(spark):
    art = "<p>The long story begins here &amp; goes on for quite a while.</p><p>A second <b>part</b> of the\n story number {i} follows it.</p>"
    page = lambda i: f"<html><body><nav><a href=x>Home</a></nav><div class='col'><h2>Head {i}</h2>{art.format(i=i)}</div><div class='share-box'>Share</div><div class=comments><p>I like {i}</p></div><form>Log in</form><footer>Bye</footer><script>x('</p>')</script></body></html>"
    rows = [(i, f"http://a.b/{i}", page(i)) for i in range(4)] + [(90, None, None), (91, "zz", ""), (92, None, "just text <b>bold")]
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head 3\nThe long story begins here & goes on for quite a while.\nA second part of the story number 3 follows it."
    assert got[90] == got[91] == "" and got[92] == "just text bold"
    assert html.align(["<a", "#p", "/a"], ["<a", "#p", "#h", "/a"]) == ["<a", "#p", "[", "#h", "]?", "/a"]


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8))
    rows = [(k, [float(x) for x in base[k % 280].astype(np.float32)]) for k in range(300)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, None] * 4), (1004, [1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).collect()
    vectors = np.array([r[1] for r in rows[:300]])
    right = 0
    for q in range(0, 300, 20):
        score = vectors @ vectors[q]
        order = [k for k in np.lexsort((np.arange(300), -np.round(score, 12))) if k != q][:5]
        own = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        right += len({v for _, v in own} & set(order))
        assert [r for r, _ in own] == [1, 2, 3, 4, 5]
    assert right >= 0.9 * 75


def test_neighbours_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, rank int, score double"
    none = spark.createDataFrame([], schema)
    is_query = F.col("vec_id") % 20 == 0
    assert neighbours.nearest(none, is_query).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, None, 1, 1.0), (20, [0.0, 0.0], 1, 1.0)], schema), is_query).count() == 0
    third = 1 / 3  # no 32-bit number
    rows = [(0, [1.0, third], 1, 1.0), (7, [1.0, third], 1, 1.0), (3, [1.0, third], 1, 1.0), (3, [1.0, third], 1, 1.0), (9, [third, 0.5], 1, 1.0), (None, [1.0, 1.0], 1, 1.0)]
    got = neighbours.nearest(spark.createDataFrame(rows, schema), is_query, 5).orderBy("rank").collect()
    same = 1.0 + third * third
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 3), (0, 2, 7), (0, 3, 9)]
    assert [r.score for r in got] == pytest.approx([same, same, third + third * 0.5], rel=1e-15)


def test_neighbours_where_most_leaves_are_not_visited(spark):
    """Recall against brute force on clustered vectors, with a tenth of the leaves visited."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    base = (centres[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 16))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 200 == 0, 10).collect()
    right = 0
    for q in range(0, 6000, 200):
        score = base @ base[q]
        score[q] = -np.inf
        right += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-score)[:10].tolist()))
    assert right >= 0.9 * 10 * 30


def test_decontamination(spark, docs, monkeypatch):
    items = [(1, "the same words over"), (2, "over and over again the same words over and over again the same"), (3, None), (4, "absent entirely")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontam.brute_force([(d, t) for d, t, _ in ODD], items)
    for size in (4_000_000, 10):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = {r.doc_id: r for r in decontam.find_contamination(docs, bench).collect()}
        for doc, (n, hit, n_items, digest, _) in want.items():
            assert (got[doc].n_words, got[doc].n_hit, len(got[doc].item_ids)) == (n, hit, n_items)
            assert hashlib.sha256(",".join(sorted(map(str, got[doc].item_ids))).encode()).hexdigest() == digest
    assert decontam.find_contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    rows = [(k, " ".join(rng.choice(words, 25)) + (" grunkle" if k % 3 == 0 else "") + " " + " ".join(rng.choice(words, 9))) for k in range(300)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score_texts(df, model).collect()}
    assert all((got[k] >= 0.5) == (k % 3 == 0) for k in range(300)) and got[900] < 0.5 and got[901] < 0.5
    counts = lambda t: toxicity.pattern_counts(t, toxicity._Classes(toxicity.Model()))
    assert counts("you idiot. not an idiot. he said idiot! idiot") == [1, 1, 1, 1, 0, 0, 0, 0]
    assert toxicity.train(df, labels.where("false")).weights.tolist() == toxicity.PRIOR.tolist()


def test_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = np.append(rng.integers(1, 4, int(rng.integers(0, 30))), 0)
        s = text.tolist()
        assert grouping.suffix_array(text).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffixes_side_by_side():
    rng = np.random.default_rng(6)
    for n in (1, 2, 60, 200):
        for width in (2, 3, 8):
            texts = [np.append(rng.integers(1, width, int(rng.integers(0, 40))), 0) for _ in range(n)]
            first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            want = [int(f) + i for f, t in zip(first, texts, strict=False) for i in sorted(range(len(t)), key=lambda i: t.tolist()[i:])]
            assert grouping.suffix_arrays(np.concatenate(texts), first).tolist() == want
    assert grouping.suffix_arrays(np.zeros(0, np.int64), np.zeros(1, np.int64)).tolist() == []


def _repeated(seed=2, n=80):
    rng = np.random.default_rng(seed)
    parts = ["".join(rng.choice(list("abc é"), int(k))) for k in rng.integers(40, 200, 6)]
    return [(100 + k, "".join(parts[j][int(rng.integers(0, 9)) :] for j in rng.integers(0, 6, int(rng.integers(0, 5))))) for k in range(n)]


def _kept(text, spans):
    data = (text or "").encode()
    edges = [0, *[x for s in spans for x in s], len(data)]
    return hashlib.sha256(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))).hexdigest()


@pytest.mark.parametrize("hot", [2, 2000])
def test_substrings(spark, hot):
    rows = _repeated() + [(d, t) for d, t, _ in ODD]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string").repartition(6)
    got = {r.doc_id: (r.text, substrings.merged_spans(r.cut)) for r in substrings.find_repeats(df, hot, "cut").collect()}
    for doc, (_, removed, n, digest) in substrings.brute_force(rows).items():
        text, spans = got[doc]
        assert (sum(b - a for a, b in spans), len(spans), _kept(text, spans)) == (removed, n, digest)


def test_substrings_of_odd_rows(spark):
    text = "One long passage that several rows of this table share, word for word. " * 2
    rows = [(5, text), (5, "other words first. " + text), (5, text), (3, "x" + text), (None, text), (9, None), (8, "")]
    got = [(r.doc_id, r.text, substrings.merged_spans(r.spans)) for r in substrings.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows)
    assert all(spans == [(0, len(text))] for d, t, spans in got if d == 5 and t == text)
    assert [spans for d, t, spans in got if t and t.startswith("other")] == [[(17, 19 + len(text))]]  # the text itself holds ". One"
    assert all(spans == [] for d, _, spans in got if d != 5)
    assert substrings.find_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_document_has_one_row_of_spans(spark, monkeypatch):
    """Its anchors lie in many buckets; what these find is one row, whatever their number."""
    made, spans = [], substrings.repeated_spans
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(substrings, "repeated_spans", lambda *a: made.append(spans(*a)) or made[-1])
    rows = _repeated(7, 120) + [(5, "a longer text than others " * 60), (6, "a longer text than others " * 50), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: substrings.merged_spans(r.spans) for r in substrings.find_repeats(df).collect()}
    want = substrings.brute_force(rows)
    assert {d: (sum(b - a for a, b in s), len(s), _kept(dict(rows)[d], s)) for d, s in got.items()} == {d: x[1:] for d, x in want.items()}
    assert made[0].count() == sum(x[1] > 0 for x in want.values()) > 60


@pytest.mark.parametrize("case", ["", "records collide", "small arrays", "hot"])
def test_a_bucket_of_contexts(monkeypatch, case):
    """All of one bucket without Spark: collisions of any hash and small arrays change nothing."""
    rows = _repeated(5, 60) + [(7, "abc " * 90), (8, "abc " * 80 + "abd " * 20)]
    known = substrings.Filter(1, 1024, np.full(128, 255, np.uint8), np.zeros(0, np.uint64))
    if case == "records collide":
        monkeypatch.setattr(substrings, "mix", lambda x: x % np.uint64(3))
    elif case == "small arrays":
        monkeypatch.setattr(substrings, "ARRAY_BYTES", 60)
    elif case == "hot":
        known.is_hot = lambda key: key % np.uint64(2) == 0
    blobs = []
    for k in range(0, len(rows), 7):
        data, at = decontam.text_bytes(pa.array([t for _, t in rows[k : k + 7]]))
        blobs += [x for _, x in substrings.deal(data, at, np.array([d for d, _ in rows[k : k + 7]]), None, known, k)]
    found = {}
    for doc, _, spans in substrings.bucket_spans(blobs):
        found.setdefault(doc, []).append(spans)
    for doc, (_, removed, n, digest) in substrings.brute_force(rows).items():
        spans = substrings.merged_spans(found.get(doc))
        assert (sum(b - a for a, b in spans), len(spans), _kept(dict(rows)[doc], spans)) == (removed, n, digest)


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|end|> \\ <\\|"), (1, 1, "assistant", "one"), (1, 2, "user", None), (1, 3, "assistant", "two"), (1, 4, "user", "left"), (2, 0, "user", "alone"), (None, 0, "assistant", "")]
    found = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(found).collect()}
    text = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:5])
    assert got[1].n_turns == 5 and got[1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[1].loss_sha256 == hashlib.sha256(b"onetwo").hexdigest()
    assert got[2].loss_chars == 0 and got[2].n_turns == 1 and found.where("conv_id = 1").count() == 3


def test_licenses(spark):
    rows = [(1, "Copyright (c) 2020 Me\nReleased under the MIT LICENCE!"), (2, "intro\nLicensed under the Apache License, Version 2.0.\nend"), (3, None), (4, ""), (4, "Released under the MIT License")]
    got = license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), license.registry(spark)).collect()
    assert sorted((r.doc_id, r.license_id, r.notices) for r in got if r.doc_id < 3) == [(1, "MIT", ["MIT"]), (2, None, ["Apache-2.0"])]
    assert len(got) == 5 and {r.license_id for r in got if r.doc_id == 4} == {None, "MIT"}


def test_licenses_of_odd_rows_and_of_a_joined_registry(spark, none, monkeypatch):
    notice = "Released under the MIT License."
    rows = [(None, notice, "a"), (None, "x", "b"), (5, notice + "\n" + notice, "c"), (5, "Licensed under CC BY 4.0.\n" + notice, "d"), (6, " \n\n \n", "e"), (7, "word - \n" * 30000 + "\t" + notice.upper(), "f"), (8, "licence  licence\n\nlicence", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, notices string")
    want = sorted([(-1, "MIT", ["MIT"]), (-1, None, []), (5, None, ["MIT"]), (5, None, ["CC-BY-4.0", "MIT"]), (6, None, []), (7, None, ["MIT"]), (8, None, [])], key=str)
    known = license.registry(spark)
    results = []
    for map_rows, broadcast_rows in ((license.MAP_ROWS, license.BROADCAST_ROWS), (0, license.BROADCAST_ROWS), (0, 0)):
        monkeypatch.setattr(license, "MAP_ROWS", map_rows)
        monkeypatch.setattr(license, "BROADCAST_ROWS", broadcast_rows)
        got = license.scan_licenses(df, known).collect()
        assert sorted([(-1 if r.doc_id is None else r.doc_id, r.license_id, r.notices) for r in got], key=str) == want
        results.append(sorted([str(r.canonical_sha256) for r in got]))
        assert license.scan_licenses(none, known).count() == 0
    assert results[0] == results[1] == results[2]
    assert {r.license_id for r in license.scan_licenses(df, known.where("false")).collect()} == {None}


def test_token_files(spark, docs, none, monkeypatch):
    monkeypatch.setattr(huffman, "BUCKET_IDS", 5000)
    got = sorted(huffman.read_digests(spark, huffman.write_token_files(docs)).collect())
    t, start = tokens.tokenizer(tokens.vocabulary_path("byte_bpe_50k.json")), 0
    for r, (doc_id, text, _) in zip(got, ODD, strict=True):
        ids = np.append(t.encode(text or ""), 2).astype("<u4")
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert huffman.read_digests(spark, huffman.write_token_files(none)).count() == 0
    bits = huffman.code_bits(np.array([1, 1, 2, 3, 5, 8, 1000]), 4)
    assert bits.max() <= 4 and (2.0**-bits).sum() == 1


def test_whole_license_files(spark):
    import textwrap

    isc, mit = (next(t for k, t in license.KNOWN if k == name and t.startswith("Permission")) for name in ("ISC", "MIT"))
    head, rest = isc.split("copyright notice and", 1)
    wrapped = f"{head.strip()}\ncopyright notice and{rest}"
    rows = [
        (1, "Copyright (c) 2020, Some One\n\n" + wrapped),
        (2, "ISC License\n\nCopyright 2020 Some One\n\n" + textwrap.fill(isc, 76)),
        (3, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + textwrap.fill(mit, 78)),
        (4, "The MIT License (MIT)\n\nCopyright Some One and others\n\n" + textwrap.fill(mit, 70)),
        (5, "Copyright: (c) Some One\n" + mit),
        (6, "# Copyright © 2020\nMIT License\n\nmy own words\n" + mit),
    ]
    rows += [(100 + w, "ISC License\nCopyright (c) 2020 Me\n" + textwrap.fill(isc, w)) for w in range(40, 100)]
    got = {r.doc_id: r.license_id for r in license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), license.registry(spark)).collect()}
    assert [got[k] for k in range(1, 7)] == ["ISC", "ISC", "MIT", "MIT", "MIT", None]
    assert {got[100 + w] for w in range(40, 100)} == {"ISC"}


def test_html_of_many_classes(spark):
    many = "absolute bg-white border flex gap-2 items-center justify-between"
    page = lambda i: f"<html><body><div class='{many} sidebar'><p>Links of the side {i}</p></div><div class='{many} social-box'><p>Follow us {i}</p></div><div class='{many} story'><p>The story number {i} goes on for a while.</p></div><div class='{many} z-10'><p>Other things of the page {i}</p></div></body></html>"
    rows = [(i, f"http://a.b/{i}", page(i)) for i in range(3)]
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"The story number {i} goes on for a while." for i in range(3)}


def test_html_keeps_the_article(spark):
    pages = {
        "<article><p>One.</p><svg width=1/><p>Two.</p></article>": "One.\nTwo.",
        "<article><p>One.</p><object data=x><p>Two.</p></article>": "One.\nTwo.",
        '<article class="post tag-search category-news"><p>Whole.</p></article>': "Whole.",
        '<article><div class="entry-header"><h1>Title</h1></div><p>Body.</p><div class="share-header">Share</div></article>': "Title\nBody.",
        "<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Body.</p></article>": "Title\nBody.",
        "<article><p>Long.</p></article>" * 1 + "<p>x</p>" * 3000: "Long.",
    }
    rows = [(k, f"http://h{k}.x/", h, "clash") for k, h in enumerate(pages)] + [(0, "http://h0.x/", next(iter(pages)), "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract_text(df)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id, r.text) for r in got.collect()) == sorted([(0, "One.\nTwo."), *enumerate(pages.values())])
    assert html.extract_text(df.where("false")).count() == 0


def test_an_anchor_of_many_slices_is_hot_only_by_its_occurrences(spark, monkeypatch):
    """From 1000 slices on every boilerplate line was hot, and each slice sent each of its strings sixteen times."""
    from netvigil.llm import substrings

    line = "This very line stands in each of the texts and is no burden to a bucket."
    calm = spark.createDataFrame([(k, f"{line} {k}") for k in range(1200)], "doc_id long, text string").repartition(2)
    monkeypatch.setattr(substrings, "SLICE", 40)  # a slice for each text
    hot = lambda docs, **more: sum(len(r.hot) for r in substrings.shared_anchors(docs, 4, 2, **more).collect()) // 6
    assert substrings.HOT_SLICES > 1200 and hot(calm) == 0
    assert hot(calm, hot_slices=1200) > 0
    dense = spark.createDataFrame([(k, f"{line} " * 64) for k in range(4)], "doc_id long, text string").repartition(2)
    assert hot(dense, hot_slices=17) > 0  # four slices of 64 occurrences
    assert hot(dense, hot_slices=30) == 0
