"""The registered queries, columns and all, against plain loops over small tables."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash

from netvigil.llm import decontam, huffman, packing, simhash, substrings, tokens, toxicity

END = 2


def corpus():
    rnd = random.Random(21)
    words = [f"w{k}" for k in range(300)] + ["Grün", "日本", "don't", "A-B", "x1"]
    passage = " ".join(rnd.choices(words, k=40))
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 120))) for _ in range(60)]
    texts += [texts[3], texts[3] + " end", passage + " one two", "begin " + passage, texts[5][:200] + "!" + texts[6], None, "", "  ", "short", "short", "x" * 400, "y" + "x" * 120]
    return [(k * 3, t, "en", "s", 0) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    rnd = random.Random(4)
    items = [(7 + k, " ".join((t or "").upper().split()[2:14])) for k, (_, t, *_) in enumerate(docs[:8])] + [(100, "w1 w2"), (101, None), (102, "-- !!"), (103, " ".join(f"q{rnd.randrange(9)}" for _ in range(30)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(k % 3 == 0)) for k, (i, *_) in enumerate(docs)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, items


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def test_op2(spark, tables):
    folder, docs, _ = tables
    want = {}
    for i, t, *_ in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        want[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in want}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in want:
        for b in want:
            if a < b and bin(want[a] ^ want[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, folder).collect()}
    assert got == {i: (f"{f:016x}", find(i)) for i, f in want.items()}


def test_op5(spark, tables):
    folder, docs, items = tables
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, text in items:
        own = words(text)
        for k in range(max(1, len(own) - 9) if own else 0):
            windows.setdefault(tuple(own[k : k + 10]), set()).add(item)
    want = {}
    for i, t, *_ in docs:
        own, hit, found = words(t), set(), set()
        for w, names in windows.items():
            for k in range(len(own) - len(w) + 1):
                if tuple(own[k : k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    found |= names
        want[i] = (len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.op5_decontaminate(spark, folder).collect()}
    assert got == want and sum(w[4] for w in want.values()) >= 8


def test_op6(spark, tables):
    folder, docs, _ = tables
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, folder).collect()}
    assert set(got) == {i for i, *_ in docs}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op7(spark, tables):
    folder, docs, _ = tables
    first, want = {}, {}
    for i, t, *_ in sorted(docs):
        data = (t or "").encode()
        grams = {data[k : k + 50] for k in range(len(data) - 49)}
        covered = [False] * len(data)
        for k in range(len(data) - 49):
            if data[k : k + 50] in first:
                covered[k : k + 50] = [True] * 50
        for g in grams:
            first.setdefault(g, i)
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        spans = sum(c and (k == 0 or not covered[k - 1]) for k, c in enumerate(covered))
        want[i] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.op7_suffix_dedup(spark, folder).collect()}
    assert got == want and sum(w[2] > 0 for w in want.values()) >= 4


def _ids(name, text):
    t = tokens.tokenizer(tokens.vocabulary_path(name)).tokenizer
    import numpy as np

    return np.array([*t.encode(text or "", add_special_tokens=False).ids, END], "<u4")


def test_op10(spark, tables):
    folder, docs, _ = tables
    start, want = 0, {}
    for i, t, *_ in sorted(docs):
        ids = _ids("byte_bpe_50k.json", t)
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in huffman.op10_token_output(spark, folder).collect()} == want


def test_op1(spark, tables):
    folder, docs, _ = tables
    rows = packing.op1_packing(spark, folder).collect()
    for i, t, *_ in docs:
        ids, at = _ids("word_bpe_49k.json", t), 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
