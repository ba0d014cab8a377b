"""Source divergence against a loop over Python dictionaries."""

import collections
import random
import re

import pytest

from netvigil.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def by_hand(rows, least, top):
    count, held, groups = collections.Counter(), collections.defaultdict(set), set()
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in TERM.findall("".join(c.lower() if c.isascii() else c for c in text or "")):
            count[lang, source, term] += 1
            held[lang, term].add(k)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for (g, t), d in held.items() if g == lang and len(d) >= least]
        sources = sorted(s for g, s in groups if g == lang)
        total = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        whole = {t: sum(count[lang, s, t] for s in sources) for t in kept}
        share = lambda n, total: 1 + 1_000_000_000 * (n + 2) // (total + 2 * len(kept))  # noqa: E731, B023
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        p = {(s, t): share(count[lang, s, t], total[s]) for s in sources for t in kept}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = [(b, sum(gap(p[s, t], p[b, t]) for t in kept)) for b in sources if b != s]
            terms = [(t, gap(p[s, t], q[t])) for t in kept if count[lang, s, t] and p[s, t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(ordered)]
    return sorted(out)


def texts(seed, sources):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "été", "日本語", "x", "ABC", "don't", "Ünï", "zz9top", "\x7f~", "😀", "straße", "İ"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(rnd.choices(words[: rnd.randint(2, len(words))], k=rnd.randint(0, 25))), rnd.choice(["en", "de", None]), rnd.choice(sources)) for _ in range(300)]
    return rows + [(None, "en", "only nulls"), ("", "en", None), ("12 34", "xx", "alone"), ("rare words here", "xx", "alone"), ("word " * 50_000, "en", "s1"), ("same", "en", "s1"), ("same", "en", "s1")]


@pytest.mark.parametrize(("bits", "sources"), [(64, 4), (3, 4), (0, 3), (64, 70)])
def test_equals_the_loop(spark, bits, sources, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 7)
    rows = texts(bits, [f"s{k}" for k in range(sources)])
    df = spark.createDataFrame([(k, *r, "clash") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string").repartition(3)
    got = divergence.divergence(df, least_docs=3, top=4, digest_bits=bits).collect()
    assert sorted(map(tuple, got)) == by_hand(rows, 3, 4)


def test_query_and_empty_table(spark, tmp_path):
    rows = texts(5, ["a", "b", "c"])
    spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, divergence.op13_divergence(spark, str(tmp_path)).collect())) == by_hand(rows, 10, 10)
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
