"""Source divergence: how far each source's use of terms lies from its language and its other sources.

Terms are counted under digests of 8 bytes, so that counts are shuffled at a fixed width;
each slice of texts writes the spelling of its digests once, apart from the counts. Only
digests that enough documents hold look their spellings up; where the least and the
greatest spelling of a digest differ, terms collided, and such a digest is split into one
number for each of its terms, whose texts are counted again. Spellings are joined to the
few rows that are reported. No result depends on digests.

Null text, lang and source are ''. Every (lang, source) pair that occurs is reported, also
without terms; a language with one source has no pairs, and one without kept terms has
pairs of value 0 and no terms. Ties go to the lesser text. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netvigil.llm.common import only, parts_for, stored, table
from netvigil.llm.rawtext import LOWER, hashes, runs, slices

#: Documents of a language that must hold a term.
LEAST_DOCS = 10
#: Terms of one source that are reported.
TOP_TERMS = 10
#: Parts of a share in a whole.
UNIT = 1_000_000_000
#: UTF-8 bytes of text that are counted in one go.
SLICE_BYTES = 16_000_000
#: Rows in one batch to Spark.
ROWS = 100_000
#: Terms that one task compares at a time, and sources in one tile of its matrix.
BLOCK_TERMS, TILE = 20_000, 64
#: Bytes that a term is made of: letters, and all of characters beyond ASCII.
_TERM = np.array([b > 0x7F or chr(b).isalpha() for b in range(256)])
_COUNTS = "lang string, source string, digest long, n long, docs long, term string"


def _counting(mask: int, spelled: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, source, digest, occurrences, documents) of each slice of texts, and apart from it the text of each digest.

    spelled: the texts are in the rows of counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, limit=SLICE_BYTES):
            terms, doc = runs(LOWER[data], offsets, _TERM)
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            known, width = coded.dictionary, len(coded.dictionary)
            digest = pa.array(hashes(known) & mask)
            pairs = pd.DataFrame({c: part.column(c).to_pylist() for c in ("lang", "source")})
            group, groups = pairs.groupby(["lang", "source"], sort=False).ngroup().to_numpy(), pairs.drop_duplicates()
            in_doc, n = np.unique(doc * width + coded.indices.to_numpy(), return_counts=True)
            cells, at = np.unique(group[in_doc // width] * width + in_doc % width, return_inverse=True)
            names = [pa.array(groups[c].tolist(), pa.string()).take(pa.array(cells // width)) for c in ("lang", "source")]
            counts = [pa.array(np.bincount(at, weights=w, minlength=len(cells)).astype(np.int64)) for w in (n, None)]
            place = pa.array(cells % width)
            del in_doc, n, at, cells
            yield from _batches(*names, digest.take(place), *counts, known.take(place).cast(pa.string()) if spelled else pa.nulls(len(place), pa.string()))
            if not spelled:
                yield from _batches(*[pa.nulls(width, pa.string())] * 2, digest, *[pa.nulls(width, pa.int64())] * 2, known.cast(pa.string()))

    return run


def _batches(*columns: pa.Array) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(list(columns), [x.split()[0] for x in _COUNTS.split(", ")])
    for at in range(0, whole.num_rows, ROWS):
        yield whole.slice(at, ROWS)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exactly at any size."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * whole(count + 2), whole(total + 2 * terms))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def count_terms(docs: DataFrame, least_docs: int, digest_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Counts of kept terms as (lang, source, digest, sub, n), and the text of each (digest, sub)."""
    texts = only(docs, "lang", "source", "text").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    mask = -1 if digest_bits >= 64 else (1 << digest_bits) - 1
    found = stored(texts.mapInArrow(_counting(mask, False), _COUNTS), "divergence-found")
    sums = [F.sum("n").alias("n"), F.sum("docs").alias("docs")]
    enough = lambda rows, *key: rows.withColumn("_docs", F.sum("docs").over(Window.partitionBy("lang", *key))).where(F.col("_docs") >= least_docs).drop("_docs")

    # One shuffle by digest: what too few documents hold goes where it arrives.
    arrived = found.where("term IS NULL").select("lang", "source", "digest", "n", "docs").repartition("digest")
    held = stored(enough(arrived, "digest").groupBy("lang", "source", "digest").agg(*sums), "divergence-held")
    wanted = held.select("digest").distinct()
    known = found.where("term IS NOT NULL").select("digest", "term").join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    known = stored(known, "divergence-texts")
    alone = known.where("low = high").select("digest", F.lit(0).alias("sub"), F.col("low").alias("term"))
    collided = known.where("low <> high").select("digest")
    if collided.isEmpty():
        return held.select("lang", "source", "digest", F.lit(0).alias("sub"), "n"), alone

    # Terms of one digest: each gets a number, and its texts are counted again by it.
    terms = found.where("term IS NOT NULL").select("digest", "term").join(collided, "digest", "left_semi").distinct()
    split = stored(terms.withColumn("sub", F.row_number().over(Window.partitionBy("digest").orderBy("term"))), "divergence-split")
    again = texts.mapInArrow(_counting(mask, True), _COUNTS).join(split, ["digest", "term"])
    apart = enough(again.groupBy("lang", "source", "digest", "sub").agg(*sums), "digest", "sub")
    whole = held.join(collided, "digest", "left_anti").withColumn("sub", F.lit(0))
    names = ["lang", "source", "digest", "sub", "n"]
    cells = stored(whole.select(*names).unionByName(apart.select(*names)), "divergence-cells")
    return cells, alone.unionByName(split)


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of gaps between sources over the terms of one block and pair of tiles.

    Rows of sub -1 stand for the sources themselves and give the share of a term that they
    lack.
    """
    marks = rows[rows["sub"] < 0].drop_duplicates("idx").sort_values("idx")
    cells = rows[rows["sub"] >= 0]
    idx, base = marks["idx"].to_numpy(np.int64), marks["p"].to_numpy(np.int64)
    term = cells.groupby(["digest", "sub"], sort=False).ngroup().to_numpy()
    seen = int(term.max(initial=-1)) + 1
    shares = np.tile(base, (seen, 1))
    shares[term, np.searchsorted(idx, cells["idx"].to_numpy(np.int64))] = cells["p"].to_numpy(np.int64)
    first, last = int(rows["tile_a"].iloc[0]), int(rows["tile_b"].iloc[0])
    out = []
    for a in np.flatnonzero(idx // TILE == first):
        others = np.flatnonzero((idx // TILE == last) & (idx > idx[a]))
        p, q = shares[:, [a]], shares[:, others]
        sums = ((p - q) ** 2 // (p + q)).sum(0)
        out += [(rows["lang"].iloc[0], int(idx[a]), int(idx[b]), seen, int(v)) for b, v in zip(others, sums, strict=True)]
    return pd.DataFrame(out, columns=["lang", "a", "b", "seen", "total"])


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, digest_bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank) for documents with text, lang and source.

    part "pair": another source of the language, and the gaps summed over all kept terms;
    part "term": the source's terms of most excess over its language.
    """
    cells, texts = count_terms(docs, least_docs, digest_bits)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    by_term = cells.groupBy("lang", "digest", "sub").agg(F.sum("n").alias("n_term"))
    langs = by_term.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_term").alias("n_lang"))
    groups = only(docs, "lang", "source").select(*named).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n_group", "terms", "n_lang"])
    in_lang = Window.partitionBy("lang")
    missing = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("n_group"), F.col("terms"))).otherwise(F.lit(1))
    groups = groups.withColumns({"idx": F.row_number().over(in_lang.orderBy("source")) - 1, "sources": F.count("*").over(in_lang), "p0": missing})
    groups = stored(groups, "divergence-groups")

    p = _share(F.col("n"), F.col("n_group"), F.col("terms"))
    shares = cells.join(groups, ["lang", "source"]).withColumn("p", p)
    excess = shares.join(by_term, ["lang", "digest", "sub"]).withColumn("q", _share(F.col("n_term"), F.col("n_lang"), F.col("terms"))).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    front = excess.select("lang", "source", "digest", "sub", _gap(F.col("p"), F.col("q")).alias("value")).withColumn("place", F.rank().over(order)).where(F.col("place") <= top)
    best = front.join(texts, ["digest", "sub"]).withColumn("rank", F.row_number().over(order.orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)
    term_part = best.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    blocks = parts_for(by_term.count(), BLOCK_TERMS)
    tiles = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / TILE).cast("int")))
    spread = ["lang", "idx", "digest", "sub", "p", "block", F.floor(F.col("idx") / TILE).cast("int").alias("own"), tiles.alias("other")]
    marks = groups.select("lang", "idx", "sources", F.lit(0).cast("long").alias("digest"), F.lit(-1).alias("sub"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = shares.withColumn("block", F.pmod(F.xxhash64("digest", "sub"), F.lit(blocks)).cast("int")).select(*spread).unionByName(marks.select(*spread))
    dealt = dealt.withColumns({"tile_a": F.least("own", "other"), "tile_b": F.greatest("own", "other")}).drop("own", "other")
    sums = dealt.groupBy("lang", "block", "tile_a", "tile_b").applyInPandas(_compare, "lang string, a long, b long, seen long, total long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("seen").alias("seen"), F.sum("total").alias("total"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("idx").alias("idx_b"), F.col("p0").alias("q0"))
    pairs = groups.join(other, "lang").where(F.col("idx") != F.col("idx_b")).withColumns({"a": F.least("idx", "idx_b"), "b": F.greatest("idx", "idx_b")})
    value = F.coalesce("total", F.lit(0)) + (F.col("terms") - F.coalesce("seen", F.lit(0))) * _gap(F.col("p0"), F.col("q0"))
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").withColumn("value", value)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(term_part)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of the documents."""
    return divergence(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = ("".join(chr(c + k) for k in range(26)) for c in (65, 97))
OP13_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n_term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS terms, sum(n_term) AS n_lang FROM kept GROUP BY lang),
cells AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n) AS n_group FROM cells GROUP BY lang, source),
grouped AS (SELECT DISTINCT lang, source FROM docs),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n_group, 0) + 2 * l.terms) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.n_term + 2)) // (l.n_lang + 2 * l.terms) AS BIGINT) AS q
  FROM grouped g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN sizes s ON g.lang = s.lang AND g.source = s.source LEFT JOIN cells c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
),
gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(g.value, 0) AS BIGINT) AS value
  FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
