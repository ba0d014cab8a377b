"""A corpus pipeline: toxicity, near-duplicates, repeated substrings, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it as
Parquet to the shared folder and reads it again as the next stage's docs. All but the
last stage return the columns of documents. A text that a stage cuts has its n_chars
counted anew; documents are dropped only where a stage says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.llm import alike, decontam, packing, substrings, toxicity
from netvigil.llm.common import free_name, only, stored, table


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these byte spans; a character that lies in a span only in part stays."""
    data = text.encode()
    out, at = [], 0
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode()


def _with_cuts(docs: DataFrame, columns: list[str], spans: str, spans_of: Callable) -> DataFrame:
    """docs (columns, and one of spans) with spans cut from text; texts without spans stay as they are."""
    at, n_at = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
    schema = only(docs, *columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            cols = list(batch.columns[:-1])
            sizes = cols[n_at].to_pylist() if n_at is not None else None
            for k, found in enumerate(batch.column(len(columns)).to_pylist()):
                if found and texts[k]:
                    texts[k] = _cut(texts[k], spans_of(found))
                    if sizes is not None:
                        sizes[k] = len(texts[k])
            cols[at] = pa.array(texts, cols[at].type)
            if n_at is not None:
                cols[n_at] = pa.array(sizes, cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, columns)

    return only(docs, *columns, spans).mapInArrow(run, schema)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a number for each row, and the name of that column."""
    row = free_name(docs, "row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 stay; null and empty texts are scored like any other."""
    score = free_name(docs, "toxicity")
    model = toxicity.train(only(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return only(toxicity.score_texts(docs, model, score).where(F.col(score) < 0.5), *docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of alike rows (sets of five-word shingles, exact similarity of 0.8 or more) the one with the smallest doc_id stays.

    Rows count by themselves: of unlike rows with one doc_id all stay, of alike ones the
    first. A row without doc_id comes after those with one. Rows without words are no
    copies of each other and all stay.
    """
    rows, row = _numbered(docs)
    found = stored(alike.copies(rows.select(F.col(row).alias("row"), "doc_id", "text")).where("class is not null"), "classes")
    first = found.groupBy("class").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    gone = stored(found.join(first, "class").where("row <> first").select(F.col("row").alias(row)), "gone")
    gone = F.broadcast(gone) if gone.count() <= alike.BROADCAST_KEYS else gone  # else all texts are shuffled
    return only(rows.join(gone, row, "left_anti"), *docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte under a 50-byte string that also starts in a document with a smaller doc_id."""
    spans = free_name(docs, "spans")
    return _with_cuts(substrings.find_repeats(docs, name=spans), docs.columns, spans, substrings.merged_spans)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words that lie in windows of benchmark items; rows count by themselves, whatever their doc_id."""
    rows, row = _numbered(docs)
    spans = free_name(docs, "spans")
    found = decontam.find_contamination(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = found.where("n_hit > 0").select(F.col("doc_id").alias(row), F.col("spans").alias(spans))
    return _with_cuts(rows.join(found, row, "left"), docs.columns, spans, lambda s: [(x["start"], x["end"]) for x in s])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 ids."""
    return packing.pack_pieces(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_substrings", cut_repeats),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return stored(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
