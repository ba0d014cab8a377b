"""Lexical retrieval packing.

Documents become token ids once, in a table in the shared folder; document frequencies
are counted over all of them. Shards of ``SHARD_TOKENS`` ids each build a BM25 inverted
index of their documents, with ids as terms and the global frequencies. The longest
unused document is the seed of a window; its ``QUERY_TERMS`` strongest terms are the
query, and its unused neighbours fill the window greedily, best first. What doesn't fit
is cut, and the rest of that document is the next seed. Documents that no window of a
shard can take whole go on to the task's next shard, so that a task leaves one
unfinished window at most; that one is written as sequences of powers of two, which
need no padding.

Defined results: a null or empty text is its end id alone; rows with equal doc_id stay
documents of their own; a null doc_id is packed like any other; other columns are
ignored; no rows give no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.llm.common import only, parts_for, table
from netvigil.llm.huffman import all_ids, ids_of, token_table
from netvigil.llm.tokens import vocabulary_path

WINDOW = 4096
SHARD_TOKENS = 2_000_000
QUERY_TERMS = 24
K1, B = 1.2, 0.75
#: Neighbours that are sorted at a time.
NEAREST = 32


@dataclass
class Statistics:
    """Document frequency by id, documents, and their mean length."""

    frequency: np.ndarray
    documents: int
    mean: float

    def idf(self, ids: np.ndarray) -> np.ndarray:
        f = self.frequency[ids]
        return np.log1p((self.documents - f + 0.5) / (f + 0.5))


def statistics(tokens: DataFrame) -> Statistics:
    """Counts over all documents; at most a row for each id of the vocabulary reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids, n = all_ids(part.column(0), part.column(1))
                pair = np.sort((np.repeat(np.arange(len(n), dtype=np.int64), n) << 32) | ids)
                own = np.bincount(pair[np.concatenate([[True], pair[1:] != pair[:-1]])] & 0xFFFFFFFF)
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    by_id = tokens.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    whole = tokens.agg(F.count("*").alias("documents"), F.sum("n").alias("ids")).first()
    frequency = np.zeros(int(by_id["id"].max()) + 1 if len(by_id) else 1, np.int64)
    frequency[by_id["id"].to_numpy(np.int64)] = by_id["n"].to_numpy(np.int64)
    return Statistics(frequency, whole["documents"], (whole["ids"] or 0) / max(1, whole["documents"]))


@dataclass
class Part:
    """What is left of a document: its ids from start on."""

    doc_id: int | None
    total: int
    start: int
    ids: np.ndarray


class Index:
    """BM25 inverted index of a shard's documents."""

    def __init__(self, parts: list[Part], stats: Statistics):
        self.stats = stats
        sizes = np.array([len(p.ids) for p in parts], np.int64)
        width = np.int64(len(stats.frequency))
        doc = np.repeat(np.arange(len(parts)), sizes)
        pair, count = np.unique(np.concatenate([p.ids for p in parts]).astype(np.int64) + doc * width, return_counts=True)
        doc, term = pair // width, pair % width
        idf = stats.idf(term)
        weight = idf * count * (K1 + 1) / (count + K1 * (1 - B + B * sizes[doc] / stats.mean))
        self.first = np.searchsorted(doc, np.arange(len(parts) + 1))
        self.own_terms, self.own_weight = term, idf * np.log1p(count)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order].astype(np.int32), weight[order]
        self.lists = np.searchsorted(term[order], np.arange(width + 1))
        self.n = len(parts)

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a query term with the seed, best first."""
        a, b = self.first[seed], self.first[seed + 1]
        own = np.arange(a, b)
        if b - a > QUERY_TERMS:
            own = a + np.argpartition(-self.own_weight[a:b], QUERY_TERMS)[:QUERY_TERMS]
        spans = [slice(self.lists[t], self.lists[t + 1]) for t in self.own_terms[own].tolist()]
        if not spans:
            return
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        score[~unused] = 0
        given = 0
        while True:
            live = np.flatnonzero(score > 0)
            if not len(live):
                return
            best = live if len(live) <= NEAREST else live[np.argpartition(-score[live], NEAREST)[:NEAREST]]
            for k in best[np.lexsort((best, -score[best]))].tolist():
                given += 1
                yield k
            score[best] = 0


def pack_shard(parts: list[Part], stats: Statistics, last: bool) -> tuple[list[list[Part]], list[Part]]:
    """Full windows of a shard, and what is left over; with ``last`` all is packed."""
    windows: list[list[Part]] = []
    index = Index(parts, stats)
    rest = list(parts)
    unused = np.ones(len(parts), bool)
    by_size = sorted(range(len(parts)), key=lambda k: (-len(parts[k].ids), k))
    turn = iter(by_size)
    seed: int | None = None
    while True:
        if seed is None:
            seed = next((k for k in turn if unused[k]), None)
            if seed is None:
                return windows, []
        window: list[Part] = []
        room = WINDOW

        def take(k: int) -> bool:
            """Puts document k, or as much as fits, into the window; whether something is left of it."""
            nonlocal room
            p = rest[k]
            window.append(Part(p.doc_id, p.total, p.start, p.ids[:room]))
            if len(p.ids) > room:
                rest[k] = Part(p.doc_id, p.total, p.start + room, p.ids[room:])
                room = 0
                return True
            room -= len(p.ids)
            unused[k] = False
            return False

        nxt = seed if take(seed) else None
        if room:
            for k in index.neighbours(seed, unused):
                if take(k):
                    nxt = k
                if not room:
                    break
        if room:
            for k in turn:  # nothing is alike any more
                if unused[k]:
                    if take(k):
                        nxt = k
                    if not room:
                        break
        if room and not last:
            return windows, window
        if room:
            windows += _powers(window)
            return windows, []
        windows.append(window)
        seed = nxt


def _powers(window: list[Part]) -> list[list[Part]]:
    """Cuts an unfinished window into sequences of powers of two."""
    out: list[list[Part]] = []
    left = sum(len(p.ids) for p in window)
    queue = list(window)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        own: list[Part] = []
        while room:
            p = queue.pop(0)
            own.append(Part(p.doc_id, p.total, p.start, p.ids[:room]))
            if len(p.ids) > room:
                queue.insert(0, Part(p.doc_id, p.total, p.start + room, p.ids[room:]))
            room -= len(own[-1].ids)
        out.append(own)
    return out


def padded_length(length: int) -> int:
    """Sequences are padded to the window, except at a power of two."""
    return length if length & (length - 1) == 0 else WINDOW


def _windows(batches: Iterator[pa.RecordBatch], stats: Statistics) -> Iterator[list[tuple[int, list[Part]]]]:
    """Numbered sequences of a task's documents, shard by shard."""
    number = TaskContext.get().partitionId() << 32
    parts: list[Part] = []
    held = 0
    for batch in batches:
        for doc_id, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            parts.append(Part(doc_id, n, 0, ids_of(n, data.as_py())))
            held += n
            if held >= SHARD_TOKENS:
                full, parts = pack_shard(parts, stats, False)
                held = sum(len(p.ids) for p in parts)
                yield [(number + k, w) for k, w in enumerate(full)]
                number += len(full)
    if parts:
        yield [(number + k, w) for k, w in enumerate(pack_shard(parts, stats, True)[0])]


def _shards(docs: DataFrame, vocabulary: str, end_id: int) -> tuple[DataFrame, Statistics]:
    tokens = token_table(docs, vocabulary_path(vocabulary), end_id)
    stats = statistics(tokens)
    return tokens.coalesce(parts_for(int(stats.mean * stats.documents), SHARD_TOKENS)), stats


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Where each piece of each document lies: ``PIECES``."""
    tokens, stats = _shards(docs, vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbered in _windows(batches, stats):
            rows = []
            for number, window in numbered:
                offset = 0
                for p in window:
                    rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(np.ascontiguousarray(p.ids, "<u4").tobytes()), p.total, number, offset))
                    offset += len(p.ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return tokens.mapInArrow(run, PIECES)


def pack_sequences(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids): ids padded to padded_length."""
    tokens, stats = _shards(docs, vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbered in _windows(batches, stats):
            for at in range(0, len(numbered), 64):
                some = numbered[at : at + 64]
                ids = [np.concatenate([p.ids for p in w]).astype(np.int32) for _, w in some]
                full = [np.concatenate([x, np.full(padded_length(len(x)) - len(x), pad_id, np.int32)]) for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(full, pa.list_(pa.int32()))], ["sequence_id", "length", "ids"])

    return tokens.mapInArrow(run, "sequence_id long, length long, ids array<int>")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents."""
    return pack_pieces(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
