"""Benchmark decontamination with an FM-index for each training shard.

The windows of the benchmark (``WINDOW`` consecutive words; a shorter item is one
window) are the phrases. A task gathers the words of its documents into a shard: runs
of benchmark words at least as long as the shortest phrase, with a separator for
everything else, which no phrase can match. The shard gets a suffix array, its
Burrows-Wheeler transform as a wavelet tree, and sampled suffix positions. All phrases
are searched backwards through wavelet-tree ranks; occurrences are located by stepping
to the nearest sample; overlapping word spans are merged.

Benchmark text is sent to the tasks in blocks of at most ``BLOCK_BYTES``; a larger
benchmark takes one pass for each block, and the spans of a document are then merged
over the blocks.

Defined results: a null or empty text has no words; items without words match
nothing; repeated items and rows count each by themselves (equal item_ids once); an
empty benchmark finds nothing; no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.llm.common import only, stored, table

WINDOW = 10
#: Benchmark text for one pass.
BLOCK_BYTES = 4_000_000
#: Words of one shard's index, and bytes of text looked at in one go.
SHARD_WORDS = 1_000_000
SLICE_BYTES = 2_000_000
#: Text positions between two sampled suffixes.
SAMPLE = 16

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each begins and the last ends."""
    own = column.cast(pa.large_binary())
    if own.null_count:
        own = own.fill_null(b"")
    if not len(own):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
    data = own.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


@dataclass
class Words:
    """Words of several texts: byte spans in the joined texts, hashes, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, at: np.ndarray, base: int) -> Words:
    """Splits texts into lower-case words; base is the odd multiplier of the hash."""
    low = _LOW[data]
    inside = _WORD[low]
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    if len(data):
        before[at[:-1][at[:-1] < len(data)]] = False
        after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), base, np.uint64)]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    # Scaled to the power of the end of the texts, a word's hash doesn't depend on its place.
    turn = np.uint64(pow(base, -1, 1 << 64))
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), turn, np.uint64)]), dtype=np.uint64)
    hashes = (total[ends] - total[starts]) * inverse[starts]
    return Words(low, starts, ends, hashes, np.searchsorted(starts, at))


@dataclass
class Phrases:
    """Phrases as symbols from 2 on (0: end of shard, 1: separator), with the items that have them."""

    base: int
    hashes: np.ndarray
    number: np.ndarray
    spelt: np.ndarray
    spelt_at: np.ndarray
    maybe: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    item_phrase: np.ndarray
    item_ids: np.ndarray

    @property
    def least(self) -> int:
        return int(self.lengths.min(initial=WINDOW))


def phrases_of(items: list[tuple[int, str | None]], window: int = WINDOW) -> Phrases:
    """The distinct windows of some benchmark items."""
    texts = pa.array([t or "" for _, t in items], pa.string())
    data, at = text_bytes(texts)
    base = 0x9E3779B97F4A7C15
    while True:  # until no two different words of the benchmark share a hash
        words = words_of(data, at, base)
        spelt = [words.data[s:e].tobytes() for s, e in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
        known = dict(zip(words.hashes.tolist(), spelt, strict=True))
        if len(known) == len(set(spelt)):
            break
        base += 2
    hashes = np.array(sorted(known), np.uint64)
    own = [known[h] for h in hashes.tolist()]
    symbol = np.searchsorted(hashes, words.hashes) + 2
    seen: dict[bytes, int] = {}
    rows, pairs = [], set()
    for k, (item_id, _) in enumerate(items):
        part = symbol[words.first[k] : words.first[k + 1]].astype(np.int32)
        for s in range(max(1, len(part) - window + 1) if len(part) else 0):
            piece = part[s : s + window]
            number = seen.setdefault(piece.tobytes(), len(seen))
            if number == len(rows):
                rows.append(piece)
            pairs.add((number, item_id))
    symbols = np.zeros((len(rows), window), np.int32)
    for k, row in enumerate(rows):
        symbols[k, window - len(row) :] = row
    maybe = np.zeros(1 << 20, bool)
    maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True
    ordered = sorted(pairs, key=lambda x: (x[0], str(x[1])))
    spelt_at = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    return Phrases(base, hashes, np.arange(len(hashes)) + 2, np.frombuffer(b"".join(own), np.uint8), spelt_at, maybe, symbols, np.array([len(r) for r in rows], np.int64), np.array([p for p, _ in ordered], np.int64), np.array([i for _, i in ordered], np.int64))


def symbols_in(words: Words, phrases: Phrases) -> np.ndarray:
    """Each word's symbol: 1 unless it is a word of the benchmark, byte by byte."""
    out = np.ones(len(words.hashes), np.int32)
    near = np.flatnonzero(phrases.maybe[(words.hashes >> np.uint64(44)).astype(np.int64)])
    if not len(near) or not len(phrases.hashes):
        return out
    place = np.minimum(np.searchsorted(phrases.hashes, words.hashes[near]), len(phrases.hashes) - 1)
    same = phrases.hashes[place] == words.hashes[near]
    near, place = near[same], place[same]
    sizes = words.ends[near] - words.starts[near]
    same = sizes == phrases.spelt_at[place + 1] - phrases.spelt_at[place]
    near, place, sizes = near[same], place[same], sizes[same]
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    equal = words.data[np.repeat(words.starts[near], sizes) + within] == phrases.spelt[np.repeat(phrases.spelt_at[place], sizes) + within]
    if len(near):
        right = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
        out[near[right]] = place[right] + 2
    return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol is the only 0."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step, n = 1, len(text)
    while True:
        nexts = np.concatenate([rank[step:] + 1, np.zeros(min(step, n), np.int64)])[:n]
        key = rank * (n + 1) + nexts
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FmIndex:
    """Burrows-Wheeler transform of a shard as a wavelet tree laid out by levels."""

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        self.bwt = text[order - 1]
        self.levels = max(1, int(self.bwt.max()).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=(1 << self.levels)))])
        self.ones = []
        for level in range(self.levels):
            top = self.bwt >> (self.levels - level)
            laid = self.bwt[np.argsort(top, kind="stable")]
            self.ones.append(np.concatenate([[0], np.cumsum((laid >> (self.levels - 1 - level)) & 1)]))
        kept = order % SAMPLE == 0
        self.sampled = kept
        self.sample_rank = np.cumsum(kept) - 1
        self.samples = order[kept]
        self.n = len(text)

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before a row."""
        start, end, at = np.zeros_like(upto), np.full_like(upto, self.n), upto
        for level, ones in enumerate(self.ones):
            bit = (symbol >> (self.levels - 1 - level)) & 1
            first = ones[start]
            in_node, own = ones[end] - first, ones[start + at] - first
            split = end - in_node
            at = np.where(bit == 1, own, at - own)
            start, end = np.where(bit == 1, split, start), np.where(bit == 1, end, split)
        return at

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with each phrase (right-aligned, 0 before it), by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((phrases[:, k] > 0) & (low < high))
            symbol = phrases[live, k].astype(np.int64)
            known = symbol < (1 << self.levels)
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled suffix."""
        out, steps = np.zeros(len(rows), np.int64), 0
        open_, rows = np.arange(len(rows)), rows.copy()
        while len(open_):
            done = self.sampled[rows]
            out[open_[done]] = self.samples[self.sample_rank[rows[done]]] + steps
            open_, rows = open_[~done], rows[~done]
            symbol = self.bwt[rows].astype(np.int64)
            rows = self.before[symbol] + self.rank(symbol, rows)
            steps += 1
        return out


class Shard:
    """Words of some documents that may belong to phrases, until there are enough for an index."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.clear()

    def clear(self) -> None:
        self.doc_ids: list = []
        self.n_words: list[np.ndarray] = []
        self.symbol: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.word: list[np.ndarray] = []
        self.start: list[np.ndarray] = []
        self.end: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_ids: pa.Array, texts: pa.Array) -> None:
        data, at = text_bytes(texts)
        words = words_of(data, at, self.phrases.base)
        symbol = symbols_in(words, self.phrases)
        count = np.diff(words.first)
        doc = np.repeat(np.arange(len(count)), count)
        run = np.concatenate([[True], (symbol[1:] > 1) != (symbol[:-1] > 1)]) if len(symbol) else np.zeros(0, bool)
        run |= np.concatenate([[True], doc[1:] != doc[:-1]]) if len(symbol) else False
        heads = np.flatnonzero(run)
        sizes = np.diff(np.concatenate([heads, [len(symbol)]]))
        keep = np.flatnonzero(np.repeat((symbol[heads] > 1) & (sizes >= self.phrases.least), sizes)) if len(symbol) else np.zeros(0, np.int64)
        self.symbol.append(symbol[keep])
        self.doc.append(doc[keep] + len(self.doc_ids))
        self.word.append(keep - words.first[doc[keep]])
        self.start.append(words.starts[keep] - at[doc[keep]])
        self.end.append(words.ends[keep] - at[doc[keep]])
        self.n_words.append(count)
        self.doc_ids += doc_ids.to_pylist()
        self.held += len(keep)

    def results(self) -> pa.RecordBatch:
        n = len(self.doc_ids)
        symbol, doc, word, start, end = (np.concatenate(x) for x in (self.symbol, self.doc, self.word, self.start, self.end))
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1] + 1)]) if len(symbol) else np.zeros(0, bool)
        place = np.arange(len(symbol)) + np.cumsum(new)  # a separator before each run
        hit = np.zeros(len(symbol), bool)
        items: list[list[int]] = [[] for _ in range(n)]
        if len(symbol) and len(self.phrases.lengths):
            text = np.ones(int(place[-1]) + 2, np.int32)
            text[place] = symbol
            text[-1] = 0
            back = np.zeros(len(text), np.int64)
            back[place] = np.arange(len(symbol))
            index = FmIndex(text)
            low, high = index.search(self.phrases.symbols)
            count = high - low
            which = np.repeat(np.arange(len(count)), count)
            rows = np.arange(int(count.sum())) + np.repeat(low - (np.cumsum(count) - count), count)
            at = back[index.locate(rows)]
            edge = np.zeros(len(symbol) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + self.phrases.lengths[which], -1)
            hit = np.cumsum(edge)[:-1] > 0
            pairs = np.unique(np.stack([doc[at], which], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            first, last = (np.searchsorted(self.phrases.item_phrase, pairs[:, 1], side=s) for s in ("left", "right"))
            own = np.repeat(pairs[:, 0], last - first)
            got = self.phrases.item_ids[np.arange(len(own)) + np.repeat(first - (np.cumsum(last - first) - (last - first)), last - first)]
            for d, i in np.unique(np.stack([own, got], 1), axis=0).tolist():
                items[d].append(i)
        spans: list[list[dict]] = [[] for _ in range(n)]
        ids = np.flatnonzero(hit)
        if len(ids):
            cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1] + 1) | new[ids[1:]]]))
            for a, b in zip(ids[cut], np.concatenate([ids[cut[1:] - 1], ids[-1:]]), strict=True):
                spans[doc[a]].append({"start": int(start[a]), "end": int(end[b]), "word": int(word[a]), "words": int(word[b] - word[a] + 1)})
        n_hit = np.bincount(doc[hit], minlength=n)[:n] if len(symbol) else np.zeros(n, np.int64)
        cols = [pa.array(self.doc_ids, pa.int64()), pa.array(np.concatenate(self.n_words), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(_SPAN))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "item_ids", "spans"])


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("word", pa.int64()), ("words", pa.int64())])
SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<long>, spans array<struct<start:long,end:long,word:long,words:long>>"


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows into parts of about so many bytes of text."""
    sizes = np.diff(text_bytes(batch.column(text))[1])
    part = np.cumsum(sizes) // most
    cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(sizes)]]) if len(sizes) else [0, 0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of bounded size, from a row iterator that holds one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if block and size + len(row[1] or "") > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1] or "")
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, spans): word and byte spans that lie inside benchmark windows."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = benchmark_blocks(benchmark.where("item_id is not null"))
    first = next(blocks)
    second = next(blocks, None)

    def one_pass(given: DataFrame, block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(phrases_of(block))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard = Shard(sent.value)
            for batch in batches:
                for part in slices(batch, 1):
                    shard.add(part.column(0), part.column(1))
                    if shard.held >= SHARD_WORDS or len(shard.doc_ids) >= 50_000:
                        yield shard.results()
                        shard.clear()
            if shard.doc_ids:
                yield shard.results()

        return given.mapInArrow(run, SCHEMA)

    if second is None:
        return one_pass(rows, first)
    # Several passes: rows get numbers of their own, under which their spans meet again.
    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    passes = one_pass(numbered.select(F.col("row").alias("doc_id"), "text"), first)
    while second is not None:
        passes = passes.unionByName(one_pass(numbered.select(F.col("row").alias("doc_id"), "text"), second))
        second = next(blocks, None)
    met = passes.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.sort_array(F.flatten(F.collect_list(F.expr("transform(spans, s -> struct(s.word, s.words, s.start, s.end))")))).alias("found"))
    merged = F.expr("""aggregate(found, cast(array() as array<struct<start:bigint,end:bigint,word:bigint,words:bigint>>), (a, s) ->
        if(size(a) > 0 and s.word <= element_at(a, -1).word + element_at(a, -1).words,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end), 'word', element_at(a, -1).word, 'words',
             greatest(element_at(a, -1).word + element_at(a, -1).words, s.word + s.words) - element_at(a, -1).word))),
           concat(a, array(named_struct('start', s.start, 'end', s.end, 'word', s.word, 'words', s.words)))))""")
    whole = met.withColumn("spans", merged).withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.words)"))
    return numbered.select("doc_id", "row").join(whole.withColumnRenamed("doc_id", "row"), "row").select("doc_id", "n_words", "n_hit", "item_ids", "spans")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = find_contamination(only(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """The same by plain loops, for tests."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows: dict[tuple, set] = {}
    for item, text in items:
        own = word.findall((text or "").translate(low))
        for s in range(max(1, len(own) - WINDOW + 1) if own else 0):
            windows.setdefault(tuple(own[s : s + WINDOW]), set()).add(item)
    sizes = sorted({len(w) for w in windows})
    out = {}
    for doc, text in docs:
        own, hit, found = word.findall((text or "").translate(low)), set(), set()
        for s in range(len(own)):
            for k in sizes:
                if (got := windows.get(tuple(own[s : s + k]))) and s + k <= len(own):
                    hit |= set(range(s, s + k))
                    found |= got
        names = ",".join(sorted(map(str, found)))
        out[doc] = (len(own), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out
