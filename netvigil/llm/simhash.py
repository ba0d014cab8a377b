"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: words between ASCII white space, lower case A-Z, shingles of ``width``
words with repeats, XXH64 of each; a bit is 1 if over half of the hashes have it.

Links: fingerprints at most ``limit`` bits apart. 64 bits in ``limit + 1`` or more
blocks have one block (or several) in common, so the distinct fingerprints are dealt
by the value of each choice of blocks. A task sorts its fingerprints by Gray rank
within these values, factors the bits that a run of neighbours shares into a masked
pattern, and does so again for runs of patterns up to the root of each value. A search
goes down from the roots; a group is left out when the differences on its shared bits
exceed the limit, or when all of it already belongs to the searching fingerprint's
class. Only the links of a spanning forest leave a task. A value with more than
``HOT`` fingerprints is cut into parts that meet in pairs.

Defined results: a null or empty text has fingerprint zero; rows with equal doc_id
have a fingerprint each and the same class if linked; a null doc_id is left out of
links but kept (its own class null); other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.llm.common import only, parts_for, stored, table
from netvigil.llm.components import joined_classes, smallest_reachable

#: Neighbours in one node of the index, and nodes under one above.
LEAF, FAN = 16, 8
#: Fingerprints of one block value that one task takes.
HOT = 200_000
#: 64-bit words of (searching fingerprint, child) pairs looked at in one go.
FRONT = 2_000_000
#: Links that a search holds before it joins classes by them.
HELD = 500_000
#: Hashes whose bits are counted in one go.
BITS = 100_000
#: Texts, and UTF-8 bytes of them, whose hashes are held in one go; one longer text is held alone.
TEXTS, TEXT_BYTES = 1024, 8_000_000


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each shingle, with repeats."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    whole = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts, stops = (ends - sizes)[: len(words) - width + 1].tolist(), (ends - 1)[width - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def fingerprints_of(texts: list[str | None], width: int = 4, words: int = 1) -> np.ndarray:
    """The fingerprint of each text: a row of 64-bit words, the first from the hashes themselves."""
    hashes = [shingle_hashes(t or "", width) for t in texts]
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    joined = np.concatenate([np.zeros(0, np.uint64), *hashes])
    return majorities(joined, counts, words)


def majorities(joined: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """For each run of hashes the bits that over half of them have, in words of 64 bits."""
    return np.stack([_majorities(joined if k == 0 else mix(joined + np.uint64(k)), counts) for k in range(words)], 1)


def _majorities(joined: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits that over half of them have."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    ends = np.cumsum(counts)
    groups = np.split(full, np.flatnonzero(np.diff(ends[full] // BITS)) + 1)
    for part in groups:  # unpacked bits take 64 bytes a hash
        own = counts[part]
        ones = np.zeros((len(part), 64), np.int64)
        if len(part) == 1:
            for lo in range(int(ends[part[0]] - own[0]), int(ends[part[0]]), BITS):
                ones[0] += _unpacked(joined[lo : min(lo + BITS, int(ends[part[0]]))]).sum(0, dtype=np.int64)
        elif len(part):
            bits = _unpacked(joined[ends[part[0]] - own[0] : ends[part[-1]]])
            after = np.cumsum(own)
            for k, (a, b) in enumerate(zip((after - own).tolist(), after.tolist(), strict=True)):
                ones[k] = bits[a:b].sum(0, dtype=np.int64)
        out[part] = np.packbits(2 * ones > own[:, None], axis=1).view(">u8").reshape(-1)
    return out


def _unpacked(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash, highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)


def with_fingerprints(docs: DataFrame, width: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the fingerprint's 64-bit words as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_BYTES, side="right"))
                part = batch.slice(at, min(max(end - at, 1), TEXTS))
                at += part.num_rows
                found = fingerprints_of(part.column(1).to_pylist(), width, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.tolist(), pa.list_(pa.int64()))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp array<long>")


def mix(x: np.ndarray) -> np.ndarray:
    """Another hash from a hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def block_masks(limit: int, extra: int) -> list[tuple[int, int]]:
    """(word 0, mask) for each choice of blocks of which any two 64-bit codes within the limit share one."""
    n = limit + 1 + extra
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [(0, sum(c)) for c in combinations(blocks, 1 + extra)]


def sampled_masks(words: int, bits: int) -> list[tuple[int, int]]:
    """(word, mask) of all blocks of so many bits, for codes of several words that are only likely to share one."""
    return [(w, ((1 << bits) - 1) << a) for w in range(words) for a in range(0, 64 - bits + 1, bits)]


class GrayIndex:
    """Groups of codes in Gray order within their keys, with the bits that each group shares."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        self.order = np.lexsort((*[gray_rank(codes[:, w]) for w in range(codes.shape[1] - 1, -1, -1)], keys))
        self.codes = codes[self.order]
        self.levels: list[dict[str, np.ndarray]] = []
        key = keys[self.order]
        all_one, any_one, first = self.codes, self.codes, np.arange(len(key))
        fan = LEAF
        while True:
            new = np.concatenate([[True], key[1:] != key[:-1]])
            within = np.arange(len(key)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            heads = np.flatnonzero(within % fan == 0)
            all_one, any_one = np.bitwise_and.reduceat(all_one, heads), np.bitwise_or.reduceat(any_one, heads)
            key, first = key[heads], first[heads]
            self.levels.append({"child": np.concatenate([heads, [len(within)]]), "pattern": all_one, "shared": ~(all_one ^ any_one), "first": first})
            fan = FAN
            if len(np.unique(key)) == len(key):
                break
        self.root = np.searchsorted(first, np.arange(len(codes)), side="right") - 1

    def forest(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, position) links, in the given order, each within the limit, that join all codes within the limit.

        Neighbours in Gray order are joined first: a large group of near copies is then
        a few classes, which searches leave out whole.
        """
        n = len(self.codes)
        label = np.arange(n)
        beside = np.flatnonzero(np.bitwise_count(self.codes[1:] ^ self.codes[:-1]).sum(1, dtype=np.int64) <= limit)
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def join(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal label
            label, used = joined_by(label, a, b)
            kept.append((a[used], b[used]))

        join(beside, beside + 1)
        step = 4096
        for lo in range(0, n, step):
            asks = np.arange(lo, min(n, lo + step))
            common = self._common(label)
            front = [(len(self.levels) - 1, asks, self.root[asks])]
            found_a, found_b, held = [], [], 0
            while front:
                level, ask, node = front.pop()
                if len(ask) > max(1, FRONT // (self.codes.shape[1] * (FAN if level else LEAF))):
                    half = len(ask) // 2
                    front += [(level, ask[:half], node[:half]), (level, ask[half:], node[half:])]
                    continue
                at = self.levels[level]
                far = np.bitwise_count((self.codes[ask] ^ at["pattern"][node]) & at["shared"][node]).sum(1, dtype=np.int64)
                live = (far <= limit) & (common[level][node] != label[ask])
                ask, node = ask[live], node[live]
                size = at["child"][node + 1] - at["child"][node]
                child = np.arange(int(size.sum())) + np.repeat(at["child"][node] - (np.cumsum(size) - size), size)
                ask = np.repeat(ask, size)
                if level:
                    front.append((level - 1, ask, child))
                    continue
                near = (label[child] != label[ask]) & (np.bitwise_count(self.codes[ask] ^ self.codes[child]).sum(1, dtype=np.int64) <= limit)
                found_a.append(ask[near])
                found_b.append(child[near])
                held += len(found_a[-1])
                if held > HELD:
                    join(np.concatenate(found_a), np.concatenate(found_b))
                    common = self._common(label)
                    found_a, found_b, held = [], [], 0
            a, b = np.concatenate(found_a or [asks[:0]]), np.concatenate(found_b or [asks[:0]])
            if len(a):
                join(a, b)
        one, two = (np.concatenate(x) for x in zip(*kept, strict=True))
        return self.order[one], self.order[two]

    def _common(self, label: np.ndarray) -> list[np.ndarray]:
        """The class that all codes below a node share, or -1."""
        out, below = [], label
        for at in self.levels:
            low, high = np.minimum.reduceat(below, at["child"][:-1]), np.maximum.reduceat(below, at["child"][:-1])
            mixed = np.minimum.reduceat(below, at["child"][:-1]) < 0
            below = np.where((low == high) & ~mixed, low, -1)
            out.append(below)
        return out


def joined_by(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes after links between a and b, and which links were needed: each class takes its first one to another."""
    used = [np.zeros(0, np.int64)]
    while True:
        x, y = label[a], label[b]
        across = np.flatnonzero(x != y)
        if not len(across):
            return label, np.concatenate(used)
        first = np.full(len(label), len(a))
        np.minimum.at(first, x[across], across)
        np.minimum.at(first, y[across], across)
        used.append(np.unique(first[first < len(a)]))
        label = joined_classes(label, a[used[-1]], b[used[-1]])


def linked_classes(codes: DataFrame, limit: int) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint in (doc_id, fp), by exact links."""
    nodes = stored(codes.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprints")
    n = nodes.count()
    roots = smallest_reachable(gray_links(nodes, n, limit, block_masks(limit, 0 if n < 4_000_000 else 1)))
    return nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))


def gray_links(nodes: DataFrame, n: int, limit: int, masks: list[tuple[int, int]]) -> DataFrame:
    """(a, b): links that join all of n nodes (node, fp) that are within the limit and share the bits of a mask."""
    dealt = nodes.select("node", "fp", F.posexplode(F.array(*[F.element_at("fp", w + 1).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for w, m in masks])).alias("choice", "value"))
    hot = dealt.groupBy("choice", "value").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    if n > HOT and hot.limit(1).count():
        dealt = dealt.join(hot, ["choice", "value"], "left").withColumn("parts", F.ceil(F.coalesce("n", F.lit(0)) * 2 / HOT).cast("int"))
        own = F.pmod(F.xxhash64("fp"), F.greatest("parts", F.lit(1))).cast("int")
        other = F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))
        dealt = dealt.withColumn("own", own).withColumn("other", F.explode(other)).withColumn("pair", F.least("own", "other") * 100_000 + F.greatest("own", "other"))
    else:
        dealt = dealt.withColumn("pair", F.lit(0))
    parts = parts_for(n * len(masks), 1_000_000, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        choice, value, pair, node = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(4))
        fp = np.concatenate([b.column(4).flatten().to_numpy() for b in held]).reshape(len(node), -1)
        place = np.lexsort((pair, value, choice))
        new = np.concatenate([[True], (choice[place][1:] != choice[place][:-1]) | (value[place][1:] != value[place][:-1]) | (pair[place][1:] != pair[place][:-1])])
        key = np.empty(len(place), np.int64)
        key[place] = np.cumsum(new)
        a, b = GrayIndex(key, fp.astype(np.int64).view(np.uint64)).forest(limit)
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return dealt.select("choice", "value", "pair", "node", "fp").repartition(parts, "choice", "value", "pair").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, limit: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row, by exact links of 64-bit fingerprints."""
    codes = stored(with_fingerprints(docs, width), "codes")
    classes = linked_classes(codes, limit)
    return codes.join(classes, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of all documents."""
    found = near_duplicates(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.element_at("fp", 1)), 16, "0")).alias("fingerprint"), "component_id")
