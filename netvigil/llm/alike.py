"""Near-duplicates: SimHash links, checked and completed by exact Jaccard similarity.

SimHash codes of ``WORDS`` words over each text's set of shingles are linked through the
Gray-order index of ``simhash``; a link counts only after the exact similarity of both
sets. Codes are estimates, so a pair near the limit may share no block or differ in too
many bits. The rest follows exactly: of two sets with similarity s, ordered alike, the
first n - ceil(s n) + 1 members of each have a member in common, whatever the order. So
every pair that must link shares one of these; pairs that do and are not in one class
yet are counted too, and no pair is missed. The order puts shingles that a sample of
texts repeats last; it tells how much work is done, never what is found. Pairs are left
out uncounted only by bounds that hold always: their sizes, and the bits in which the
parities of their hashes differ, each of which needs a shingle that only one of them has.

Equal sets are one node, and classes are joined before the rest is looked at, so a large
group of copies doesn't bring all its pairs. Shingles whose texts have the same smallest
and largest class are one family, whose nodes are held against each other once, not for
each shingle. Of the pairs that the bounds leave there only a forest is counted first;
with the classes that it makes, those that are still between classes are counted too.

Defined results: texts without words are no copies of each other (node null); repeats
of a shingle count once; every row counts by itself, whatever its doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import parts_for, stored
from netvigil.llm.components import smallest_reachable
from netvigil.llm.simhash import gray_links, joined_by, majorities, mix, sampled_masks, shingle_hashes

#: Words of a code, bits of a block, and bits in which linked codes may differ: at a similarity of 0.8 they differ in 39, give or take 6.
WORDS, BLOCK, LIMIT = 4, 12, 50
#: Places by which parities are counted: a power of two from four for each shingle on, and at least.
EACH, PLACES = 4, 1024
#: Keys of texts that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Texts that the order is taken from, and shingles whose counts every task knows.
SAMPLE, KNOWN = 8_000, 1_000_000
#: Members that one task takes, and 64-bit words of parities.
ROWS, BITS = 1_000_000, 2_000_000
#: Pairs that are looked at in one go, and 64-bit words of their parities.
PAIRS, HELD = 200_000, 1_000_000
#: Nodes of one family that one task holds against each other.
HOT = 20_000


def _members(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    return np.unique(shingle_hashes(text or "", width))


def _common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of texts repeats, sorted, and in how many of its texts they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                found = np.concatenate([np.zeros(0, np.uint64), *[_members(t, width) for t in batch.column(0).slice(at, 200).to_pylist()]])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    step = max(1, -(-docs.count() // SAMPLE))
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).select("text").mapInArrow(run, "h long")
    top = some.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(KNOWN).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    place = np.argsort(h)
    return h[place], n[place]


def _node(members: np.ndarray) -> int | None:
    return int.from_bytes(blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True) if len(members) else None


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *[x.view(np.int64) for x in found]])))


def with_sets(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """(row, doc_id, text_key, node, size, code, prefix, wide) of every row: how many shingles, their SimHash, the first of them with rare ones before others, the parities of their hashes by place."""
    known, counts = _common_shingles(docs, width)
    sent = docs.sparkSession.sparkContext.broadcast((known, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [_members(text, width) for text in part.column(3).to_pylist()]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                codes = majorities(np.concatenate([np.zeros(0, np.uint64), *found]), sizes, WORDS)
                firsts, wide = [], []
                for own in found:
                    many = 1 << max(PLACES - 1, EACH * len(own) - 1).bit_length()
                    odd = np.bincount((mix(own) & np.uint64(many - 1)).astype(np.int64), minlength=many) & 1
                    wide.append(np.packbits(odd.astype(bool)).view(np.uint64))
                    if len(known) and len(own):
                        k = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        own = own[np.argsort(np.where(known[k] == own, counts[k], 0), kind="stable")]
                    firsts.append(own[: len(own) - math.ceil(len(own) * similarity - 1e-9) + 1])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(map(_node, found), pa.int64()), pa.array(sizes), _lists(list(codes)), _lists(firsts), _lists(wide)], ["row", "doc_id", "text_key", "node", "size", "code", "prefix", "wide"])

    rows = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, text_key long, node long, size long, code array<long>, prefix array<long>, wide array<long>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """All rows of a task, sorted by their first column and then the second, and where its values start and end."""
    held = pa.Table.from_batches([b for b in batches if b.num_rows] or [])
    cols = [c.to_numpy() for c in held.columns]
    place = np.lexsort((cols[1], cols[0]))
    cols = [c[place] for c in cols]
    new = np.concatenate([[True], cols[0][1:] != cols[0][:-1]])
    yield cols, np.concatenate([np.flatnonzero(new), [len(new)]])


def _counted(pairs: DataFrame, sets: DataFrame, docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike, counted from all members of both; only texts of pairs that the bounds leave are read again."""
    bound = (1 - similarity) / (1 + similarity)
    one, two = (sets.select(F.col("node").alias(x), F.col("text_key").alias(f"key_{x}"), F.col("size").alias(f"size_{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab")
    half = F.least(F.size("wide_a"), F.size("wide_b"))  # alike sets differ in size by a quarter at most, so one fold is enough
    folded = [F.when(F.size(x) == half, F.col(x)).otherwise(F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))) for x in ("wide_a", "wide_b")]
    differ = F.aggregate(F.zip_with(*folded, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    both = F.col("size_a") + F.col("size_b")
    alike_sizes = F.abs(F.col("size_a") - F.col("size_b")) <= both * bound + 1e-9
    pairs = pairs.join(one, "a").join(two, "b").where(alike_sizes & F.when(alike_sizes, differ <= both * bound + 1e-9))
    pairs = stored(pairs.select("a", "b", "key_a", "key_b"), "pairs")
    wanted = stored(pairs.select(F.explode(F.array("key_a", "key_b")).alias("text_key")).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                found = [_members(t, width) for t in batch.column(0).slice(at, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in found], pa.int64()), _lists(found)], ["node", "members"])

    texts = docs.select("text", F.xxhash64("text").alias("text_key")).join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"])
    members = stored(texts.select("text").mapInArrow(run, "node long, members array<long>").dropDuplicates(["node"]), "members")
    one, two = (members.select(F.col("node").alias(x), F.col("members").alias(f"in_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("in_a", "in_b"))
    both = F.size("in_a") + F.size("in_b")
    return pairs.select("a", "b").join(one, "a").join(two, "b").where(shared * (1 + similarity) >= both * similarity - 1e-9).select("a", "b")


def linked_nodes(rows: DataFrame, docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """(node, root) for all nodes of rows with_sets that have a link: the smallest node that it reaches."""
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = rows.where("node is not null")
    members = full.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    sets = stored(full.groupBy("node").agg(*[F.first(x).alias(x) for x in ("text_key", "size", "code", "wide")]), "sets")
    n = sets.count()
    near = gray_links(sets.select("node", F.col("code").alias("fp")), n, LIMIT, sampled_masks(WORDS, BLOCK))
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    classes = stored(smallest_reachable(_counted(pairs, sets, docs, similarity, width)), "classes")

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            for (h, node), _ in _runs(iter(held)):
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])  # equal texts once
                h, node = h[new], node[new]
                size = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), [len(h)]]))
                many = np.repeat(size > 1, size)
                yield pa.RecordBatch.from_arrays([pa.array(h[many]), pa.array(node[many])], ["h", "node"])

    dealt = full.select(F.explode("prefix").alias("h"), "node")
    shared = stored(dealt.repartition(parts_for(members, ROWS, least), "h").mapInArrow(share, "h long, node long"), "shared")

    # What SimHash left apart, first as links that would join classes, then as all that these left.
    families = stored(_families(shared, classes), "families").join(sets.select("node", "size", "wide"), "node")
    parts = parts_for(families.agg(F.coalesce(F.sum(F.size("wide")), F.lit(0))).first()[0], BITS, least)
    for forest in (True, False):
        known = families.join(classes, "node", "left").select("family", "node", F.coalesce("root", "node").alias("root"), "size", "wide")
        found = stored(known.repartition(parts, "family").mapInArrow(lambda x, forest=forest: _apart(x, similarity, forest), "family long, a long, b long"), "apart")
        links = _counted(found.select("a", "b").distinct(), sets, docs, similarity, width)
        classes = stored(smallest_reachable(links.unionByName(classes.select(F.col("node").alias("a"), F.col("root").alias("b")))), "classes")
        families = families.join(found.select("family").distinct(), "family", "left_semi")  # the others have no pair that the bounds leave
    return classes


def _families(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(family, node): the nodes of all shingles (h, node) that have the same first and last class; of a large family each two of its parts."""
    known = shared.join(classes, "node", "left").select("h", "node", F.coalesce("root", "node").alias("root"))
    open_ = known.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    nodes = known.join(open_.select("h", F.xxhash64("low", "high").alias("family")), "h").select("family", "node").distinct()
    nodes = stored(nodes, "in-families")
    parts = F.ceil(F.col("n") / HOT).cast("int")
    hot = nodes.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("family", parts.alias("parts"))
    if not hot.limit(1).count():
        return nodes
    nodes = nodes.join(hot, "family", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int"))
    nodes = nodes.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    cell = F.xxhash64("family", F.least("own", "other"), F.greatest("own", "other"))
    return nodes.select(F.when(F.col("parts").isNull(), F.col("family")).otherwise(cell).alias("family"), "node")


def _apart(batches: Iterator[pa.RecordBatch], similarity: float, forest: bool) -> Iterator[pa.RecordBatch]:
    """(family, a, b): a family's pairs of different classes that the bounds leave; as a forest, only those that join classes if all of them hold."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    family, node, root, size = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(4))
    words = np.concatenate([b.column(4).value_lengths().to_numpy() for b in held]).astype(np.int64)
    bits = np.concatenate([b.column(4).flatten().to_numpy() for b in held]).view(np.uint64)
    begin = np.cumsum(words) - words
    order = np.lexsort((node, size, family))
    family, node, root, size, words, begin = (x[order] for x in (family, node, root, size, words, begin))
    number = np.cumsum(np.concatenate([[0], family[1:] != family[:-1]]))
    kind = np.unique(np.stack([number, root], 1), axis=0, return_inverse=True)[1].reshape(-1)
    label = np.arange(len(kind))
    bound = (1 - similarity) / (1 + similarity)
    most = np.floor(size * ((1 + bound) / (1 - bound)) + 1e-6).astype(np.int64) + 1
    stop = np.searchsorted(number << 32 | size, number << 32 | most, side="right")  # in order of size, the last that may be alike
    after = np.concatenate([[0], np.cumsum(stop - np.arange(len(node)) - 1)])
    lo = 0
    while lo < len(node):
        hi = max(lo + 1, int(np.searchsorted(after, after[lo] + PAIRS, side="right")) - 1)
        own = np.arange(lo, hi)
        i = np.repeat(own, np.diff(after[lo : hi + 1]))
        j = i + 1 + np.arange(len(i)) - (after[i] - after[lo])
        lo = hi
        both = size[i] + size[j]
        live = (label[kind[i]] != label[kind[j]]) & (size[j] - size[i] <= both * bound + 1e-9)
        i, j, both = i[live], j[live], both[live]
        differ = np.empty(len(i), np.int64)
        for w in np.unique(words[i]).tolist():
            at = np.flatnonzero(words[i] == w)
            for some in np.split(at, range(HELD // w, len(at), max(1, HELD // w))):
                place, twice = begin[j[some]][:, None] + np.arange(w), words[j[some]] > w
                odd = bits[place] ^ bits[begin[i[some]][:, None] + np.arange(w)]
                odd[twice] ^= bits[place[twice] + w]  # alike sets differ in size by a quarter at most, so one fold is enough
                differ[some] = np.bitwise_count(odd).sum(1, dtype=np.int64)
        near = np.flatnonzero(differ <= both * bound + 1e-9)
        if forest:
            near = near[np.argsort(differ[near] / both[near], kind="stable")]
            label, used = joined_by(label, kind[i[near]], kind[j[near]])
            near = near[used]
        i, j = i[near], j[near]
        yield pa.RecordBatch.from_arrays([pa.array(family[i]), pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["family", "a", "b"])


def copies(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """(row, doc_id, class) of every row of docs (row, doc_id, text); rows of a class are alike, null is a class of its own."""
    rows = stored(with_sets(docs, similarity, width), "sets-by-row")
    roots = linked_nodes(rows, docs, similarity, width)
    return rows.select("row", "doc_id", "node").join(roots, "node", "left").select("row", "doc_id", F.coalesce("root", "node").alias("class"))
