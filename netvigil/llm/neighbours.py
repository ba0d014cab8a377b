"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are grown on at most ``SAMPLE`` vectors (those whose key has the smallest
hash) and split at the median of a random projection. Every distinct vector is put into
its leaf of each tree. A query walks all trees through one priority queue, ordered by
the squared margins that a path has crossed, until it has visited ``SHARE`` of the
forest's leaves (``LEAST_VISITS`` at least). Leaves are dealt to parts; each part holds
a vector once with its leaves there, scores the vectors of visited leaves exactly, in
double precision, and keeps the best of each query; the parts' lists are merged.

Equal vectors are one entry with their ``k + 1`` smallest ids, which is all that a
query can return of them, so a very common vector is no hot leaf.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part, nor do vectors of another length than the most common one (ties: the shorter);
null ids take no part; repeated (vec_id, vector) rows count once; with fewer candidates
than k all are returned; no vectors give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netvigil.llm.common import parts_for, stored, table

SAMPLE = 32_768
TREES = 8
LEAF = 64
#: Visited leaves of all trees: at least 0.9 of the true neighbours on unclustered unit vectors of 64 components.
SHARE = 0.1
LEAST_VISITS = 64
#: Vector copies of one part, and scored pairs held before they are thinned.
PART_ROWS = 200_000
PAIRS = 2_000_000


@dataclass
class Tree:
    """Inner nodes as arrays; a child below zero is leaf -child - 1."""

    normals: np.ndarray
    splits: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """Each vector's leaf."""
        node = np.full(len(vectors), 0 if len(self.splits) else -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            right = np.einsum("ij,ij->i", vectors[inner], self.normals[at]) > self.splits[at]
            node[inner] = self.children[at, right.astype(int)]
        return -node - 1


def grow(vectors: np.ndarray, leaf: int, seed: int) -> Tree:
    """A tree whose leaves hold at most so many of the given vectors, but for equal ones."""
    rng = np.random.default_rng(seed)
    normals, splits, children, leaves = [], [], [], 0
    todo = [(np.arange(len(vectors)), -1, 0)]
    while todo:
        ids, parent, side = todo.pop()
        here = None
        if len(ids) > leaf:
            pair = vectors[rng.choice(ids, 2, replace=False)]
            normal = pair[0] - pair[1]
            normal = normal / (np.linalg.norm(normal) or 1)
            place = vectors[ids] @ normal
            split = float(np.median(place))
            right = place > split
            if right.any():
                here = len(splits)
                normals.append(normal)
                splits.append(split)
                children.append([0, 0])
                todo += [(ids[right], here, 1), (ids[~right], here, 0)]
        if here is None:
            leaves += 1
            here = -leaves
        if parent >= 0:
            children[parent][side] = here
    width = vectors.shape[1] if vectors.ndim == 2 else 0
    return Tree(np.array(normals).reshape(-1, width), np.array(splits), np.array(children, np.int64).reshape(-1, 2), leaves)


@dataclass
class Forest:
    """Trees with leaves numbered through, and the part of each leaf."""

    trees: list[Tree]
    parts: int

    def __post_init__(self) -> None:
        self.first = np.concatenate([[0], np.cumsum([t.leaves for t in self.trees])])
        self.visits = max(LEAST_VISITS, int(np.ceil(SHARE * self.first[-1])))
        self.part = np.random.default_rng(7).permutation(int(self.first[-1])) % self.parts

    def homes(self, vectors: np.ndarray) -> np.ndarray:
        """A row for each vector: its leaf in every tree."""
        return np.stack([t.leaf_of(vectors) + f for t, f in zip(self.trees, self.first, strict=False)], 1)

    def visited(self, vector: np.ndarray) -> list[int]:
        """The leaves that a query looks at, best first."""
        margins = [(t.normals @ vector - t.splits).tolist() for t in self.trees]
        count = itertools.count()
        heap = [(0.0, next(count), k, 0 if len(t.splits) else -1) for k, t in enumerate(self.trees)]
        out: list[int] = []
        while heap and len(out) < self.visits:
            crossed, _, k, node = heapq.heappop(heap)
            children = self.trees[k].children
            while node >= 0:
                margin = margins[k][node]
                near = int(margin > 0)
                heapq.heappush(heap, (crossed + margin * margin, next(count), k, int(children[node, 1 - near])))
                node = int(children[node, near])
            out.append(int(self.first[k]) - node - 1)
        return out


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, candidate: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, candidate, score))
        self.held += len(query)
        if self.held > PAIRS:
            self.thin()

    def thin(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, c, s = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (c[1:] != c[:-1])]) if len(q) else np.zeros(0, bool)
        q, c, s = q[new], c[new], s[new]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        q, c, s = q[keep], c[keep], s[keep]
        last = np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1
        self.least[q[last]] = s[last]
        self.parts, self.held = [(q, c, s)], len(q)
        return q, c, s


def _vectors(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), flat.dtype)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): the rows that take part."""
    double = vectors.schema["embedding"].dataType.simpleString() == "array<double>"
    vec: Column = F.col("embedding").cast("array<double>" if double else "array<float>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine)
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vec") == (common["d"] if common else 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found by inner product; is_query is over vec_id."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    single = rows.groupBy("vec", "vec_id").agg(F.lit(1).alias("one"))
    entries = stored(single.select("vec", "vec_id", place.alias("place")).where(F.col("place") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("key"), "vec", "ids"), "vectors")
    queries = single.where(is_query).select("vec_id", "vec")
    asked = queries.groupBy("vec").agg(F.min("vec_id").alias("key"))
    n = entries.count()
    kind = entries.schema["vec"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = entries.select("key", "vec").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toPandas()
    grown_on = np.array(sample["vec"].tolist(), np.float64).reshape(len(sample), -1)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts_for(n * TREES, PART_ROWS, shuffle)
    sent = spark.sparkContext.broadcast(Forest([grow(grown_on, LEAF, s) for s in range(TREES)], parts))
    dealt = f"part int, asks boolean, key long, vec {kind}, leaves array<int>"

    def deal(asks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    piece = batch.slice(at, 512)
                    if not piece.num_rows:
                        continue
                    own = _vectors(piece.column(1)).astype(np.float64)
                    leaves = [forest.visited(v) for v in own] if asks else forest.homes(own).tolist()
                    out_row, out_part, out_leaves = [], [], []
                    for row, visited in enumerate(leaves):
                        by_part: dict[int, list[int]] = {}
                        for leaf in visited:
                            by_part.setdefault(int(forest.part[leaf]), []).append(leaf)
                        out_row += [row] * len(by_part)
                        out_part += by_part
                        out_leaves += by_part.values()
                    index = pa.array(out_row, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(out_part, pa.int32()), pa.array([asks] * len(out_row), pa.bool_()), piece.column(0).take(index), piece.column(1).take(index), pa.array(out_leaves, pa.list_(pa.int32()))], ["part", "asks", "key", "vec", "leaves"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        asks, key = whole.column(1).to_numpy(zero_copy_only=False), whole.column(2).to_numpy()
        vec = _vectors(whole.column(3))
        leaf, count = whole.column(4).flatten().to_numpy(), np.diff(whole.column(4).offsets.to_numpy())
        row = np.repeat(np.arange(len(key)), count)
        order = np.lexsort((asks[row], leaf))
        row, leaf = row[order], leaf[order]
        cuts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]]))
        asked_keys, asked_no = np.unique(key[asks], return_inverse=True)
        number = np.zeros(len(key), np.int64)
        number[asks] = asked_no
        query_vec = np.zeros((len(asked_keys), vec.shape[1]))
        query_vec[asked_no] = vec[asks]
        own_keys, own_no = np.unique(key[~asks], return_inverse=True)
        number[~asks] = own_no
        own_vec = np.zeros((len(own_keys), vec.shape[1]), vec.dtype)
        own_vec[own_no] = vec[~asks]
        best = Best(len(asked_keys), k + 1)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows_here = row[a:b]
            split = a + int(np.searchsorted(asks[rows_here], True)) - a
            own, asking = number[rows_here[:split]], number[rows_here[split:]]
            for lo in range(0, len(own), 4096):
                part = own[lo : lo + 4096]
                if not len(asking) or not len(part):
                    continue
                score = query_vec[asking] @ own_vec[part].astype(np.float64).T
                q, c = np.nonzero(score >= best.least[asking][:, None] - 1e-9)
                best.add(asking[q], part[c], score[q, c])
        q, c, _ = best.thin()
        exact = (query_vec[q] * own_vec[c].astype(np.float64)).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(asked_keys[q]), pa.array(own_keys[c]), pa.array(exact)], ["query", "key", "score"])

    both = entries.select("key", "vec").mapInArrow(deal(False), dealt).unionByName(asked.select("key", "vec").mapInArrow(deal(True), dealt))
    found = both.repartition(parts, "part").mapInArrow(search, "query long, key long, score double")
    # Each part's list is cut to the best before ids are looked up.
    merged = found.groupBy("query").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct((-F.col("score")).alias("s"), "key")))), 1, k + 1).alias("found"))
    named = merged.select("query", F.explode("found").alias("f")).select("query", "f.s", "f.key").join(entries.select("key", "ids"), "key")
    lists = named.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("s", "key", "ids"))).alias("found"))
    flat = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct(f["s"].alias("s"), i.alias("vec_id")))))
    answers = asked.join(lists, F.col("key") == F.col("query")).select("vec", F.slice(F.array_sort(flat), 1, k + 1).alias("near"))
    ranked = queries.join(answers, "vec").select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)).alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
