"""Connected components of a link table, as local unions, one exchange by node and Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import parts_for, stored

#: Links that a task joins in one go before they are dealt, and that one task is dealt.
HELD = 1_000_000


def joined_classes(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Classes after links between a and b; each class is named by its first position."""
    parent = label.copy()
    while True:
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        if not apart.any():
            return parent
        np.minimum.at(parent, high[apart], low[apart])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def _stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Links (a, b) of every node to the smallest that it reaches by these links."""
    a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = joined_classes(np.arange(len(nodes)), place[: len(a)], place[len(a) :])
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], ["a", "b"])


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of every ``HELD`` links of a task."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(x.num_rows for x in held) >= HELD:
            yield _stars(held)
            held = []
    if held:
        yield _stars(held)


def _all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of all links of a task."""
    held = [x for x in batches if x.num_rows]
    if held:
        yield _stars(held)


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): the smallest node that it reaches.

    Alternates small-star and large-star steps. For the first each task joins the links
    that it reads, then those of each larger end meet in one task, which joins all that
    it is dealt: after the first union a node has one link to a smaller one from each
    run of ``HELD`` links, however many it had. The second hands a node's larger
    neighbours to its smallest one by a join with the minima. Few exchanges matter: each
    makes as many tasks as there are shuffle partitions, however small the table is.
    """
    spark = links.sparkSession
    links = links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    links = stored(links.mapInArrow(_some, "a long, b long"), "links")
    parts = parts_for(links.count(), HELD, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while True:
        links = stored(links.mapInArrow(_some, "a long, b long").repartition(parts, "a").mapInArrow(_all, "a long, b long"), "links")
        least = stored(links.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("top")), "least")
        below = least.select(F.col("a").alias("b"), F.col("m").alias("up"))
        deep = least.select(F.col("m").alias("b"), (F.col("m") < F.col("top")).alias("two")).join(below, "b", "left")
        if not deep.where("two or up is not null").limit(1).count():
            break
        links = links.join(below, "b", "left").select("a", F.coalesce("up", "b").alias("b"))
    roots = least.select(F.col("a").alias("node"), F.col("m").alias("root"))
    return roots.unionByName(least.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
