"""Connected components of an edge table: in one task while they are few, by alternating star steps beyond."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import settle, stored

#: Most edges that one task joins (16 bytes each, and a few times that while it works).
AT_ONCE = 1_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), ascending, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: a.size], at[a.size :]
    label = np.arange(nodes.size)
    while True:
        new, p, q = label.copy(), label[i], label[j]
        np.minimum.at(new, p, q)
        np.minimum.at(new, q, p)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _joined_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
    if held:
        nodes, label = joined(*(np.concatenate(x) for x in zip(*held)))
        for at in range(0, nodes.size, 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(label[part])], names=["node", "label"])


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(node, label): for each node of the edges (a, b), both long, the smallest node it can reach.

    Up to `at_once` different edges are joined by one task. Beyond, each round hangs every neighbour of a
    node on the smallest one around it, once for larger and once for smaller neighbours, until only stars
    are left. Minima are joined back instead of gathering neighbours, so a node with very many edges is
    never held by one task alone. Every round is stored. Null ends must not occur; repeated edges
    and edges from a node to itself change nothing (a node with no other edge is not returned); no edges give no rows.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = settle(edges), None
    if edges.count() <= at_once:
        ship(edges.sparkSession)
        return edges.coalesce(1).mapInArrow(_joined_batches, "node long, label long")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stored(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array(F.col("a"), F.col("b"))).alias("a")
        small = large.join(least, "a").select(ends, F.col("m").alias("b")).filter("a <> b").distinct()
        edges = stored(small)
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    stars = edges.groupBy("a").agg(F.min("b").alias("b"))
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(own)
