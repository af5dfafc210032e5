"""Exact top-k inner products by MaxScore over sharded postings."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

#: Vectors of a shard, about; least number of shards; vectors whose postings are read together.
SHARD, LEAST, PART = 131_072, 8, 16_384
#: Postings read from the head of each of so many lists for a first bound.
HEAD, LISTS = 64, 8
#: Queries that traverse a shard together; share of the k-th score that the terms only probed may add.
STEP, MARGIN = 128, 0.4


def top_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids, best first."""
    if scores.size > k:
        least = np.partition(scores, scores.size - k)[scores.size - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(scores.size)
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


class Postings:
    """The vectors of a shard as one posting list per term (dimension), with bounds for each sign of a query's weight."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.rows = ids, vectors
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        head = min(HEAD, len(ids))
        order = np.argsort(vectors.T, axis=1, kind="stable")
        self.heads = {-1: order[:, :head].copy(), 1: order[:, order.shape[1] - head :].copy()}
        self.lists: dict[type, np.ndarray] = {}
        self.touched = 0

    def _exact(self, queries: np.ndarray) -> type:
        """The fastest number type in which every partial sum is exact."""
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(self.rows).max(initial=0)) * max(1, self.rows.shape[1])
        return np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, ids and scores of the k best vectors of the shard, without those whose id is its own.

        What a term can add is bounded by its largest contribution in the shard. Terms are ordered by the
        range of theirs; those at the end whose bounds together stay under MARGIN of the current k-th
        score are non-essential: they alone can't lift a vector to it. Essential lists, and no others, are traversed for
        a block of queries at once, the others probed, widest first, only for vectors that can still
        reach the k-th score.
        """
        kind = self._exact(queries)
        if kind not in self.lists:
            self.lists[kind] = np.ascontiguousarray(self.rows.T, dtype=kind)
        one, other = queries * self.low, queries * self.high
        terms = np.argsort(-np.abs(other - one), axis=1, kind="stable")
        ahead = np.cumsum(np.take_along_axis(np.maximum(one, other), terms, axis=1)[:, ::-1], axis=1)[:, ::-1]
        ahead = np.concatenate((ahead, np.zeros((len(queries), 1), ahead.dtype)), axis=1)  # what the terms from here on can add
        limits, cuts = [], []
        for query, mine, order, rest in zip(queries, own, terms, ahead):
            seen = np.unique(np.concatenate([self.heads[1 if query[t] > 0 else -1][t] for t in order[:LISTS]]))
            seen = seen[self.ids[seen] != mine]
            first = self.rows[seen] @ query
            limits.append(int(np.partition(first, first.size - k)[first.size - k]) if first.size >= k else None)
            under = np.flatnonzero(rest < MARGIN * limits[-1]) if limits[-1] is not None else []
            cuts.append(int(under[0]) if len(under) else len(order))
        place = np.empty_like(terms)
        np.put_along_axis(place, terms, np.arange(terms.shape[1])[None, :].repeat(len(queries), axis=0), axis=1)
        essential = place < np.array(cuts)[:, None]
        read = essential.any(axis=0)  # lists that are essential to no query of the block are not traversed
        gained = (queries * essential)[:, read].astype(kind) @ (self.lists[kind] if read.all() else self.lists[kind][read])
        self.touched += int(read.sum()) * len(self.ids)
        out = []
        for q, (query, mine, limit, cut) in enumerate(zip(queries, own, limits, cuts)):
            alive = np.flatnonzero(gained[q] >= limit - ahead[q, cut]) if limit is not None else np.arange(len(self.ids))
            alive = alive[self.ids[alive] != mine]
            score = gained[q, alive].astype(np.int64)
            for at in range(cut, terms.shape[1]):
                t = terms[q, at]
                score = score + query[t] * self.rows[alive, t]
                keep = score + ahead[q, at + 1] >= limit
                if not keep.all():
                    alive, score = alive[keep], score[keep]
            best = top_of(self.ids[alive], score, k)
            out.append((self.ids[alive][best], score[best]))
        return out


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows end in zeros."""
    lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
    flat = np.asarray(lists.flatten())
    out = np.zeros((len(lists), width), dtype=flat.dtype)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


class Shard:
    """Vectors of a shard as they come in, then their postings in parts, built once."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.parts: list[Postings] | None = None

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids.append(ids)
        self.rows.append(rows)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, ids, scores): the k best of the shard."""
        if self.parts is None:
            ids, rows = (np.concatenate(x) if x else np.zeros((0, 1), np.int64) for x in (self.ids, self.rows))
            self.ids = self.rows = []
            self.parts = [Postings(ids[at : at + PART], rows[at : at + PART].astype(np.int64)) for at in range(0, len(ids), PART)]
        for at in range(0, len(own), STEP):
            found = [p.search(queries[at : at + STEP], own[at : at + STEP], k) for p in self.parts]
            for q, several in enumerate(zip(*found)):
                ids, scores = (np.concatenate(x) for x in zip(*several))
                best = top_of(ids, scores, k)
                yield at + q, ids[best], scores[best]


def quantized(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): floor(64 * x) of each component; rows with a null vector or component, NaN or infinity go."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & ~F.exists("v", bad))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * 64).cast("long")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """Each query's k highest integer inner products among vectors: query_id, rank, vec_id, score.

    Ties go to smaller vec_ids; a query's own id is no candidate; with fewer vectors all are returned.
    Vectors are dealt into shards, each sent once, as the smallest integers that hold them; the shard's
    postings are built once, and queries, of which each shard gets a copy, stream past them. The
    shards' lists are merged by query. Null or non-finite vectors take no part. Vectors of unequal
    lengths are compared as if the shorter ended in zeros. Rows of vectors repeated with one id are
    candidates each; queries repeated with equal vectors count once. A null id is no query, and as a
    candidate comes first among ties. An empty table gives no rows.
    """
    ship(vectors.sparkSession)
    base, asked = quantized(vectors, id_col, vector_col), quantized(queries, id_col, vector_col).filter("vec_id IS NOT NULL").distinct()
    least, most = F.min(F.array_min("v")), F.max(F.array_max("v"))
    n, widest, *ends = base.agg(F.count(F.lit(1)), F.max(F.size("v")), least, most).first()
    wide, *other = asked.agg(F.max(F.size("v")), least, most).first()
    kind = next(t for t, top in (("smallint", 2**15), ("int", 2**31), ("bigint", 2**63)) if all(-top <= (x or 0) < top for x in (*ends, *other)))
    shards, width = max(LEAST, ceil(n / shard)), max(widest or 0, wide or 0, 1)
    packed = F.col("v").cast(f"array<{kind}>").alias("v")
    # by their place, so that repeated rows don't all fall into one shard
    left = base.select(F.pmod(F.xxhash64("vec_id", "v") + F.monotonically_increasing_id(), F.lit(shards)).alias("s"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("q"), "vec_id", packed)
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("s"), F.lit(1).alias("kind"), F.xxhash64("vec_id", "v").alias("q"), "vec_id", packed)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, at, held = np.iinfo(np.int64).min, None, Shard()
        for batch in batches:
            keys, kinds = np.asarray(batch.column("s")), np.asarray(batch.column("kind"))
            change = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(keys)]):
                if hi == lo:
                    continue
                part = batch.slice(lo, hi - lo)
                if keys[lo] != at:
                    at, held = keys[lo], Shard()
                own, rows = part.column("vec_id").fill_null(none).to_numpy(), _matrix(part.column("v"), width)
                if kinds[lo] == 0:
                    held.add(own, rows)
                    continue
                marks, out = part.column("q").to_numpy(), [[np.zeros(0, np.int64)] for _ in range(4)]
                for q, ids, scores in held.search(rows.astype(np.int64), own, k):
                    for x, y in zip(out, (np.full(ids.size, marks[q]), np.full(ids.size, own[q]), ids, scores)):
                        x.append(y)
                arrays = [pa.array(np.concatenate(x), pa.int64()) for x in out]
                arrays[2] = pa.compute.if_else(pa.compute.equal(arrays[2], none), pa.scalar(None, pa.int64()), arrays[2])
                yield pa.RecordBatch.from_arrays(arrays, names=["q", "query_id", "vec_id", "score"])

    rows = left.unionByName(right).repartition(shards, "s").sortWithinPartitions("s", "kind")
    found = rows.mapInArrow(search, "q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
