"""Grouping the samples of a question: by key, by components, by leaders."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept, ship

#: Questions with more samples than this get their clusters by joins instead of one row with all links.
ARRAY_LIMIT = 64
#: Questions of up to so many samples are ranked by windows over their samples, larger ones by their different keys.
WINDOW_LIMIT = 100_000
#: Positions of a question that are settled in the first round, and the most links of a block that one task searches.
LEAD_BLOCK, MOST_LINKS = 1024, 2_000_000
#: Questions whose links are held at once while their components are searched.
SLICE = 1024


def by_key(samples: DataFrame, key: Sequence[str], group: str | Sequence[str] = "qid", pos: str = "pos", limit: int = WINDOW_LIMIT, where: str | None = None) -> DataFrame:
    """Adds `cluster`: samples of a question with equal keys share one; ids count from 0 by first position.

    group: the columns of a question. where: a boolean column; samples for which it isn't true take no part and have a
    null. Where no question has more than `limit` samples, which one count by question tells, two windows rank them: one
    exchange, one scan. Else keys are counted first and only different ones are ranked, so that no large question is in a
    single task. Both give the same ids.
    """
    groups = [group] if isinstance(group, str) else list(group)
    part = F.coalesce(F.col(where), F.lit(False)) if where else F.lit(True)
    largest = samples.groupBy(*groups).count().agg(F.max("count")).first()[0]
    if (largest or 0) <= limit:
        marked = samples.withColumn("__in", part)
        first = marked.withColumn("__first", F.min(pos).over(Window.partitionBy(*groups, "__in", *key)))
        rank = F.dense_rank().over(Window.partitionBy(*groups).orderBy(F.desc("__in"), "__first")) - 1
        return first.withColumn("cluster", F.when(F.col("__in"), rank)).drop("__in", "__first")
    names = [f"__key{k}" for k in range(len(key) + len(groups))]
    firsts = samples.filter(part).groupBy(*[F.col(c).alias(n) for c, n in zip([*groups, *key], names)]).agg(F.min(pos).alias("__first"))
    ranked = firsts.withColumn("cluster", F.dense_rank().over(Window.partitionBy(*names[: len(groups)]).orderBy("__first")) - 1).drop("__first")
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in zip([*groups, *key], names)], part)
    return samples.join(ranked, same, "left" if where else "inner").drop(*names)


def plain(samples: DataFrame, group: str, pos: str, limit: int = ARRAY_LIMIT) -> bool:
    """Whether no question has more than `limit` rows and no sample lacks a question or a position; one count by question."""
    rows = samples.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(pos).isNull()).alias("none"))
    most, none = rows.agg(F.max("n"), F.max((F.col("none") > 0) | F.col(group).isNull())).first()
    return (most or 0) <= limit and not none


def looked_up(samples: DataFrame, rows: DataFrame, ids: Column, group: str, pos: str) -> DataFrame:
    """samples with `cluster`, from rows (group, __at, ...) with their question's positions and an array of ids for these:
    samples that lie by question stay where they are."""
    found = rows.select(group, "__at", ids.alias("__ids")).hint("merge")
    met = samples.join(found, group).withColumn("cluster", F.get("__ids", (F.array_position("__at", F.col(pos)) - 1).cast("int")))
    return met.select(group, pos, *[c for c in samples.columns if c not in (group, pos)], "cluster")


def _labelled(sizes: np.ndarray, question: np.ndarray, a: np.ndarray, b: np.ndarray, directed: bool) -> np.ndarray:
    """The cluster ids of all positions of many questions, from links between positions a and b of a question.

    A label is the least position that reaches one, found by rounds that halve the distance to it; see propagate().
    """
    starts = np.cumsum(sizes) - sizes
    x, y = starts[question] + a, starts[question] + b
    if not directed:
        x, y = np.concatenate((x, y)), np.concatenate((y, x))
    label = own = np.arange(int(sizes.sum()))
    while True:
        after = label.copy()
        np.minimum.at(after, y, label[x])
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    ids = np.cumsum(label == own) - 1
    return (ids[label] - np.repeat(ids[starts[sizes > 0]], sizes[sizes > 0])).astype(np.int32)


def _reached(n: int, a: np.ndarray, b: np.ndarray, directed: bool) -> list[int]:
    """For each position, the id of the cluster it hangs together with. Directed links are followed from the least
    position that is not yet reached."""
    return _labelled(np.array([n]), np.zeros(len(a), np.int64), np.asarray(a, np.int64), np.asarray(b, np.int64), directed).tolist()


def _led(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """For each position, the id of its leader: itself if no earlier leader matches it, else the last one that does."""
    before: list[set[int]] = [set() for _ in range(n)]
    for x, y in zip(a.tolist(), b.tolist()):
        if x != y:
            before[max(x, y)].add(min(x, y))
    place: dict[int, int] = {}
    ids = []
    for i in range(n):
        matched = [k for k in before[i] if k in place]
        if not matched:
            place[i] = len(place)
        ids.append(place[max(matched)] if matched else place[i])
    return ids


def _ids(find: Callable[[int, np.ndarray, np.ndarray], list[int]]) -> Column:
    """The cluster ids of a question's positions, from its row."""

    @F.pandas_udf("array<int>")
    def run(n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([find(int(k), x, y) for k, x, y in zip(n, a, b)], dtype=object)

    return run("__n", F.transform("__links", lambda e: e["a"]), F.transform("__links", lambda e: e["b"]))


def _components(directed: bool) -> Column:
    """The ids of the components of a question's positions, from its row; SLICE questions at a time."""

    @F.arrow_udf("array<int>")
    def run(n: pa.Array, links: pa.Array) -> pa.Array:
        out = [np.zeros(0, np.int32)]
        for k in range(0, len(n), SLICE):
            own, sizes = links.slice(k, SLICE), n.slice(k, SLICE).to_numpy().astype(np.int64)
            ends, counts = own.flatten(), own.value_lengths().to_numpy()
            a, b = (ends.field(c).to_numpy().astype(np.int64) for c in "ab")
            out.append(_labelled(sizes, np.repeat(np.arange(len(sizes)), counts), a, b, directed))
        offsets = np.concatenate(([0], np.cumsum(n.to_numpy())))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out), pa.int32()))

    return run("__n", "__links")


def _grouped(samples: DataFrame, links: DataFrame, group: str, pos: str) -> DataFrame:
    """One row per question: its positions, their number, and its links between ranks of positions. What lies by question
    is not shuffled; links are ranked before they are gathered, so that those of other positions are left out."""
    at = samples.filter(F.col(group).isNotNull()).groupBy(group).agg(F.sort_array(F.collect_set(F.struct(F.col(pos).alias("p")))).alias("__s")).select(group, F.col("__s.p").alias("__at"))
    ends = at.join(links.select(group, "a", "b").hint("merge"), group, "left")
    ends = ends.select(group, "__at", *[(F.array_position("__at", F.col(c)) - 1).cast("int").alias(c) for c in "ab"])
    found = F.when((F.col("a") >= 0) & (F.col("b") >= 0), F.struct("a", "b"))
    rows = ends.groupBy(group).agg(F.first("__at").alias("__at"), F.collect_set(found).alias("__links"))
    return rows.withColumn("__n", F.size("__at"))


def _unfolded(rows: DataFrame, ids: Column, group: str, pos: str) -> DataFrame:
    out = rows.select(group, F.arrays_zip(F.col("__at"), ids.alias("__ids")).alias("__z"))
    return out.select(group, F.explode("__z").alias("z")).select(group, F.col("z.__at").alias(pos), F.col("z.__ids").cast("int").alias("cluster"))


def _settled(samples: DataFrame, links: DataFrame, group: str, pos: str, limit: int, whole: bool, ids: Callable[[], Column], by_joins: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Clusters of small questions by `ids` from their rows, of larger ones by joins; whole: samples with all columns."""
    ship(samples.sparkSession)  # before `ids` makes the function, which takes with it what workers import

    def in_rows(samples: DataFrame, links: DataFrame) -> DataFrame:
        rows = _grouped(samples, links, group, pos)
        return looked_up(samples.filter(F.col(pos).isNotNull()), rows, ids(), group, pos) if whole else _unfolded(rows, ids(), group, pos)

    most = samples.groupBy(group).count().agg(F.max("count")).first()[0]
    if (most or 0) <= limit:
        return in_rows(samples, links)
    small, large = _by_size(samples, group, pos, limit)
    out = in_rows(*(df.join(small, group, "left_semi") for df in (samples, links)))
    if large.isEmpty():
        return out
    samples, links = (df.join(large, group, "left_semi") for df in (samples, links))
    found = by_joins(samples, links)
    return out.unionByName(samples.join(found, [group, pos]) if whole else found)


def components(samples: DataFrame, links: DataFrame, group: str = "qid", pos: str = "pos", directed: bool = False, limit: int = ARRAY_LIMIT, whole: bool = False) -> DataFrame:
    """(group, pos, cluster): samples that hang together by links (group, a, b); whole: all columns of samples, and cluster.

    Ids count from 0 in the order of each cluster's first member. Links count in both directions unless
    `directed`; directed ones are followed outward from the first sample that is not in a cluster yet.
    Small questions are searched many at a time in Arrow batches, larger ones propagate labels by joins.
    """
    return _settled(samples, links, group, pos, limit, whole, lambda: _components(directed), lambda s, l: propagate(s, l, group, pos, directed))


def _by_size(samples: DataFrame, group: str, pos: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Questions with up to `limit` samples, and those with more."""
    sizes = samples.groupBy(group).agg(F.countDistinct(pos).alias("__size"))
    return sizes.filter(F.col("__size") <= limit).select(group), sizes.filter(F.col("__size") > limit).select(group)


def propagate(samples: DataFrame, links: DataFrame, group: str = "qid", pos: str = "pos", directed: bool = False) -> DataFrame:
    """Components of questions of any size, by labels that halve the distance to the least member each round.

    A label is the least sample that reaches a sample. Along directed links that is the root from which it is
    first reached: had an earlier root reached that sample, it would reach this one too.
    """
    back = links.select(group, F.col("b").alias("a"), F.col("a").alias("b"))  # a takes the label of b
    both = kept((back if directed else back.union(links.select(group, "a", "b"))).filter("a <> b").distinct())
    labels = kept(samples.select(group, pos, F.col(pos).alias("label")).distinct())
    while True:
        near = both.join(labels.select(group, F.col(pos).alias("b"), F.col("label").alias("other")), [group, "b"]).groupBy(group, "a").agg(F.min("other").alias("other"))
        step = labels.join(near.withColumnRenamed("a", pos), [group, pos], "left").select(group, pos, "label", F.least("label", F.coalesce("other", "label")).alias("least"))
        jump = step.select(group, F.col(pos).alias("least"), F.col("least").alias("further"))
        after = kept(step.join(jump, [group, "least"], "left").select(group, pos, "label", F.least("least", F.coalesce("further", "least")).alias("next")))
        moved = not after.filter("label <> next").isEmpty()
        labels = after.select(group, pos, F.col("next").alias("label"))
        if not moved:
            break
    first = labels.select(group, "label").distinct().withColumn("cluster", F.dense_rank().over(Window.partitionBy(group).orderBy("label")) - 1)
    return labels.join(first, [group, "label"]).select(group, pos, F.col("cluster").cast("int").alias("cluster"))


def leaders(samples: DataFrame, links: DataFrame, group: str = "qid", pos: str = "pos", limit: int = ARRAY_LIMIT, whole: bool = False) -> DataFrame:
    """(group, pos, cluster): a sample that no earlier leader matches leads; any other takes the last leader that matches it.

    Questions with more than `limit` samples find their leaders block by block of positions. whole: all columns of samples.
    """
    return _settled(samples, links, group, pos, limit, whole, lambda: _ids(_led), lambda s, l: lead_by_rounds(s, l, group, pos))


def lead_by_rounds(samples: DataFrame, links: DataFrame, group: str = "qid", pos: str = "pos", block: int = LEAD_BLOCK) -> DataFrame:
    """Leaders of questions of any size, block by block of positions; blocks double.

    Whether a sample leads depends on those before it only. Each round settles the next block of every question: a
    join strikes the samples that a settled leader matches; those that are left and have no links among each other lead,
    the others are searched by one task a question. A block is halved if a question has more than MOST_LINKS such
    links in it, else the next one is twice as long: the rounds are logarithmic in the samples of a question, whatever
    chains its links form.
    """
    ends = links.filter("a <> b").select(group, F.greatest("a", "b").alias(pos), F.least("a", "b").alias("__before")).distinct()
    nodes = kept(samples.select(group, pos).distinct().withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(pos)) - 1))
    ahead = nodes.select(group, F.col(pos).alias("__before"), F.col("__rank").alias("__before_rank"))
    ends = kept(ends.join(nodes, [group, pos]).join(ahead, [group, "__before"]))
    most, done, leads = nodes.agg(F.max("__rank")).first()[0], 0, None
    ship(samples.sparkSession)
    while most is not None and done <= most:
        fresh = nodes.filter(F.col("__rank").between(done, done + block - 1))
        if leads is not None:
            struck = ends.filter(F.col("__rank").between(done, done + block - 1)).join(leads.withColumnRenamed(pos, "__before"), [group, "__before"], "left_semi")
            fresh = fresh.join(struck, [group, pos], "left_anti")
        fresh = kept(fresh)
        open_ = fresh.select(group, pos)
        inner = ends.filter(F.col("__rank").between(done, done + block - 1) & (F.col("__before_rank") >= done)).join(open_, [group, pos], "left_semi")
        inner = kept(inner.join(open_.withColumnRenamed(pos, "__before"), [group, "__before"], "left_semi"))
        worst = inner.groupBy(group).count().agg(F.max("count")).first()[0] or 0
        if worst > MOST_LINKS and block > 1:
            block //= 2
            continue
        linked = inner.select(group, pos).union(inner.select(group, F.col("__before").alias(pos))).distinct()
        found = _unfolded(_grouped(linked, inner.select(group, F.col(pos).alias("a"), F.col("__before").alias("b")), group, pos), _ids(_leads), group, pos)
        own = kept(open_.join(found.filter("cluster = 0"), [group, pos], "left_anti"))
        leads = own if leads is None else leads.unionByName(own)
        done, block = done + block, 2 * block
    if leads is None:
        return samples.select(group, pos).withColumn("cluster", F.lit(None).cast("int")).filter("false")
    last = ends.join(leads.withColumnRenamed(pos, "__before"), [group, "__before"]).groupBy(group, pos).agg(F.max("__before").alias("__last"))
    marked = leads.withColumn("__leads", F.lit(True))
    own = nodes.join(marked, [group, pos], "left").join(last, [group, pos], "left").select(group, pos, F.when(F.col("__leads"), F.col(pos)).otherwise(F.col("__last")).alias("__own"))
    ids = leads.withColumn("cluster", (F.row_number().over(Window.partitionBy(group).orderBy(pos)) - 1).cast("int")).withColumnRenamed(pos, "__own")
    return own.join(ids, [group, "__own"]).select(group, pos, "cluster")


def _leads(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """For each position, whether it leads: no earlier leader matches it."""
    before: list[list[int]] = [[] for _ in range(n)]
    for x, y in zip(a.tolist(), b.tolist()):
        before[max(x, y)].append(min(x, y))
    out: list[int] = []
    for i in range(n):
        out.append(int(not any(out[k] for k in before[i])))
    return out


def cluster(samples: DataFrame, links: DataFrame, algorithm: str = "dfs", **names: str | bool) -> DataFrame:
    """Components ('dfs') or leaders ('greedy')."""
    if algorithm not in ("dfs", "greedy"):
        raise ValueError(f"unknown algorithm {algorithm!r}: 'dfs' or 'greedy'")
    return components(samples, links, **names) if algorithm == "dfs" else leaders(samples, links, **names)


def largest(clustered: DataFrame, group: Sequence[str] = ("qid",)) -> DataFrame:
    """(group, cluster, size): each question's largest cluster, of equal ones the lowest id."""
    sizes = clustered.groupBy(*group, "cluster").agg(F.count(F.lit(1)).alias("size"))
    best = F.max(F.struct("size", (-F.col("cluster")).alias("last"))).alias("best")
    return sizes.groupBy(*group).agg(best).select(*group, (-F.col("best.last")).alias("cluster"), F.col("best.size").alias("size"))
