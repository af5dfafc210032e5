"""How well uncertainty tells passing questions from failing ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept, ship
from .entropy import MEASURES, entropies_of_parts, entropy_parts

#: Ranges of entropy between a power of two and the next, in which cumulative counts are taken apart.
RANGES = 1024
#: More than the number of ranges below any double's, and the range of infinity.
_SHIFT, _LAST = 1100 * RANGES, 4 * 1100 * RANGES

#: Sums of a cluster's scores, and what a question has of them: see question_scores().
_SUMS = {"__max": F.max, "__sum": F.sum, "__scored": F.sum}


def _score_parts(score: str) -> list[Column]:
    return [F.max(score).alias("__max"), F.sum(score).alias("__sum"), F.count(score).alias("__scored")]


def _score_sums() -> list[Column]:
    return [f(c).alias(c) for c, f in _SUMS.items()]


def _best() -> dict[str, tuple]:
    """What a question has of its clusters: the sums of all, and of the largest, of equal ones that with the lowest id."""
    top = F.struct("n", (-F.col("cluster")).alias("last"), "__max", "__sum", "__scored")
    return {"__best": (F.max, top)} | {c: (f, F.col(c)) for c, f in _SUMS.items()}


def _scores() -> list[Column]:
    top = F.col("__best")
    one = lambda c: F.coalesce(c == 1.0, F.lit(False)).cast("int")
    mean = lambda total, n: F.coalesce(F.try_divide(total, n), F.lit(0.0))
    return [
        one(F.col("__max")).alias("pass_at_n"), one(top["__max"]).alias("pass_at_cluster"),
        mean(F.col("__sum"), F.col("__scored")).alias("avg_score"), F.coalesce(F.col("__max"), F.lit(0.0)).alias("max_score"),
        mean(top["__sum"], top["__scored"]).alias("cluster_avg_score"), F.coalesce(top["__max"], F.lit(0.0)).alias("cluster_max_score"),
    ]


def question_scores(samples: DataFrame, group: Sequence[str] = ("qid",), score: str = "score") -> DataFrame:
    """One row per question: pass_at_n, pass_at_cluster, and the mean and greatest score of all samples and of the largest
    cluster, of equal ones that with the lowest id. Samples are added up by cluster first, and read once."""
    sums = samples.groupBy(*group, "cluster").agg(F.count(F.lit(1)).alias("n"), *_score_parts(score))
    return sums.groupBy(*group).agg(*[f(c).alias(name) for name, (f, c) in _best().items()]).select(*group, *_scores())


def question_measures(samples: DataFrame, group: Sequence[str] = ("qid",), logprob: str = "logprob", score: str = "score") -> DataFrame:
    """entropies() and question_scores() of the same samples, which are added up once for both."""
    parts = entropy_parts(samples, logprob, group, also=_score_parts(score))
    return entropies_of_parts(parts, group, also=_score_sums(), more=_best(), then=_scores())


def with_overall(rows: DataFrame, difficulty: str = "difficulty") -> DataFrame:
    """Each row twice: once in its own group and once in 'overall'."""
    return rows.withColumn(difficulty, F.explode(F.array(F.col(difficulty).cast("string"), F.lit("overall"))))


def positional(rows: DataFrame, group: Sequence[str], order: str, label: str, entropy: str) -> DataFrame:
    """Labels and entropies paired as lists of which only the second leaves out nulls, cut to the shorter."""
    w = Window.partitionBy(*group).orderBy(order)
    labels = rows.select(*group, F.row_number().over(w).alias("__k"), label)
    known = rows.filter(F.col(entropy).isNotNull()).select(*group, F.row_number().over(w).alias("__k"), entropy)
    return labels.join(known, [*group, "__k"]).drop("__k")


def long_form(rows: DataFrame, keys: Sequence[str], targets: Sequence[str], measures: Sequence[str] = MEASURES, target: str = "metric", value: str = "y") -> DataFrame:
    """One row for each target and measure; rows whose measure is null are left out."""
    t = F.explode(F.array(*[F.struct(F.lit(c).alias(target), F.col(c).alias(value)) for c in targets])).alias("__t")
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("entropy_type"), F.col(c).cast("double").alias("entropy")) for c in measures])).alias("__e")
    out = rows.select(*keys, t, *measures).select(*keys, "__t.*", e).select(*keys, target, value, "__e.*")
    return out.filter(F.col("entropy").isNotNull())


def entropy_range(e: Column) -> Column:
    """A whole number that doesn't fall as e rises: RANGES of them between each power of two and the next, zero apart.

    Whether the logarithm is rounded up or down at a power of two makes no difference: the last range below it is what
    the place before the first range above it is.
    """
    size = F.abs(e)
    power = F.floor(F.log2(size))
    place = power * RANGES + F.floor((size / F.pow(F.lit(2.0), power) - 1) * RANGES) + _SHIFT
    far = F.when(size == float("inf"), _LAST).when(size < 2.0**-1000, 1).otherwise(place).cast("long")
    return F.when(F.isnan(e), 2 * _LAST).when(e == 0, 0).when(e > 0, far).otherwise(-far)


def _cumulative(rows: DataFrame, group: Sequence[str], label: str, entropy: str) -> DataFrame:
    """Per distinct entropy of a group: positives and negatives here and at lower entropies, and in all."""
    return _running(rows.groupBy(*group, F.col(entropy).cast("double").alias("__e")).agg(*_labels(label)), group)


def _labels(label: str, p: str = "p", n: str = "n") -> list[Column]:
    return [F.sum(F.col(label).cast("long")).alias(p), F.sum(1 - F.col(label).cast("long")).alias(n)]


def _counted(rows: DataFrame, keys: Sequence[str], targets: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """The counts of with_overall(long_form()): of each entropy of a measure those of all targets are added up in one row, and
    only these counts are repeated by target and for 'overall'."""
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("entropy_type"), F.col(c).cast("double").alias("__e")) for c in measures])).alias("__m")
    labels = [c for i, t in enumerate(targets) for c in _labels(f"__y{i}", f"__p{i}", f"__n{i}")]
    flat = rows.select(*keys, *[F.col(t).alias(f"__y{i}") for i, t in enumerate(targets)], e).select("*", "__m.*").filter(F.col("__e").isNotNull())
    once = flat.groupBy(*keys, "entropy_type", "__e").agg(*labels)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("metric"), F.col(f"__p{i}").alias("p"), F.col(f"__n{i}").alias("n")) for i, t in enumerate(targets)])).alias("__t")
    every = with_overall(once.select(*keys, "entropy_type", "__e", each).select(*keys, "entropy_type", "__e", "__t.*"), keys[-1])
    return every.groupBy(*keys, "metric", "entropy_type", "__e").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def _running(counted: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts (group, __e, p, n) of different entropies with those at lower ones, and in all.

    The counts are stored, so that what they are made of is read once. Running sums are taken inside ranges of
    entropy (a fixed function of the number, see entropy_range) and added to those of the ranges below, so that no
    group is sorted by one task.
    """
    met = kept(counted).withColumn("__r", entropy_range(F.col("__e"))).repartition(*group, "__r")
    sums = met.groupBy(*group, "__r").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    whole = Window.partitionBy(*group)
    below = whole.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    base = [F.coalesce(F.sum(c).over(below), F.lit(0)).alias(n) for c, n in (("rp", "bp"), ("rn", "bn"))]
    sums = sums.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("__r").alias("__own"), *base, F.sum("rp").over(whole).alias("all_p"), F.sum("rn").over(whole).alias("all_n"))
    inside = Window.partitionBy(*group, "__r").orderBy("__e").rowsBetween(Window.unboundedPreceding, -1)
    run = met.withColumn("lp", F.coalesce(F.sum("p").over(inside), F.lit(0))).withColumn("ln", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"__{c}")) for c in group], F.col("__r") == F.col("__own"))
    return run.join(sums, same).select(*group, F.col("__e").alias("entropy"), "p", "n", "all_p", "all_n", (F.col("lp") + F.col("bp")).alias("tp"), (F.col("ln") + F.col("bn")).alias("fp"))


def roc_points(rows: DataFrame, group: Sequence[str], label: str = "y", entropy: str = "entropy") -> DataFrame:
    """(group, fpr, tpr): the curve of "low entropy means passed", with its origin. Groups of one class get the diagonal."""
    return _points(kept(_cumulative(rows, group, label, entropy)), group)


def _points(c: DataFrame, group: Sequence[str]) -> DataFrame:
    """roc_points() from cumulative counts."""
    one = (F.col("all_p") == 0) | (F.col("all_n") == 0)
    point = F.struct(((F.col("fp") + F.col("n")) / F.col("all_n")).alias("fpr"), ((F.col("tp") + F.col("p")) / F.col("all_p")).alias("tpr"))
    points = c.filter(~one).select(*group, point.alias("x"))
    heads = c.select(*group, one.alias("one")).distinct()
    ends = F.when(F.col("one"), F.array(F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")), F.struct(F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr")))).otherwise(F.array(F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))))
    return points.unionByName(heads.select(*group, F.explode(ends).alias("x"))).select(*group, "x.fpr", "x.tpr")


def auroc(rows: DataFrame, group: Sequence[str], label: str = "y", entropy: str = "entropy") -> DataFrame:
    """(group, auroc, num_samples): 0.0 for one class, 0.5 for constant entropy."""
    return _cumulative(rows, group, label, entropy).groupBy(*group).agg(*_area())


def _area() -> list[Column]:
    area = F.sum(F.col("n") * (F.col("tp") + F.col("p") / 2))
    share = F.try_divide(area, F.max("all_p") * F.max("all_n").cast("double"))
    return [F.coalesce(share, F.lit(0.0)).alias("auroc"), (F.max("all_p") + F.max("all_n")).alias("num_samples")]


def _crossing(x: str, y: str, at: float) -> Column:
    """y where the curve reaches x = at, straight between points; of points with one x the highest y counts."""
    low = F.max(F.when(F.col(x) <= at, F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    low = F.coalesce(low, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))  # the origin
    high = F.min(F.when(F.col(x) > at, F.struct(F.col(x).alias("x"), (-F.col(y)).alias("y"))))
    slope = (at - low["x"]) / (high["x"] - low["x"])
    return F.when(high.isNull(), low["y"]).otherwise(low["y"] + (-high["y"] - low["y"]) * slope)


def fpr_at_tpr(points: DataFrame, group: Sequence[str], targets: Sequence[float] = (0.8, 0.9)) -> DataFrame:
    return points.groupBy(*group).agg(*[_crossing("tpr", "fpr", t).alias(f"fpr_at_{round(100 * t)}") for t in targets])


def tpr_at_fpr(points: DataFrame, group: Sequence[str], targets: Sequence[float] = (0.05, 0.10)) -> DataFrame:
    return points.groupBy(*group).agg(*[_crossing("fpr", "tpr", t).alias(f"tpr_at_{round(100 * t)}") for t in targets])


def evaluate(rows: DataFrame, keys: Sequence[str] = ("model", "method", "difficulty"), targets: Sequence[str] = ("pass_at_n", "pass_at_cluster")) -> DataFrame:
    """AUROC and its operating points per group, target and measure, and overall. rows: keys, targets and the four measures."""
    group = [*keys, "metric", "entropy_type"]
    c = _running(_counted(rows, keys, targets), group)
    c = c.withColumn("fpr", F.try_divide(F.col("fp") + F.col("n"), F.col("all_n"))).withColumn("tpr", F.try_divide(F.col("tp") + F.col("p"), F.col("all_p")))
    one = (F.max("all_p") == 0) | (F.max("all_n") == 0)
    at = [("fpr_at", "tpr", "fpr", t) for t in (0.8, 0.9)] + [("tpr_at", "fpr", "tpr", t) for t in (0.05, 0.10)]
    points = [F.when(one, t).otherwise(_crossing(x, y, t)).alias(f"{name}_{round(100 * t)}") for name, x, y, t in at]
    return c.groupBy(*group).agg(*_area(), *points)


def pearson(rows: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """(group, correlation, num_samples): 0.0 for fewer than two rows or without variance."""
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    r = F.when((F.count(F.lit(1)) >= 2) & (spread > 0), F.try_divide(F.covar_pop(x, y), spread))
    return both.groupBy(*group).agg(F.greatest(F.least(F.coalesce(r, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0)).alias("correlation"), F.count(F.lit(1)).alias("num_samples"))


def p_value(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of a correlation r of n rows: the regularised incomplete beta function at 1 - r^2, a = (n - 2) / 2, b = 1/2.

    Evaluated by its continued fraction (modified Lentz), on whichever side converges fast.
    """
    from math import lgamma

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
        out = d
        for m in range(1, 500):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + top * d or tiny)
                c = 1 + top / c or tiny
                out *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return out

    def one(r: float, n: float) -> float:
        if n < 3 or abs(r) >= 1:
            return 1.0 if n < 3 else 0.0
        a, b, y = (n - 2) / 2, 0.5, r * r  # x is 1 - y, which would lose a small y
        if y == 0:
            return 1.0
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log1p(-y) + b * np.log(y))
        return float(front * fraction(a, b, 1 - y) / a if 1 - y < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, y) / b)

    return np.array([one(float(a), float(b)) for a, b in zip(r, n)])


def with_p_value(rows: DataFrame, correlation: str = "correlation", n: str = "num_samples") -> DataFrame:
    """Adds p_value; 1.0 where the correlation is 0.0 for want of rows or variance, and for two rows."""
    ship(rows.sparkSession)

    @F.pandas_udf("double")
    def p(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for r, k in batches:
            yield pd.Series(p_value(r.to_numpy(), k.to_numpy()))

    return rows.withColumn("p_value", p(correlation, n))


def correlate(rows: DataFrame, keys: Sequence[str] = ("model", "method", "difficulty"), scores: Sequence[str] = ("avg_score", "max_score", "cluster_avg_score", "cluster_max_score")) -> DataFrame:
    """Pearson correlation of each measure with each score, per group and overall; questions with a null measure or score and groups of one are left out."""
    whole = rows
    for c in (*MEASURES, *scores):
        whole = whole.filter(F.col(c).isNotNull())
    flat = with_overall(long_form(whole, keys, scores, target="score_type", value="score"), keys[-1])
    return pearson(flat, [*keys, "score_type", "entropy_type"], "entropy", "score").filter("num_samples >= 2")


#: What a chart shows: an area of at least the first number; some false positive rate below the second; some true
#: positive rate of at least the third.
LIMITS = (0.6, 0.5, 0.5)
CHARTS = {
    "roc": lambda area, fpr, tpr: F.col("auroc") >= area,
    "fpr": lambda area, fpr, tpr: (F.col("fpr_at_80") < fpr) | (F.col("fpr_at_90") < fpr),
    "tpr": lambda area, fpr, tpr: (F.col("tpr_at_5") >= tpr) | (F.col("tpr_at_10") >= tpr),
}


def chart_rows(evaluation: DataFrame, charts: Sequence[str] = tuple(CHARTS), limits: tuple[float, float, float] = LIMITS) -> DataFrame:
    """The rows that each chart shows, with its name in `chart`."""
    if unknown := set(charts) - set(CHARTS):
        raise ValueError(f"unknown charts: {', '.join(sorted(unknown))}")
    names = F.array(*[F.when(CHARTS[c](*limits), c) for c in charts])
    return evaluation.withColumn("chart", F.explode(F.filter(names, lambda c: c.isNotNull())))


def roc_summary(rows: DataFrame, keys: Sequence[str] = ("model", "method", "difficulty"), targets: Sequence[str] = ("pass_at_n", "pass_at_cluster"), least: float = LIMITS[0]) -> DataFrame:
    """The curves of each model's summary, one row for each point: (keys, metric, entropy_type, label, auroc, fpr, tpr).
    Curves with an area below `least` are left out. rows: as in evaluate()."""
    group = [*keys, "metric", "entropy_type"]
    c = kept(_running(_counted(rows, keys, targets), group))
    shown = c.groupBy(*group).agg(*_area()).filter(F.col("auroc") >= least).drop("num_samples")
    label = F.concat(F.concat_ws("_", keys[1], "entropy_type"), F.format_string(" (AUC=%.4f)", "auroc"))
    return _points(c, group).join(shown, group).select(*group, label.alias("label"), "auroc", "fpr", "tpr")


def correlation_bars(correlations: DataFrame) -> DataFrame:
    """The bars of the charts that each model, difficulty and score type has: label, height, and colour, red below zero and
    blue otherwise."""
    label = F.concat_ws("_", "method", "entropy_type")
    colour = F.when(F.col("correlation") < 0, "red").otherwise("blue")
    return correlations.select("model", "difficulty", "score_type", label.alias("label"), F.col("correlation").alias("height"), colour.alias("colour"))
