"""Debug traces and saved rounds: what a sample finally is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_known(trace: Column, field: str) -> Column:
    """The last value of a field of a trace that isn't null."""
    return F.try_element_at(F.filter(F.transform(trace, lambda x: x[field]), lambda v: v.isNotNull()), F.lit(-1))


def final_samples(rows: DataFrame, trace: str = "debug_trace", missing: float | None = None) -> DataFrame:
    """Rows with a trace: the last code and, each on its own, the last known log probabilities; score 0.0 if null.

    missing: what stands for a log probability that no step has (null for entropies, 0.0 for selection).
    """
    t = F.col(trace)
    fill = lambda c: c if missing is None else F.coalesce(c, F.lit(missing))
    kept = rows.filter(F.size(t) > 0)
    return kept.withColumns(
        {"code": F.element_at(t, -1)["code"], "logprob": fill(last_known(t, "logprob")), "norm_logprob": fill(last_known(t, "norm_logprob")), "trace_length": F.size(t)}
        | ({"score": F.coalesce("score", F.lit(0.0))} if "score" in rows.columns else {})
    )


def first_last(rows: DataFrame, trace: str = "debug_trace") -> DataFrame:
    """Rows with a trace: first and last code, the first step's log probabilities (0.0 if null), first_passed and last_passed."""
    t = F.col(trace)
    kept = rows.filter(F.size(t) > 0)
    return kept.withColumns(
        {
            "first_code": F.element_at(t, 1)["code"], "last_code": F.element_at(t, -1)["code"],
            "first_logprob": F.coalesce(F.element_at(t, 1)["logprob"], F.lit(0.0)), "first_norm_logprob": F.coalesce(F.element_at(t, 1)["norm_logprob"], F.lit(0.0)),
            "first_passed": F.col("passed") & (F.size(t) == 1), "last_passed": F.col("passed"), "debug_trace_length": F.size(t),
        }
    )


def traces(steps: DataFrame, group: Sequence[str] = ("qid",), step: str = "step", fields: Sequence[str] = ("code", "logprob", "norm_logprob")) -> DataFrame:
    """(group, debug_trace): steps gathered in order."""
    gathered = F.sort_array(F.collect_list(F.struct(step, *fields)))
    return steps.groupBy(*group).agg(F.transform(gathered, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("debug_trace"))


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], trace: str = "debug_trace") -> DataFrame:
    """Of rows repeated for one key, the first with a trace; `total_count` also counts those without one before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn("total_count", F.row_number().over(w)).filter(F.size(trace) > 0)
    return numbered.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def layer_counts(rows: DataFrame, keys: Sequence[str] = ("qid", "layer"), public: str = "is_passed_public") -> DataFrame:
    """(keys, total_count, passed_public_count)."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_count"), F.count_if(F.col(public)).alias("passed_public_count"))


def fill_tests(expected: DataFrame, results: DataFrame, keys: Sequence[str] = ("qid", "test")) -> DataFrame:
    """Every expected test with its result; missing ones time out: failed, 'Error: Time out!', infinite seconds. A result
    that is there stays as it is, nulls included."""
    met = expected.join(results.withColumn("__known", F.lit(True)), list(keys), "left")
    known = lambda c, missing: F.when(F.col("__known"), F.col(c)).otherwise(F.lit(missing)).alias(c)
    return met.select(*expected.columns, known("passed", False), known("message", "Error: Time out!"), known("seconds", float("inf")))


def verdicts(results: DataFrame, keys: Sequence[str] = ("qid",), order: str = "test", passed: str = "passed", fast: bool = False) -> DataFrame:
    """(keys, passed, score, num_tests): all passed, and the share passed.

    fast: tests run from the last to the first and stop at a failure; those not run count as timed out.
    """
    if not fast:
        return results.groupBy(*keys).agg(F.bool_and(passed).alias("passed"), F.avg(F.col(passed).cast("int")).alias("score"), F.count(F.lit(1)).alias("num_tests"))
    broken = F.max(F.when(~F.col(passed), F.col(order))).alias("__broken")
    ran = results.join(results.groupBy(*keys).agg(broken), list(keys))
    run = F.col("__broken").isNull() | (F.col(order) > F.col("__broken"))
    return ran.groupBy(*keys).agg(F.bool_and(passed).alias("passed"), F.avg(run.cast("int")).alias("score"), F.count(F.lit(1)).alias("num_tests"))


def running_counts(results: DataFrame) -> DataFrame:
    """Totals over saved rows: how many, passed public and private tests, accuracy."""
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_passed_public").alias("public"), F.count_if("passed").alias("private"),
        F.coalesce(F.avg(F.col("passed").cast("int")), F.lit(0.0)).alias("accuracy"),
    )
