"""Clusters of samples by what their programs output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clusters import ARRAY_LIMIT, by_key, looked_up, plain

ERROR = "ERROR"


def normalised(output: Column) -> Column:
    """An output that holds 'Error:' becomes ERROR."""
    text = output.cast("string")
    return F.when(text.contains("Error:"), ERROR).otherwise(text)


def pick_tests(tests: DataFrame, k: int = 5, group: str = "qid", test: str = "test", seed: int = 0) -> DataFrame:
    """At most k tests of each question, those with the least hashes, in their own order."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), group, test), test)
    return tests.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k")


def passed_outputs(samples: DataFrame, outputs: DataFrame, group: str = "qid", pos: str = "pos", test: str = "test", output: str = "output") -> DataFrame:
    """(group, pos, test, output) of what the samples gave and is no error: a missing, null or failed output has no row.

    Of repeated outputs of a sample on a test the least counts, null last.
    """
    least = outputs.groupBy(group, pos, test).agg(F.min(normalised(F.col(output))).alias(output))
    return least.filter(F.col(output) != ERROR).join(samples.select(group, pos).distinct(), [group, pos], "left_semi")


def _sizes(samples: DataFrame, group: str, pos: str) -> DataFrame:
    return samples.groupBy(group).agg(F.countDistinct(pos).alias("n"))


def error_counts(samples: DataFrame, outputs: DataFrame, group: str = "qid", pos: str = "pos", test: str = "test", output: str = "output") -> DataFrame:
    """(group, test, errors, n): on how many of a question's n samples each test failed or gave nothing."""
    passed = passed_outputs(samples, outputs, group, pos, test, output).groupBy(group, test).agg(F.count(F.lit(1)).alias("__ok"))
    tests = outputs.select(group, test).distinct().join(_sizes(samples, group, pos), group).join(passed, [group, test], "left")
    return tests.select(group, test, (F.col("n") - F.coalesce("__ok", F.lit(0))).alias("errors"), "n")


def by_outputs(samples: DataFrame, outputs: DataFrame, group: str = "qid", pos: str = "pos", test: str = "test", output: str = "output", limit: int = ARRAY_LIMIT) -> DataFrame:
    """Adds `cluster`: samples with equal outputs on all valid tests, those that fewer than half of the question's
    samples failed; alone where a question has no valid test. A missing output is an error.

    Errors are what is left when passed outputs are counted, and two samples agree on all valid tests if what they passed
    with is the same: no row is made for a sample and a test it has no output of. Questions of up to `limit` samples are
    settled in one row each, which needs their samples and outputs by question and nothing else; if any is larger, or a
    sample lacks an id, all go by counts and joins. Both give the same clusters.
    """
    if plain(samples, group, pos, limit):
        return looked_up(samples, _in_rows(samples, outputs, group, pos, test, output), F.col("__ids"), group, pos)
    passed = passed_outputs(samples, outputs, group, pos, test, output).repartition(group, test)
    counts = passed.groupBy(group, test).agg(F.count(F.lit(1)).alias("__ok")).join(_sizes(samples, group, pos), group)
    valid = counts.filter(F.col("n") - F.col("__ok") < F.col("n") / 2).select(group, test)
    vectors = passed.join(valid, [group, test], "left_semi").groupBy(group, pos).agg(F.sort_array(F.collect_list(F.struct(test, output))).alias("__v"))
    some = valid.select(group, F.lit(True).alias("__some")).distinct()
    met = samples.join(vectors, [group, pos], "left").join(some, group, "left")
    alone = F.when(F.col("__some").isNull(), F.col(pos))
    return by_key(met.withColumn("__alone", alone), ["__v", "__alone"], group, pos).drop("__v", "__alone", "__some")


def _in_rows(samples: DataFrame, outputs: DataFrame, group: str, pos: str, test: str, output: str) -> DataFrame:
    """(group, __at, __ids): each question's positions and their cluster ids.

    A test is valid if more than half of the n samples passed it: among the passed outputs, sorted by test, two that stand
    n DIV 2 apart are of that test. A column that a lambda reads stands in its expression twice, so that it is not
    made anew for every element.
    """
    at = samples.groupBy(group).agg(F.sort_array(F.collect_set(pos)).alias("__at"))
    given = outputs.select(group, F.col(pos).alias("__p"), F.col(test).alias("__t"), normalised(F.col(output)).alias("__o"))
    own = F.when(F.array_contains("__at", F.col("__p")) & F.col("__t").isNotNull() & F.col("__o").isNotNull(), F.struct(F.col("__t").alias("t"), F.col("__p").alias("p"), F.col("__o").alias("o")))
    rows = at.join(given.hint("merge"), group, "left").groupBy(group).agg(F.first("__at").alias("__at"), F.sort_array(F.collect_set(own)).alias("__all"))
    before = lambda i: F.get("__all", i - 1)
    least = lambda x, i: (i == 0) | (before(i)["t"] != x["t"]) | (before(i)["p"] != x["p"])
    rows = rows.select(group, "__at", F.filter("__all", lambda x, i: least(x, i) & (x["o"] != ERROR)).alias("__ok"), F.floor(F.size("__at") / 2).cast("int").alias("__half"))
    same = lambda x, j: (F.get("__ok", j)["t"] == x["t"]) & (F.get("__ok", j + F.col("__half"))["t"] == x["t"])
    valid = lambda x, i: F.exists(F.sequence(F.greatest(i - F.col("__half"), F.lit(0)), i), lambda j: same(x, j))
    rows = rows.select(group, "__at", F.filter("__ok", valid).alias("__valid"))
    vector = lambda p: F.transform(F.filter("__valid", lambda x: x["p"] == p), lambda x: F.struct(x["t"], x["o"]))
    rows = rows.select(group, "__at", F.when(F.size("__valid") > 0, F.transform("__at", vector)).alias("__v"))
    first = F.transform(F.col("__v"), lambda v: F.array_position("__v", v))
    rows = rows.select(group, "__at", F.coalesce(first, F.sequence(F.lit(1).cast("long"), F.size("__at").cast("long"))).alias("__first"))
    return rows.select(group, "__at", F.transform("__first", lambda k: (F.array_position(F.array_distinct("__first"), k) - 1).cast("int")).alias("__ids"))


def acquire_tests(questions: DataFrame, cache: DataFrame, fresh: DataFrame, k: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The tests that each question is clustered by, and the cache with what was new.

    questions: (task_id, is_stdin, ...); cache and fresh: (task_id, is_stdin, generated_tests). A question whose
    (task_id, is_stdin) is in the cache with tests takes them, k of them by hash if there are more; any other takes
    all fresh ones, which go into the cache. A question without a task_id takes fresh ones that no one stores;
    one without any tests has no rows. The first result is (task_id, is_stdin, test_no, test).
    """
    keys, named = ["task_id", "is_stdin"], F.coalesce(F.col("task_id") != "", F.lit(False))
    wanted = questions.select(*keys).distinct()
    same = lambda rows, how: wanted.join(rows.select(*[F.col(c).alias(f"__{c}") for c in keys], "generated_tests"), F.col("task_id").eqNullSafe(F.col("__task_id")) & F.col("is_stdin").eqNullSafe(F.col("__is_stdin")), how).select(*keys, "generated_tests")
    held = same(cache.filter(F.size("generated_tests") > 0), "inner").filter(named)
    wanted = wanted.join(held.select(*[F.col(c).alias(f"__{c}") for c in keys]), (F.col("task_id") == F.col("__task_id")) & (F.col("is_stdin") == F.col("__is_stdin")), "left_anti")
    new = same(fresh.filter(F.size("generated_tests") > 0), "inner")
    rows = held.select(*keys, F.posexplode("generated_tests").alias("test_no", "test"), F.lit(True).alias("__cached")).unionByName(
        new.select(*keys, F.posexplode("generated_tests").alias("test_no", "test"), F.lit(False).alias("__cached"))
    )
    w = Window.partitionBy(*keys, "__cached").orderBy(F.xxhash64(F.lit(seed), *keys, "test_no"), "test_no")
    picked = rows.withColumn("__k", F.row_number().over(w)).filter(~F.col("__cached") | (F.col("__k") <= k))
    stored = cache.select(*keys, "generated_tests").unionByName(new.filter(named))
    return picked.select(*keys, "test_no", "test"), stored
