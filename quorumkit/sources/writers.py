"""Writers of results; rows go out as JSON lines unless said otherwise."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept
from .readers import TESTS, _paths, cache_lines

#: The buckets of a cache in parts; part of its layout, so that it can't be changed for a cache that is there.
BUCKETS = 64
ROUND_COLUMNS = ("question_id", "debug_trace", "is_passed_public", "passed", "score")


def write_rounds(rows: DataFrame, folder: str, append: bool = False, batch: int | None = None) -> None:
    """The five saved columns, in folders by difficulty, model and round_id, which readers.rounds reads; null values are kept.
    The lines are compressed by gzip; a file is what one task has of one round.

    With a batch number they go into a folder batch=<number> below these, in place of what a batch of that number left
    there: a batch that is written again after a failure counts once, and others stay. All batches of a folder have numbers,
    or none has. Files of a write that didn't end are never seen by readers.
    """
    names = ("difficulty", "model", "round_id")
    out = rows.select(*ROUND_COLUMNS, *names)
    if batch is None:
        write = out.write.mode("append" if append else "overwrite").partitionBy(*names)
    else:
        write = out.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names, "batch")
    write.option("ignoreNullFields", False).option("compression", "gzip").json(folder)


def write_results(rows: DataFrame, folder: str, parameters: dict | None = None) -> None:
    """Entropy results in folders by difficulty, model and method, which readers.results reads; parameters, such as those
    of an ensemble, go beside them as one line of JSON in config/."""
    rows.write.mode("overwrite").partitionBy("difficulty", "model", "method").json(folder)
    if parameters is not None:
        line = json.dumps(parameters, sort_keys=True)
        rows.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")


def evaluation_rows(rows: DataFrame) -> DataFrame:
    return rows.orderBy("model", "method", "difficulty", "metric", "entropy_type")


def operating_rows(rows: DataFrame) -> DataFrame:
    """The operating points of an evaluation, one row each: (model, method, difficulty, metric, entropy_type, point, value)."""
    keys, points = ("model", "method", "difficulty", "metric", "entropy_type"), ("fpr_at_80", "fpr_at_90", "tpr_at_5", "tpr_at_10")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("point"), F.col(c).alias("value")) for c in points])).alias("p")
    return rows.select(*keys, each).select(*keys, "p.*").orderBy(*keys, "point")


def correlation_rows(rows: DataFrame) -> DataFrame:
    return rows.orderBy("model", "method", "difficulty", "score_type", "entropy_type")


def write_sorted(rows: DataFrame, folder: str) -> None:
    """A report, in order, as one file: rows per group, not per question."""
    rows.coalesce(1).write.mode("overwrite").json(folder)


def experiment(config: dict, parameters: dict, now: str) -> str:
    """What a run was made with, as JSON."""
    return json.dumps({"config": config, "parameters": parameters, "timestamp": now}, indent=2, sort_keys=True)


def cascade_rows(results: DataFrame, samples: DataFrame, group: str = "qid") -> DataFrame:
    """One row per question: its layers with verdicts and cluster ids of their samples, entropy, score and stop; score and passed."""
    listed = samples.filter("is_passed_public").groupBy(group, "layer").agg(F.sort_array(F.collect_list(F.struct("pos", "passed", "cluster"))).alias("s"))
    layers = results.select(group, F.explode("layer_details").alias("d")).withColumn("layer", F.col("d.layer")).join(listed, [group, "layer"], "left")
    one = F.struct(
        F.col("layer").alias("layer_idx"), F.col("d.passed_public_count").alias("passed_public"), F.col("s.passed").alias("passed"), F.col("s.cluster").alias("cluster_ids"),
        F.col("d.entropy").alias("entropy"), F.col("d.score").alias("score"), (F.col("d.decision") == "stop").alias("stop"),
    )
    gathered = layers.groupBy(group).agg(F.sort_array(F.collect_list(one)).alias("layers"))
    return results.join(gathered, group, "left").select(group, "layers", F.col("final_score").alias("score"), F.col("final_passed").alias("passed"))


def full_rows(results: DataFrame) -> DataFrame:
    """Results without working columns, whose names begin with an underscore."""
    return results.select(*[F.col(f"`{c}`") for c in results.columns if not c.startswith("_")])


def upsert_tests(cache: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("task_id", "is_stdin")) -> DataFrame:
    """The cache with fresh tests added: to a known key those that it doesn't have yet, in their order; a new key as it is.

    Tests are equal if their texts and types are; tests that are repeated only among the fresh ones stay.
    """
    known = cache.select(*keys, F.col("generated_tests").alias("__old"))
    met = known.join(fresh.select(*keys, F.col("generated_tests").alias("__new")), list(keys), "full")
    more = F.filter("__new", lambda t: ~F.array_contains("__old", t))
    tests = F.when(F.col("__old").isNull(), F.col("__new")).when(F.col("__new").isNull(), F.col("__old")).otherwise(F.concat("__old", more))
    return met.select(*keys, tests.alias("generated_tests"))


def write_cache(spark: SparkSession, cache: DataFrame, path: str) -> None:
    """To a new folder: a cache that is being read can't be overwritten."""
    cache.write.mode("errorifexists").json(path)


def append_tests(spark: SparkSession, fresh: DataFrame, path: str) -> None:
    """Adds fresh tests to the cache at path, as upsert_tests does, by writing the lists that change and no others.

    A changed list is a new line with the next version of its key, below bucket=<number>; readers.test_cache takes the
    highest version. Only buckets that fresh keys fall into are read. The same fresh tests again change no list, so that
    nothing is written; what a write that failed has left is never read. Of several fresh rows of a key the greatest list
    counts; rows without a task_id or tests are left out, a null is_stdin is false. A cache has one writer at a time.
    """
    keys = ["task_id", "is_stdin"]
    named = fresh.filter("task_id <> '' AND size(generated_tests) > 0").select("task_id", F.coalesce("is_stdin", F.lit(False)).alias("is_stdin"), "generated_tests")
    new = named.groupBy(*keys).agg(F.max("generated_tests").alias("__new")).withColumn("bucket", _bucket())
    if _paths(spark, path):
        buckets = [r.bucket for r in new.select("bucket").distinct().collect()]
        lines = cache_lines(spark, path).filter(F.col("bucket").isin(buckets))
        known = lines.groupBy(*keys).agg(F.max_by("generated_tests", "version").alias("__old"), F.max("version").alias("__version"))
    else:
        known = spark.createDataFrame([], f"task_id string, is_stdin boolean, __old {TESTS}, __version long")
    more = F.filter("__new", lambda t: ~F.array_contains("__old", t))
    tests = F.when(F.col("__old").isNull(), F.col("__new")).otherwise(F.concat("__old", more))
    out = new.join(known, keys, "left").filter(F.col("__old").isNull() | (F.size(more) > 0))
    out = out.select(*keys, tests.alias("generated_tests"), (F.coalesce("__version", F.lit(-1)) + 1).alias("version"), "bucket")
    out.repartition("bucket").write.mode("append").partitionBy("bucket").json(path)


def compact_tests(spark: SparkSession, path: str, lines_per_key: float = 2.0) -> None:
    """Writes the buckets anew that have more than so many lines a key: one line a key, that of the highest version.

    Other buckets aren't touched. The rows are first written to the shared checkpoint folder, as a bucket can't be read
    while it is overwritten.
    """
    lines = cache_lines(spark, path)
    sizes = lines.groupBy("bucket").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("task_id", "is_stdin").alias("keys"))
    buckets = [r.bucket for r in sizes.filter(F.col("lines") > lines_per_key * F.col("keys")).collect()]
    if not buckets:
        return
    held = lines.filter(F.col("bucket").isin(buckets))
    last = held.groupBy("task_id", "is_stdin").agg(F.max_by("generated_tests", "version").alias("generated_tests"), F.max("version").alias("version"))
    rows = kept(last.withColumn("bucket", _bucket()))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").json(path)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("task_id", "is_stdin"), F.lit(BUCKETS)).cast("int")


def rejected(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that the schema can't read, but for blank ones."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    read = F.from_json("value", f"{schema}, _corrupt_record string", options)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.filter(read["_corrupt_record"].isNotNull()).select(F.col("value").alias("_corrupt_record"))
