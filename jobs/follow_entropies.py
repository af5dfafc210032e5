"""Keeps the uncertainty of every question up to date while files with new samples arrive.

    python -m jobs.follow_entropies SAMPLES OUTPUT CHECKPOINT [--config FILE]

Each run takes the files below SAMPLES (Parquet) that no run has taken before, and ends. A batch of files is added up
by (question, answer) into parts, in OUTPUT/parts/bucket=<b>/batch=<k>/; then the buckets that it touched are written
anew from their parts, in OUTPUT/uncertainty/bucket=<b>/: the four entropies of each question, its number of samples and
of different answers, and its most frequent answer with its share (of equal ones the first by alphabet).

A file is read once; what is read again later are parts, which hold one row per (question, answer, step of log
probability) and batch, and only those of touched buckets. A batch that is run again after a failure has the same
number and overwrites its own parts, so nothing counts twice. CHECKPOINT belongs to OUTPUT: give a new one together
with a new OUTPUT only. Rows without a question are left out; an answer may be null. Nulls as log probabilities count as samples without.
"""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumkit.operators.entropy import MEASURES, add_parts, entropies_of_parts, entropy_parts

from .common import config_of, parser, session

log = logging.getLogger("follow_entropies")

#: Columns of the samples, SQL for question, answer and log probability, buckets of the output, files of a batch at most.
SETTINGS = {
    "schema": "event_id long, user_id long, event_type string, value double",
    "question": "user_id",
    "answer": "event_type",
    "logprob": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE -value / CAST(100 AS DOUBLE) END",
    "buckets": 16,
    "files_per_batch": 1000,
}
GROUP, KEY = ("bucket", "question"), ("answer",)
PART = "question {question}, answer {answer}, step long, n long, m long, s double, z double, w double, bucket int, batch long"


def pattern(path: str) -> str:
    """A pattern that matches the path alone: Spark's file streams take folders, or patterns, which may match a file too."""
    return path if re.search(r"[*?\[{]", path) else re.sub(r"(.)/*$", r"[\1]", path)


def taken(rows: DataFrame, config: dict) -> DataFrame:
    """(bucket, question, answer, logprob) of the samples."""
    named = rows.select(F.expr(config["question"]).alias("question"), F.expr(config["answer"]).alias("answer"), F.expr(config["logprob"]).cast("double").alias("logprob"))
    return named.filter("question IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("question"), F.lit(config["buckets"])).cast("int"))


def overwrite(df: DataFrame, path: str, *names: str) -> None:
    """Writes the partitions that df has rows of, and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(path)


def uncertainty(parts: DataFrame) -> DataFrame:
    """(bucket, question, measures, num_samples, num_clusters, top_answer, top_share) from parts."""
    added = add_parts(parts, GROUP, KEY)
    sizes = added.groupBy(*GROUP, *KEY).agg(F.sum("n").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), F.col("answer").isNull().alias("none"), "answer")
    top = sizes.groupBy(*GROUP).agg(F.min(order).alias("t"), F.sum("n").alias("total"))
    top = top.select(*GROUP, F.col("t.answer").alias("top_answer"), (-F.col("t.n") / F.col("total")).alias("top_share"))
    return entropies_of_parts(added, GROUP, KEY).join(top, list(GROUP))


def refresh(parts: DataFrame, output: str) -> None:
    """Writes the buckets that parts has."""
    overwrite(uncertainty(parts).repartition("bucket"), f"{output}/uncertainty", "bucket")


def run(spark: SparkSession, samples: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes what is new, waits for the end, and returns read(); config: as in SETTINGS."""
    config = SETTINGS | (config or {})
    rows = spark.readStream.schema(config["schema"]).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(pattern(samples))

    def add(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        log.info("batch %d: read %d samples from %s", number, batch.count(), samples)
        parts = entropy_parts(taken(batch, config), "logprob", GROUP, KEY).withColumn("batch", F.lit(number).cast("long"))
        overwrite(parts.repartition("bucket"), f"{output}/parts", "bucket", "batch")
        every = read_parts(own, output, config)
        touched = [r.bucket for r in every.filter(F.col("batch") == number).select("bucket").distinct().collect()]  # `buckets` at most
        log.info("batch %d: wrote %d parts to %s/parts", number, every.filter(F.col("batch") == number).count(), output)
        if touched:
            refresh(every.filter(F.col("bucket").isin(touched)), output)
            log.info("batch %d: wrote %d questions in %d buckets to %s/uncertainty", number, read(own, output, config).filter(F.col("bucket").isin(touched)).count(), len(touched), output)

    stream = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(add).start()
    stream.awaitTermination()
    log.info("took %d batches", sum(p["numInputRows"] > 0 for p in stream.recentProgress))
    return read(spark, output, config)


def _kinds(spark: SparkSession, config: dict) -> dict[str, str]:
    return dict(taken(spark.createDataFrame([], config["schema"]), config).dtypes)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table; without rows if nothing has been written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def read_parts(spark: SparkSession, output: str, config: dict) -> DataFrame:
    return _stored(spark, f"{output}/parts", PART.format(**_kinds(spark, config)))


def read(spark: SparkSession, output: str, config: dict | None = None) -> DataFrame:
    """The uncertainty of every question as it stands; no rows before the first run that had samples."""
    kinds = _kinds(spark, SETTINGS | (config or {}))
    measures = ", ".join(f"{m} double" for m in MEASURES)
    schema = f"question {kinds['question']}, {measures}, num_samples long, num_clusters long, top_answer {kinds['answer']}, top_share double, bucket int"
    return _stored(spark, f"{output}/uncertainty", schema)


def main(arguments: list[str] | None = None) -> None:
    asked = parser(__doc__, "samples", "output", "checkpoint").parse_args(arguments)
    spark = session("follow_entropies")
    try:
        run(spark, asked.samples, asked.output, asked.checkpoint, config_of(spark, asked.config, SETTINGS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
