"""Shared pieces of the corpus operators: tables, checkpoints, running totals and range lookup."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder the cluster names in spark.checkpoint.dir; sets one of its own only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark's file systems find it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint_path(spark: SparkSession) -> str:
    """The shared folder, as a path for Spark's writers and readers."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder, so that its rows are fixed and its lineage is cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder as packed Parquet and reads it again: like `settle`, for whole texts."""
    path = f"{checkpoint_path(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(row, doc_id, text, *more), stored: each row with a number of its own. A null text counts as empty."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), *more))


def row_key(id_col: str, text: Column, *more: Column) -> list[Column]:
    """Two non-null longs that stand for (id, text, more): rows that agree in both are one document; a null id is last."""
    return [
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(2**63 - 1)).alias("k1"),
        F.xxhash64(F.col(f"`{id_col}`").isNull(), text, *[y for x in more for y in (x.isNull(), x)]).alias("k2"),
    ]


def beside(df: DataFrame, *names: str) -> list[str]:
    """Names of columns like those given that df doesn't have, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for what runs inside: whole texts pass, but fewer at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def running_total(df: DataFrame, group: Sequence[str], chunk: Column, weight: str) -> DataFrame:
    """Adds `start`: the sum of `weight` over all rows that stand before a row in its group.

    The order inside a group is by chunk, then by all columns. No group meets in one task: totals by
    (group, chunk) give each chunk its base, and only the rows of a chunk are sorted together.
    Repeated rows are counted first and unfolded last, so that they can't fill a chunk.
    `group` columns and `chunk` must not be null.
    """
    cols, keys = df.columns, [*group, "__chunk"]
    counted = df.withColumn("__chunk", chunk).groupBy(*cols, "__chunk").agg(F.count(F.lit(1)).alias("__copies"))
    amount = F.col(weight) * F.col("__copies")
    rows = Window.partitionBy(*keys).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    local = counted.withColumn("__local", F.coalesce(F.sum(amount).over(rows), F.lit(0)))
    totals = counted.groupBy(*keys).agg(F.sum(amount).alias("__sum"))
    over = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__base"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)).alias("__copy")
    return (
        local.join(bases, keys)
        .select(*cols, "__base", "__local", copies)
        .select(*cols, (F.col("__base") + F.col("__local") + F.col("__copy") * F.col(weight)).alias("start"))
    )


def locate(points: DataFrame, at: str, ranges: DataFrame, first: str, last: str, width: int) -> DataFrame:
    """Joins each point with the range [first, last) that holds it, by equality of buckets of `width`."""
    buckets = F.explode(F.sequence(F.expr(f"{first} div {width}"), F.expr(f"({last} - 1) div {width}"))).alias("__bucket")
    spread = ranges.filter(F.col(last) > F.col(first)).select("*", buckets)
    inside = (F.col(at) >= F.col(first)) & (F.col(at) < F.col(last))
    return points.withColumn("__bucket", F.expr(f"{at} div {width}")).join(spread, "__bucket").filter(inside).drop("__bucket")
