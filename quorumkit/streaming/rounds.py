"""New round files as a stream, with each question's uncertainty kept up to date."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.text import prompt_key
from ..operators.traces import final_samples
from ..session import ship
from ..sources.readers import ROUND
from ..sources.writers import write_rounds

#: The key of samples without a code.
NO_CODE = ""


def read_rounds(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Rows of round files as they appear below <folder>/<difficulty>/<model>/."""
    read = spark.readStream.schema(ROUND).option("mode", "DROPMALFORMED").option("pathGlobFilter", "round_*.json*").option("recursiveFileLookup", True)
    return (read.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else read).json(folder)


def save_rounds(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream that appends new rows (the saved columns with difficulty, model, round_id) to a folder of rounds, and
    ends with what is there. A batch that is repeated after a failure overwrites what it had written."""
    stream = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    return stream.foreachBatch(lambda batch, number: write_rounds(batch, folder, batch=number)).start()


def running_counts(rows: DataFrame) -> DataFrame:
    """Per question: samples, those that pass public tests, those that pass all (for mode complete or update)."""
    return rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if("is_passed_public").alias("public"), F.count_if("passed").alias("passed"))


class DigestCounts(StatefulProcessor):
    """Of each question: a map from code digest to count, and (samples, digests, sum of n ln n over digests)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "k string", "n long")
        self.totals = handle.getValueState("totals", "samples long, digests long, weight double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        samples, digests, weight = self.totals.get() if self.totals.exists() else (0, 0, 0.0)
        for batch in rows:
            for k, n in batch["k"].value_counts(dropna=False).items():
                k = NO_CODE if pd.isna(k) else k
                before = self.counts.getValue((k,))[0] if self.counts.containsKey((k,)) else 0
                now = before + int(n)
                self.counts.updateValue((k,), (now,))
                samples, digests = samples + int(n), digests + (before == 0)
                weight += now * log(now) - (before * log(before) if before else 0.0)
        self.totals.update((samples, digests, weight))
        entropy = log(samples) - weight / samples - 1e-10 * digests
        yield pd.DataFrame({"qid": [key[0]], "num_samples": [samples], "num_clusters": [digests], "DSE": [entropy]})

    def close(self) -> None:
        pass


def running_entropy(rows: DataFrame) -> DataFrame:
    """(qid, num_samples, num_clusters, DSE) after each batch, of clusters of equal final codes (mode update); samples
    without a code are one cluster.

    A batch reads and writes the counts of its own digests and the question's totals, however many digests the question
    has. The entropy is -sum p ln(p + 1e-10) to the first order in 1e-10, which is off by less than 1e-9 up to 1e11
    samples x digests. The session's spark.sql.streaming.stateStore.providerClass must be RocksDB's, as map states need it.
    """
    ship(rows.sparkSession)
    keyed = final_samples(rows).select(F.col("question_id").alias("qid"), prompt_key(F.col("code")).alias("k"))
    return keyed.groupBy("qid").transformWithStateInPandas(DigestCounts(), "qid string, num_samples long, num_clusters long, DSE double", "Update", "None")
