"""What the library needs of a Spark session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoints(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; one of its own only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir().rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: its rows are fixed, its lineage is cut, and its size is known,
    which a checkpoint in a loop of joins only multiplies."""
    path = f"{checkpoints(df.sparkSession)}/kept-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once for each application, so that they can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_quorumkit_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="quorumkit-")) / "quorumkit.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path("quorumkit") / path.relative_to(root))
    sc.addPyFile(str(target))
    sc._quorumkit_shipped = True
