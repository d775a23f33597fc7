"""What an application does once per session: ship the package, find shared folders."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


#: Settings of this session unless it has its own: tasks hold a batch and the buffers it grew in beside a worker that holds
#: it again; Spark's default is 64 MB and 10,000 rows.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def bounded(spark: SparkSession) -> None:
    """Hand tables to Python workers in small batches."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not share the driver's path."""
    bounded(spark)
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    fd, name = tempfile.mkstemp(prefix="quire-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((ROOT / "quire").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(name)
    sc._quire_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI in this application's folder under spark.checkpoint.dir, which driver and executors share.

    Only on one machine, as in tests, a temporary folder stands in where that setting is absent.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quire-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete the tables and files that this application has put into the shared folder; frames that read them are void."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/quire-{spark.sparkContext.applicationId}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, kept when executors are lost, of known size to the planner."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that goes by shuffle and sort. The planner takes a table's bytes on disk for its size; tables of
    like packages are many times larger as rows, and one that it broadcasts is held by the driver and by every executor."""
    return df.hint("merge")
