"""Session helpers: tables, checkpoints and settings that hold at any size."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors that the cluster names in spark.checkpoint.dir.

    Where the setting is absent (tests, local mode) a temporary folder is set instead.
    """
    context = spark.sparkContext
    now = context.getCheckpointDir()
    if now:
        return now
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the executors")
        named = tempfile.mkdtemp(prefix="docmill-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir() or named


def materialize(df: DataFrame) -> DataFrame:
    """Run df once and cut its lineage; the rows survive the loss of an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Run df once into a compressed table in the shared folder: (the table, what deletes it).

    For what is read several times and only in part: a scan reads the columns it needs.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid4().hex}"
    df.write.parquet(path)

    def release() -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return spark.read.schema(df.schema).parquet(path), release


def tidy(spark: SparkSession) -> None:
    """Let go of what finished steps left: their plans on the driver, and their shuffle files, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
