"""Folders that all executors share, for what a query writes down on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a temporary folder only where none is named (local tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        _delete_at_end(spark, sc.getCheckpointDir())


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the folder deleted when the driver's JVM ends."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, deleted when the driver ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _delete_at_end(spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet below the checkpoint folder and read again: a cut of the lineage in few bytes, of which
    later plans read the columns they need."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
