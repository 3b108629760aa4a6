"""Cutting lineage by checkpoints and tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The checkpoint folder (spark.checkpoint.dir). Where none is set, a local master gets one of its own, a cluster an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rankloom-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written to the checkpoint folder."""
    _folder(df)
    return df.checkpoint()


def _path_of(df: DataFrame, path: str):
    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """The same as compressed columns, of which each reader reads those it needs; the driver's JVM deletes them when it ends."""
    path = f"{_folder(df).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, at = _path_of(df, path)
    files.deleteOnExit(at)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), when nothing reads it any more."""
    files, at = _path_of(df, df._written_at)
    files.delete(at, True)
