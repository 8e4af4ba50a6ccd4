"""Where the library keeps what it writes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir, which all executors share; in local mode, where that is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/vecloom-{uuid.uuid4().hex}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="vecloom-")


def mounted(path: str) -> str:
    """The path of a file: URI as the file system has it, for readers and writers of single files."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} isn't on a mounted file system")
    return path


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: nothing is computed twice, and a lost executor loses nothing."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
