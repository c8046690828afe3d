"""Folders for tables that a job writes and reads again: below the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, removed when the driver ends. Where that is unset: a temporary folder if the master is local, else an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors share no folder")
        at = "file://" + tempfile.mkdtemp(prefix="plinth-scratch-")
        sc.setCheckpointDir(at)
    path = f"{at.rstrip('/')}/plinth/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    if path.startswith("file://"):
        shutil.rmtree(path.removeprefix("file://"), True)
        return
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone: nothing can be removed through it
        pass


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
