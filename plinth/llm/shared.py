"""What the operators share: the cluster's shared folder, bounded Arrow batches, staged tables."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="plinth-shared-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/plinth/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_dir, path)
    return path


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def drop_dir(path: str) -> None:
    fs, local = file_system(path)
    if fs.get_file_info(local).type == pafs.FileType.Directory:
        fs.delete_dir(local)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Lets go of shuffle files and broadcasts that nothing refers to any more; else they stay until the driver's garbage happens to be collected.

    The last query's events refer to its plan, so they are waited for; what its plan refers to is seen to be garbage one collection later.
    """
    gc.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def prepare(spark: SparkSession) -> None:
    """Ships this package to the executors; Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes, whatever the length of the texts."""
    ship(spark)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(conf)) <= BATCH_ROWS:
        spark.conf.set(conf, BATCH_ROWS)
    by_bytes = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(by_bytes).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(by_bytes, BATCH_BYTES)


def unused(columns: list[str], name: str) -> str:
    """name, or with marks added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, most: int = 512 << 10):
    """Consecutive pieces of a batch with about ``most`` bytes of ``column`` each; a longer text is a piece of its own."""
    import numpy as np

    col = batch.column(column)
    if not batch.num_rows:
        return
    offs = text_offsets(col)[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_offsets(col: pa.Array):
    """The bytes of a string array and its len + 1 offsets into them; null texts have no bytes."""
    import numpy as np

    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not (wide or pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col, wide = col.cast(pa.large_string()), True
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw[:0], offs - (offs[0] if len(offs) else 0)
