"""Batches that Python gets and gives: bounded, whatever the length of texts and the rows made of each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession

BATCH_BYTES = 16 << 20
#: Rows of a frame that a task gives back, and tasks for each core where rows take long.
ROWS, WAVES = 4096, 4


def bounded_batches(spark: SparkSession) -> None:
    """Rows may have megabytes, so Arrow batches are cut by bytes too."""
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(conf).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(conf, BATCH_BYTES)


def frames(rows: Iterable[tuple], columns: list[str], most: int = ROWS) -> Iterator[pd.DataFrame]:
    """rows as frames of at most ``most`` rows, made as they are asked for: a batch's rows are never held at once."""
    rows = iter(rows)
    while some := list(islice(rows, most)):
        yield pd.DataFrame(some, columns=columns)


def parts(spark: SparkSession) -> int:
    """As many parts as a shuffle has, or WAVES for each core if these are more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), WAVES * spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, *by: Column | str) -> DataFrame:
    """df in so many parts: rows that take long but shuffle to little aren't gathered in a few tasks."""
    return df.repartition(parts(df.sparkSession), *by)
