"""The manifest as a stream: the last successful entry of each url, kept as state across micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.readers import MANIFEST

ENTRY = "url string, fetched_at string, path string, status int, bytes long, n long"
NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def _keep(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of the state and all new rows the entry fetched last, ties to the larger path; n: how many successes were seen. Rows out of order change nothing but n."""
    best = state.get if state.exists else None
    n = best[-1] if best else 0
    before = best[:-1] if best else None
    last = before
    for pdf in rows:
        for r in pdf[NAMES[1:-1]].itertuples(index=False):
            n += 1
            now = tuple(None if pd.isna(x) else x for x in r)
            if last is None or (now[0] or "", now[1] or "") > (last[0] or "", last[1] or ""):
                last = now
    state.update((*last, n))
    if last != before:
        yield pd.DataFrame([(key[0], *last, n)], columns=NAMES)


def latest_entries(lines: DataFrame) -> DataFrame:
    """A stream of lines (value: JSON of MANIFEST) -> ENTRY of each url whose last successful entry changed, for the update mode. Broken lines, failures and lines without a url are skipped."""
    rows = lines.select(F.from_json("value", MANIFEST).alias("r")).where("r.ok and r.url is not null").select("r.url", "r.fetched_at", "r.path", F.col("r.status").cast("int").alias("status"), "r.bytes")
    state = ENTRY.replace("url string, ", "")
    return rows.groupBy("url").applyInPandasWithState(_keep, ENTRY, state, "update", GroupStateTimeout.NoTimeout)


def keep_manifest(spark: SparkSession, source: str, sink: str, checkpoint: str, max_files: int = 100) -> StreamingQuery:
    """Follows JSON-lines files below source; what changed in a batch is the partition batch=<number> of the table at sink, which a repeated batch overwrites."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(source)

    def put(df: DataFrame, k: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/batch={k}")

    return latest_entries(lines).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, sink: str) -> DataFrame:
    """The manifest as it stands: of each url what its last batch says."""
    rows = spark.read.parquet(sink)
    return rows.groupBy("url").agg(F.max_by(F.struct(*NAMES[1:]), "batch").alias("r")).select("url", "r.*")
