"""The two incremental jobs as Structured Streaming, with the batch functions as their meaning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


PROGRESS = "item string, source string, status string, ts timestamp, open boolean"


def progress_stream(updates: DataFrame, late: str = "2 hours", idle_minutes: int = 24 * 60) -> DataFrame:
    """Streaming (item, source, status, ts) -> rows (item, source, status, ts, open) for update mode: a key's latest status by (ts, status) whenever it changes.

    State is one small row for each key that is open: a key without an update for ``idle_minutes`` of event time is closed, which says
    its last status once more with ``open`` false, and forgotten. Updates later than ``late`` behind the newest are dropped. Rows
    with a null item, source or ts are left out; a key that comes back after it was closed begins anew.
    """
    rows = updates.select(F.col("item").cast("string"), F.col("source").cast("string"), "status", F.col("ts").cast("timestamp").alias("ts")).where("item is not null and source is not null and ts is not null")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(ts: int, status: str | None, open_: bool) -> pd.DataFrame:
            return pd.DataFrame({"item": [key[0]], "source": [key[1]], "status": [status], "ts": [pd.Timestamp(ts, unit="us")], "open": [open_]})

        if state.hasTimedOut:
            ts, status = state.get
            state.remove()
            yield row(ts, status, False)
            return
        known = best = tuple(state.get) if state.exists else None
        for b in batches:
            for ts, status in zip(b["ts"].astype("datetime64[us]").astype("int64"), b["status"]):
                status = status if isinstance(status, str) else None
                if best is None or (ts, status or "") > (best[0], best[1] or ""):
                    best = (int(ts), status)
        if best is None:
            return
        state.update(best)
        state.setTimeoutTimestamp(max(best[0] // 1000 + idle_minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        if best != known:
            yield row(*best, True)

    timed = rows.withWatermark("ts", late).groupBy("item", "source")
    return timed.applyInPandasWithState(step, PROGRESS, "ts long, status string", "update", GroupStateTimeout.EventTimeTimeout)


def progress_sink(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch of ``progress_stream`` to a folder of its own, which a replay of the batch overwrites."""
    put = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/batch={n}")
    return changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_table(spark: SparkSession, folder: str) -> DataFrame:
    """(item, source, status, ts, open): what the sink's folder says last of each key."""
    rows = spark.read.schema(PROGRESS).option("basePath", folder).parquet(f"{folder}/*")
    last = F.max(F.struct("ts", F.coalesce("status", F.lit("")).alias("s"), (~F.col("open")).alias("closed"), "status")).alias("l")
    return rows.groupBy("item", "source").agg(last).select("item", "source", "l.status", "l.ts", (~F.col("l.closed")).alias("open"))


def windowed_activity(updates: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Streaming counts per event-time window and source; state older than the watermark is dropped."""
    return updates.withWatermark("ts", late).groupBy(F.window("ts", width), "source").agg(F.count("*").alias("n"))


def staging_drop_stream(
    spark: SparkSession, folder: str, schema: str, finished: Callable[[], DataFrame], apply: Callable[[DataFrame, int], object], checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """New staging files -> ``apply`` on each batch, without items in ``finished()``.

    ``apply`` must change nothing when a batch is replayed under its number, as an import into versioned tables does.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)

    def batch(df: DataFrame, n: int) -> None:
        apply(df.dropDuplicates(["id"]).join(finished().select("id"), "id", "left_anti"), n)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
