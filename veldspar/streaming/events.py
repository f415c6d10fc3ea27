"""Streams: event windows, first arrivals, log sessions, registry refresh, a keyed file state machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..runtime import ship


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): batch or stream; on a stream windows close ``late`` after the newest event."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    g = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no gap of that length."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    g = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_arrivals(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event id once."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def log_blocks(events: DataFrame, within: str, order: list[str], closes: str) -> DataFrame:
    """(within, block, n, start, end, closed): a block ends with the event for which ``closes`` is true."""
    w = Window.partitionBy(within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = events.withColumn("block", F.coalesce(F.sum(F.expr(closes).cast("long")).over(w), F.lit(0)))
    return numbered.groupBy(within, "block").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.max(F.expr(closes)).alias("closed"))


def refresh(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``apply`` on every micro-batch: the way a registry table follows a stream of files."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_actions(snapshots: DataFrame) -> DataFrame:
    """(path, sha256, action): what each sighting of a file asks for, by the state kept for its path.

    new: first sight; unchanged: same hash and done; retry: same hash, failed, fewer than three
    times; give_up after that; changed: another hash. ``snapshots``: path, sha256, ok, ts.
    """
    ship(snapshots.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sha, ok, tries = state.get if state.exists else (None, None, 0)
        out = []
        for row in sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: r.ts):
            if sha is None:
                action, tries = "new", 0
            elif row.sha256 != sha:
                action, tries = "changed", 0
            elif ok:
                action = "unchanged"
            elif tries < 3:
                action, tries = "retry", tries + 1
            else:
                action = "give_up"
            sha, ok = row.sha256, bool(row.ok)
            out.append((key[0], sha, action))
        state.update((sha, ok, tries))
        yield pd.DataFrame(out, columns=["path", "sha256", "action"])

    return snapshots.groupBy("path").applyInPandasWithState(run, "path string, sha256 string, action string", "sha256 string, ok boolean, tries int", "append", GroupStateTimeout.NoTimeout)


def read_events(spark: SparkSession, folder: str, schema, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
