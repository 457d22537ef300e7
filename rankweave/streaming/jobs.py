"""Structured Streaming jobs for what the batch operators keep up to date.

Each takes a streaming (or batch) DataFrame, so the same plan serves both; tests
hold a stream's final result against the batch result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.ledger import Floored, Streak
from rankweave.operators.ordered import floored_counters
from rankweave.streaming.keyed import in_order


def rate_limit_breaches(events: DataFrame, key: str, at: str, limit: int, window: str = "1 minute", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """(key, start, n) for windows with more than ``limit`` events of a key."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    counts = rows.groupBy(F.window(at, window, slide), key).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit).select(key, F.col("window.start").alias("start"), "n")


def running_counters(edges: DataFrame, key: str, at: str, tie: str, delta: str, late: str = "1 hour") -> DataFrame:
    """(key, n): counts after signed changes in the order of (time, tie), at no step under 0.

    A batch gives each key's last count; a stream gives the count after every change
    that the watermark has passed, so that a key's last row holds.
    """
    if edges.isStreaming:
        return in_order(edges.withColumn("change", F.col(delta).cast("long")), key, at, tie, Floored(), late)
    return floored_counters(edges, key, [at, tie], delta)


def once_per_id(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """One of the events that repeat an id: in batch the first by time, and of those the least row;
    in a stream the one that comes first, if its repeats are no later than ``late``."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    row = F.struct(F.col(at).alias("__at"), F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("row"))
    return events.groupBy(F.col(key).alias("__key")).agg(F.min(row).alias("first")).select("first.row.*")


def recompute_touched(changes: DataFrame, base: Callable[[], DataFrame], key: str, aggregate: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """On each micro-batch, aggregate the base rows of the touched keys anew and hand them to ``sink``."""

    def batch(df: DataFrame, number: int) -> None:
        touched = df.select(key).distinct()
        sink(aggregate(base().join(touched, key, "left_semi")), number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_streaks(log: DataFrame, key: str, success: str, at: str, tie: str, late: str = "1 hour") -> DataFrame:
    """(key, streak): failures since the last success after every row that the watermark has passed,
    in the order of (time, tie); a key's last row holds."""
    return in_order(log.withColumn("ok", F.col(success)), key, at, tie, Streak(), late)


def daily_publish(pending: DataFrame, publish: Callable[[DataFrame], None], checkpoint: str):
    """One run over all that waits, for a scheduler to start."""
    return pending.writeStream.foreachBatch(lambda df, _: publish(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
