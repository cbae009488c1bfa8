"""Streams of events: windows, pending work, retention, idempotent delivery.

Each function takes a streaming DataFrame (or a batch one, with the same result for complete data).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ops import subscribed
from ..sources.durable import settled
from ..sources.sinks import replace_in_place

#: Folders that a table kept up by a stream is dealt to.
BUCKETS = 64
LATE = "1 day"


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark. Watermarks need a timestamp with a zone; the session's, which should be UTC, is taken."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def daily(events: DataFrame, late: str = LATE) -> DataFrame:
    """(day, kind, n) in tumbling windows of a day; rows later than ``late`` are dropped and state is freed."""
    e = _timed(events, late)
    return e.groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "kind", "n")


def once(events: DataFrame, key: str = "event_id", late: str = LATE) -> DataFrame:
    """Each event once, though it be delivered again within ``late``."""
    return _timed(events, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a longer gap."""
    e = _timed(events, late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Everything that has arrived since the last run, once, in batches; the checkpoint remembers what was done."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def incremental(stream: DataFrame, checkpoint: str, path: str) -> None:
    """New rows of a file source appended to a Parquet table, each once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def kept_up(changes: DataFrame, checkpoint: str, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A Parquet table with the latest row of each key of a stream in update mode, brought up to what has arrived.

    Each batch of changes replaces the rows of its keys, in folders by a hash of the key, of which only those with
    changes are written anew. A batch that is run again after a failure puts the same rows in, so each counts once.
    ``buckets`` must stay the same for a table.
    """
    dealt = changes.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    run_available(dealt, checkpoint, lambda batch, _: replace_in_place(settled(batch), path, ["bucket", *keys], ["bucket"]), "update")


def subscriptions(events: DataFrame) -> DataFrame:
    """As the batch form, of a stream of events that carry the same values whenever they are delivered: the state is a
    user's latest event, which an event told twice or late leaves right; no event is dropped for being late."""
    last = events.groupBy("user_id").agg(F.max_by(F.struct("kind", "plan", "ts"), F.struct("ts", "event_id")).alias("e"))
    return subscribed(last)


def used_by_day(events: DataFrame, late: str = LATE) -> DataFrame:
    """(user_id, day, used): uses of each day, an event told twice within ``late`` counted once; state goes when a day is past."""
    e = once(events, "event_id", late)
    return e.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("used")).select("user_id", F.to_date("w.start").alias("day"), "used")
