"""The batch operators on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_sessions(stream: DataFrame, gap: str, late: str, key: str, ts: str = "ts") -> DataFrame:
    """(key, started_at, ended_at, n): sessions closed by a gap, out once the watermark has passed."""
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    out = timed.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.min("_at").alias("started_at"), F.max("_at").alias("ended_at"), F.count(F.lit(1)).alias("n"))
    return out.select(key, "started_at", "ended_at", "n")


def deduplicated(stream: DataFrame, late: str, key: str = "sha256", ts: str = "ts") -> DataFrame:
    """The first item of each content within the watermark."""
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_at")


def index_incrementally(source: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Runs step on each batch of new files until none is left; the checkpoint lets a later call go on where this one ended."""
    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()
