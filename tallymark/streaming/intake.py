"""Chat intake as Structured Streaming: idempotency, caption join, session bursts.

Event time is ``received_at`` as a timestamp column ``ts``; every operator states its watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def idempotent(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drops repeats of (group_id, message_id) within ``delay``; rows later than that are dropped with their state."""
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["group_id", "message_id"])


def caption_join(images: DataFrame, captions: DataFrame, radius: str = "2 seconds", delay: str = "1 minute") -> DataFrame:
    """Images with the captions of their group and sender within ``radius`` either way; images without one come out once the watermark passes."""
    i = images.withWatermark("ts", delay).alias("i")
    c = captions.withWatermark("ts", delay).alias("c")
    near = F.expr(f"i.group_id = c.group_id AND i.sender = c.sender AND c.ts BETWEEN i.ts - INTERVAL {radius} AND i.ts + INTERVAL {radius}")
    gap = F.abs(F.unix_timestamp("i.ts") - F.unix_timestamp("c.ts"))
    return i.join(c, near, "leftOuter").select("i.message_id", F.col("c.message_id").alias("caption_id"), gap.alias("gap"))


def nearest(met: DataFrame) -> DataFrame:
    """Of an image's captions the nearest, ties by id: what ``caption_join`` has put out, in a batch after it."""
    best = F.min(F.struct(F.col("gap").isNull().alias("none"), "gap", "caption_id")).alias("m")
    return met.groupBy("message_id").agg(best).select("message_id", "m.caption_id", "m.gap")


def bursts(rows: DataFrame, quiet: str = "2500 milliseconds", delay: str = "1 minute") -> DataFrame:
    """(group_id, start, end, n): runs of a group's receipts with no gap of ``quiet``."""
    s = rows.withWatermark("ts", delay).groupBy(F.session_window("ts", quiet).alias("s"), "group_id").agg(F.count("*").alias("n"))
    return s.select("group_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
