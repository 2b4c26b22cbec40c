"""Streams of messages: progress folds and debounced edits; the same functions serve batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE = "seq bigint, id string, msg string, level string, total_files int, status string"


def progress_counts(messages: DataFrame) -> DataFrame:
    """Done messages so far, and the largest announced total."""
    return messages.groupBy().agg(F.sum(F.expr("case when status = 'done' then 1 else 0 end")).alias("processed"), F.max("total_files").alias("total"))


def debounce(edits: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """The last edit of each burst a user makes: bursts end with ``gap`` of silence. ``late`` sets a stream's watermark."""
    e = edits.withWatermark("ts", late) if late else edits
    out = e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    return out.drop("session_window")
