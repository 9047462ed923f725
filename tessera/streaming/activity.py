"""User activity sessions from an event stream.

``session_window(ts, 30 minutes)`` per user with a watermark, append mode:
a session is emitted when the watermark passes its end, so the still-open
last session of a user is held back until later events close it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sessions import SESSION_GAP_SECONDS


def stream_sessions(events: DataFrame, watermark: str = "1 hour",
                    gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    e = events.withWatermark("ts", watermark)
    w = F.session_window("ts", f"{gap_seconds} seconds")
    return (e.groupBy("user_id", w.alias("session"))
            .agg(F.count("*").alias("n_events"),
                 F.count(F.when(F.col("event_type") == "error", 1)).alias("n_errors"),
                 F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event_type"))
            .select("user_id", F.col("session.start").alias("session_start"),
                    F.col("session.end").alias("session_end"), "n_events", "n_errors",
                    "last_event_type"))
