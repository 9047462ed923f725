"""Governed turn rows from a stream of hook events.

Duplicated hook events are dropped within the watermark
(``dropDuplicatesWithinWatermark`` on ``event_id``); events are grouped by
``session_window(ts, gap)`` and invocation, with the same aggregates as the
batch operator, in append mode: a turn row is emitted once the watermark
passes the end of its window, and events later than the watermark are
dropped by Spark; :class:`LateHooks` logs their number per micro-batch.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.policy import DEFAULT_RULES, GUARDRAIL_RULES
from ..operators.governance import (_tool_event, annotate, finish_turns, tools_from_events,
                                    turn_aggregates, write_log)


def stream_turns(events: DataFrame, watermark: str = "10 minutes", gap: str = "30 minutes",
                 redaction_rules=DEFAULT_RULES, guardrail_rules=GUARDRAIL_RULES,
                 classifier=None) -> DataFrame:
    """Streaming DataFrame of final turn rows; ``events`` must have an
    event-time ``ts`` (TIMESTAMP) and ``event_id`` (a batch goes through
    :func:`governance.assemble_turns`). An event without an invocation id is a turn
    of its own (one error row each, E7)."""
    ev = annotate(events, redaction_rules, guardrail_rules, classifier)
    ev = ev.withWatermark("ts", watermark).withColumn(
        # ids are unique within an invocation only; an event without one is
        # known by its place
        "_event", F.coalesce("event_id", F.concat_ws("~", F.lit(""), "hook", "seq", "ts"))) \
        .dropDuplicatesWithinWatermark(["invocation_id", "_event"])
    tool_ev = _tool_event()
    orphan = F.when(F.col("invocation_id").isNull(),
                    F.xxhash64("session_id", "seq", "event_id", "hook", "user_id", "text"))
    agg = ev.groupBy(F.session_window("ts", gap).alias("window"), "invocation_id",
                     orphan.alias("_orphan")).agg(
        *turn_aggregates(), F.collect_list(tool_ev).alias("_tools"))
    agg = agg.withColumn("_tools", F.array_sort("_tools"))
    agg = agg.withColumn("tools_summary", tools_from_events(F.col("_tools")))
    agg = agg.withColumn("tool_errors", F.size(F.filter(
        "tools_summary", lambda x: x["status"] == "error")).cast("bigint"))
    return finish_turns(agg, keep=(F.col("window.start").alias("window_start"),
                                   F.col("window.end").alias("window_end")))


def start_turn_log(events: DataFrame, path: str, checkpoint: str, **kw):
    """S11 as a stream: governed turn rows appended as JSON log lines
    ``(severity, message, custom)`` partitioned by date, one file set per
    micro-batch; ``checkpoint`` must be the same at every start. Returns the StreamingQuery."""
    from ..operators.governance import log_rows
    turns = stream_turns(events, **kw)
    custom = F.struct("invocation_id", "agent_name", "user_id", "session_id", "request",
                      "response", "token_usage", "eval_tags", "tools_summary")
    rows = log_rows(turns.withColumn("custom", custom), keep=("window_end",))
    return (rows.withColumn("date", F.to_date("window_end")).drop("window_end")
            .writeStream.format("json").partitionBy("date").outputMode("append")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .start())


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_turns_at_end_hook(events: DataFrame, path: str, checkpoint: str,
                            watermark: str = "10 minutes", timeout_ms: int = 30 * 60 * 1000,
                            **kw):
    """R1 with the reference's timing: a turn row is written in the
    micro-batch where its end hook (``after_agent``) arrives, not when a
    watermark passes, and a pause within a turn does not split it.

    The stateful step (``transformWithState``) only holds each invocation's
    events in a list state and releases them when the end hook is seen, or by an
    event-time timer ``timeout_ms`` after its last event (those turns then take
    the error path). The turn logic stays in Spark: every micro-batch of
    released events goes through the batch :func:`assemble_turns` in
    ``foreachBatch`` and is appended to ``path`` (Parquet). Late events for
    an already closed invocation open a new list, which times out into an
    error-path row. Events without an invocation id are held by no state: each is
    an error row of its own micro-batch (E7)."""
    from ..operators.governance import EVENT_COLUMNS, assemble_turns, conform_events
    from ._state import HeldTurns

    spark = events.sparkSession
    ev = conform_events(events).withWatermark("ts", watermark)
    packed = ev.select("invocation_id", "hook", "ts",      # ts carries the watermark
                       F.to_json(F.struct(*EVENT_COLUMNS.keys())).alias("ev"))
    held = packed.where("invocation_id IS NOT NULL").groupBy("invocation_id").transformWithStateInPandas(
        HeldTurns(timeout_ms), "invocation_id string, ev string", "Append", "EventTime")
    released = held.unionByName(packed.where("invocation_id IS NULL").select("invocation_id", "ev"))
    schema = ", ".join(f"{k} {v}" for k, v in EVENT_COLUMNS.items())

    def write(batch: DataFrame, batch_id: int) -> None:
        # one directory per micro-batch, overwritten when Spark re-runs the
        # batch after a failure: the output stays exactly-once
        rows = batch.select(F.from_json("ev", schema).alias("e")).select("e.*")
        assemble_turns(rows, **kw).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)              # the query takes its settings at the start
    try:
        return (released.writeStream.foreachBatch(write)
                .option("checkpointLocation", checkpoint)
                .start())
    finally:
        spark.conf.set(key, before)


class LateHooks(StreamingQueryListener):
    """Counts the hooks that the watermark drops: per micro-batch with any, one
    log row (S11: severity, message, custom with query, batch and count) is
    appended to ``path`` as JSON, partitioned by date. ``queries`` are the names
    listened to (all, if none). Add it with ``spark.streams.addListener``."""

    MESSAGE = "Late hooks dropped"

    def __init__(self, spark, path: str, queries: tuple[str, ...] = ()):
        self.spark, self.path, self.queries = spark, path, queries
        self.total = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        if not late or self.queries and p.name not in self.queries:
            return
        self.total += late
        row = [(p.timestamp, "WARNING", self.MESSAGE,
                json.dumps({"query": p.name or str(p.id), "batch": p.batchId, "dropped": late}))]
        rows = self.spark.createDataFrame(row, "ts string, severity string, message string, custom string")
        write_log(rows.withColumn("ts", F.to_timestamp("ts")), self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
