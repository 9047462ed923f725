import os

from pyspark.sql import functions as F

from tessera.operators.governance import EVENT_COLUMNS, assemble_turns
from tessera.operators.sessions import activity_sessions
from tessera.sources.mapping import load_mapping
from tessera.streaming.activity import stream_sessions
from tessera.streaming.ingest import start_ingest_stream
from tessera.streaming.turns import stream_turns

from conftest import SF001
from test_governance import SCHEMA, ev, fixture_events


def _run_to_memory(df, name, scratch):
    q = (df.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", f"{scratch}/ck-{name}").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def test_stream_turns_equal_batch(spark, scratch):
    rows = [r for r in fixture_events() if r["invocation_id"] != "t5"]
    rows.append(ev("flush", 1, "before_model", "later", minute=600))   # advances the watermark
    batch_df = spark.createDataFrame(rows, SCHEMA)
    path = f"{scratch}/events"
    batch_df.write.parquet(path)
    stream = spark.readStream.schema(batch_df.schema).parquet(path)
    _run_to_memory(stream_turns(stream), "turns_out", scratch)
    got = {r.invocation_id: r for r in spark.table("turns_out").collect()}
    want = {r.invocation_id: r for r in assemble_turns(batch_df).collect()}
    assert "flush" not in got                        # its window is still open
    assert set(got) == set(want) - {"flush"}
    for k in got:
        for c in ("request", "response", "token_usage", "eval_tags", "tools_summary"):
            assert got[k][c] == want[k][c], (k, c)


def test_stream_sessions_equal_batch_closed(spark, scratch):
    e = spark.read.parquet(f"{SF001}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"{scratch}/ev"
    e.write.parquet(path)
    s = spark.readStream.schema(e.schema).parquet(path)
    _run_to_memory(stream_sessions(s), "sess_out", scratch)
    got = {(r.user_id, r.session_start, r.n_events) for r in spark.table("sess_out").collect()}
    wm = e.agg(F.max("ts")).first()[0]
    import datetime as dt
    closed = [r for r in activity_sessions(e).collect() if r.session_end <= wm - dt.timedelta(hours=1)]
    want = {(r.user_id, r.session_start, r.n_events) for r in closed}
    assert want <= got and len(got) - len(want) <= e.select("user_id").distinct().count()


def test_ingest_stream(spark, scratch):
    root = f"{scratch}/corpus"
    os.makedirs(f"{root}/a")
    open(f"{root}/a/one.txt", "w").write("alpha " * 400)
    open(f"{root}/a/skip.md", "w").write("ignored")
    store, ck = f"{scratch}/map", f"{scratch}/ck"
    start_ingest_stream(spark, root, "gs://c/", store, checkpoint=ck).awaitTermination()
    first = load_mapping(spark, store).count()
    open(f"{root}/a/TWO.TXT", "w").write("beta " * 10)
    start_ingest_stream(spark, root, "gs://c/", store, checkpoint=ck).awaitTermination()
    m = load_mapping(spark, store)
    assert first == 3 and m.count() == 4
    assert m.where(F.col("source").endswith("TWO.TXT")).count() == 1


def test_stream_turns_drops_late_events(spark, scratch):
    import datetime as dt
    on_time = [ev("a", 1, "before_model", "hi", minute=0), ev("a", 2, "after_model", "hello", minute=0),
               ev("a", 3, "after_agent", minute=0), ev("z", 1, "before_model", "later", minute=120)]
    late = [ev("a", 4, "after_model", "LATE TEXT", minute=0)]
    path = f"{scratch}/ev"
    spark.createDataFrame(on_time, SCHEMA).coalesce(1).write.parquet(f"{path}/1")
    schema = spark.createDataFrame(on_time, SCHEMA).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    q = (stream_turns(s).writeStream.format("memory").queryName("late_out").outputMode("append")
         .option("checkpointLocation", f"{scratch}/ck").start())
    q.processAllAvailable()
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.parquet(f"{path}/2")
    q.processAllAvailable()
    dropped = sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress
                  for op in p.get("stateOperators", []))
    q.stop()
    rows = {r.invocation_id: r for r in spark.table("late_out").collect()}
    assert rows["a"].response == "hello" and dropped >= 1


def test_turn_log_stream(spark, scratch):
    import json
    from tessera.streaming.turns import start_turn_log
    rows = [r for r in fixture_events() if r["invocation_id"] in ("t1", "t2")]
    rows.append(ev("flush", 1, "before_model", "later", minute=600))
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{scratch}/ev")
    q = start_turn_log(spark.readStream.schema(df.schema).parquet(f"{scratch}/ev"),
                       f"{scratch}/log", checkpoint=f"{scratch}/ck")
    q.processAllAvailable()
    q.stop()
    out = spark.read.json(f"{scratch}/log").collect()
    got = {json.loads(r.custom)["invocation_id"]: r for r in out}
    assert set(got) == {"t1", "t2"} and all(r.message == "Final agent turn" for r in out)
    assert json.loads(got["t2"].custom)["request"] == "[BLOCKED_BY_GUARDRAIL]"


def test_turns_emitted_at_end_hook(spark, scratch):
    from tessera.streaming.turns import start_turns_at_end_hook
    rows = [r for r in fixture_events() if r["invocation_id"] in ("t1", "t2", "t6", "t7")]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{scratch}/ev")
    q = start_turns_at_end_hook(spark.readStream.schema(df.schema).parquet(f"{scratch}/ev"),
                                f"{scratch}/out", checkpoint=f"{scratch}/ck")
    q.processAllAvailable()
    q.stop()
    got = {r.invocation_id: r for r in spark.read.parquet(f"{scratch}/out").collect()}
    want = {r.invocation_id: r for r in assemble_turns(df).collect()}
    assert set(got) == {"t1", "t2", "t6", "t7"}          # emitted without any watermark wait
    for k in got:
        for c in ("request", "response", "token_usage", "eval_tags", "tools_summary", "message"):
            assert got[k][c] == want[k][c], (k, c)


def test_ingest_stream_partitioned(spark, scratch):
    from tessera.sources.mapping import load_partitioned
    root = f"{scratch}/corpus"
    os.makedirs(root)
    open(f"{root}/one.txt", "w").write("alpha " * 400)
    store, ck = f"{scratch}/pmap", f"{scratch}/ck"
    start_ingest_stream(spark, root, "gs://c/", store, checkpoint=ck, partitioned=True).awaitTermination()
    open(f"{root}/two.txt", "w").write("beta " * 10)
    start_ingest_stream(spark, root, "gs://c/", store, checkpoint=ck, partitioned=True).awaitTermination()
    assert load_partitioned(spark, store).count() == 4


def test_pause_timer_and_events_without_invocation(spark, scratch):
    """Over several micro-batches: a turn with a pause of two hours is one row,
    a turn without an end is an error row by the timer, and events without an
    invocation id are one error row each; all equal to the batch."""
    import time

    from tessera.operators.governance import ERROR_MESSAGE
    from tessera.streaming.turns import start_turns_at_end_hook
    batches = [
        [ev("p", 1, "before_model", "begin", minute=0), ev("p", 2, "after_model", "part one", minute=1),
         ev("n", 1, "before_model", "never ends", minute=0),
         *[dict(ev(None, k, "before_model", f"orphan {k}", minute=0), event_id=None) for k in range(3)]],
        [ev("p", 3, "after_model", "part two", minute=100), ev("p", 4, "after_agent", minute=101)],
        [ev("o", 1, "before_model", "later", minute=900), ev("o", 2, "after_agent", minute=900)],
        [ev("o2", 1, "before_model", "later", minute=901), ev("o2", 2, "after_agent", minute=901)]]
    schema = spark.createDataFrame(batches[0], SCHEMA).schema
    q = start_turns_at_end_hook(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/ev/*"),
        f"{scratch}/out", f"{scratch}/ck", timeout_ms=200 * 60 * 1000)
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{scratch}/ev/{i}")
            q.processAllAvailable()
        end = time.time() + 30
        while True:
            got = spark.read.parquet(f"{scratch}/out").collect()
            if len(got) == 7 or time.time() > end:
                break
            q.processAllAvailable()
    finally:
        q.stop()
    every = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    cols = ["invocation_id", "message", "error", "request", "response", "severity"]
    want = sorted((tuple(r[c] for c in cols) for r in assemble_turns(every).collect()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == want
    errors = [r for r in got if r.message == ERROR_MESSAGE]
    assert sorted(str(r.invocation_id) for r in errors) == ["None", "None", "None", "n"]
    assert next(r for r in got if r.invocation_id == "p").response == "part two"


def test_windowed_stream_gives_each_orphan_a_row(spark, scratch):
    rows = [dict(ev(None, k, "before_model", f"orphan {k}"), event_id=None) for k in range(4)]
    rows.append(ev("flush", 1, "before_model", "later", minute=900))
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{scratch}/ev")
    _run_to_memory(stream_turns(spark.readStream.schema(df.schema).parquet(f"{scratch}/ev")), "orphan_out", scratch)
    got = spark.table("orphan_out").where("invocation_id IS NULL").collect()
    assert len(got) == 4 and {r.error for r in got} == {"missing invocation_id"}


def test_late_hooks_are_logged(spark, scratch):
    import json
    import time

    from tessera.streaming.turns import LateHooks
    on_time = [ev("a", 1, "before_model", "hi", minute=0), ev("a", 3, "after_agent", minute=0),
               ev("z", 1, "before_model", "later", minute=120)]
    late = [ev("a", 4, "after_model", "LATE", minute=0), ev("a", 5, "after_model", "LATER", minute=0)]
    schema = spark.createDataFrame(on_time, SCHEMA).schema
    listener = LateHooks(spark, f"{scratch}/log", ("late_log",))
    spark.streams.addListener(listener)
    try:
        spark.createDataFrame(on_time, SCHEMA).coalesce(1).write.parquet(f"{scratch}/ev/1")
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/ev/*")
        q = (stream_turns(s).writeStream.format("memory").queryName("late_log").outputMode("append")
             .option("checkpointLocation", f"{scratch}/ck").start())
        q.processAllAvailable()
        spark.createDataFrame(late, SCHEMA).coalesce(1).write.parquet(f"{scratch}/ev/2")
        q.processAllAvailable()
        end = time.time() + 30
        while not listener.total and time.time() < end:
            time.sleep(0.2)
        time.sleep(2)
        q.stop()
    finally:
        spark.streams.removeListener(listener)
    rows = spark.read.json(f"{scratch}/log").collect()
    assert {(r.severity, r.message) for r in rows} == {("WARNING", "Late hooks dropped")}
    counts = [json.loads(r.custom) for r in rows]
    assert sum(c["dropped"] for c in counts) == listener.total == 2 and counts[0]["query"] == "late_log"
