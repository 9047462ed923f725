"""Cases found by review: page text, ranking ties, turns, stores, streams."""

import html as H
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions.html import page_text
from tessera.operators.governance import ERROR_MESSAGE, EVENT_COLUMNS, assemble_turns
from tessera.operators.knn import topk_dense
from tessera.sources import mapping
from tessera.streaming.turns import stream_turns

from test_governance import ev

SCHEMA = ", ".join(f"{k} {v}" for k, v in EVENT_COLUMNS.items())


def _text(spark, pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    return [r[0] for r in df.orderBy("i").select(page_text(F.col("html"))).collect()]


def test_page_text_of_long_tag_runs_and_hard_markup(spark):
    got = _text(spark, [
        "<table>" + "<tr><td></td>" * 50_000 + "</table>end", "a" + "<b>" * 100_000 + "z",
        "x<nav>one<nav>two</nav>three</nav>y", "x<p title=\"p > q\" data-x='a>b'>y</p>",
        "x<script>var a = '<p>';", "x<!-- <nav> --><footer>f</footer>y<form>f<form>g</form></form>",
        "<script>s = '<!--'</script>kept", "<a href=\"open>t</a>", None, "", "1 < 2 & 3 > 2"])
    assert got == ["end", "a\nz", "x\ny", "x\ny", "x", "x\ny", "kept", "t", "", "", "1 < 2 & 3 > 2"]


def test_character_references_equal_the_parser(spark):
    texts = ["&eacute;&#8217;&rsquo;&#x27;&#X1F642;", "&amp;lt; &lt;b&gt; &ampx &copy 2024 &copyright;",
             "&notin; &notit; &not; &nosuch; &;& &#; &#x; &#0; &#x110000; &#xD800;", "&#128;&#150;",
             "a&b=c&amp;d", "&AMP;&Aacute&zwnj;x", "&#00000065;", "&NotEqualTilde;"]
    assert _text(spark, texts) == [H.unescape(t) for t in texts]


def test_dense_ranking_keeps_negative_scores_and_rounded_ties(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(1, [0.2, 0.0]), (2, [-0.5, 0.0]), (3, [-0.6, 0.0])],
                              "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk_dense(q, c, 3).orderBy("rank").collect()]
    assert got == [(1, 0.2), (2, -0.5), (3, -0.6)]
    near = spark.createDataFrame([(10, [0.1234564, 0.0]), (1, [0.1234556, 0.0])],
                                 "vec_id long, embedding array<double>")
    for parts in (1, 2):
        assert [r["vec_id"] for r in topk_dense(q, near.repartition(parts), 1).collect()] == [1]


def test_each_event_without_invocation_is_an_error_row(spark):
    rows = [ev(None, 1, "before_model", f"text {k}", sess=f"s{k}", eid=f"e{k}") for k in range(5)]
    got = assemble_turns(spark.createDataFrame(rows + rows[:1], SCHEMA)).collect()
    assert sorted(r.session_id for r in got) == [f"s{k}" for k in range(5)]
    assert {r.message for r in got} == {ERROR_MESSAGE}


def test_many_tool_calls_in_one_turn(spark):
    rows, n = [ev("t", 0, "before_agent")], 2000
    for k in range(n):
        rows.append(ev("t", 2 * k + 1, "before_tool", tool=f"tool{k}", call=f"c{k}"))
        if k % 10:
            rows.append(ev("t", 2 * k + 2, "after_tool", call=f"c{k}",
                           status="error" if k % 7 == 0 else "ERROR"))
    rows.append(ev("t", 2 * n + 1, "after_agent"))
    t0 = time.time()
    row = assemble_turns(spark.createDataFrame(rows, SCHEMA)).collect()[0]
    assert time.time() - t0 < 60
    want = ["requested" if k % 10 == 0 else "error" if k % 7 == 0 else "ok" for k in range(n)]
    assert [x["status"] for x in row.tools_summary] == want     # statuses compare exactly


def test_stream_keeps_events_without_and_with_reused_ids(spark, scratch):
    rows = []
    for inv in ("a", "b"):
        for k, hook in enumerate(("before_model", "after_model", "after_agent")):
            e = ev(inv, k, hook, f"{inv} {hook}", minute=6 * k)      # a pause within the turn
            e["event_id"] = None if inv == "a" else f"{k}"
            rows.append(e)
    other = [dict(e, invocation_id="c") for e in rows if e["invocation_id"] == "b"]
    batch = spark.createDataFrame(rows + other + [ev("flush", 1, "before_model", minute=900)], SCHEMA)
    batch.write.parquet(f"{scratch}/ev")
    q = (stream_turns(spark.readStream.schema(batch.schema).parquet(f"{scratch}/ev"))
         .writeStream.format("memory").queryName("ids_out").outputMode("append")
         .option("checkpointLocation", f"{scratch}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    want = {r.invocation_id: r.request for r in assemble_turns(batch).collect()}
    got = [(r.invocation_id, r.request) for r in spark.table("ids_out").collect()]
    assert sorted(got) == sorted((k, want[k]) for k in ("a", "b", "c"))


def test_stores_survive_crashes_and_repeats(spark, scratch):
    import os
    one = spark.createDataFrame([("c1", "s", 0, "x")], mapping.MAPPING_SCHEMA)
    base = f"{scratch}/map"
    mapping.save_mapping(one, base)
    os.makedirs(f"{base}/v000002")                      # a write that died
    assert mapping.save_mapping(one, base).endswith("v000003")
    points = spark.createDataFrame([("p1", 1), ("p2", 1)], "datapoint_id string, v int")
    for v in (points, points.withColumn("v", F.lit(2)).where("datapoint_id = 'p1'"), points.limit(0)):
        mapping.save_datapoints(v, f"{scratch}/points")
    got = spark.read.parquet(f"{scratch}/points").collect()
    assert sorted((r[0], r[1]) for r in got) == [("p1", 2), ("p2", 1)]
    mapping.upsert_partitioned(one, f"{scratch}/parts", n_parts=16)
    with pytest.raises(ValueError):
        mapping.upsert_partitioned(one, f"{scratch}/parts")


def test_session_times_keep_their_json_type(spark):
    from tessera.operators.sessions import SESSION_TIME_KEYS
    from tessera.sources.sessions import normalize_sessions
    key = SESSION_TIME_KEYS[0]
    items = [('"20240101"', 1704067200.0), ("1700000000", 1.7e9), ("1700000000.5", 1700000000.5),
             ('"2024-01-01T00:00:00Z"', 1704067200.0), ("null", 0.0), ('"no time"', 0.0)]
    payload = "[" + ",".join(f'{{"id": "s{i}", "{key}": {v}}}' for i, (v, _) in enumerate(items)) + "]"
    got = {r["session_id"]: r["updated_epoch"] for r in normalize_sessions(
        spark.createDataFrame([(payload,)], "payload string")).collect()}
    assert got == {f"s{i}": t for i, (_, t) in enumerate(items)}


def test_running_topk_keeps_ties_over_many_batches():
    import numpy as np
    import pandas as pd
    from tessera.operators.knn import _running_topk
    rng = np.random.default_rng(0)
    frames = [pd.DataFrame({"q": rng.integers(0, 5, 20_000), "c": rng.integers(0, 10 ** 9, 20_000),
                            "s": rng.integers(-400, 400, 20_000) / 1000}) for _ in range(12)]
    got = pd.concat(_running_topk(iter(frames), "q", "s", 3))
    both = pd.concat(frames)
    for q, rows in both.groupby("q"):
        kth = rows["s"].nlargest(3).min()
        want = sorted(rows.loc[rows["s"] >= kth, "c"])
        assert sorted(got.loc[got["q"] == q, "c"]) == want
    assert list(_running_topk(iter([]), "q", "s", 3)) == []


def test_a_time_zone_set_at_run_time_is_kept(spark):
    from tessera.session import ensure_defaults
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Jakarta")
    try:
        ensure_defaults(spark)
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Jakarta"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
