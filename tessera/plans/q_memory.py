"""Session and memory bindings over ``events`` and ``conversations``:
activity_sessions, recent_sessions, session_tail, memory_build,
memory_counts, memory_search, report_rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.embed import with_sparse_tf
from ..operators.sessions import (LIST_PREVIEW, MAX_SESSIONS, MEMORY_PREFIX, MEMORY_TOP_K,
                                  NO_HITS, SESSION_GAP_SECONDS, activity_sessions,
                                  memory_counts, memory_rows, recent_sessions, report_text,
                                  scoped_topk, session_tail)
from ..sources.tables import read_table
from . import sqlparts as S
from .registry import query

APP = "tessera"
TS_FMT_SPARK = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_FMT_SQL = "%Y-%m-%d %H:%M:%S.%f"

_SESSIONS_SQL = f"""
_e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events),
_s AS (SELECT *, sum(CASE WHEN d IS NULL OR d >= INTERVAL {SESSION_GAP_SECONDS} SECOND THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no
       FROM _e),
sessions AS (
  SELECT user_id, CAST(session_no AS BIGINT) AS session_no,
         min(ts) AS session_start, max(ts) + INTERVAL {SESSION_GAP_SECONDS} SECOND AS session_end,
         CAST(count(*) AS BIGINT) AS n_events,
         CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS n_errors,
         (array_agg(event_type ORDER BY ts DESC, event_id DESC))[1] AS last_event_type
  FROM _s GROUP BY user_id, session_no
)"""


def _sessions(spark, sf_dir):
    return activity_sessions(read_table(spark, sf_dir, "events"))


@query("activity_sessions", sql=f"""
WITH {_SESSIONS_SQL}
SELECT user_id, session_no, strftime(session_start, '{TS_FMT_SQL}') AS session_start,
       strftime(session_end, '{TS_FMT_SQL}') AS session_end, n_events, n_errors, last_event_type
FROM sessions""")
def q_activity_sessions(spark, sf_dir):
    """R3 (batch form): user activity sessions with a 30-minute gap."""
    s = _sessions(spark, sf_dir)
    return s.select("user_id", "session_no",
                    F.date_format("session_start", TS_FMT_SPARK).alias("session_start"),
                    F.date_format("session_end", TS_FMT_SPARK).alias("session_end"),
                    "n_events", "n_errors", "last_event_type")


@query("recent_sessions", sql=f"""
WITH {_SESSIONS_SQL}
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY session_end DESC, session_no) AS INTEGER) AS rank,
       session_no, strftime(session_end, '{TS_FMT_SQL}') AS session_end, n_events
FROM sessions QUALIFY rank <= {MAX_SESSIONS}""")
def q_recent_sessions(spark, sf_dir):
    """The 10 most recent activity sessions of every user."""
    r = recent_sessions(_sessions(spark, sf_dir))
    return r.select("user_id", F.col("rank").cast("int").alias("rank"), "session_no",
                    F.date_format("session_end", TS_FMT_SPARK).alias("session_end"), "n_events")


@query("session_tail", sql=f"""
SELECT conv_id, turn, coalesce(role, '') AS role, substr(text, 1, {LIST_PREVIEW}) AS preview
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
WHERE r <= 3 AND coalesce(text, '') <> ''""")
def q_session_tail(spark, sf_dir):
    """Last three events of every conversation, text-less ones dropped
    after the cut, 120-character previews."""
    c = read_table(spark, sf_dir, "conversations")
    return session_tail(c, session="conv_id", seq="turn")


_MEM_KEY = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"
_MEMORIES_SQL = f"""
memories AS (
  SELECT '{APP}' AS app_name, CAST(conv_id AS VARCHAR) AS user_id, CAST(conv_id AS VARCHAR) AS session_id,
         turn AS seq, {S.uuid5(_MEM_KEY, MEMORY_PREFIX + APP)} AS memory_id,
         replace(text, 'John Doe', '[PERSON_NAME]') AS text
  FROM conversations WHERE role = 'user' AND coalesce(text, '') <> ''
)"""


def _memories(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return memory_rows(c.select(F.col("conv_id").alias("user_id"),
                                F.col("conv_id").alias("session_id"),
                                F.col("turn").alias("seq"), "text"), APP)


@query("memory_build", sql=f"WITH {_MEMORIES_SQL} SELECT app_name, user_id, session_id, seq, memory_id, text FROM memories")
def q_memory_build(spark, sf_dir):
    """One memory per user turn of every conversation (redacted text,
    UUIDv5 id)."""
    return _memories(spark, sf_dir).select("app_name", "user_id", "session_id", "seq",
                                           "memory_id", "text")


@query("memory_counts", sql=f"""
WITH {_MEMORIES_SQL}
SELECT app_name, user_id, session_id, CAST(count(*) AS BIGINT) AS generated_memories
FROM memories GROUP BY ALL""")
def q_memory_counts(spark, sf_dir):
    """Memories generated per session."""
    return memory_counts(_memories(spark, sf_dir))


@query("memory_search", sql=f"""
WITH {_MEMORIES_SQL},
mq AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS query_id,
              '{APP}' AS app_name, CAST(conv_id AS VARCHAR) AS user_id, text
       FROM conversations WHERE role = 'assistant'),
{S.term_ctes('m', 'memories', 'memory_id', 'text')},
{S.term_ctes('q', 'mq', 'query_id', 'text')},
mu AS (SELECT memory_id, app_name, user_id, text FROM memories),
dots AS (
  SELECT qt.id AS query_id, mt.id AS memory_id, sum(qt.tf * mt.tf) AS dot
  FROM q_tf qt JOIN mq ON mq.query_id = qt.id
  JOIN mu ON mu.app_name = mq.app_name AND mu.user_id = mq.user_id
  JOIN m_tf mt ON mt.id = mu.memory_id AND mt.bucket = qt.bucket
  GROUP BY ALL
),
sc AS (
  SELECT d.query_id, d.memory_id,
         CAST(d.dot AS DOUBLE) / (sqrt(CAST(qs.ss AS DOUBLE)) * sqrt(CAST(ms.ss AS DOUBLE))) AS score
  FROM dots d JOIN q_ss qs ON qs.id = d.query_id JOIN m_ss ms ON ms.id = d.memory_id
),
top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank
  FROM sc QUALIFY rank <= {MEMORY_TOP_K}
),
agg AS (
  SELECT t.query_id, CAST(count(*) AS BIGINT) AS n_hits,
         string_agg(CAST(t.rank AS VARCHAR) || '. ' || mu.text, chr(10) ORDER BY t.rank) AS listing
  FROM top t JOIN mu USING (memory_id) GROUP BY t.query_id
)
SELECT mq.query_id, coalesce(a.n_hits, 0) AS n_hits, coalesce(a.listing, '{NO_HITS}') AS listing
FROM mq LEFT JOIN agg a USING (query_id)""")
def q_memory_search(spark, sf_dir):
    """Every assistant message used as a memory query within its own
    user's scope; top 20 memories, printed as a numbered listing or
    '(no hits)'."""
    mem = _memories(spark, sf_dir)
    c = read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    q = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
                 .alias("query_id"), F.lit(APP).alias("app_name"),
                 F.col("conv_id").cast("string").alias("user_id"), "text")
    qv = with_sparse_tf(q, "text")
    top = scoped_topk(qv, mem, MEMORY_TOP_K)
    hits = top.join(mem.select("memory_id", "text"), "memory_id")
    agg = hits.groupBy("query_id").agg(
        F.count("*").alias("n_hits"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))),
                                 lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["text"])),
                     "\n").alias("listing"))
    return (q.select("query_id").join(agg, "query_id", "left")
            .select("query_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
                    F.coalesce("listing", F.lit(NO_HITS)).alias("listing")))


@query("report_rows", sql="""
SELECT event_id,
       'Summary of your content: ' || event_type || ' event ' || CAST(event_id AS VARCHAR) ||
       '.' || chr(10) || chr(10) || 'Time of summary: ' ||
       strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') || ' WIB+0700 ' || chr(10) || chr(10) ||
       'Disclaimer: Information provided is for demonstration purposes only...' AS report
FROM events""")
def q_report_rows(spark, sf_dir):
    """A timestamped report per event, time shown in Asia/Jakarta
    (UTC+7, no daylight saving)."""
    e = read_table(spark, sf_dir, "events")
    summary = F.concat(F.col("event_type"), F.lit(" event "), F.col("event_id").cast("string"))
    return e.select("event_id", report_text(summary, F.col("ts")).alias("report"))


@query("recent_session_tails", sql=f"""
WITH {_SESSIONS_SQL},
_top AS (
  SELECT user_id, session_no,
         row_number() OVER (PARTITION BY user_id ORDER BY session_end DESC, session_no) AS session_rank
  FROM sessions QUALIFY session_rank <= {MAX_SESSIONS}
),
_ev AS (
  SELECT s.user_id, CAST(s.session_no AS BIGINT) AS session_no, s.event_id, s.ts, s.event_type, s.value,
         row_number() OVER (PARTITION BY s.user_id, s.session_no ORDER BY s.ts DESC, s.event_id DESC) AS r
  FROM _s s JOIN _top t ON t.user_id = s.user_id AND t.session_no = s.session_no
)
SELECT user_id, session_no, event_id, event_type, value FROM _ev WHERE r <= 3""")
def q_recent_session_tails(spark, sf_dir):
    """C8 shape over ``events``: each user's 10 most recent sessions
    joined with their events (J4), last three events of each (W3)."""
    from pyspark.sql import Window
    from ..operators.sessions import recent_session_events
    e = recent_session_events(read_table(spark, sf_dir, "events"))
    w = Window.partitionBy("user_id", "session_no").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    t = e.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 3)
    return t.select("user_id", "session_no", "event_id", "event_type", "value")
