"""Sessions and long-term memory (T3, W3, J4, S9, S10, C8, C9, T6, A12, R3
batch form, X12).

Sessionisation without a per-user task: a user's events are cut into gap
sized time buckets. Whether an event starts a session only depends on the
previous event of the same user, which lies in its own or the previous
bucket -- a window over (user, bucket) plus one equi-join with the previous
bucket's last time. Session numbers are a prefix sum of per-bucket start
counts: the prefix runs over one summary row per active (user, bucket), so
its size grows with the user's time span, not with the number of events, and
a user holding a third of all events is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embed import DEFAULT_DIM, embed_with, with_sparse_tf
from ..functions.ids import namespace_hex, uuid5
from ..functions.policy import DEFAULT_RULES, redaction

# --- fixed values -----------------------------------------------------------
SESSION_GAP_SECONDS = 30 * 60
MAX_SESSIONS = 10                   # sessions per memory run
TAIL_EVENTS = 3                     # events shown per session
LIST_PREVIEW = 120                  # preview of a session's last events
INGEST_PREVIEW = 160                # preview when ingesting one session
MEMORY_TOP_K = 20
SCORE_ROWS = 1024                   # memories scored at once
NO_HITS = "(no hits)"
MEMORY_PREFIX = "memory://"
SESSION_TIME_KEYS = ("last_update_time", "updated_at", "updated_time", "created_at",
                     "created_time", "start_time")
REPORT_ZONE = "Asia/Jakarta"
REPORT_ZONE_LABEL = "WIB+0700"
DISCLAIMER = "Disclaimer: Information provided is for demonstration purposes only..."
REPORT_HEAD = "Summary of your content: "
REPORT_TIME = ".\n\nTime of summary: "
REPORT_TAIL = " \n\n"          # a space before the newlines, as the reference writes it
# ----------------------------------------------------------------------------


def _epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts)


def activity_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts",
                      gap_seconds: int = SESSION_GAP_SECONDS,
                      extra_aggs: tuple = ()) -> DataFrame:
    """Sessions of each user: a new session starts when the gap to the
    user's previous event is ``>= gap_seconds``. Returns (user, session_no,
    session_start, session_end = last event + gap, n_events, n_errors,
    last_event_type) -- ``session_window`` semantics, computed in parallel
    for hot users (see module doc)."""
    e = assign_sessions(events, user, ts, gap_seconds)
    return e.groupBy(user, "session_no").agg(
        F.min(ts).alias("session_start"),
        (F.max(ts) + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("session_end"),
        F.count("*").alias("n_events"),
        F.count(F.when(F.col("event_type") == "error", 1)).alias("n_errors"),
        F.max_by("event_type", F.struct("_t", "event_id")).alias("last_event_type"),
        *extra_aggs)


def assign_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts",
                    gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Every event with its user's ``session_no`` (1-based, in time order)."""
    gap_us = gap_seconds * 1_000_000
    e = events.withColumn("_t", _epoch_us(F.col(ts))).withColumn(
        "_b", F.floor(F.col("_t") / F.lit(gap_us)).cast("bigint"))
    # within a bucket: starts after its first event, and their running number
    wb = Window.partitionBy(user, "_b").orderBy("_t", "event_id")
    prev = F.lag("_t").over(wb)
    e = e.withColumn("_inner", F.coalesce(F.col("_t") - prev >= gap_us, F.lit(False)).cast("int"))
    e = e.withColumn("_nth", F.sum("_inner").over(wb.rowsBetween(Window.unboundedPreceding, 0)))
    # over the user's active buckets: does the first event start a session
    # (buckets are a gap wide, so one further back than the last is past it),
    # and how many started before
    per_b = e.groupBy(user, "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"),
                                      F.sum("_inner").alias("_n"))
    wu = Window.partitionBy(user).orderBy("_b")
    opens = F.coalesce(F.col("_first") - F.lag("_last").over(wu) >= gap_us, F.lit(True)).cast("int")
    per_b = per_b.withColumn("_opens", opens)
    upto = F.sum(F.col("_opens") + F.col("_n")).over(wu.rowsBetween(Window.unboundedPreceding, 0))
    per_b = per_b.select(user, "_b", (upto - F.col("_n")).alias("_before"))
    return (e.join(per_b, [user, "_b"])
            .withColumn("session_no", (F.col("_before") + F.col("_nth")).cast("bigint"))
            .drop("_b", "_inner", "_nth", "_before"))


def recent_session_events(events: DataFrame, n: int = MAX_SESSIONS,
                          user: str = "user_id", ts: str = "ts") -> DataFrame:
    """J4 + T3: the events of each user's ``n`` most recent sessions. The
    sessions side is bounded by n per user; the join is an equi-join on
    (user, session_no) -- one join instead of one fetch per session."""
    e = assign_sessions(events, user, ts)
    sessions = e.groupBy(user, "session_no").agg(F.max(ts).alias("_last"))
    top = recent_sessions(sessions, n, user, "_last", "session_no").select(
        user, "session_no", F.col("rank").alias("session_rank"))
    return e.join(top, [user, "session_no"])


def recent_sessions(sessions: DataFrame, n: int = MAX_SESSIONS, user: str = "user_id",
                    updated: str = "session_end", sid: str = "session_no") -> DataFrame:
    """The ``n`` most recent sessions of each user (latest activity
    first, ties by session id). A top-n per group: Spark's WindowGroupLimit
    keeps n rows per user in each partition before the shuffle."""
    w = Window.partitionBy(user).orderBy(F.col(updated).desc(), F.col(sid).asc())
    return sessions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def session_tail(events: DataFrame, session: str = "session_id", seq: str = "seq",
                 n: int = TAIL_EVENTS, preview_chars: int = LIST_PREVIEW) -> DataFrame:
    """The last ``n`` events of each session, in order, then those
    without text dropped (the filter comes after the cut), text previewed."""
    w = Window.partitionBy(session).orderBy(F.col(seq).desc())
    t = events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    t = t.where(F.coalesce(F.col("text"), F.lit("")) != "")
    return t.select(session, seq, F.coalesce("role", F.lit("")).alias("role"),
                    F.substr("text", F.lit(1), F.lit(preview_chars)).alias("preview"))


def session_time(cols: dict[str, Column | tuple[Column, Column]]) -> Column:
    """T3 timestamp of a session record: the first usable of the known keys,
    each a number (epoch seconds) or an ISO string ('Z' and the basic date form
    accepted); none -> epoch 0. A key whose type is known comes as a pair
    (number, string): digits in a string are then a date, not seconds."""
    parts = []
    for k in SESSION_TIME_KEYS:
        if k in cols:
            num, text = cols[k] if isinstance(cols[k], tuple) else (cols[k], cols[k])
            as_num = num.try_cast("double")
            iso = F.regexp_replace(text.cast("string"), "Z$", "+00:00")
            iso = F.regexp_replace(iso, "^([0-9]{4})([0-9]{2})([0-9]{2})(?=T|$)", "$1-$2-$3")
            as_iso = F.unix_micros(F.try_to_timestamp(iso)) / F.lit(1e6)
            parts.append(F.coalesce(as_num, as_iso))
    return F.coalesce(*parts, F.lit(0.0))


def memory_rows(turns: DataFrame, app_name: str, *, user: str = "user_id",
                session: str = "session_id", seq: str = "seq", text: str = "text",
                rules=DEFAULT_RULES, dim: int = DEFAULT_DIM, embedder=None) -> DataFrame:
    """One memory per user turn of the given sessions: the redacted
    text, a deterministic id (UUIDv5 of ``session:seq`` in the app's
    namespace, so re-ingesting a session replaces its memories) and its
    hashed vector, or as ``feature_vector`` that of the ``embedder``."""
    ns = namespace_hex(MEMORY_PREFIX + app_name)
    red, _ = redaction(F.col(text), rules)
    m = turns.select(
        F.lit(app_name).alias("app_name"), F.col(user).cast("string").alias("user_id"),
        F.col(session).cast("string").alias("session_id"), F.col(seq).alias("seq"),
        red.alias("text"))
    m = m.where(F.coalesce("text", F.lit("")) != "")
    m = m.withColumn("memory_id", uuid5(ns, F.concat_ws(":", "session_id",
                                                         F.col("seq").cast("string"))))
    if embedder is not None:
        return embed_with(m, "text", "feature_vector", embedder)
    return with_sparse_tf(m, "text", dim)


def ingest_memory(session_events: DataFrame, app_name: str, top: int = MAX_SESSIONS,
                  existing: DataFrame | None = None, rules=DEFAULT_RULES,
                  dim: int = DEFAULT_DIM, embedder=None) -> tuple[DataFrame, DataFrame]:
    """Move each user's ``top`` most recent sessions into long-term
    memory. ``session_events`` is (user_id, session_id, seq, role, text,
    ts). Sessions are ranked by their last event (T3), joined back to their
    events on (user, session) (J4, one join instead of one fetch per
    session), every user turn becomes a memory, and the result is merged
    into ``existing`` by ``memory_id`` (J2: re-ingesting a session replaces
    its memories). Returns (memory table, memories generated per session)."""
    from .upsert import merge
    last = session_events.groupBy("user_id", "session_id").agg(F.max("ts").alias("_last"))
    chosen = recent_sessions(last, top, "user_id", "_last", "session_id").select(
        "user_id", "session_id")
    turns = (session_events.join(chosen, ["user_id", "session_id"])
             .where(F.col("role") == "user"))
    new = memory_rows(turns, app_name, rules=rules, dim=dim, embedder=embedder)
    counts = memory_counts(new)
    if existing is not None:
        new = merge(existing.select(*new.columns), new, key="memory_id")
    return new, counts


def memory_counts(memories: DataFrame) -> DataFrame:
    """Memories created per session."""
    return memories.groupBy("app_name", "user_id", "session_id").agg(
        F.count("*").alias("generated_memories"))


def scoped_topk(queries: DataFrame, memories: DataFrame, k: int = MEMORY_TOP_K,
                scope: tuple[str, ...] = ("app_name", "user_id"), *,
                dim: int = DEFAULT_DIM, rows_per_group: int = 20_000,
                queries_per_group: int = 2_000) -> DataFrame:
    """Top-k memories per query within the query's (app, user)
    scope, by cosine of hashed counts (exact, as :func:`knn.topk_sparse`).

    No pair rows: memories and queries are cogrouped and scored with NumPy in
    blocks of ``SCORE_ROWS`` memories with a running top-k, each group emitting
    only its per-query top-k. A scope with more than
    ``rows_per_group`` memories (or ``queries_per_group`` queries) is split
    into salts on that side, the other side replicated across them; the
    per-scope salt counts are joined in as a table (never collected), and
    small scopes share a group through a hash of the scope, scored one scope
    at a time inside it."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql import types as T

    from .grid import Running
    from .knn import empty_frame

    mv = memories.select("memory_id", *scope, "buckets", "tfs", "ss")
    qv = queries.select("query_id", *scope, "buckets", "tfs", "ss")
    n_groups = int(memories.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = (mv.groupBy(*scope).agg(F.count("*").alias("_nm"))
             .join(qv.groupBy(*scope).agg(F.count("*").alias("_nq")), list(scope))
             .select(*scope,
                     F.ceil(F.col("_nm") / rows_per_group).cast("int").alias("_ms"),
                     F.ceil(F.col("_nq") / queries_per_group).cast("int").alias("_qs")))
    g = F.pmod(F.xxhash64(*scope), F.lit(n_groups)).cast("int")
    mv = (mv.join(sizes, list(scope))
          .withColumn("_g", g)
          .withColumn("_m_salt", F.pmod(F.xxhash64("memory_id"), F.col("_ms")).cast("int"))
          .withColumn("_q_salt", F.explode(F.sequence(F.lit(0), F.col("_qs") - 1)))
          .drop("_ms", "_qs"))
    qv = (qv.join(sizes, list(scope))
          .withColumn("_g", g)
          .withColumn("_q_salt", F.pmod(F.xxhash64("query_id"), F.col("_qs")).cast("int"))
          .withColumn("_m_salt", F.explode(F.sequence(F.lit(0), F.col("_ms") - 1)))
          .drop("_ms", "_qs"))
    out_schema = T.StructType([queries.schema["query_id"], memories.schema["memory_id"],
                               T.StructField("score", T.DoubleType())])
    scope_cols = list(scope)

    def dense(pdf):
        D = np.zeros((len(pdf), dim), dtype=np.float64)
        lens = pdf["buckets"].map(len).to_numpy()
        if lens.sum():
            D[np.repeat(np.arange(len(pdf)), lens),
              np.concatenate(pdf["buckets"].to_numpy()).astype(np.int64)] = \
                np.concatenate(pdf["tfs"].to_numpy()).astype(np.float64)
        return D, np.sqrt(pdf["ss"].to_numpy().astype(np.float64))

    def score_group(key, qpdf, mpdf):
        outs = []
        if len(qpdf) and len(mpdf):
            mgroups = dict(list(mpdf.groupby(scope_cols, sort=False)))
            for sk, qs in qpdf.groupby(scope_cols, sort=False):
                ms = mgroups.get(sk)
                if ms is None:
                    continue
                Q, qn = dense(qs)
                best = Running(len(qs), k, 0.0, 0.0) if len(ms) > SCORE_ROWS else None
                for lo in range(0, len(ms), SCORE_ROWS):
                    part = ms.iloc[lo:lo + SCORE_ROWS]
                    M, mn = dense(part)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        S = (M @ Q.T) / (qn[None, :] * mn[:, None])
                    S[~np.isfinite(S)] = 0.0
                    if best is not None:
                        best.offer(S, pa.array(part["memory_id"].to_numpy()), np.arange(len(qs)))
                        continue
                    B = S.shape[0]
                    least = np.partition(S, B - k, axis=0)[B - k] if B > k else np.zeros(len(qs))
                    r, c = np.nonzero((S >= least[None, :]) & (S > 0))
                    outs.append((qs["query_id"].to_numpy()[c], ms["memory_id"].to_numpy()[r], S[r, c]))
                if best is not None:
                    for b in best.rows(pa.array(qs["query_id"].to_numpy()), ["q", "m", "s"]):
                        outs.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        if not outs:
            return empty_frame(out_schema)
        # one frame from concatenated arrays (concatenating frames can leave
        # chunked Arrow-backed string columns, which the Arrow writer rejects)
        return pd.DataFrame({"query_id": np.concatenate([o[0] for o in outs]),
                             "memory_id": np.concatenate([o[1] for o in outs]),
                             "score": np.concatenate([o[2] for o in outs])})

    keys = ("_g", "_m_salt", "_q_salt")

    scored = (qv.groupBy(*keys).cogroup(mv.groupBy(*keys))
              .applyInPandas(score_group, out_schema))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("memory_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def report_text(summary: Column, ts: Column) -> Column:
    """The timestamped report; the time is an input column (never the
    wall clock inside a query), shown in Asia/Jakarta."""
    local = F.date_format(F.from_utc_timestamp(ts, REPORT_ZONE),
                          f"yyyy-MM-dd HH:mm:ss '{REPORT_ZONE_LABEL}'")
    return F.concat(F.lit(REPORT_HEAD), summary, F.lit(REPORT_TIME), local,
                    F.lit(REPORT_TAIL + DISCLAIMER))
