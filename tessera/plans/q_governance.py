"""Governance bindings: redaction, guardrail, governed turn rows, tool
summaries, log rows and turn metrics over ``conversations``, ``documents``,
``labels`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.policy import (ALL_RULES, BLOCKED_PROMPT, BLOCKED_RESPONSE, GUARDRAIL_RULES,
                                guardrail_decision, redaction, sql_pattern)
from ..operators.governance import (FINAL_MESSAGE, assemble_turns, conversation_events,
                                    log_rows, tool_summary, turn_pairs)
from ..sources.tables import read_table, read_text_table
from . import sqlparts as S
from .registry import query


def _redact_sql(expr: str) -> str:
    out = expr
    for pat, tag in ALL_RULES:
        out = f"regexp_replace({out}, {S.sql_str(sql_pattern(pat))}, {S.sql_str(tag)}, 'g')"
    return f"CASE WHEN coalesce({expr}, '') = '' THEN {expr} ELSE {out} END"


def _category_sql(expr: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(coalesce({expr}, ''), {S.sql_str(pat)}) THEN '{cat}'"
                     for cat, pat in GUARDRAIL_RULES)
    return f"(CASE {whens} END)"


@query("redact_pii", sql=f"""
SELECT conv_id, turn, {_redact_sql('text')} AS redacted,
       coalesce({_redact_sql('text')} <> text, false) AS pii_redacted
FROM conversations WHERE role = 'user'""")
def q_redact_pii(spark, sf_dir):
    """Redaction of every user message (default rule + e-mail, IPv4 and long
    digit-run rules) (X13)."""
    c = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    red, changed = redaction(F.col("text"), ALL_RULES)
    return c.select("conv_id", "turn", red.alias("redacted"), changed.alias("pii_redacted"))


@query("redact_documents", sql=f"""
SELECT doc_id, {_redact_sql('text')} AS redacted,
       coalesce({_redact_sql('text')} <> text, false) AS pii_redacted
FROM documents""")
def q_redact_documents(spark, sf_dir):
    d = read_text_table(spark, sf_dir, "documents")
    red, changed = redaction(F.col("text"), ALL_RULES)
    return d.select("doc_id", red.alias("redacted"), changed.alias("pii_redacted"))


@query("guardrail", sql=f"""
WITH r AS (SELECT doc_id, {_redact_sql('text')} AS red FROM documents)
SELECT doc_id, CASE WHEN {_category_sql('red')} IS NULL THEN 'safe' ELSE 'unsafe' END AS decision,
       {_category_sql('red')} AS reasoning
FROM r""")
def q_guardrail(spark, sf_dir):
    """Rule guardrail on the redacted text of every document."""
    d = read_text_table(spark, sf_dir, "documents")
    red, _ = redaction(F.col("text"), ALL_RULES)
    dec = guardrail_decision(red, GUARDRAIL_RULES)
    return d.select("doc_id", dec["decision"].alias("decision"), dec["reasoning"].alias("reasoning"))


@query("guardrail_eval", sql=f"""
WITH r AS (SELECT doc_id, {_redact_sql('text')} AS red FROM documents),
p AS (SELECT r.doc_id, {_category_sql('r.red')} IS NOT NULL AS flagged, l.toxic = 1 AS toxic
      FROM r JOIN labels l USING (doc_id))
SELECT CAST(count(*) FILTER (WHERE flagged AND toxic) AS BIGINT) AS tp,
       CAST(count(*) FILTER (WHERE flagged AND NOT toxic) AS BIGINT) AS fp,
       CAST(count(*) FILTER (WHERE NOT flagged AND toxic) AS BIGINT) AS fn,
       CAST(count(*) FILTER (WHERE NOT flagged AND NOT toxic) AS BIGINT) AS tn
FROM p""")
def q_guardrail_eval(spark, sf_dir):
    """Confusion counts of the rule guardrail against the ``toxic`` labels."""
    d = read_text_table(spark, sf_dir, "documents")
    red, _ = redaction(F.col("text"), ALL_RULES)
    flagged = guardrail_decision(red, GUARDRAIL_RULES)["decision"] == "unsafe"
    p = d.select("doc_id", flagged.alias("flagged")).join(
        read_table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic")),
        "doc_id")

    def cnt(c):
        return F.count(F.when(c, 1)).cast("bigint")
    return p.agg(cnt(F.col("flagged") & F.col("toxic")).alias("tp"),
                 cnt(F.col("flagged") & ~F.col("toxic")).alias("fp"),
                 cnt(~F.col("flagged") & F.col("toxic")).alias("fn"),
                 cnt(~F.col("flagged") & ~F.col("toxic")).alias("tn"))


_GROUPS_SQL = """
_c AS (
  SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
           OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g
  FROM conversations
),
_t AS (
  SELECT conv_id, CAST(g AS BIGINT) AS g,
         min_by(text, turn) FILTER (WHERE role = 'user') AS utext,
         max_by(text, turn) FILTER (WHERE role = 'assistant' AND coalesce(text, '') <> '') AS last_text,
         count(*) FILTER (WHERE role = 'assistant') AS n_model
  FROM _c WHERE g > 0 GROUP BY conv_id, g
)"""


@query("turn_pairs", sql=f"""
WITH {_GROUPS_SQL}
SELECT conv_id, g AS turn_no, utext AS request, coalesce(last_text, '') AS response,
       CAST(n_model AS BIGINT) AS n_responses
FROM _t""")
def q_turn_pairs(spark, sf_dir):
    """Request/response pairs of every conversation turn."""
    return turn_pairs(read_table(spark, sf_dir, "conversations"))


_TURN_ROWS_SQL = f"""
WITH {_GROUPS_SQL},
_r AS (SELECT *, {_redact_sql('utext')} AS red FROM _t),
_d AS (SELECT *, CASE WHEN coalesce(utext, '') = '' THEN NULL
                      WHEN {_category_sql('red')} IS NOT NULL THEN 'unsafe' ELSE 'safe' END AS status
       FROM _r),
turns AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(g AS VARCHAR) AS invocation_id,
         CAST(conv_id AS VARCHAR) AS session_id,
         CASE WHEN coalesce(utext, '') = '' THEN ''
              WHEN status = 'unsafe' THEN {S.sql_str(BLOCKED_PROMPT)} ELSE red END AS request,
         CASE WHEN status = 'unsafe' THEN {S.sql_str(BLOCKED_RESPONSE)} ELSE coalesce(last_text, '') END AS response,
         coalesce(status = 'unsafe', false) AS guardrail_blocked,
         coalesce(utext <> '' AND red <> utext, false) AS pii_redacted,
         CAST(0 AS BIGINT) AS tool_retry,
         CASE WHEN status = 'unsafe' OR n_model > 0 THEN CAST(0 AS BIGINT) END AS prompt_tokens,
         CASE WHEN status = 'unsafe' OR n_model > 0 THEN CAST(0 AS BIGINT) END AS response_tokens,
         CASE WHEN status = 'unsafe' OR n_model > 0 THEN CAST(0 AS BIGINT) END AS total_tokens,
         '{FINAL_MESSAGE}' AS message, 'INFO' AS severity
  FROM _d
)"""


def _turn_rows(spark, sf_dir):
    ev = conversation_events(read_table(spark, sf_dir, "conversations"))
    t = assemble_turns(ev, redaction_rules=ALL_RULES)
    return t.select(
        "invocation_id", "session_id", "request", "response",
        F.col("eval_tags.guardrail_blocked").alias("guardrail_blocked"),
        F.col("eval_tags.pii_redacted").alias("pii_redacted"),
        F.col("eval_tags.tool_retry").alias("tool_retry"),
        F.col("token_usage.prompt_tokens").alias("prompt_tokens"),
        F.col("token_usage.response_tokens").alias("response_tokens"),
        F.col("token_usage.total_tokens").alias("total_tokens"),
        "message", "severity")


@query("turn_rows", sql=_TURN_ROWS_SQL + " SELECT * FROM turns")
def q_turn_rows(spark, sf_dir):
    """Governed final row of every conversation turn (C7 over hook events
    derived from the conversation log: redaction, guardrail, intercept,
    final-text and usage priority)."""
    return _turn_rows(spark, sf_dir)


@query("turn_metrics", sql=_TURN_ROWS_SQL + """
SELECT session_id, CAST(count(*) AS BIGINT) AS turns,
       CAST(count(*) FILTER (WHERE guardrail_blocked) AS BIGINT) AS blocked,
       CAST(count(*) FILTER (WHERE pii_redacted) AS BIGINT) AS redacted,
       CAST(count(*) FILTER (WHERE guardrail_blocked) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS block_rate,
       CAST(sum(total_tokens) AS BIGINT) AS tokens
FROM turns GROUP BY ROLLUP (session_id)""")
def q_turn_metrics(spark, sf_dir):
    """Per-session and overall (rollup) turn counts, blocks, redactions,
    block rate and tokens."""
    t = _turn_rows(spark, sf_dir)
    return t.rollup("session_id").agg(
        F.count("*").alias("turns"),
        F.count(F.when(F.col("guardrail_blocked"), 1)).cast("bigint").alias("blocked"),
        F.count(F.when(F.col("pii_redacted"), 1)).cast("bigint").alias("redacted"),
        (F.count(F.when(F.col("guardrail_blocked"), 1)).cast("double")
         / F.count("*").cast("double")).alias("block_rate"),
        F.sum("total_tokens").cast("bigint").alias("tokens"))


def event_hooks(spark, sf_dir):
    """``events`` as a tool-hook log: an invocation is one user-day, each
    event a tool call (name = event type) answered at once, with status
    error for ``error`` events."""
    e = read_table(spark, sf_dir, "events")
    inv = F.concat(F.col("user_id").cast("string"), F.lit(":"),
                   F.date_format("ts", "yyyy-MM-dd"))
    answer = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    hooks = F.array(
        F.struct(F.lit("before_tool").alias("hook"), (F.col("event_id") * 2).alias("seq"),
                 F.lit(None).cast("string").alias("tool_status")),
        F.struct(F.lit("after_tool").alias("hook"), (F.col("event_id") * 2 + 1).alias("seq"),
                 answer.alias("tool_status")))
    return e.select(inv.alias("invocation_id"), F.col("event_type").alias("tool_name"),
                    F.explode(hooks).alias("h")).select("invocation_id", "tool_name", "h.*")


@query("tool_summary", sql="""
SELECT CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS invocation_id,
       string_agg(event_type || ':' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END,
                  ',' ORDER BY event_id) AS tools,
       CAST(count(*) AS BIGINT) AS tool_calls,
       CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS tool_errors
FROM events GROUP BY ALL""")
def q_tool_summary(spark, sf_dir):
    """A7/W4/W5 over the event log seen as tool hooks."""
    ts = tool_summary(event_hooks(spark, sf_dir))
    return ts.select("invocation_id",
                     F.array_join(F.transform("tools_summary", lambda x: F.concat(
                         x["name"], F.lit(":"), x["status"])), ",").alias("tools"),
                     "tool_calls", "tool_errors")


@query("log_rows", sql="""
SELECT event_id,
       CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity,
       'Tool response' AS message, coalesce(props, '{}') AS custom
FROM events""")
def q_log_rows(spark, sf_dir):
    """Each event as a structured log row; the raw severity is the
    lower-case event level ('error', 'notice' or 'info'), normalised."""
    e = read_table(spark, sf_dir, "events")
    raw = (F.when(F.col("event_type") == "error", "error")
           .when(F.col("event_type") == "purchase", "notice").otherwise("info"))
    rows = e.select("event_id", raw.alias("severity"), F.lit("Tool response").alias("message"),
                    F.col("props").alias("custom"))
    return log_rows(rows, keep=("event_id",))


@query("tool_calls", sql="""
SELECT CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS invocation_id,
       event_id * 2 AS call_seq, event_type AS name,
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
       CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS BIGINT) AS call_no
FROM events""")
def q_tool_calls(spark, sf_dir):
    """A7/W4/W5 in row form: every tool call of the event log with its
    resolved status and running call number within its invocation."""
    t = tool_summary(event_hooks(spark, sf_dir), rows=True)
    return t.select("invocation_id", "call_seq", "name", "status",
                    F.col("call_no").cast("bigint").alias("call_no"))
