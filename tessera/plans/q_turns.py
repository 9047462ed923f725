"""Governed turns over a hook log with every input: tools (parallel, repeated
and unknown call ids, open calls), final events, usage, guardrail output of all
shapes, missing ends, identity fallbacks and re-delivered hooks. The log is
derived from ``conversations``, so it grows with the table; what a hook carries
follows from its conversation and turn numbers, as the oracles state by value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.policy import (ALL_RULES, BLOCKED_PROMPT, BLOCKED_RESPONSE, ERROR_PROMPT,
                                ERROR_RESPONSE)
from ..operators.governance import (ERROR_MESSAGE, FINAL_MESSAGE, USAGE_T, assemble_turns,
                                    conversation_events, tool_summary, turn_rates, verbose_rows)
from ..sources.tables import read_table
from . import sqlparts as S
from .q_governance import _category_sql, _redact_sql
from .registry import query

# Guardrail output by (conversation + turn number) mod 11, and its status.
DECISIONS = {1: ('{"decision": "UNSAFE", "reasoning": "r"}', "unsafe"), 2: ("not json", "error"),
             3: ("[]", "error"), 4: ("", "safe"), 5: ("{}", "safe"), 6: ('{"decision": ""}', "safe"),
             7: ('{"decision": "safe"}', "safe")}


def full_hooks(spark, sf_dir):
    """Hook events of every conversation turn with all fields set."""
    e = conversation_events(read_table(spark, sf_dir, "conversations"))
    conv, g = F.col("session_id").cast("long"), F.split_part("invocation_id", F.lit("-"), F.lit(-1)).cast("long")
    turn = F.floor(F.col("seq") / 10).cast("long")
    x = conv + g
    is_end, is_model, is_start = (F.col("hook") == h for h in ("after_agent", "after_model", "before_agent"))
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")

    def usage(a, b, c):
        return F.struct(*[v.cast("long").alias(f.name) for f, v in zip(USAGE_T.fields, (a, b, c))])

    decision = F.lit(None).cast("string")
    for k, (text, _) in DECISIONS.items():
        decision = F.when(x % 11 == k, F.lit(text)).otherwise(decision)
    part = F.struct(F.lit("").alias("text"))
    final = F.struct(F.concat(F.lit("Final "), F.col("invocation_id")).alias("text"))
    e = e.withColumns({
        "agent_name": F.concat(F.lit("agent"), (conv % 2).cast("string")),
        "user_id": F.when(g % 2 == 1, F.concat(F.lit("own"), (conv % 3).cast("string")))
        .when(g % 4 == 0, F.lit("")),
        "context_user_id": F.concat(F.lit("u"), (conv % 7).cast("string")),
        "decision_json": F.when(F.col("hook") == "before_model", decision),
        "is_final": F.when(is_end, x % 3 != 0),
        "parts": F.when(is_end, F.when(x % 4 == 1, F.array(part, final)).when(x % 4 == 2, F.array(part))),
        "usage": F.when(is_end & (x % 2 == 0), usage(100 + g, F.lit(10), 110 + g))
        .when(is_model & (x % 5 != 0), usage(size, turn, F.when(turn % 2 == 1, size + turn)))})
    e = e.where(~(is_end & (x % 13 == 12)))

    def tool(step, hook, name, call, status=None, when=None):
        s = F.struct(F.lit(hook).alias("hook"), (F.col("seq") + step).alias("seq"),
                     name.alias("tool_name"), call.cast("string").alias("call_id"),
                     F.lit(None).cast("string").alias("tool_status") if status is None
                     else status.alias("tool_status"))
        return s if when is None else F.when(when, s)

    search, k1 = F.lit("search"), F.lit("k1")
    fetch = F.when(x % 7 != 1, F.lit("fetch"))
    second = F.when(x % 3 == 0, F.lit("k1")).otherwise(F.lit("k2"))
    bad = F.when(conv % 2 == 0, F.lit("error")).otherwise(F.lit("fine"))
    tools = F.array(
        tool(3, "before_tool", search, k1), tool(4, "before_tool", fetch, second),
        tool(5, "after_tool", search, k1, bad), tool(6, "before_tool", F.lit("open"), F.lit(None)),
        tool(7, "after_tool", F.lit("open"), F.lit("k9"), F.lit("ok"), x % 5 == 1),
        tool(8, "after_tool", search, k1, F.lit("ok"), x % 4 == 2))
    drop = ["hook", "seq", "tool_name", "call_id", "tool_status"]
    t = e.where(is_start & (x % 2 == 1)).withColumn("t", F.explode(F.filter(tools, lambda s: s.isNotNull())))
    t = t.drop(*drop, "event_id").select("*", "t.*").drop("t").withColumn(
        "event_id", F.concat_ws(":", "invocation_id", F.col("seq").cast("string")))
    log = e.unionByName(t)
    # re-delivery: every hook whose place is 1 mod 4 comes twice
    return log.withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(F.col("seq") % 4 == 1, 2).otherwise(1)))) \
        .drop("_n")


_STATUS = "CASE x % 11 " + " ".join(f"WHEN {k} THEN '{v[1]}'" for k, v in DECISIONS.items())
_ROWS = f"""
_c AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
                 OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS g
       FROM conversations),
_g AS (SELECT *, conv_id + g AS x, coalesce(length(text), 0) AS n FROM _c WHERE g > 0),
_t AS (
  SELECT conv_id, g, x, min(turn) AS first_turn, max(turn) AS last_turn,
         any_value(text) FILTER (WHERE role = 'user') AS utext,
         arg_max(text, turn) FILTER (WHERE role = 'assistant' AND coalesce(text, '') <> '') AS last_text,
         max(turn) FILTER (WHERE role = 'assistant') AS model_turn,
         coalesce(arg_max(n, turn) FILTER (WHERE role = 'assistant'), 0) AS model_n
  FROM _g GROUP BY ALL),
_r AS (SELECT *, {_redact_sql('utext')} AS red, coalesce(utext, '') <> '' AS checked,
              CASE WHEN x % 13 <> 12 AND x % 3 <> 0 AND x % 4 = 1
                   THEN 'Final ' || conv_id || '-' || g ELSE '' END AS end_text FROM _t),
_s AS (SELECT *, CASE WHEN checked THEN {_STATUS} ELSE
                 CASE WHEN {_category_sql('red')} IS NOT NULL THEN 'unsafe' ELSE 'safe' END END END AS status FROM _r),
_u AS (SELECT *, end_text = '' AND coalesce(status IN ('unsafe', 'error'), false) AS cut,
              x % 13 <> 12 AND x % 3 <> 0 AND x % 2 = 0 AS has_usage, x % 5 <> 0 AS model_usage,
              CASE WHEN x % 4 = 2 OR conv_id % 2 = 1 THEN 'ok' ELSE 'error' END AS k1 FROM _s),
_tools AS (SELECT *, CASE WHEN x % 2 = 1 THEN
    ['search:' || CASE WHEN x % 3 = 0 THEN 'requested' ELSE k1 END,
     CASE WHEN x % 7 = 1 THEN '' ELSE 'fetch' END || ':' || CASE WHEN x % 3 = 0 THEN k1 ELSE 'requested' END,
     'open:' || CASE WHEN x % 5 = 1 THEN 'ok' ELSE 'requested' END] ELSE [] END AS calls FROM _u),
turns AS (
  SELECT conv_id || '-' || g AS invocation_id, 'agent' || (conv_id % 2) AS agent_name,
         CASE WHEN g % 2 = 1 THEN 'own' || (conv_id % 3) ELSE 'u' || (conv_id % 7) END AS user_id,
         CAST(conv_id AS VARCHAR) AS session_id,
         CASE WHEN x % 13 = 12 THEN '{ERROR_MESSAGE}' ELSE '{FINAL_MESSAGE}' END AS message,
         CASE WHEN x % 13 = 12 THEN 'WARNING' ELSE 'INFO' END AS severity,
         CASE WHEN x % 13 = 12 THEN 'turn has no end event' END AS error,
         CASE WHEN NOT checked THEN '' WHEN status = 'unsafe' THEN {S.sql_str(BLOCKED_PROMPT)}
              WHEN status = 'error' THEN {S.sql_str(ERROR_PROMPT)} ELSE red END AS request,
         CASE WHEN cut AND status = 'unsafe' THEN {S.sql_str(BLOCKED_RESPONSE)}
              WHEN cut THEN {S.sql_str(ERROR_RESPONSE)}
              WHEN end_text <> '' THEN end_text ELSE coalesce(last_text, '') END AS response,
         CASE WHEN cut THEN 0 WHEN has_usage THEN 100 + g WHEN model_turn IS NULL THEN NULL
              WHEN model_usage THEN model_n ELSE 0 END AS prompt_tokens,
         CASE WHEN cut THEN 0 WHEN has_usage THEN 10 WHEN model_turn IS NULL THEN NULL
              WHEN model_usage THEN model_turn ELSE 0 END AS response_tokens,
         CASE WHEN cut THEN 0 WHEN has_usage THEN 110 + g WHEN model_turn IS NULL THEN NULL
              WHEN model_usage AND model_turn % 2 = 1 THEN model_n + model_turn ELSE 0 END AS total_tokens,
         coalesce(status = 'unsafe', false) AS guardrail_blocked,
         checked AND red <> utext AS pii_redacted, len(calls) AS tool_calls,
         array_to_string(calls, ',') AS tools,
         len(list_filter(calls, lambda c: ends_with(c, ':error'))) AS tool_errors,
         conv_id, g, x, first_turn, calls, status, checked
  FROM _tools)"""


def _turns(spark, sf_dir):
    return assemble_turns(full_hooks(spark, sf_dir), redaction_rules=ALL_RULES)


def _joined(c):
    return F.array_join(F.transform(c, lambda t: F.concat(t["name"], F.lit(":"), t["status"])), ",")


@query("governed_turns", sql=f"""
WITH {_ROWS}
SELECT invocation_id, agent_name, user_id, session_id, message, severity, error, request, response,
       CAST(prompt_tokens AS BIGINT) AS prompt_tokens, CAST(response_tokens AS BIGINT) AS response_tokens,
       CAST(total_tokens AS BIGINT) AS total_tokens, guardrail_blocked, pii_redacted,
       CAST(tool_calls AS BIGINT) AS tool_retry, tools, CAST(tool_errors AS BIGINT) AS tool_errors
FROM turns""")
def q_governed_turns(spark, sf_dir):
    """C7 with all its inputs: final text and usage by priority (E3, E4, E5,
    F10, A10), guardrail output parsed (X15, E1, E2), error row of a turn that
    never ended (E7), identity fallbacks (X16), tools (A7, W4, W5)."""
    return _turns(spark, sf_dir).select(
        "invocation_id", "agent_name", "user_id", "session_id", "message", "severity", "error",
        "request", "response", "token_usage.*", "eval_tags.*",
        _joined("tools_summary").alias("tools"), "tool_errors").drop("guardrail_error")


@query("turn_tools", sql=f"""
WITH {_ROWS},
_calls AS (SELECT invocation_id, first_turn, unnest(calls) AS c, generate_subscripts(calls, 1) AS no FROM turns)
SELECT invocation_id, CAST(first_turn * 10 + [3, 4, 6][no] AS BIGINT) AS call_seq,
       split_part(c, ':', 1) AS name, split_part(c, ':', 2) AS status, CAST(no AS BIGINT) AS call_no
FROM _calls""")
def q_turn_tools(spark, sf_dir):
    """W4/W5/A7 in row form over parallel, repeated, unknown and open calls
    and re-delivered hooks; ``governed_turns`` has the array form of the same."""
    t = tool_summary(full_hooks(spark, sf_dir), rows=True)
    return t.select("invocation_id", "call_seq", "name", "status",
                    F.col("call_no").cast("long").alias("call_no"))


@query("turn_rates", sql=f"""
WITH {_ROWS}
SELECT agent_name, user_id, CAST(count(*) AS BIGINT) AS turns,
       count(*) FILTER (WHERE guardrail_blocked) / count(*)::DOUBLE AS block_rate,
       count(*) FILTER (WHERE pii_redacted) / count(*)::DOUBLE AS redaction_rate,
       CASE WHEN sum(tool_calls) > 0 THEN sum(tool_errors)::DOUBLE / sum(tool_calls)::DOUBLE END AS tool_error_rate,
       CAST(sum(total_tokens) AS BIGINT) AS tokens
FROM turns GROUP BY ROLLUP (agent_name, user_id)""")
def q_turn_rates(spark, sf_dir):
    """Block, redaction and tool error rates and tokens per agent and
    user, with subtotals."""
    return turn_rates(_turns(spark, sf_dir), "agent_name", "user_id")


@query("verbose_hooks", sql=f"""
WITH {_ROWS},
_hooks AS (
  SELECT invocation_id, first_turn * 10 AS seq, 'Agent turn started' AS message, 'INFO' AS severity,
         NULL AS tool_name, 0 AS tools FROM turns
  UNION ALL
  SELECT invocation_id, first_turn * 10 + 1, 'PII redacted', 'INFO', NULL, 0 FROM turns WHERE checked
  UNION ALL
  SELECT invocation_id, first_turn * 10 + 1,
         CASE WHEN status = 'unsafe' THEN 'Policy violation detected' ELSE 'Model request' END,
         CASE WHEN status = 'unsafe' THEN 'WARNING' ELSE 'INFO' END, NULL, 0 FROM turns
  UNION ALL
  SELECT invocation_id, _g.turn * 10 + 2, 'Model response', 'INFO', NULL, tool_calls
  FROM turns JOIN _g USING (conv_id, g) WHERE role = 'assistant'
  UNION ALL
  SELECT invocation_id, first_turn * 10 + step, CASE WHEN step IN (3, 4, 6) THEN 'Tool request' ELSE 'Tool response' END,
         'INFO', CASE WHEN step IN (3, 5, 8) THEN 'search' WHEN step = 4 THEN CASE WHEN turns.x % 7 <> 1 THEN 'fetch' END
                 ELSE 'open' END, CASE step WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 3 END
  FROM turns, (SELECT unnest([3, 4, 5, 6, 7, 8]) AS step)
  WHERE turns.x % 2 = 1 AND (step <> 7 OR turns.x % 5 = 1) AND (step <> 8 OR turns.x % 4 = 2))
SELECT invocation_id, CAST(seq AS BIGINT) AS seq, message, severity, tool_name,
       CAST(tools AS BIGINT) AS tool_retry
FROM _hooks""")
def q_verbose_hooks(spark, sf_dir):
    """One log row per hook of the verbose log, the redaction row before
    each model request, running tool counter (W5)."""
    rows = verbose_rows(full_hooks(spark, sf_dir).dropDuplicates(["event_id"]), ALL_RULES, pii_rows=True)
    return rows.select("invocation_id", "seq", "message", "severity", "tool_name",
                       F.col("tool_retry").cast("long").alias("tool_retry"))
