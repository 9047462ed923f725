"""Governed turn log.

Input: a hook-event table, one row per lifecycle callback::

    invocation_id, session_id, user_id, agent_name, event_id, seq, ts,
    hook         before_agent | before_model | after_model | before_tool
                 | after_tool | after_agent
    text         before_model: user text sent to the model;
                 after_model: first part text of the model response
    is_final, parts ARRAY<STRUCT<text>>, usage   after_agent: final event
    tool_name, call_id, tool_status              tool hooks
    decision_json                                guardrail model output
    usage STRUCT<prompt_token_count, candidates_token_count, total_token_count>

Output: one row per invocation with the request (sanitised), the response,
token usage, eval tags and the tool summary -- the "Final agent turn" row.

Plan: one grouped aggregate by ``invocation_id`` (all flags and last-values
are partial-aggregatable: bool_or, max_by, count), plus a window over the tool
events of each invocation to attach each response to its call. State is keyed
by invocation, so nothing leaks from one turn into the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embed import _let
from pyspark.sql import types as T

from .prefix import running_last, running_sum
from ..functions.policy import (BLOCKED_PROMPT, BLOCKED_RESPONSE, DEFAULT_RULES, ERROR,
                                ERROR_PROMPT, ERROR_RESPONSE, GUARDRAIL_RULES, UNSAFE,
                                guardrail_decision, normalize_severity, parse_decision,
                                redaction)

# --- fixed values -----------------------------------------------------------
FINAL_MESSAGE = "Final agent turn"
ERROR_MESSAGE = "Final agent turn (error path)"
HOOK_MESSAGES = (
    ("before_agent", "Agent turn started"),
    ("before_model", "Model request"),
    ("after_model", "Model response"),
    ("before_tool", "Tool request"),
    ("after_tool", "Tool response"),
)
POLICY_MESSAGE = "Policy violation detected"
REDACTION_MESSAGE = "PII redacted"
UNKNOWN_STATUS = "unknown"
REQUESTED = "requested"
# ----------------------------------------------------------------------------

USAGE_T = T.StructType([
    T.StructField("prompt_token_count", T.LongType()),
    T.StructField("candidates_token_count", T.LongType()),
    T.StructField("total_token_count", T.LongType()),
])
EVENT_COLUMNS = {
    "invocation_id": "string", "session_id": "string", "user_id": "string",
    "agent_name": "string", "event_id": "string", "seq": "bigint", "ts": "timestamp",
    "hook": "string", "text": "string", "is_final": "boolean",
    "parts": "array<struct<text:string>>", "tool_name": "string", "call_id": "string",
    "tool_status": "string", "decision_json": "string",
    "usage": USAGE_T.simpleString(),
}


# Where an identity field may also come from the invocation context
IDENTITY_FALLBACKS = (
    ("user_id", ("user_id", "context_user_id")),
    ("session_id", ("session_id", "context_session_id", "context_session_session_id")),
)


def identity(events: DataFrame) -> DataFrame:
    """user = own, else the invocation context's; session = own, else
    the context session's ``id``, else its ``session_id`` (empty counts as
    missing)."""
    out = events
    for target, alts in IDENTITY_FALLBACKS:
        present = [a for a in alts if a in events.columns]
        if len(present) > 1:
            out = out.withColumn(target, F.coalesce(*[F.nullif(F.col(a).cast("string"), F.lit(""))
                                                      for a in present]))
    return out


def conform_events(events: DataFrame) -> DataFrame:
    """Resolve identity fallbacks, then add any missing event column as null
    of its type."""
    events = identity(events)
    cols = []
    for c, t in EVENT_COLUMNS.items():
        cols.append(F.col(c).cast(t).alias(c) if c in events.columns
                    else F.lit(None).cast(t).alias(c))
    return events.select(*cols)


def _zero_usage():
    return F.struct(F.lit(0).cast("bigint").alias("prompt_token_count"),
                    F.lit(0).cast("bigint").alias("candidates_token_count"),
                    F.lit(0).cast("bigint").alias("total_token_count"))


def _model_usage(u):
    """after_model usage: a missing field (or missing usage) counts as 0."""
    return F.struct(*[F.coalesce(u[f], F.lit(0)).cast("bigint").alias(f)
                      for f in ("prompt_token_count", "candidates_token_count",
                                "total_token_count")])


def annotate(events: DataFrame, redaction_rules=DEFAULT_RULES,
             guardrail_rules=GUARDRAIL_RULES, classifier=None) -> DataFrame:
    """Per-event governance values: redaction, guardrail status, the
    sanitised prompt and intercept each before_model event produces."""
    ev = conform_events(events)
    is_req = F.col("hook") == "before_model"
    raw = F.coalesce(F.col("text"), F.lit(""))
    red, changed = redaction(raw, redaction_rules)
    ev = ev.withColumn("_raw", F.when(is_req, raw))
    ev = ev.withColumn("_redacted", F.when(is_req, red))
    ev = ev.withColumn("_pii", is_req & (raw != "") & changed)
    rule = guardrail_decision(F.col("_redacted"), guardrail_rules, classifier)
    status = F.when(F.col("decision_json").isNotNull(), parse_decision(F.col("decision_json"))) \
        .otherwise(F.lower(rule["decision"]))
    checked = is_req & (raw != "")
    ev = ev.withColumn("_status", F.when(checked, status))
    ev = ev.withColumn("_sanitized", F.when(
        checked, F.when(F.col("_status") == UNSAFE, F.lit(BLOCKED_PROMPT))
        .when(F.col("_status") == ERROR, F.lit(ERROR_PROMPT))
        .otherwise(F.col("_redacted"))))
    ev = ev.withColumn("_intercept", F.when(
        checked & F.col("_status").isin(UNSAFE, ERROR),
        F.struct(F.when(F.col("_status") == UNSAFE, F.lit(BLOCKED_RESPONSE))
                 .otherwise(F.lit(ERROR_RESPONSE)).alias("final_text"),
                 _zero_usage().alias("usage"))))
    return ev


def tool_summary(events: DataFrame, rows: bool = False) -> DataFrame:
    """(invocation_id, tools_summary ARRAY<STRUCT<name,status>>, tool_calls,
    tool_errors). Each tool response marks one call recorded before it: the
    latest with its ``call_id``, else (no id, or an id no earlier call has) the
    latest of all, the reference's rule. The latest response for a call wins; a
    call without response stays ``requested``; a response before any call is
    dropped. A re-delivered hook (same ``event_id`` within the invocation)
    counts once, at its first position.

    ``rows=True`` returns one row per call instead (invocation_id, call_seq,
    name, status, call_no = running call counter, W5): the form for
    invocations too large for one array. Both forms and the per-turn form
    (:func:`tools_from_events`) follow this rule."""
    has_id, has_event = "call_id" in events.columns, "event_id" in events.columns
    ev = conform_events(events).where(F.col("hook").isin("before_tool", "after_tool"))
    if has_event:
        known = ev.where("event_id IS NOT NULL")
        first = known.groupBy("invocation_id", "event_id").agg(
            F.min_by(F.struct(*[c for c in ev.columns if c not in ("invocation_id", "event_id")]),
                     F.struct("seq", "hook")).alias("_e"))
        ev = first.select("invocation_id", "event_id", "_e.*").unionByName(ev.where("event_id IS NULL"))
    call_seq = F.when(F.col("hook") == "before_tool", F.col("seq"))
    ev = running_last(ev, ["invocation_id"], "seq", call_seq, "_last_call")
    same_id = F.lit(None).cast("bigint")
    if has_id:
        # the rows of one id; rows without an id stand alone
        own = F.when(F.col("call_id").isNull(), F.col("seq"))
        same_id = F.when(F.col("call_id").isNotNull(), F.last(call_seq, ignorenulls=True).over(
            Window.partitionBy("invocation_id", "call_id", own).orderBy("seq")))
    # calls and their responses meet by the call's place: one grouping, no join
    is_call = F.col("hook") == "before_tool"
    ev = ev.withColumn("_target", F.when(is_call, F.col("seq")).otherwise(F.coalesce(same_id, "_last_call")))
    recs = ev.where("_target IS NOT NULL").groupBy("invocation_id", F.col("_target").alias("call_seq")).agg(
        F.max(F.when(is_call, F.coalesce("tool_name", F.lit("")))).alias("name"),
        F.max_by(F.when(F.col("tool_status") == "error", "error").otherwise("ok"),
                 F.when(~is_call, F.col("seq"))).alias("status"))
    recs = recs.withColumn("status", F.coalesce("status", F.lit(REQUESTED)))
    if rows:
        return running_sum(recs, ["invocation_id"], "call_seq", F.lit(1), "call_no")
    return recs.groupBy("invocation_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("call_seq", "name", "status"))),
                    lambda x: F.struct(x["name"].alias("name"),
                                       F.coalesce(x["status"], F.lit(UNKNOWN_STATUS)).alias("status")))
        .alias("tools_summary"),
        F.count("*").alias("tool_calls"),
        F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).cast("bigint").alias("tool_errors"))


def turn_aggregates() -> list:
    """The per-invocation aggregates of the turn row (all partial-
    aggregatable, also valid in a streaming aggregation)."""
    seq = F.col("seq")
    hook = F.col("hook")
    is_end = hook == "after_agent"
    final_part = F.get(F.filter("parts", lambda p: p["text"].isNotNull() & (p["text"] != "")), 0)["text"]
    return [
        F.max("agent_name").alias("agent_name"),
        F.max("user_id").alias("user_id"),
        F.max("session_id").alias("session_id"),
        F.max_by("_sanitized", F.when(F.col("_sanitized").isNotNull(), seq)).alias("_sanitized"),
        F.min_by("_raw", F.when(F.coalesce("_raw", F.lit("")) != "", seq)).alias("_user_text"),
        F.bool_or(F.coalesce(F.col("_status") == UNSAFE, F.lit(False))).alias("guardrail_blocked"),
        F.bool_or(F.coalesce(F.col("_status") == ERROR, F.lit(False))).alias("guardrail_error"),
        F.bool_or(F.coalesce("_pii", F.lit(False))).alias("pii_redacted"),
        F.max_by("_intercept", F.when(F.col("_intercept").isNotNull(), seq)).alias("_intercept"),
        F.max_by("text", F.when((hook == "after_model") & (F.coalesce("text", F.lit("")) != ""), seq))
        .alias("_last_text"),
        F.max_by(_model_usage(F.col("usage")), F.when(hook == "after_model", seq)).alias("_last_usage"),
        F.max_by(F.struct(F.when(F.coalesce("is_final", F.lit(False)), F.coalesce(final_part, F.lit("")))
                          .otherwise(F.lit("")).alias("text"),
                          F.when(F.coalesce("is_final", F.lit(False)), F.col("usage")).alias("usage")),
                 F.when(is_end, seq)).alias("_end"),
        F.count(F.when(is_end, 1)).alias("_n_end"),
        F.count(F.when(hook == "before_tool", 1)).alias("_n_tools"),
    ]


def finish_turns(t: DataFrame, require_end: bool = True, keep: tuple = ()) -> DataFrame:
    """Resolve the aggregated state into the final row."""
    end_text = F.coalesce(F.col("_end.text"), F.lit(""))
    use_intercept = (end_text == "") & F.col("_intercept").isNotNull()
    text1 = F.when(use_intercept, F.col("_intercept.final_text")).otherwise(end_text)
    response = F.when(F.coalesce(text1, F.lit("")) != "", text1) \
        .otherwise(F.coalesce(F.col("_last_text"), F.lit("")))
    usage1 = F.when(use_intercept, F.col("_intercept.usage")).otherwise(F.col("_end.usage"))
    usage = F.coalesce(usage1, F.col("_last_usage"))
    request = F.coalesce(F.nullif(F.col("_sanitized"), F.lit("")),
                         F.nullif(F.col("_user_text"), F.lit("")), F.lit(""))
    ok = F.col("invocation_id").isNotNull() & ((F.col("_n_end") > 0) | F.lit(not require_end))
    return t.select(
        *keep, "invocation_id", "agent_name", "user_id", "session_id",
        F.when(ok, F.lit(FINAL_MESSAGE)).otherwise(F.lit(ERROR_MESSAGE)).alias("message"),
        F.when(ok, F.lit("INFO")).otherwise(F.lit("WARNING")).alias("severity"),
        F.when(~ok, F.when(F.col("invocation_id").isNull(), F.lit("missing invocation_id"))
               .otherwise(F.lit("turn has no end event"))).alias("error"),
        request.alias("request"),
        response.alias("response"),
        F.struct(usage["prompt_token_count"].alias("prompt_tokens"),
                 usage["candidates_token_count"].alias("response_tokens"),
                 usage["total_token_count"].alias("total_tokens")).alias("token_usage"),
        F.struct(F.col("guardrail_blocked"), F.col("pii_redacted"),
                 F.col("_n_tools").cast("bigint").alias("tool_retry")).alias("eval_tags"),
        F.coalesce("tools_summary", F.array().cast("array<struct<name:string,status:string>>"))
        .alias("tools_summary"),
        F.col("_n_tools").cast("bigint").alias("tool_calls"),
        F.coalesce("tool_errors", F.lit(0).cast("bigint")).alias("tool_errors"),
        "guardrail_error")


def tools_from_events(arr) -> tuple:
    """Tool summary from one turn's tool events as an array of
    STRUCT<seq, hook, name, call_id, status> sorted by seq -- the same rule
    as :func:`tool_summary`, evaluated per turn (used by the stream, where
    the turn's events are aggregated anyway). Returns (summary, errors)."""
    # every intermediate array is bound once; inlined, it would be built again
    # for each element of the next
    return _let(first_deliveries(arr), _tools_of)


def first_deliveries(arr):
    """The events of the sorted array ``arr`` without re-deliveries: of equal
    (non-null) event ids the first."""
    return _let(F.transform(arr, lambda e: e["event_id"]), lambda ids: F.filter(
        arr, lambda e, i: e["event_id"].isNull() | (F.array_position(ids, e["event_id"]) == i + 1)))


def _tools_of(arr):
    return _let(F.filter(arr, lambda e: e["hook"] == "before_tool"), lambda calls: _let(
        F.filter(arr, lambda e: e["hook"] == "after_tool"),
        lambda resps: _resolved_calls(calls, resps)))


def _resolved_calls(calls, resps):
    def target(r):
        prior = F.filter(calls, lambda c: c["seq"] < r["seq"])
        same = F.filter(prior, lambda c: c["call_id"].isNotNull() & (c["call_id"] == r["call_id"]))
        return F.coalesce(F.get(same, F.size(same) - 1)["seq"],
                          F.get(prior, F.size(prior) - 1)["seq"])

    resolved = F.transform(resps, lambda r: F.struct(target(r).alias("t"), r["seq"].alias("s"),
                                                     r["status"].alias("status")))

    def summary(resolved):
        # the latest response of each call wins
        last = F.map_from_entries(F.transform(
            F.array_distinct(F.transform(resolved, lambda x: x["t"])),
            lambda t: F.struct(t, F.element_at(F.filter(resolved, lambda x: x["t"] == t), -1)["status"])))
        return _let(last, lambda m: F.transform(calls, lambda c: F.struct(
            F.coalesce(c["name"], F.lit("")).alias("name"),
            F.coalesce(F.try_element_at(m, c["seq"]), F.lit(REQUESTED)).alias("status"))))

    return _let(F.filter(resolved, lambda x: x["t"].isNotNull()), summary)


def assemble_turns(events: DataFrame, redaction_rules=DEFAULT_RULES,
                   guardrail_rules=GUARDRAIL_RULES, classifier=None,
                   require_end: bool = True, dedupe: bool = True) -> DataFrame:
    """One governed row per invocation (C7). Turns without an end hook are
    emitted on the error path (WARNING) instead of being dropped, when
    ``require_end``; rows without an invocation id likewise. A re-delivered
    hook event (same ``event_id`` within its invocation) counts once."""
    ev = annotate(events, redaction_rules, guardrail_rules, classifier)
    # One shuffle: every aggregate is insensitive to an exact re-delivered
    # copy of an event (max_by/min_by/bool_or), except the tool counts,
    # which come from the de-duplicated set of the turn's tool events.
    # An event without invocation id is a turn of its own (one error row each).
    orphan = F.when(F.col("invocation_id").isNull(),
                    F.xxhash64("session_id", "seq", "event_id", "hook", "user_id", "text"))
    agg = ev.groupBy("invocation_id", orphan.alias("_orphan")).agg(
        *turn_aggregates(),
        (F.collect_set(_tool_event()) if dedupe else F.collect_list(_tool_event())).alias("_tools"))
    agg = (agg.withColumn("_tools", F.array_sort("_tools"))
           .withColumn("_tools", first_deliveries(F.col("_tools")) if dedupe else F.col("_tools"))
           .withColumn("_n_tools", F.size(F.filter("_tools", lambda x: x["hook"] == "before_tool")))
           .withColumn("tools_summary", tools_from_events(F.col("_tools")))
           .withColumn("tool_errors", F.size(F.filter(
               "tools_summary", lambda x: x["status"] == "error")).cast("bigint")))
    return finish_turns(agg, require_end)


def _tool_event():
    return F.when(F.col("hook").isin("before_tool", "after_tool"), F.struct(
        F.col("seq"), F.col("hook"), F.col("tool_name").alias("name"), F.col("call_id"),
        F.when(F.col("tool_status") == "error", "error").otherwise("ok").alias("status"),
        F.col("event_id")))


def verbose_rows(events: DataFrame, redaction_rules=DEFAULT_RULES,
                 guardrail_rules=GUARDRAIL_RULES, classifier=None,
                 pii_rows: bool = False) -> DataFrame:
    """One log row per hook event (when the verbose flag is on): the
    hook's label, WARNING for a policy violation. ``pii_rows`` adds the row that
    the redaction step logs for every model request with text."""
    ev = annotate(events, redaction_rules, guardrail_rules, classifier)
    label = F.create_map(*[x for h, m in HOOK_MESSAGES for x in (F.lit(h), F.lit(m))])
    msg = F.when(F.col("_status") == UNSAFE, F.lit(POLICY_MESSAGE)).otherwise(label[F.col("hook")])
    # The running tool counter as of each event
    ev = running_sum(ev, ["invocation_id"], "seq",
                     F.when(F.col("hook") == "before_tool", 1).otherwise(0), "tool_retry",
                     tiebreak=["event_id"])
    row = F.struct(msg.alias("message"), F.when(F.col("_status") == UNSAFE, "WARNING")
                   .otherwise("INFO").alias("severity"))
    if pii_rows:
        pii = F.struct(F.lit(REDACTION_MESSAGE).alias("message"), F.lit("INFO").alias("severity"))
        ev = ev.withColumn("_row", F.explode(F.when(F.coalesce("_raw", F.lit("")) != "", F.array(pii, row))
                                             .otherwise(F.array(row))))
    else:
        ev = ev.withColumn("_row", row)
    return (ev.where(msg.isNotNull())
            .select("invocation_id", "agent_name", "user_id", "session_id", "seq",
                    "_row.message", "_row.severity", F.col("tool_name"), "tool_retry"))


def turn_rates(turns: DataFrame, *by: str) -> DataFrame:
    """Over the rows of :func:`assemble_turns`, rolled up by ``by``: turns,
    share blocked, share redacted, tool errors per call (null without calls),
    tokens."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    calls, errors = F.sum("tool_calls").cast("double"), F.sum("tool_errors").cast("double")
    return turns.rollup(*by).agg(
        F.count("*").alias("turns"), share("eval_tags.guardrail_blocked").alias("block_rate"),
        share("eval_tags.pii_redacted").alias("redaction_rate"),
        F.when(calls > 0, F.try_divide(errors, calls)).alias("tool_error_rate"),
        F.sum("token_usage.total_tokens").cast("bigint").alias("tokens"))


def log_rows(df: DataFrame, message: str = "message", severity: str = "severity",
             custom: str | None = "custom", keep: tuple[str, ...] = ()) -> DataFrame:
    """(severity, message, custom JSON). Unknown severity -> INFO,
    missing custom -> '{}'. Struct payloads are serialised with to_json."""
    c = F.lit("{}")
    if custom is not None:
        col = F.col(custom)
        if not isinstance(df.schema[custom].dataType, T.StringType):
            col = F.to_json(col)
        c = F.coalesce(col, F.lit("{}"))
    return df.select(*keep, normalize_severity(F.col(severity)).alias("severity"),
                     F.col(message).alias("message"), c.alias("custom"))


def write_log(df: DataFrame, path: str, date_col: str = "ts") -> None:
    """Append log rows as JSON lines partitioned by date."""
    (df.withColumn("date", F.to_date(date_col)).write.mode("append")
     .partitionBy("date").json(path))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Hook events for a conversation log (W6): every user row opens a turn
    (invocation ``{conv_id}-{n}``, n = running count of user rows), the user
    text is the model request, assistant rows are model responses, and the
    turn ends after its last row. Rows before the first user row (system
    prompt) belong to no turn."""
    c = running_sum(conversations, ["conv_id"], "turn",
                    F.when(F.col("role") == "user", 1).otherwise(0), "_g")
    c = c.where(F.col("_g") > 0).select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("_g").cast("string"))
        .alias("invocation_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.lit("assistant").alias("agent_name"), "turn", "role", "text")
    def hook(name, step, text=None):
        return F.struct(F.lit(name).alias("hook"),
                        (F.col("turn") * 10 + step).cast("bigint").alias("seq"),
                        (text if text is not None else F.lit(None).cast("string")).alias("text"))

    # one pass over the rows: the hooks of each, exploded
    hooks = F.when(F.col("role") == "user", F.array(hook("before_agent", 0),
                                                    hook("before_model", 1, F.col("text")))) \
        .when(F.col("role") == "assistant", F.array(hook("after_model", 2, F.col("text"))))
    base = ["invocation_id", "session_id", "agent_name"]
    out = c.select(*base, F.explode(hooks).alias("h")).select(*base, "h.*")
    end = c.groupBy(*base).agg(
        (F.max("turn") * 10 + 9).cast("bigint").alias("seq")).select(
        *base, F.lit("after_agent").alias("hook"), "seq", F.lit(None).cast("string").alias("text"))
    out = out.unionByName(end)
    return conform_events(out.withColumn("event_id", F.concat_ws(
        ":", "invocation_id", F.col("seq").cast("string"))))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn_no, request, response, n_responses): the user text
    opening each turn and the last non-empty assistant text of the turn."""
    c = running_sum(conversations, ["conv_id"], "turn",
                    F.when(F.col("role") == "user", 1).otherwise(0), "turn_no")
    c = c.withColumn("turn_no", F.col("turn_no").cast("bigint")).where(F.col("turn_no") > 0)
    is_a = (F.col("role") == "assistant")
    return c.groupBy("conv_id", "turn_no").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("request"),
        F.coalesce(F.max_by("text", F.when(is_a & (F.coalesce("text", F.lit("")) != ""), F.col("turn"))),
                   F.lit("")).alias("response"),
        F.count(F.when(is_a, 1)).alias("n_responses"))
