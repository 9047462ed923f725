"""Governance column functions: PII redaction (X13), rule guardrail (X14),
guardrail decision parsing (X15), severity normalisation (X17).

Patterns avoid ``\\b`` and look-arounds so they mean the same in Java regex
(Spark) and RE2 (the SQL oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# The reference redacts one literal name (a demo rule).
PERSON_RULE = (r"\QJohn Doe\E", "[PERSON_NAME]")
# Extra rules the reference points at ("use a real detector"); opt-in.
EXTRA_RULES = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP_ADDRESS]"),
    (r"[0-9]{13,}", "[CARD_NUMBER]"),
)
DEFAULT_RULES = (PERSON_RULE,)
ALL_RULES = (PERSON_RULE,) + EXTRA_RULES

# Guardrail categories the reference's guardrail prompt lists, as rules.
# Off-topic requests are not expressible as a pattern (classifier hook).
GUARDRAIL_RULES = (
    ("instructions", r"(?i)((ignore|disregard|forget)\s+(all\s+|any\s+|the\s+)?(previous|prior|above|your)\s+(instructions|rules|prompt)|reveal\s+(your|the)\s+(system\s+)?(prompt|instructions)|jailbreak)"),
    ("persona", r"(?i)(pretend\s+to\s+be|you\s+are\s+now\s|act\s+as\s+(a|an|my)\s|roleplay\s+as)"),
    ("toxic", r"(?i)(^|[^a-z])(idiot|moron|clown|worthless|stupid|loser|trash|pathetic)([^a-z]|$)"),
    ("brand", r"(?i)((criticize|insult|mock)\s+(the\s+|our\s+|your\s+)?(brand|company)|competitor)"),
)
SAFE, UNSAFE, ERROR = "safe", "unsafe", "error"
BLOCKED_PROMPT = "[BLOCKED_BY_GUARDRAIL]"
ERROR_PROMPT = "[GUARDRAIL_ERROR]"
BLOCKED_RESPONSE = "Sorry, I can't help with that."
ERROR_RESPONSE = "Issue processing your request."
SEVERITIES = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
SEVERITY_ALIASES = (("WARN", "WARNING"), ("FATAL", "CRITICAL"))
# ----------------------------------------------------------------------------


def sql_pattern(p: str) -> str:
    """The same pattern for RE2 (no \\Q...\\E quoting)."""
    if p.startswith(r"\Q") and p.endswith(r"\E"):
        import re
        return re.escape(p[2:-2])
    return p


def redact(text: Column, rules=DEFAULT_RULES) -> Column:
    """Apply each (pattern, tag) rule in order; empty text is left as is."""
    out = text
    for pat, tag in rules:
        out = F.regexp_replace(out, pat, tag.replace("$", "\\$"))
    return F.when(F.coalesce(text, F.lit("")) == "", text).otherwise(out)


def redaction(text: Column, rules=DEFAULT_RULES) -> tuple[Column, Column]:
    """(redacted text, changed flag)."""
    r = redact(text, rules)
    return r, F.coalesce(r != text, F.lit(False))


def guardrail_category(text: Column, rules=GUARDRAIL_RULES) -> Column:
    """First matching rule category, else null."""
    expr = None
    for cat, pat in rules:
        cond = F.coalesce(text, F.lit("")).rlike(pat)
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    return expr


def guardrail_decision(text: Column, rules=GUARDRAIL_RULES, classifier=None) -> Column:
    """``STRUCT<decision, reasoning>``: a rule hit is unsafe with the category
    as reasoning; ``classifier`` (a pandas UDF returning the same struct, e.g.
    a model call) replaces the rules when given."""
    if classifier is not None:
        return classifier(text)
    cat = guardrail_category(text, rules)
    return F.struct(F.when(cat.isNotNull(), F.lit(UNSAFE)).otherwise(F.lit(SAFE)).alias("decision"),
                    cat.alias("reasoning"))


def parse_decision(js: Column) -> Column:
    """Status of a guardrail response (X15): '' or null -> safe (empty
    object); invalid JSON or a non-object -> error; otherwise unsafe iff the
    lower-cased decision is 'unsafe' (missing/empty decision -> safe)."""
    s = F.trim(F.coalesce(js, F.lit("")))
    v = F.try_parse_json(s)
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    dec = F.lower(F.coalesce(F.nullif(F.try_variant_get(v, "$.decision", "string"), F.lit("")),
                             F.lit(SAFE)))
    return (F.when(s == "", F.lit(SAFE))
            .when(v.isNull() | ~is_obj, F.lit(ERROR))
            .when(dec == UNSAFE, F.lit(UNSAFE))
            .otherwise(F.lit(SAFE)))


def normalize_severity(sev: Column) -> Column:
    """Upper-case; known levels kept (WARN -> WARNING, FATAL -> CRITICAL);
    anything else -> INFO (X17)."""
    u = F.upper(F.trim(F.coalesce(sev, F.lit(""))))
    expr = F.when(u.isin(*SEVERITIES), u)
    for a, b in SEVERITY_ALIASES:
        expr = expr.when(u == a, F.lit(b))
    return expr.otherwise(F.lit("INFO"))
