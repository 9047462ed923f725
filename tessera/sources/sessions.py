"""Session store payloads.

A session listing arrives as JSON in one of the shapes the reference
accepts -- ``{"sessions": [...]}``, a bare list, or null -- one payload per
row. ``normalize_sessions`` turns a table of such payloads into one row per
session with its id (``session_id``, else ``id``; rows without one are
dropped) and its activity time (T3 key chain; numbers are epoch seconds,
strings ISO-8601). Parsing is per row (VARIANT), so any number of payloads
is processed in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import SESSION_TIME_KEYS, session_time


def normalize_sessions(raw: DataFrame, payload: str = "payload",
                       keep: tuple[str, ...] = ()) -> DataFrame:
    v = F.try_parse_json(F.col(payload))
    kind = F.schema_of_variant(v)
    wrapped = F.try_variant_get(v, "$.sessions", "array<variant>")
    bare = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    items = F.coalesce(wrapped, bare, F.array().cast("array<variant>"))
    s = raw.select(*keep, F.explode(items).alias("s"))

    def field(name):
        return F.try_variant_get(F.col("s"), f"$.{name}", "string")

    def typed(name):
        """(number, string) of a field; the one its JSON type is not is null."""
        is_text = F.schema_of_variant(F.try_variant_get(F.col("s"), f"$.{name}", "variant")) == "STRING"
        return (F.when(~is_text, F.try_variant_get(F.col("s"), f"$.{name}", "double")),
                F.when(is_text, field(name)))

    sid = F.coalesce(F.nullif(field("session_id"), F.lit("")), F.nullif(field("id"), F.lit("")))
    ts = session_time({k: typed(k) for k in SESSION_TIME_KEYS})
    return (s.select(*keep, sid.alias("session_id"), ts.alias("updated_epoch"),
                     F.to_json(F.col("s")).alias("record"))
            .where(F.col("session_id").isNotNull()))


def read_sessions(spark: SparkSession, path: str, app_name: str, user_id: str) -> DataFrame:
    """Sessions of one app and user from a Parquet session table; the
    equality filters are pushed into the scan (S9, F9)."""
    return (spark.read.parquet(path)
            .where((F.col("app_name") == app_name) & (F.col("user_id") == user_id)))


def read_sessions_jdbc(spark: SparkSession, url: str, table: str, app_name: str,
                       user_id: str, properties: dict | None = None,
                       id_buckets: int = 0) -> DataFrame:
    """Sessions of one app and user from a relational session store.
    The scope is sent to the database as a WHERE clause; with
    ``id_buckets > 0`` the read is split into that many parallel range
    queries on a hash of the session id. Not exercised by the tests: no
    database runs in this environment."""
    esc_app, esc_user = app_name.replace("'", "''"), user_id.replace("'", "''")
    scope = f"app_name = '{esc_app}' AND user_id = '{esc_user}'"
    props = dict(properties or {})
    if id_buckets > 0:
        preds = [f"{scope} AND MOD(ABS(HASHTEXT(id)), {id_buckets}) = {b}" for b in range(id_buckets)]
        return spark.read.jdbc(url, table, predicates=preds, properties=props)
    return spark.read.jdbc(url, f"(SELECT * FROM {table} WHERE {scope}) s", properties=props)
