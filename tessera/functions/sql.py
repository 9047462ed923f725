"""SQL surface: the text functions as Spark SQL temporary functions
(``CREATE TEMPORARY FUNCTION ... RETURN <expression>``), so SQL callers get
the same JVM-side expressions -- no Python UDF or UDTF. Bodies are built from
the same fixed values as the Column functions and are tested against them.

    register_sql_functions(spark)
    spark.sql("SELECT explode(parts) FROM (SELECT tessera_chunks(text, 1000, 100) AS parts FROM documents)")

(Spark takes no SQL function inside a generator, hence the subquery.)
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .embed import TOKEN_PATTERN
from .html import MARKUP_STEPS, URL_PATTERN, URL_TRAILING_PATTERN
from .ids import CHUNK_KEY_SEPARATOR, UUID_VARIANT_NIBBLES, UUID_VERSION_NIBBLE, namespace_hex
from .text import WHITESPACE_CODEPOINTS, WS_RUN, validate_chunking

_WHITESPACE = re.compile("[" + "".join(re.escape(chr(c)) for c in WHITESPACE_CODEPOINTS) + "]+")


# fixed values; "&amp;" last, so that "&amp;lt;" reads "&lt;"
COMMON_REFERENCES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&reg;", "\u00ae"), ("&middot;", "\u00b7"),
    ("&hellip;", "\u2026"), ("&mdash;", "\u2014"), ("&ndash;", "\u2013"), ("&amp;", "&"))


def _lit(s: str) -> str:
    """A Spark SQL string literal (escapes backslashes and quotes)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, {_lit('^' + WS_RUN + '|' + WS_RUN + '$')}, '')"


def _bodies() -> dict[str, str]:
    clean = f"trim(regexp_replace(coalesce(t, ''), {_lit(WS_RUN)}, ' '))"
    decoded = "coalesce(html, '')"
    for pattern, to in MARKUP_STEPS:
        decoded = f"regexp_replace({decoded}, {_lit(pattern)}, {_lit(to)})"
    # the common references only; functions.html.decode_entities has all
    for k, v in COMMON_REFERENCES:
        decoded = f"replace({decoded}, {_lit(k)}, {_lit(v)})"
    nl = _lit(chr(10))
    page_text = _strip(
        f"regexp_replace(regexp_replace({decoded}, {_lit('[ ' + chr(9) + ']+' + chr(10))}, {nl}), "
        f"{_lit(chr(10) + '{2,}')}, {_lit(chr(10) * 2)})")
    h = "h"         # the digest, bound once below
    fmt = (f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', '{UUID_VERSION_NIBBLE}', "
           f"substr({h}, 14, 3), '-', substr('{UUID_VARIANT_NIBBLES}', "
           f"cast(conv(substr({h}, 17, 1), 16, 10) AS INT) % 4 + 1, 1), substr({h}, 18, 3), '-', "
           f"substr({h}, 21, 12))")
    uuid5 = f"transform(array(sha1(concat(unhex(ns), encode(k, 'UTF-8')))), h -> {fmt})[0]"
    # each intermediate is bound once through a lambda variable
    # (transform(array(x), v -> ...)[0]); repeating it inside the window
    # lambda would re-run the regexes per window
    step = "greatest(chunk - overlap, 1)"
    n = "length(c)"
    count = (f"CASE WHEN {n} = 0 THEN 0 WHEN {n} <= chunk THEN 1 "
             f"ELSE CAST(ceil(({n} - chunk) / {step}) AS INT) + 1 END")
    windows = (f"transform(CASE WHEN {count} > 0 THEN sequence(0, {count} - 1) ELSE array() END, "
               f"i -> substr(array_join(slice(ps, i + 1, CAST(ceil(chunk / {step}) AS INT)), ''), 1, chunk))")
    with_pieces = (f"transform(array(regexp_extract_all(c, concat('(?s).{{1,', {step}, '}}'), 0)), "
                   f"ps -> {windows})[0]")
    chunks = f"transform(array(tessera_clean_text(t)), c -> {with_pieces})[0]"
    urls = (f"slice(array_distinct(transform(regexp_extract_all(coalesce(t, ''), {_lit(URL_PATTERN)}, 0), "
            f"u -> regexp_replace(u, {_lit(URL_TRAILING_PATTERN)}, ''))), 1, greatest(lim, 1))")
    toks = f"regexp_extract_all(lower(coalesce(t, '')), {_lit(TOKEN_PATTERN)}, 0)"
    return {
        "tessera_clean_text(t STRING) RETURNS STRING": clean,
        "tessera_chunks(t STRING, chunk INT, overlap INT) RETURNS ARRAY<STRING>": chunks,
        "tessera_uuid5(ns STRING, k STRING) RETURNS STRING": uuid5,
        "tessera_page_text(html STRING) RETURNS STRING": page_text,
        "tessera_extract_urls(t STRING, lim INT) RETURNS ARRAY<STRING>": urls,
        "tessera_tokens(t STRING) RETURNS ARRAY<STRING>": toks,
    }


class ChunkTable:
    """Table function of SQL callers: the chunks (X2-X5) of a table of (uri, text).

        SELECT * FROM tessera_chunk_table(TABLE(SELECT uri, text FROM t), 'gs://corpus/', 1000, 100)

    The rows are those of :func:`operators.chunking.chunk_table`. It runs in Python
    workers, in Arrow batches; the column and SQL functions stay in the JVM."""

    def eval(self, row, prefix: str, chunk: int, overlap: int):
        validate_chunking(chunk, overlap)
        text = _WHITESPACE.sub(" ", row["text"] or "").strip(" ")
        namespace = uuid.UUID(hex=namespace_hex(prefix))
        step = max(chunk - overlap, 1)
        count = 0 if not text else max(0, -(-(len(text) - chunk) // step)) + 1
        for i in range(count):
            key = f"{row['uri']}{CHUNK_KEY_SEPARATOR}{i}"
            yield str(uuid.uuid5(namespace, key)), row["uri"], i, text[i * step:i * step + chunk]


def register_table_functions(spark: SparkSession) -> list[str]:
    """Register the table functions; returns their names."""
    spark.udtf.register("tessera_chunk_table", udtf(
        ChunkTable, returnType="chunk_id string, source string, chunk_index int, text string",
        useArrow=True))
    return ["tessera_chunk_table"]


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary SQL functions; returns their names.
    ``tessera_chunks`` rejects nothing itself: pass chunk > 0, overlap >= 0."""
    names = []
    for sig, body in _bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {sig} RETURN {body}")
        names.append(sig.split("(")[0])
    return names
