"""Reusable SQL fragments for the DuckDB oracle queries.

They restate the column functions of ``tessera.functions`` in SQL, using the
same fixed values (whitespace set, token pattern, id layout).
"""

from __future__ import annotations

from ..functions.embed import DEFAULT_DIM, TOKEN_PATTERN
from ..functions.ids import namespace_hex
from ..functions.text import WS_RUN
from ..operators.chunking import CORPUS_PREFIX


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(expr: str) -> str:
    return f"trim(regexp_replace(coalesce({expr}, ''), {sql_str(WS_RUN)}, ' ', 'g'))"


def corpus_uri(source: str = "source", doc_id: str = "doc_id") -> str:
    return f"({sql_str(CORPUS_PREFIX)} || {source} || '/' || CAST({doc_id} AS VARCHAR) || '.txt')"


def uuid5(key_expr: str, prefix: str = CORPUS_PREFIX) -> str:
    h = f"sha1(unhex({sql_str(namespace_hex(prefix))}) || encode({key_expr}))"
    return (f"(substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || "
            f"substr('89ab', CAST(('0x' || substr({h},17,1)) AS INTEGER) % 4 + 1, 1) || "
            f"substr({h},18,3) || '-' || substr({h},21,12))")


def chunk_ctes(chunk: int = 1000, overlap: int = 100, name: str = "chunks",
               src: str = "documents") -> str:
    """CTEs ``{name}_cleaned(source, clean)`` and ``{name}(chunk_id, source,
    chunk_index, text)`` over ``src``, a table like ``documents``."""
    step = max(chunk - overlap, 1)
    return f"""
{name}_cleaned AS (
  SELECT {corpus_uri()} AS source, {clean('text')} AS clean FROM {src}
),
{name}_spans AS (
  SELECT source, clean,
         unnest(range(0, CASE WHEN length(clean) <= {chunk} THEN 1
                              ELSE CAST(ceil((length(clean) - {chunk}) / {step}.0) AS BIGINT) + 1 END)) AS i
  FROM {name}_cleaned WHERE length(clean) > 0
),
{name} AS (
  SELECT {uuid5("source || '::chunk::' || CAST(i AS VARCHAR)")} AS chunk_id,
         source, CAST(i AS INTEGER) AS chunk_index,
         substr(clean, CAST(i * {step} + 1 AS BIGINT), {chunk}) AS text
  FROM {name}_spans
)"""


def bucket(tok: str, dim: int = DEFAULT_DIM) -> str:
    return f"CAST(CAST(('0x' || substr(md5({tok}), 1, 8)) AS UBIGINT) % {dim} AS INTEGER)"


def term_ctes(name: str, src: str, id_col: str, text_col: str,
              dim: int = DEFAULT_DIM) -> str:
    """CTEs ``{name}_tf(id, bucket, tf)`` and ``{name}_ss(id, ss)``."""
    return f"""
{name}_tok AS (
  SELECT {id_col} AS id, unnest(regexp_extract_all(lower(coalesce({text_col}, '')), {sql_str(TOKEN_PATTERN)})) AS tok
  FROM {src}
),
{name}_tf AS (
  SELECT id, {bucket('tok', dim)} AS bucket, CAST(count(*) AS BIGINT) AS tf
  FROM {name}_tok GROUP BY ALL
),
{name}_ss AS (
  SELECT id, CAST(sum(tf * tf) AS BIGINT) AS ss FROM {name}_tf GROUP BY id
)"""


def sparse_topk_ctes(q: str, c: str, k: int) -> str:
    """CTE ``_top(query_id, cand_id, score, rank)`` from term CTEs ``q`` and
    ``c`` (see :func:`term_ctes`)."""
    return f"""
_dots AS (
  SELECT qt.id AS query_id, ct.id AS cand_id, sum(qt.tf * ct.tf) AS dot
  FROM {q}_tf qt JOIN {c}_tf ct USING (bucket) GROUP BY ALL
),
_scored AS (
  SELECT d.query_id, d.cand_id,
         CAST(d.dot AS DOUBLE) / (sqrt(CAST(qs.ss AS DOUBLE)) * sqrt(CAST(cs.ss AS DOUBLE))) AS score
  FROM _dots d JOIN {q}_ss qs ON qs.id = d.query_id JOIN {c}_ss cs ON cs.id = d.cand_id
),
_top AS (
  SELECT query_id, cand_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS INTEGER) AS rank
  FROM _scored QUALIFY rank <= {k}
)"""


# --- web ---------------------------------------------------------------------

def strip(expr: str) -> str:
    from ..functions.text import WS_RUN as _W
    return f"regexp_replace({expr}, {sql_str('^' + _W + '|' + _W + '$')}, '', 'g')"


def decode_entities(expr: str) -> str:
    """The references that the driver's pages hold, stated here on their own."""
    for ent, ch in (("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&quot;", '"'), ("&lt;", "<"),
                    ("&gt;", ">"), ("&#39;", "'"), ("&amp;", "&")):
        expr = f"replace({expr}, {sql_str(ent)}, {sql_str(ch)})"
    return expr


def page_text(html: str) -> str:
    # a pattern of the oracle's own: RE2 has no possessive loops and needs none
    dropped = "|".join(f"<{e}[^>]*>.*?</{e}>" for e in
                       ("script", "style", "noscript", "nav", "footer", "form"))
    run = f"(?is)(?:{dropped}|<!--.*?-->|</?[a-z!][^>]*>)+"
    t = f"regexp_replace(coalesce({html}, ''), {sql_str(run)}, chr(10), 'g')"
    t = decode_entities(t)
    t = f"regexp_replace({t}, '[ \\t]+\\n', chr(10), 'g')"
    t = f"regexp_replace({t}, '\\n{{2,}}', chr(10) || chr(10), 'g')"
    return strip(t)


def title(html: str) -> str:
    from ..functions.html import TITLE_PATTERN
    return strip(decode_entities(f"regexp_extract(coalesce({html}, ''), {sql_str(TITLE_PATTERN)}, 1)"))


def page_lang(html: str) -> str:
    from ..functions.html import LANG_PATTERN
    return f"nullif(regexp_extract(coalesce({html}, ''), {sql_str(LANG_PATTERN)}, 1), '')"


def host(url: str) -> str:
    from ..functions.html import HOST_PATTERN
    return f"lower(regexp_extract({url}, {sql_str(HOST_PATTERN)}, 1))"


def page_output(url: str, text: str, max_chars: int = 8000) -> str:
    from ..functions.html import EMPTY_PAGE, NOT_FOUND, TRUNCATION_MARK
    body = (f"CASE WHEN length({text}) > {max_chars} THEN substr({text}, 1, {max_chars}) || "
            f"{sql_str(TRUNCATION_MARK)} ELSE {text} END")
    return (f"CASE WHEN {text} IS NULL THEN '[' || {url} || '] ' || {sql_str(NOT_FOUND)} "
            f"WHEN length({text}) = 0 THEN '[' || {url} || '] ' || {sql_str(EMPTY_PAGE)} "
            f"ELSE '[URL] ' || {url} || chr(10) || chr(10) || {body} END")


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def bm25_ctes(q_src: str, q_id: str, q_text: str, d_src: str, d_id: str, d_text: str,
              k: int, name: str = "bm") -> str:
    """CTE ``{name}_top(query_id, doc_id, score, rank)``; same formula and
    operation order as the Spark operator."""
    from ..operators.web import BM25_B, BM25_K1, SCORE_DIGITS
    tok = sql_str(TOKEN_PATTERN)
    return f"""
{name}_dtok AS (
  SELECT {d_id} AS doc_id, unnest(regexp_extract_all(lower(coalesce({d_text}, '')), {tok})) AS term FROM {d_src}
),
{name}_dl AS (
  SELECT {d_id} AS doc_id, len(regexp_extract_all(lower(coalesce({d_text}, '')), {tok})) AS dl FROM {d_src}
),
{name}_stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(dl AS DOUBLE)) AS avgdl FROM {name}_dl),
{name}_qt AS (
  SELECT DISTINCT {q_id} AS query_id, unnest(regexp_extract_all(lower(coalesce({q_text}, '')), {tok})) AS term FROM {q_src}
),
{name}_dtf AS (
  SELECT doc_id, term, count(*) AS tf FROM {name}_dtok
  WHERE term IN (SELECT term FROM {name}_qt) GROUP BY ALL
),
{name}_idf AS (
  SELECT term, ln({dbl(1.0)} + (s.n - CAST(count(*) AS DOUBLE) + {dbl(0.5)}) / (CAST(count(*) AS DOUBLE) + {dbl(0.5)})) AS idf
  FROM {name}_dtf, {name}_stats s GROUP BY term, s.n
),
{name}_sc AS (
  SELECT q.query_id, d.doc_id,
         round(sum(i.idf * CAST(d.tf AS DOUBLE) * {dbl(BM25_K1 + 1.0)}
                   / (CAST(d.tf AS DOUBLE) + {dbl(BM25_K1)} * ({dbl(1.0 - BM25_B)} + {dbl(BM25_B)} * CAST(l.dl AS DOUBLE) / s.avgdl))), {SCORE_DIGITS}) AS score
  FROM {name}_qt q JOIN {name}_idf i USING (term) JOIN {name}_dtf d USING (term)
       JOIN {name}_dl l ON l.doc_id = d.doc_id, {name}_stats s
  GROUP BY ALL
),
{name}_top AS (
  SELECT query_id, doc_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM {name}_sc QUALIFY rank <= {k}
)"""
