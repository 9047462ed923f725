"""Text column expressions: whitespace cleaning, fixed-size chunk spans,
result-field cleaning, previews.

Everything here returns a ``Column`` built from Spark built-ins, so it stays
inside Catalyst (and whole-stage codegen where the expression supports it).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# The characters Python's str.split() treats as whitespace (str.isspace()),
# which the reference uses to normalise text. Java's \s and RE2's \s differ
# from this set, so it is spelled out and shared by Spark and the SQL oracle.
WHITESPACE_CODEPOINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0,
    0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
    0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
# The same characters as ranges, without and with the space: a matcher tests a few
# ranges for each character of a text, not every code point of the list.
_WS_RANGES = (r"\x{9}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
              r"\x{202f}\x{205f}\x{3000}")
# Default chunk geometry of the ingest path: characters, not bytes or tokens.
DEFAULT_CHUNK_CHARS = 1000
DEFAULT_CHUNK_OVERLAP = 100
# ----------------------------------------------------------------------------


def _ws_class() -> str:
    parts = []
    for cp in WHITESPACE_CODEPOINTS:
        parts.append(f"\\x{{{cp:x}}}")
    return "[" + "".join(parts) + "]"


# One regex character class, valid in both Java regex and RE2 (\x{...}).
WS_CLASS = _ws_class()
WS_RUN = WS_CLASS + "+"
# The runs that are not one single space already.
UNCLEAN_RUN = f"[{_WS_RANGES}][ {_WS_RANGES}]*+| [ {_WS_RANGES}]++"
END_RUNS = f"^[ {_WS_RANGES}]++|[ {_WS_RANGES}]++$"


def clean_text(col: Column | str) -> Column:
    """Collapse every whitespace run to one space and strip both ends."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), UNCLEAN_RUN, " "))


def chunk_count(n_chars: Column, chunk: int, overlap: int) -> Column:
    """Number of windows the sliding chunker produces for a text of
    ``n_chars`` characters (0 for empty text)."""
    step = max(chunk - overlap, 1)
    return (
        F.when(n_chars <= 0, F.lit(0))
        .when(n_chars <= chunk, F.lit(1))
        .otherwise(F.ceil((n_chars - F.lit(chunk)) / F.lit(step)).cast("int") + 1)
    )




def validate_chunking(chunk: int, overlap: int) -> None:
    if chunk <= 0:
        raise ValueError(f"chunk size must be positive, got {chunk}")
    if overlap < 0:
        raise ValueError(f"overlap must be non-negative, got {overlap}")


def clean_field(col: Column | str, newline_to_space: bool = False) -> Column:
    """Null -> '', optional newline -> space, then strip."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.coalesce(c, F.lit(""))
    if newline_to_space:
        c = F.replace(c, F.lit("\n"), F.lit(" "))
    return strip(c)


def strip(col: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace runs."""
    return F.regexp_replace(col, END_RUNS, "")


def preview(col: Column | str, n: int) -> Column:
    """First ``n`` characters."""
    c = F.col(col) if isinstance(col, str) else col
    return F.substr(c, F.lit(1), F.lit(n))
