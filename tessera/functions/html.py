"""HTML page text and URL extraction.

Page text follows an HTML parser's text view: the content of script, style,
noscript, nav, footer and form elements is dropped, every other text node is
kept, consecutive text nodes are separated by one newline. As regexes over the
raw page that is: replace each dropped element, comment, declaration and tag by
a mark and each run of marks by one newline (``MARKUP_STEPS``), decode
character references, then apply the two newline rules and strip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS, strip

# --- fixed values -----------------------------------------------------------
DROPPED_ELEMENTS = ("script", "style", "noscript", "nav", "footer", "form")
MAX_PAGE_CHARS = 8000
TRUNCATION_MARK = "\n\n[...truncated...]"
EMPTY_PAGE = "Empty page or unreadable content."
NOT_FOUND = "HTTP 404 - unable to fetch."
URL_TRAILING = ").,]>'\""
# ----------------------------------------------------------------------------


# Attributes of a tag; quoted values may hold ">". Possessive, so the matcher
# loops instead of recursing however long the page is.
_ATTRS = "(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_RAW = "|".join(e for e in DROPPED_ELEMENTS if e in ("script", "style"))
_NESTED = "|".join(e for e in DROPPED_ELEMENTS if e not in ("script", "style"))
#: Depth to which dropped elements may be nested in their own kind.
NESTING = 6
_MARK = "\x01"

#: Replacements in order. Each dropped element, comment and tag becomes one
#: mark; a run of marks is one newline. An unclosed script, style or comment
#: runs to the end; nested elements go innermost first.
MARKUP_STEPS = (
    (f"(?is)<!--.*?(?:-->|\\z)|<({_RAW})\\b{_ATTRS}>.*?(?:</\\1\\s*>|\\z)", _MARK),
    *((f"(?i)<({_NESTED})\\b{_ATTRS}>(?:[^<]++|<(?!/?\\1\\b))*+</\\1\\s*>", _MARK),) * NESTING,
    (f"(?i)</?[a-z]{_ATTRS}>", _MARK),
    ("(?i)<(?:![^>]*|/?[a-z][^>]*)>", _MARK),
    (f"{_MARK}+", "\n"),
)
SPACE_BEFORE_NEWLINE, NEWLINES = "[ \t]+\n", "\n{2,}"
URL_PATTERN = f"https?://[^{WS_CLASS[1:-1]})]+"
URL_TRAILING_PATTERN = "[" + "".join("\\" + c for c in URL_TRAILING) + "]+$"
TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title\s*>"
LANG_PATTERN = r"(?is)<html[^>]*\blang=\"([^\"]+)\""
HOST_PATTERN = r"^https?://([^/:?#]+)"


def _named() -> tuple[str, str]:
    """The HTML5 names as a JSON object, and the pattern of those that need no
    semicolon (longest first)."""
    import json
    from html.entities import html5
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return json.dumps(html5), "^(?:" + "|".join(bare) + ")"


def decode_entities(col: Column) -> Column:
    """Character references decoded in one pass, as an HTML parser does:
    named (all of HTML5, the old ones also without semicolon), decimal, hex.
    Invalid numbers become U+FFFD, the C1 range reads as Windows-1252."""
    names, bare = _named()
    table = F.from_json(F.lit(names), "map<string,string>")
    c1 = "".join(bytes([k]).decode("cp1252", "replace") for k in range(128, 160))

    def piece(p: Column) -> Column:
        digits = F.regexp_extract(p, "^#([0-9]+);?", 1)
        hexa = F.regexp_extract(p, "^#[xX]([0-9a-fA-F]+);?", 1)
        # more digits than any code point has: out of range
        code = F.when(digits != "", F.coalesce(digits.try_cast("bigint"), F.lit(-1))) \
            .when(hexa != "", F.when(F.length(F.ltrim(hexa, F.lit("0"))) > 6, F.lit(-1))
                  .otherwise(F.conv(F.coalesce(F.nullif(F.ltrim(hexa, F.lit("0")), F.lit("")),
                                               F.lit("0")), 16, 10).cast("bigint")))
        bad = (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        char = F.when(bad, F.lit("\ufffd")) \
            .when(code.between(128, 159), F.substr(F.lit(c1), (code - 127).cast("int"), F.lit(1))) \
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        number = F.regexp_extract(p, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
        named = F.regexp_extract(p, "^[A-Za-z][A-Za-z0-9]*;", 0)
        old = F.regexp_extract(p, bare, 0)

        def rest(found):
            return F.substr(p, F.length(found) + 1, F.length(p) + 1)

        return F.when(number != "", F.concat(char, rest(number))) \
            .when((named != "") & F.try_element_at(table, named).isNotNull(),
                  F.concat(F.try_element_at(table, named), rest(named))) \
            .when(old != "", F.concat(F.try_element_at(table, old), rest(old))) \
            .otherwise(F.concat(F.lit("&"), p))

    parts = F.split(col, "&", -1)
    decoded = F.concat(F.get(parts, F.lit(0)),
                       F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), ""))
    return F.when(F.contains(col, F.lit("&")), decoded).otherwise(col)


def page_text(html: Column) -> Column:
    """Cleaned text of a page (before the length limit and the prefix)."""
    t = F.coalesce(html, F.lit(""))
    for pattern, to in MARKUP_STEPS:
        t = F.regexp_replace(t, pattern, to)
    t = decode_entities(t)
    t = F.regexp_replace(t, SPACE_BEFORE_NEWLINE, "\n")
    t = F.regexp_replace(t, NEWLINES, "\n\n")
    return strip(t)


def page_output(url: Column, text: Column, max_chars: int = MAX_PAGE_CHARS) -> Column:
    """The per-URL block of a page read: status line for an empty page,
    truncation past ``max_chars``, ``[URL] url`` header. ``text`` null means
    the page is missing."""
    body = F.when(F.length(text) > max_chars,
                  F.concat(F.substr(text, F.lit(1), F.lit(max_chars)), F.lit(TRUNCATION_MARK))
                  ).otherwise(text)
    return (F.when(text.isNull(), F.concat(F.lit("["), url, F.lit("] " + NOT_FOUND)))
            .when(F.length(text) == 0, F.concat(F.lit("["), url, F.lit("] " + EMPTY_PAGE)))
            .otherwise(F.concat(F.lit("[URL] "), url, F.lit("\n\n"), body)))


def title(html: Column) -> Column:
    return strip(decode_entities(F.regexp_extract(F.coalesce(html, F.lit("")),
                                                  TITLE_PATTERN, 1)))


def page_lang(html: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(html, F.lit("")), LANG_PATTERN, 1), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST_PATTERN, 1))


def site_match(url: Column, site: str) -> Column:
    """Host equals ``site`` or is a sub-domain of it (F5). A leading
    ``site:`` in the argument is accepted."""
    s = site.strip()
    if s.startswith("site:"):
        s = s[5:]
    s = s.lower()
    h = host(url)
    return (h == F.lit(s)) | h.endswith("." + s)


def extract_urls(text: Column, limit: int | None = None) -> Column:
    """URLs in ``text`` in first-occurrence order, trailing punctuation
    removed, duplicates dropped, at most ``max(limit, 1)`` (X8, T2)."""
    urls = F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL_PATTERN), F.lit(0)),
        lambda u: F.regexp_replace(u, URL_TRAILING_PATTERN, ""))
    urls = F.array_distinct(urls)
    if limit is not None:
        urls = F.slice(urls, 1, max(limit, 1))
    return urls
