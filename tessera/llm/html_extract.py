"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded along the
tree.

A page is parsed into element nodes (implied ends of ``p``, ``li``, cells and the
like included, no recursion, linear in the page). Each node gets features of
its subtree (text, words, link and punctuation density, tags), of its position
(depth, place among siblings, share of parent and page) and of its tag and
attribute tokens and those of its ancestors. The trees estimate whether the
node's subtree holds main text; the decoding takes the most likely labelling in
which nothing below a rejected node is accepted (one pass up, one down).

The trees are trained on pages composed by a seeded generator, whose parts
(article, menu, header, footer, sidebar, notice, advert, form, reader comments)
carry their labels, in semantic and in plain ``div`` markup, with and without
telling names. No page of the input is needed for the fit, so every page, alone
or among others, gets the same text.

Defined cases: null and empty html give an empty text; a page without an element
is one block of text, kept; unclosed and misnested elements are closed where
HTML would, and at the latest by an end tag of an element around them (script,
style, title, textarea and iframe only by their own); contents of elements that
hold no readable text (script, style, svg, button, ...) are never text; text of
``math`` is text of the element around it; ``br`` counts as white space; repeated pages are
extracted alike; other columns are not read.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import slices
from .quality import Trees, boost
from .toxicity import sigmoid

_words = str.split
VOID = set(_words("area base br col embed hr img input link meta param source track wbr"))
#: Elements whose contents are no readable text.
SILENT = set(_words("script style noscript template head title iframe svg object canvas "
                    "textarea select button audio video map datalist annotation annotation-xml"))
#: Of these, the ones that hold raw text: only their own end tag ends them.
RAW = set(_words("script style title textarea iframe"))
#: Elements whose tags honour a closing slash within, the places in them that
#: hold HTML again, and the HTML start tags that end them elsewhere.
FOREIGN = {"svg", "math"}
MATHML = set(_words("math semantics mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle merror "
                    "mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover "
                    "mmultiscripts mtable mtr mtd maction"))
HTML_AGAIN = set(_words("foreignobject desc title mi mo mn ms mtext annotation-xml"))
ENDS_FOREIGN = set(_words(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img "
    "li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var"))
INLINE = set(_words("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label "
                    "mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u "
                    "var wbr"))
#: Start tags that end an open ``p``.
ENDS_P = set(_words("address article aside blockquote details div dl fieldset figcaption figure "
                    "footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section "
                    "table ul center dir"))
SCOPES = set(_words("table td th caption button object html body"))
#: Start tag: open elements it ends, and the elements that bound the search.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}),
        "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}

#: Tag groups and attribute tokens that are features of their own.
TAGS = [_words(x) for x in (
    "article", "main", "section", "div", "p", "h1 h2", "h3 h4 h5 h6", "ul ol dl menu", "li dt dd",
    "table tbody thead tfoot tr", "td th", "nav", "header", "footer", "aside",
    "form fieldset input label", "a", "blockquote pre figure figcaption", "body html",
    "b i em strong span code")]
TOKENS = [_words(x) for x in (
    "content article post entry story body text main maincontent prose copy",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc topics",
    "header masthead logo topbar branding",
    "footer copyright legal colophon bottom",
    "sidebar side aside widget rail related recommended trending popular more",
    "ad ads advert advertisement adsense sponsor sponsored promo banner promotion",
    "cookie cookies consent notice alert gdpr popup modal overlay message warning disclaimer "
    "announcement",
    "form search login signup subscribe newsletter register contact subscription",
    "comment comments reply replies respond discussion disqus reviews feedback responses",
    "share social follow sharing tags meta byline author",
    "hidden none")]
_GROUP = {t: i for i, g in enumerate(TAGS) for t in g}
_TOKEN = {t: i for i, g in enumerate(TOKENS) for t in g}
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?]")
_MARKUP = re.compile(r"<[A-Za-z/!?]")
_NUMBER = re.compile(r"&#([0-9]{8,})(;?)")


def _page(html: str) -> str:
    """``html`` without a tag that the page's end cuts short, and with numeric
    references beyond Unicode as U+FFFD."""
    last = html.rfind(">") + 1
    cut = _MARKUP.search(html, last)
    html = html[:cut.start()] if cut else html

    def number(m):
        digits = m[1].lstrip("0") or "0"
        return "\ufffd" if len(digits) > 7 else f"&#{digits}{m[2]}"
    return _NUMBER.sub(number, html)


class Dom(HTMLParser):
    """Element nodes in document order (parents before children), and the
    text pieces with their node and block."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.names = ["#root"], [-1], [frozenset()]
        self.pieces: list[tuple[int, int, str]] = []
        self.block = 0
        self.open, self.tags = [0], ["#root"]    # stack of nodes, and their tags
        self.places: dict[str, list[int]] = {}   # stack places by tag
        self.blocks, self.scopes = [], []        # and of elements of a kind
        self.hush, self.foreign = [], []
        self.feed(_page(html))
        self.close()

    def parse_marked_section(self, i, report=1):
        """``<![...`` is a comment to the next ``>`` in HTML."""
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_comment(self, i, report=1):
        """A comment that is never closed lasts to the page's end."""
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)

    def _last(self, tags) -> int:
        """Place of the innermost open element of the tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _push(self, tag, attrs):
        place = len(self.open)
        if self.hush or tag in SILENT or self._math(tag):
            self.open.append(self.open[-1])      # no node of its own
        else:
            self.parent.append(self.open[-1])
            self.tag.append(tag)
            self.names.append(_tokens(attrs))
            self.open.append(len(self.tag) - 1)
        self.tags.append(tag)
        self.places.setdefault(tag, []).append(place)
        if not (tag in INLINE or tag in SILENT or tag in MATHML):
            self.blocks.append(place)
        if tag in SCOPES:
            self.scopes.append(place)
        if tag in FOREIGN or self.foreign and tag in HTML_AGAIN:
            self.foreign.append(place)
        if tag in SILENT:
            self.hush.append(place)

    def _pop_to(self, place):
        while len(self.open) > place:
            self.open.pop()
            self.places[self.tags.pop()].pop()
            for places in (self.blocks, self.scopes, self.hush, self.foreign):
                if places and places[-1] == len(self.open):
                    places.pop()

    def _math(self, tag) -> bool:
        return tag == "math" or bool(self.places.get("math"))

    def _in_foreign(self) -> bool:
        return bool(self.foreign) and self.tags[self.foreign[-1]] in FOREIGN

    def handle_starttag(self, tag, attrs, slash=False):
        if self.tags[-1] in RAW:
            return
        while tag in ENDS_FOREIGN and self._in_foreign():
            self._pop_to(self.foreign[-1])
        if tag == "body":
            self._end_head()
        if tag == "head":
            return
        if tag == "button" and self.scopes and self.tags[self.scopes[-1]] == "button":
            self._pop_to(self.scopes[-1])
        # start tags in a silent element end nothing around it
        bound = self.hush[-1] if self.hush else 0
        if tag not in INLINE and tag not in SILENT and not self.hush and not self._math(tag):
            self.block += 1
        if tag in ENDS_P:
            p = self._last(("p",))
            if p > bound and (not self.scopes or p > self.scopes[-1]):
                self._pop_to(p)
        if tag in ENDS:
            ends, bounds = ENDS[tag]
            place = self._last(ends)
            if place > max(bound, self._last(bounds)):
                self._pop_to(place)
        if tag == "br" and not self.hush:
            self.pieces.append((self.open[-1], self.block, " "))
        # a slash does not close in HTML
        if tag not in VOID and not (slash and (tag in FOREIGN or self._in_foreign())):
            self._push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def _end_head(self):
        """Silent elements that the head left open end where the body begins."""
        if self.hush and not self.places.get("body"):
            self._pop_to(self.hush[0])

    def handle_endtag(self, tag):
        if self.tags[-1] in RAW and tag != self.tags[-1]:
            return
        if tag == "head":
            self._end_head()
            return
        place = self._last((tag,))
        # an inline end tag does not end blocks around it
        if place >= 0 and (tag not in INLINE or not self.blocks or place > self.blocks[-1]):
            self._pop_to(place)
        if tag not in INLINE and tag not in SILENT and tag not in MATHML and not self.hush:
            self.block += 1

    def handle_data(self, data):
        if not self.hush:
            self.pieces.append((self.open[-1], self.block, data))


def _tokens(attrs) -> frozenset:
    found = set()
    for name, value in attrs:
        if name in ("class", "id", "role", "aria-label", "itemprop") and value:
            for t in _SPLIT.split(_CAMEL.sub(" ", value).lower()):
                if t in _TOKEN:
                    found.add(_TOKEN[t])
        elif name == "hidden" or name == "aria-hidden" and value == "true" or \
                name == "style" and value and "display:none" in value.replace(" ", "").lower():
            found.add(len(TOKENS) - 1)
    return frozenset(found)


def features(dom: Dom) -> np.ndarray:
    """(nodes, features), nodes in document order."""
    n = len(dom.tag)
    parent = np.array(dom.parent)
    chars, words, punct = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, _, text in dom.pieces:
        k = text.split()
        if k:
            chars[node] += sum(map(len, k)) + len(k) - 1
            words[node] += len(k)
            punct[node] += len(_PUNCT.findall(text))
    group = np.array([_GROUP.get(t, -1) for t in dom.tag])
    tag = np.zeros((n, len(TAGS)))
    tag[np.flatnonzero(group >= 0), group[group >= 0]] = 1
    name = np.zeros((n, len(TOKENS)))
    for i, s in enumerate(dom.names):
        for t in s:
            name[i, t] = 1
    is_a, is_p = group == _GROUP["a"], group == _GROUP["p"]
    is_h = group == _GROUP["h1"]
    below = np.stack([chars, words, punct, np.ones(n), is_a, is_p, np.zeros(n), np.zeros(n),
                      is_h], 1)
    above = np.concatenate([tag, name], 1)
    own = above.copy()
    depth, place, kids = np.zeros(n), np.zeros(n), np.zeros(n)
    in_a, in_p = is_a.astype(float), is_p.astype(float)
    for i in range(1, n):                            # down
        p = parent[i]
        depth[i] = depth[p] + 1
        place[i] = kids[p]
        kids[p] += 1
        if in_a[p]:
            in_a[i] = 1
        if in_p[p]:
            in_p[i] = 1
        if i > 1 or p:
            above[i] = np.maximum(above[i], above[p])
    below[:, 6], below[:, 7] = chars * in_a, chars * in_p
    for i in range(n - 1, 0, -1):                    # up
        below[parent[i]] += below[i]
    c, w, pu, tags, links, ps, link_c, p_c, heads = below.T
    up = np.maximum(parent, 0)
    safe = np.maximum(c, 1)
    same = np.zeros(n)
    keys: dict = {}
    for i in range(1, n):
        keys[parent[i], group[i]] = keys.get((parent[i], group[i]), 0) + 1
    for i in range(1, n):
        same[i] = keys[parent[i], group[i]]
    out = [np.log1p(c), np.log1p(w), np.log1p(chars), link_c / safe, p_c / safe,
           c / tags, pu / np.maximum(w, 1), np.log1p(tags), np.log1p(links), links / tags,
           w / np.maximum(ps, 1), np.minimum(depth, 50), np.minimum(place, 200), kids, kids[up],
           place / np.maximum(kids[up], 1), same, c / np.maximum(c[up], 1), c / max(c[0], 1),
           np.log1p(c[up]), link_c[up] / np.maximum(c[up], 1), np.log1p(ps[up]),
           np.log1p(heads), np.log1p(heads[up])]
    return np.concatenate([np.stack(out, 1), own, above], 1)


def decode(parent: list[int], p: np.ndarray) -> np.ndarray:
    """Most likely labels under 'nothing accepted below a rejected node'."""
    n = len(parent)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p), np.log(1 - p)
    for i in range(n - 1, 0, -1):
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    label = np.zeros(n, bool)
    label[0] = True
    for i in range(1, n):
        label[i] = label[parent[i]] and keep[i] >= drop[i]
    return label


def text_of(dom: Dom, label: np.ndarray) -> str:
    blocks: dict[int, list[str]] = {}
    for node, block, text in dom.pieces:
        if label[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: list[str | None], model: Trees) -> list[str]:
    """Main texts of a list of pages; all their nodes go down the trees at once."""
    doms = [Dom(h or "") for h in pages]
    ends = np.cumsum([len(d.tag) for d in doms])[:-1]
    p = sigmoid(model.margin(np.concatenate([features(d) for d in doms]))) if doms else []
    return [text_of(d, decode(d.parent, x)) for d, x in zip(doms, np.split(p, ends))]


# --- training pages ------------------------------------------------------------------

class _Composer:
    """Random labelled pages. Every element of a part that is main text is
    marked with the attribute ``y``."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo, hi):
        out = ["".join(self.r.choice("aeioulnrstmdbk") for _ in range(self.r.randint(2, 9)))
               for _ in range(self.r.randint(lo, hi))]
        for i in range(len(out)):
            if self.r.random() < 0.09:
                out[i] += self.r.choice(",.;:") if self.r.random() < 0.5 else "."
        return " ".join(out).capitalize()

    def names(self, *pools, silent=0.25):
        """A class or id attribute from the pools, or one that says nothing."""
        r = self.r.random()
        if r < silent:
            return "" if self.r.random() < 0.5 else f' class="{self.words(1, 1).lower()}-{self.r.randint(1, 9)}"'
        token = self.r.choice([t for k in pools for t in TOKENS[k]])
        token = self.r.choice(["{}", "{}-box", "site-{}", "page_{}", "c-{}"]).format(token)
        return f' {self.r.choice(["class", "id"])}="{token}"'

    def sentence_tag(self):
        s = self.words(4, 60) + "."
        if self.r.random() < 0.25:
            s += f' <{(t := self.r.choice(["b", "em", "a href=/x", "span"]))} y>{self.words(1, 4)}</{t.split()[0]}> {self.words(2, 12)}.'
        return s

    def paragraph(self):
        k = self.r.random()
        if k < 0.43:
            return f"<p y>{self.sentence_tag()}" + ("</p>" if self.r.random() < 0.9 else "")
        if k < 0.45:                             # a block that is one link
            return f"<p y><a href=/s y>{self.words(2, 14)}</a></p>"
        if k < 0.465:
            return "<ul y>" + "".join(f"<li y><a href=/s y>{self.words(2, 9)}</a></li>" for _ in range(self.r.randint(2, 4))) + "</ul>"
        if k < 0.52:                             # a name that misleads
            t = self.r.choice(["p", "p", "p", "div"])
            return f"<{t}{self.names(1, 4, 6, 7, 8, 9, silent=0)} y>{self.sentence_tag()}</{t}>"
        if k < 0.535:
            return f"<blockquote y><p y>{self.words(4, 30)}</p></blockquote><figure y><img src=x><figcaption y>{self.words(2, 12)}</figcaption></figure>"
        if k < 0.635:
            return f"<p y>{self.words(1, 12)}.</p>"
        if k < 0.70:
            return f"<p y><b y>{self.sentence_tag()}<br>"
        if k < 0.76:
            return f"<p y>{self.words(1, 5)}</p>"
        if k < 0.82:
            return f"<{(h := self.r.choice(['h2', 'h3']))} y>{self.words(1, 7)}</{h}>"
        if k < 0.88:
            return "<ul y>" + "".join(f"<li y>{self.words(3, 20)}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>"
        if k < 0.91:
            return f"<blockquote y><p y>{self.words(5, 40)}</p></blockquote>"
        if k < 0.94:
            return "<table y>" + "".join("<tr y>" + "".join(f"<td y>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 4))) + "</table>"
        if k < 0.97:
            return f"<div y>{self.sentence_tag()}</div>"
        return self.noise()

    def links(self, lo=3, hi=9, long=False):
        return "".join(f'<li><a href="/{i}">{self.words(1, 9 if long else 2)}</a></li>'
                       for i in range(self.r.randint(lo, hi)))

    def part(self, tags, body, *pools):
        tag = self.r.choice(tags)
        telling = tag not in ("div", "section", "ul", "p", "form")
        return f"<{tag}{self.names(*pools, silent=0.7 if telling else 0.0)}>{body}</{tag}>"

    def nav(self):
        return self.part(["nav", "div", "ul"], f"<ul>{self.links()}</ul>" if self.r.random() < 0.7 else " ".join(f"<a href=/{i}>{self.words(1, 2)}</a>" for i in range(5)), 1)

    def header(self):
        inner = f'<a href="/">{self.words(1, 3)}</a>' + (f"<p>{self.words(2, 10)}</p>" if self.r.random() < 0.5 else "") + (self.nav() if self.r.random() < 0.4 else "")
        return self.part(["header", "div"], inner, 2)

    def footer(self):
        inner = f"&copy; {self.words(1, 3)} &middot; {self.words(2, 30)}." if self.r.random() < 0.6 else f"<p>{self.words(3, 25)}</p><ul>{self.links()}</ul>"
        if self.r.random() < 0.2:                # a layout without names
            return f"<div>{inner}</div>"
        return self.part(["footer", "div"], inner, 3)

    def side(self):
        inner = f"<h3>{self.words(1, 3)}</h3>" + (f"<ul>{self.links(long=True)}</ul>" if self.r.random() < 0.6 else "".join(f"<p>{self.words(4, 30)}.</p>" for _ in range(self.r.randint(1, 3))))
        return self.part(["aside", "div", "section"], inner, 4)

    def ad(self):
        inner = self.r.choice([self.words(2, 40) + ".", f"<p>{self.words(3, 40)}.</p>", f'<a href="/buy">{self.words(2, 8)}</a>'])
        return self.part(["div", "aside", "section", "p"] if "<p" not in inner else ["div", "section"], inner, 5)

    def notice(self):
        inner = self.r.choice([f"<p>{self.words(5, 40)}.</p>", self.words(4, 25) + "."])
        return self.part(["div", "section", "aside"], inner, 6)

    def form(self):
        inner = f'<p>{self.words(2, 12)}</p><label>{self.words(1, 2)}</label><input name=q><button>Go</button>'
        f = f"<form{self.names(7)}>{inner}</form>"
        return f if self.r.random() < 0.6 else f"<div{self.names(7, silent=0.1)}>{f}</div>"

    def comments(self):
        one = lambda: f"<{(t := self.r.choice(['div', 'li', 'article']))}{self.names(8, silent=0)}><b>{self.words(1, 2)}</b><p>{self.words(4, 50)}.</p></{t}>"
        inner = f"<h3>{self.words(1, 2)}</h3>" + "".join(one() for _ in range(self.r.randint(1, 5)))
        return self.part(["section", "div"], inner, 8)

    def share(self):
        return self.part(["div", "ul"], " ".join(f"<a href=#>{self.words(1, 1)}</a>" for _ in range(4)), 9)

    def noise(self):
        return self.r.choice([self.ad, self.notice, self.form, self.share, self.side])()

    def page(self):
        r = self.r
        some = lambda p, f: f() if r.random() < p else ""
        body = [f"<h1 y>{self.words(2, 12)}</h1>"] + [self.paragraph() for _ in range(r.choice([1, 2, 2, 3, 4, 6, 9, 14]))]
        if r.random() < 0.2:
            del body[0]
        elif r.random() < 0.25:
            body[0] = f"<header y>{body[0]}</header>"
        if r.random() < 0.1:
            body.append(f"<footer>{self.words(2, 9)} <a href=/t>{self.words(1, 2)}</a></footer>")
        if r.random() < 0.3:
            body.insert(r.randint(1, len(body)), self.noise())
        if r.random() < 0.15:
            body.append(self.comments())
        if r.random() < 0.1:                     # a wrapper that is never closed
            body.insert(r.randint(0, len(body)), r.choice(["<div y>", "<section y>"]))
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        name = self.names(0, silent=0.6 if tag in ("article", "main") else 0.15)
        art = f"<{tag}{name} y>{''.join(body)}</{tag}>"
        if r.random() < 0.3:
            t = r.choice(["main", "div", "section"])
            art = f"<{t}{self.names(0, silent=0.6)} y>{art}{some(.3, self.share)}{some(.3, self.comments)}</{t}>"
        if r.random() < 0.3:
            art = f"<div y>{some(.5, self.side)}{art}{some(.6, self.side)}</div>"
        return (f"<html y><head><title>{self.words(1, 5)}</title></head><body y>"
                f"{some(.3, self.notice)}{some(.5, self.header)}{some(.8, self.nav)}"
                f"{some(.6, self.ad)}{some(.2, self.form)}{art}{some(.3, self.comments)}"
                f"{some(.3, self.side)}{some(.15, self.form)}{some(.15, self.ad)}{some(.8, self.footer)}"
                f"{some(.2, self.notice)}" + ("</body></html>" if r.random() < 0.9 else ""))


class _Labelled(Dom):
    def _push(self, tag, attrs):
        super()._push(tag, [a for a in attrs if a[0] != "y"])
        self.y = getattr(self, "y", [1.0])
        if len(self.tag) > len(self.y):
            self.y.append(float(("y", None) in attrs))


@lru_cache(4)
def trained(pages: int = 1000, seed: int = 5) -> Trees:
    """The trees, fitted on ``pages`` composed pages."""
    make, xs, ys = _Composer(seed), [], []
    for _ in range(pages):
        dom = _Labelled(make.page())
        xs.append(features(dom)), ys.append(np.array(dom.y))
    return boost(np.concatenate(xs), np.concatenate(ys), trees=100, depth=5, bins=32)


def main_text(pages: DataFrame, model: Trees | None = None, id_col: str = "page_id",
              url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id_col, url_col, text, n_chars (its code points)."""
    model = model or trained()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"))

    def run(batches):
        for b in slices(batches, "html", 1 << 20):
            text = extract(b.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("url"), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long") \
        .withColumnsRenamed({"id": id_col, "url": url_col})
