import html as H
import re

import duckdb
import numpy as np
import pytest

from tessera.llm import html_extract as X
from tessera.llm import queries

P = "<p>A plain paragraph of the text, long enough to read; it goes on, and on.</p>"
T = "A plain paragraph of the text, long enough to read; it goes on, and on."


@pytest.fixture(scope="module")
def model():
    return X.trained()


def one(html, model):
    return X.extract([html], model)[0]


def expected(html):
    """Independent reading of the driver's template: the article's blocks."""
    body = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
    blocks = [" ".join(H.unescape(re.sub(r"<[^>]+>", " ", b)).split())
              for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_driver_pages(spark):
    sf = "/root/testdata/sf0.1"
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{sf}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in queries.QUERIES["op1_html_extract"](spark, sf).collect()}
    assert len(got) == len(pages)
    for i, url, html in pages:
        assert (got[i]["url"], got[i]["text"]) == (url, expected(html)), i
        assert got[i]["n_chars"] == len(got[i]["text"])


@pytest.mark.parametrize("noise", [
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>",
    "<div class='menu'><a href=/a>Home</a> <a href=/b>News</a> <a href=/c>About us</a></div>",
    "<header><a href=/>The Site</a><p>A slogan of the site</p></header>",
    "<footer><p>&copy; 2024 The Site. All rights reserved.</p></footer>",
    "<div id='footer'><p>Imprint and contact.</p><ul><li><a href=/i>Imprint</a></ul></div>",
    "<aside><h3>Related</h3><ul><li><a href=/1>Another long headline to read</a></ul></aside>",
    "<div class='sidebar'><h3>Popular</h3><p>Some words on another matter.</p></div>",
    "<div class='cookie-notice'><p>We use cookies to make this site work for you.</p></div>",
    "<div class='ad'>Buy this now, it is cheap and good.</div>",
    "<div class='advert'><p>Buy this now, it is cheap and good.</p></div>",
    "<form class='newsletter'><p>Get our mail.</p><label>Mail</label><input><button>Go</button></form>",
    "<section id='comments'><h3>Comments</h3><div class='comment'><b>Joe</b><p>I do not agree "
    "with this text at all, sorry.</p></div></section>",
    "<script>var x = '<p>no</p>';</script><style>p{color:red}</style>"])
def test_parts_that_are_no_article(noise, model):
    art = f"<article><h1>The title of it</h1>{P * 4}</article>"
    for page in (f"<html><body>{noise}{art}</body></html>", f"<html><body>{art}{noise}</body></html>"):
        assert one(page, model) == "\n".join(["The title of it", *[T] * 4])


def test_blocks_references_and_malformed_markup(model):
    page = ("<html><body><article><h1>A &amp; B &eacute; &#8217; &#x27; &copy</h1>"
            f"<p>one\n two\t<b>three</b>four<br>five&nbsp;six<p>seven</article>")
    assert one(page, model) == "A & B é ’ ' ©\none two threefour five six\nseven"
    nested = f"<html><body><article>{P}<div title='a > b'>{P}<ul><li>x y z<li>u v w</ul>{P}"
    assert one(nested, model).split("\n") == [T, T, "x y z", "u v w", T]


@pytest.mark.parametrize("before", [
    "<svg class=i/>", "<math class=i/>", "<svg><path d=x/><g/><title/></svg>", "<div><svg><path></div>",
    "<div><button>Go</div>", "<div><span><button>Go</span></div>", "<div><noscript><img src=x></div>",
    "<div><canvas>none</div>", "<p><map name=m><area></p>", "<div><datalist><option>x<option>y</div>",
    "<div><button><div>a</div><b>b</button></div>", "<button>a<button>b</button>",
    "<div><object><p>no</div>", "<div><select><option>x</div>", "<svg class=i><path>"])
def test_silent_elements_end_where_their_parent_does(before, model):
    art = f"<article><h1>The title of it</h1>{P * 4}</article>"
    for page in (f"<html><body>{before}{art}</body></html>", f"<html><head>{before}</head><body>{art}</body></html>",
                 f"<html><body><div>{before}{art}</div></body></html>"):
        dom = X.Dom(page)
        text = X.text_of(dom, np.ones(len(dom.tag), bool))
        assert text == "\n".join(["The title of it", *[T] * 4])
        assert one(page, model) == text


def test_silent_contents_and_math(model):
    every = lambda h: X.text_of(d := X.Dom(h), np.ones(len(d.tag), bool))
    assert every("<div>a <button><div>x</div>y</button> b</div> c") == "a b\nc"
    assert every("<head><noscript><img></head><body>a<noscript><p>b<div>c</div></noscript>d") == "ad"
    assert every("<p>a<svg><foreignObject><p>x</p></foreignObject><text>y</text></svg>b</p>") == "ab"
    assert every("<div><textarea></div>x</textarea>a</div>") == "a"
    formula = ("<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn><mspace/></mrow>"
               "<annotation encoding='application/x-tex'>x=2</annotation></semantics></math>")
    page = f"<html><body><article>{P * 2}<p>The value {formula} holds here, as was said.</p>{P}</article>"
    assert one(page, model) == "\n".join([T, T, "The value x=2 holds here, as was said.", T])


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "just text &lt; here"), (None, "u", "<<<>>>"),
            (4, "u", "<p>x</p>"), (4, "u", "<p>x</p>"), (5, "u", "<script>never closed"),
            (6, "u", "<table>" + "<tr><td></td>" * 20_000 + "end"), (7, "u", "<div>" * 20_000),
            (8, "u", "</p></div>" * 1000 + "<!-- open")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string") \
        .selectExpr("*", "url AS text", "1 AS n_chars", "html AS id")
    got = X.main_text(pages, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = [(r["page_id"], r["url"], r["text"]) for r in got.collect()]
    assert len(out) == len(rows)
    assert (1, "u", "") in out and (2, "u", "") in out and (5, "u", "") in out
    assert (3, None, "just text < here") in out
    assert out.count(next(x for x in out if x[0] == 4)) == 2
    assert X.main_text(pages.limit(0), model).count() == 0


def test_decoding_never_accepts_below_a_rejected_node():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(2, 9))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        p = rng.random(n)
        got = X.decode(parent, p)
        best = max((m for m in range(2 ** n) if m & 1 and all(
            not (m >> i & 1) or (m >> parent[i] & 1) for i in range(1, n))),
            key=lambda m: sum(np.log(p[i] if m >> i & 1 else 1 - p[i]) for i in range(1, n)))
        assert got.tolist() == [bool(best >> i & 1) for i in range(n)]


def test_composed_pages_held_out(model):
    make, same = X._Composer(4242), 0
    for _ in range(150):
        dom = X._Labelled(make.page())
        label = X.decode(dom.parent, X.sigmoid(model.margin(X.features(dom))))
        same += X.text_of(dom, label) == X.text_of(dom, np.array(dom.y) > 0)
    assert same >= 140


def test_malformed_markup_never_fails(model):
    rng = np.random.default_rng(8)
    pool = ["<![foo bar]>", "<![CDATA[x]]>", "<!--", "-->", "<!", "<?", "</", "<", ">", "<a ", "<p", "<div>", "</b>",
            "<b>", "&#", "&#99999999999999999999;", "&#x110000;", "&#" + "1" * 5000, "&amp", "'", '"', "=", "<td><tr>",
            "</p></p>", "<svg/>", "<math><mi>x", "<script>", "</script >", "<title>", "text ", "\x00", "<li>", "<a x='"]
    for _ in range(600):
        bad = "".join(rng.choice(pool, rng.integers(1, 30)))
        one(bad, model)
        assert one(f"{bad}", model) == one(bad, model)
    art = f"<html><body><article><h1>The title of it</h1>{P}<![foo bar]>{P}&#{'1' * 5000};{P}</article>"
    assert one(art, model).split("\n")[:3] == ["The title of it", T, T]
    assert one(art + "<!-- never closed <p>no", model) == one(art, model)


@pytest.mark.parametrize("shape", [
    lambda n: "<a " * n, lambda n: "<b>" + "<div>" * n + "</b>" * n, lambda n: "<!--" * n,
    lambda n: "<ul>" + "<li><b>" * n, lambda n: "</" * n + ">", lambda n: "<![" * n, lambda n: "<table>" + "<td>" * n])
def test_time_grows_with_the_page(shape):
    import time

    def seconds(n):
        t = time.perf_counter()
        X.Dom(shape(n))
        return time.perf_counter() - t
    seconds(100)
    assert min(seconds(16_000) for _ in range(3)) < 12 * min(seconds(4_000) for _ in range(3)) + 0.05


@pytest.mark.parametrize("block,text", [
    ("<p><a href=/x>A linked paragraph of words</a></p>", ["A linked paragraph of words"]),
    ("<ul><li><a href=/x>first link item</a></li><li><a href=/y>second link item</a></li></ul>",
     ["first link item", "second link item"]),
    ("<blockquote>Quoted words of someone, at length.</blockquote><figure><img src=x>"
     "<figcaption>A caption</figcaption></figure>", ["Quoted words of someone, at length.", "A caption"])])
def test_blocks_of_an_article_that_look_like_others(model, block, text):
    page = (f"<html><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>One</a></li><li>"
            f"<a href=/b>Two</a></li></ul></nav><article><h1>The title of it</h1>{P}{block}{P}</article>"
            "<footer>Copyright 2024 Someone.</footer></body></html>")
    assert one(page, model).split("\n") == ["The title of it", T, *text, T]


def test_copyright_line_without_names(model):
    page = (f"<html><body><div><a href=/>Home</a></div><div><h1>The title of it</h1>{P * 3}</div>"
            "<div>&copy; 2024 Example Company. All rights reserved.</div></body></html>")
    assert one(page, model).split("\n") == ["The title of it", T, T, T]
