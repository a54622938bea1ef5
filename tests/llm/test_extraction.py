"""Main text of pages: the field against enumerating all labels, whole pages by hand."""

from __future__ import annotations

import html
import itertools
import re
import time

import numpy as np
import pytest

from galeledger.llm import html_extraction, queries
from galeledger.llm.html_blocks import blocks, score
from galeledger.llm.html_extraction import best_labels, extract, likelihood, main_text, trained
from galeledger.llm.labelled_pages import MARK, labelled_pages


def texts(page):
    return [b.text for b in blocks(page, {})]


def total(theta, k, flat, labels, first):
    value = sum(flat[i] @ theta[:k] for i, label in enumerate(labels) if label) + theta[k] * labels[0]
    pairs = theta[k + 1 :].reshape(2, 2)
    return value + sum(pairs[a, b] for a, b in zip(labels, labels[1:]))


def test_likelihood_and_slope_equal_enumeration():
    rng = np.random.default_rng(1)
    sizes, k = [4, 1, 3], 5
    real = np.arange(4) < np.array(sizes)[:, None]
    y = rng.integers(0, 2, (3, 4)) * real
    flat = rng.normal(size=(8, k))
    theta = rng.normal(size=k + 5)

    def plain(theta):
        value, at = 0.0, 0
        for n, labels in zip(sizes, y):
            some = flat[at : at + n]
            every = [total(theta, k, some, s, 0) for s in itertools.product([0, 1], repeat=n)]
            value += total(theta, k, some, labels[:n], 0) - np.logaddexp.reduce(every)
            at += n
        return value / 8 - 0.3 * (theta**2).sum() / 8

    value, slope = likelihood(theta, flat, y, real, 0.3)
    assert value == pytest.approx(plain(theta))
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert slope[i] == pytest.approx((plain(theta + step) - plain(theta - step)) / 2e-5, abs=1e-6)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(60):
        scores = rng.normal(size=rng.integers(1, 8)).tolist()
        theta = rng.normal(size=6)
        theta[0] = 1.0
        field = html_extraction.Field({}, theta[1], (tuple(theta[2:4]), tuple(theta[4:])))
        flat = np.array(scores)[:, None]
        best = max(itertools.product([0, 1], repeat=len(scores)), key=lambda s: total(theta, 1, flat, s, 0))
        assert best_labels(scores, field) == list(best)
    assert best_labels([], field) == []


def test_held_out_pages():
    field, wrong, n = trained(), 0, 0
    for page in labelled_pages(300, seed=1):
        labels = [int(t.startswith(MARK)) for t in texts(page)]
        found = blocks(page.replace(MARK, ""), field.weights)
        assert len(found) == len(labels)
        wrong += sum(a != b for a, b in zip(labels, best_labels([score(b, field.weights) for b in found], field)))
        n += len(labels)
    assert wrong <= 0.005 * n


def test_own_labelled_pages_and_none(table):
    own = [f"<p>{MARK}yes</p><div>no</div>"] * 5
    page = table([("<p>a</p><div>b</div><p>c</p>",)], "html string").selectExpr("1L page_id", "'u' url", "html")
    assert extract(page, own).first()["text"] == "a\n\nc"
    assert extract(page, []).count() == 1


def test_blocks():
    assert texts("<p>a <b>b</b>c<br>d<p>e") == ["a bc d", "e"]
    assert texts("a<div>b</div>c<ul><li>d<li>e<ul><li>f</ul>g</ul>h") == list("abcdefgh")
    assert texts("<table><tr><td>a<td>b<tr><td><p>c</td></table>d") == list("abcd")
    assert texts("<dl><dt>a<dd>b<dt>c</dl><hr>d<h1>e</h1>f") == list("abcdef")
    assert texts("<script>if (a<b) '</p>'</script>a<style>p{}</style><!-- x > y -->b<!-->c") == ["abc"]
    assert texts("<title>no</title><TEXTAREA><p>no</TextArea ><P CLASS=x>yes</P>") == ["yes"]
    assert texts('<a title="x > y" href=\'<p>\'>a</a><p title=a>b</b>b</section>b') == ["a", "bbb"]
    assert texts("&lt;p&gt; &amp;amp; &eacute;&#233;&#xE9; &copy &AM &#x110000;") == ["<p> &amp; ééé © &AM �"]
    assert texts("<p>&nbsp;  a\t\n\x0b b &#32;</p><p>&nbsp; </p>") == ["a b"]
    assert texts("1 < 2 <3 </ x><?php y?><!doctype html>z") == ["1 < 2 <3 z"]
    assert texts("<script>never closed <p>a") == [] and texts("a<!-- never") == ["a"] and texts("a<p cl") == ["a"]
    assert texts("<p title='never closed>a</p>b") == ["a", "b"]
    assert texts("a</div>b</p>c</li>d") == ["ab", "cd"]
    assert texts("") == texts("<p></p>") == texts(" \n") == []


PAGES = {
    # Names only, something foreign inside, comments behind.
    '<div class="menu"><a href=x>Home</a></div><div class="post"><p>Short.</p><p>Another.</p><div class="ad">'
    'Buy this now.</div><p>End.</p></div><div id="comments"><p>I like this long text, it is nice.</p></div>':
        "Short.\n\nAnother.\n\nEnd.",
    # A heading inside the article's own header; asides, tags, an article that is a comment.
    "<header><h1>Site</h1></header><main><article><header><h1>Title</h1><p>By X</p></header><p>Text &amp; more."
    "<aside>Side note</aside><p>More<footer>Tags</footer></article><section class=comments><article><p>Nice one, I "
    "say, and very good it was.</article></section></main><footer>c</footer>": "Title\n\nBy X\n\nText & more.\n\nMore",
    # Notices, forms, newsletters, a sidebar with whole sentences.
    '<div class="cookie-banner">We use cookies</div><form><p>Search this long site for what you want.</p></form>'
    "<article><h1>T</h1><p>x</p></article><div class=newsletter><p>Sign up, it costs nothing at all.</p></div>"
    "<aside><p>Long text is in the aside, which is to be dropped, as it says.</p></aside>": "T\n\nx",
    # A main element, lists, tables and quotes.
    "<nav><a>A</a></nav><main><h1>T</h1><ul><li>One<li>Two</ul><blockquote><p>Q.</blockquote><table><tr><td>1<td>2"
    "</table><pre>a  b</pre></main>": "T\n\nOne\n\nTwo\n\nQ.\n\n1\n\n2\n\na b",
    # No names at all.
    "<ul><li><a>A</a><li><a>B</a></ul><h1>Head</h1><p>A first sentence that is quite long, with a second. It is here."
    "</p><p>One more paragraph with words enough to be one.</p><hr><p>© Someone</p>":
        "Head\n\nA first sentence that is quite long, with a second. It is here.\n\nOne more paragraph with words "
        "enough to be one.",
    "": "",
    "<nav><a>only a menu</a></nav>": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert main_text(page, trained()) == PAGES[page]


def test_odd_rows(table):
    good = "<nav><a>x</a></nav><article><h1>T</h1><p>é &eacute; 😀.</p></article>"
    long = "<article>" + "<p>some words of an article.</p>" * 160_000 + "</article>"
    rows = [(1, "u", good, 1, "x"), (1, "u", good, 1, "x"), (None, None, good, 2, None), (2, "v", None, 3, None)]
    rows += [(3, "w", "", 0, ""), (4, "y", long, 0, ""), (5, "z", "<" * 1000, 0, "")]
    found = extract(table(rows, "page_id long, url string, html string, n_chars int, text string"))
    text = "T\n\né é 😀."
    by_key = {}
    for r in found.collect():
        by_key.setdefault((r["page_id"], r["url"]), []).append((r["text"], r["n_chars"]))
    assert by_key[1, "u"] == [(text, 9)] * 2 and by_key[None, None] == [(text, 9)]
    assert by_key[2, "v"] == by_key[3, "w"] == [("", 0)]
    assert by_key[4, "y"][0][0] == "\n\n".join(["some words of an article."] * 160_000)
    assert len(by_key) == 6 and found.columns == ["page_id", "url", "text", "n_chars"]
    assert extract(table([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize(
    "piece",
    ["<div>", "</div>", "<p>", "<li>", "<ul><li>", "<a href=\"", "<!-", "<a b='", "&amp", "<td>", "<article>", "<b>x", "</", "=<a ="],
)
def test_time_is_in_proportion(piece):
    field = trained()
    start = time.time()
    main_text(piece * 60_000 + "end", field)
    assert time.time() - start < 5


def test_whole_table_against_reading_the_article_by_pattern(spark):
    """The driver's pages have one shape, so a pattern can read them."""
    sf_dir = "/root/testdata/sf0.001"

    def plain(page):
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = [re.sub(r"<[^>]*>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", article)]
        return "\n\n".join(t for p in parts if (t := " ".join(html.unescape(p).split())))

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    expected = sorted((p["page_id"], p["url"], plain(p["html"]), len(plain(p["html"]))) for p in pages)
    assert sorted(tuple(r) for r in queries.op13_html_extraction(spark, sf_dir).collect()) == expected
