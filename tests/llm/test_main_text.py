import os

import numpy as np
import pytest

from tickloom.llm import main_text as mt

SF = os.environ.get("TICKLOOM_SF_TEXT", "/root/testdata/sf0.01")
PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li>'
    '<li><a href="/x">News</a></ul></nav><!-- no --><div class="ad">Buy now</div><article><h1>Head &amp; tail</h1><p><b>One\n  two<br>three'
    "<p>Four &eacute;&#33;</p></article><footer>&copy; us</footer>")


def test_blocks_of_a_page():
    found = mt.blocks(PAGE)
    assert [b.text for b in found] == ["T", "Home", "News", "Buy now", "Head & tail", "One two three", "Four é!", "© us"]
    mt.weak_labels(found)
    assert [b.label for b in found] == [0, 0, 0, 0, 1, 1, 1, 0]
    assert [t for t, _ in found[5].path] == ["html", "body", "article", "p"]
    assert found[1].linked == 4 and found[4].linked == 0


@pytest.mark.parametrize("html,texts", [
    (None, []), ("", []), ("   ", []), ("plain", ["plain"]), ("a < b > c", ["a < b > c"]), ("<p>a<p>b", ["a", "b"]), ("<p>a", ["a"]),
    ("</div>a</p>", ["a"]), ("<![CDATA[x]]>y<p>z", ["y", "z"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<p>a&nbsp; b c</p>", ["a b c"]), ("<script>x", []), ("<textarea>t</textarea>", ["t"]), ("<P CLASS=X>A</P>", ["A"]), ("<a>x</a> <b>y</b>", ["x y"]),
])
def test_odd_html(html, texts):
    assert [b.text for b in mt.blocks(html)] == texts


@pytest.mark.parametrize("html,texts", [
    ("<p>a<![if !IE]>b<![endif]>c</p>", ["abc"]), ("x<![CDATA[hidden]]>y", ["xy"]), ("b<!-- unclosed <p>c", ["b"]),
    ("<!--[if IE]><p>old</p><![endif]--><p>new</p>", ["new"]), ("a<!-->b<!--->c<!-- x --!>d", ["abcd"]), ("a<!", ["a"]), ("a<![CDATA[ no end", ["a"]),
    ("<!DOCTYPE html><p>t</p>", ["t"]), ("<!ELEMENT p>q", ["q"]), ("<?php echo 1 ?>r", ["r"]), ("<script>if (a<!--b) x</script><p>s</p>", ["s"]),
    ("a<!-- x -- y - > -->b", ["ab"]), ("1 < 2 <!- 3> 4", ["1 < 2 4"]),
])
def test_comments_and_marked_sections_are_no_text(html, texts):
    assert [b.text for b in mt.blocks(html)] == texts


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    w, u = rng.normal(size=(mt.INPUT, 4 * mt.HIDDEN)) * 0.1, rng.normal(size=(mt.HIDDEN, 4 * mt.HIDDEN)) * 0.3
    x, mask = rng.normal(size=(5, 3, mt.INPUT)), np.ones((5, 3))
    mask[3:, 1] = 0
    weight = rng.normal(size=(5, 3, mt.HIDDEN))
    loss = lambda w, u: float((mt._pass(w, u, x.astype(np.float64), mask, range(5))[0] * weight).sum())
    _, saved = mt._pass(w, u, x, mask, range(5))
    dw, du = mt._pass_gradient(u, x, weight, saved)
    for grad, which in ((dw, 0), (du, 1)):
        for _ in range(6):
            at = tuple(rng.integers(n) for n in grad.shape)
            up, down = [w.copy(), u.copy()], [w.copy(), u.copy()]
            up[which][at] += 0.01
            down[which][at] -= 0.01
            assert abs(grad[at] - (loss(*up) - loss(*down)) / 0.02) < 1e-2 * max(1, abs(grad[at]))


@pytest.fixture(scope="module")
def labeller(spark):
    pages = [(k, PAGE.replace("Four", "Four " * (k % 7)).replace("Buy now", f"Buy {k}")) for k in range(60)]
    return mt.fit(spark.createDataFrame(pages, "page_id long, html string"))


def test_other_templates(labeller):
    html = (
        '<html><body><div class="header">Site</div><div class="menu"><ul><li><a href="/">One</a></ul></div><div class="content"><h1>Title</h1><p>First text here.</p>'
        '<div class="share">Tweet</div><p>Second text here.</p><section class="comments"><p>Nice post</p></section></div><div class="sidebar"><p>More</p></div>'
        '<div class="cookie notice">We use cookies</div><form><p>Mail</p></form><div class="copyright">us</div></body></html>')
    found = mt.blocks(html)
    scores = labeller.scores([mt.vectors(found)])[0]
    assert [b.text for b, p in zip(found, scores, strict=True) if p > 0.5] == ["Title", "First text here.", "Second text here."]


def test_a_page_does_not_depend_on_its_batch(labeller):
    pages = [mt.vectors(mt.blocks(PAGE + "<p>x" * n)) for n in (0, 3, 50)]
    together = labeller.scores(pages)
    assert all(np.allclose(labeller.scores([p])[0], s, atol=1e-5) for p, s in zip(pages, together, strict=True))


def test_awkward_rows(spark, labeller):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p>" * 3000 + "deep"), (5, "u", "<article>" + "<p>word</p>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "html as text", "page_id as n_chars")
    got = mt.extract(pages, labeller).collect()
    assert len(got) == len(rows) and all(len(r["text"]) == r["n_chars"] for r in got)
    assert [r["text"] for r in got[:5]] == ["Head & tail One two three Four é!"] * 3 + ["", ""]
    assert got[6]["n_chars"] == 20_000 * 5 - 1
    assert mt.extract(pages.limit(0), labeller).collect() == []
    assert mt.fit(pages.limit(0)).scores([mt.vectors(mt.blocks(PAGE))])[0].shape == (8,)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_articles_of_the_test_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: " ".join(html.unescape(re.sub("<[^>]+>", " ", r["html"].split("<article>")[1].split("</article>")[0])).split()) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in mt.extract(pages, mt.fit(pages)).collect()}
    assert sum(got[k] != t for k, t in want.items()) <= 0.01 * len(want)


def test_copies_and_large_pages_are_examples(spark, monkeypatch):
    shown = []
    monkeypatch.setattr(mt, "train", lambda pages, seed: shown.extend(pages))
    page = lambda k, n=1: f"<html><body><article><h1>page {k}</h1>" + f"<p>{'words ' * 9}</p>" * n + "</article></body></html>"
    rows = [page("copied")] * 5000 + [page(k) for k in range(100)]
    mt.fit(spark.createDataFrame([(h,) for h in rows], "html string"))
    assert len(shown) == 101 * (1 + mt.VARIANTS)
    shown.clear()
    mt.fit(spark.createDataFrame([(page(k, 2000),) for k in range(5)], "html string"))
    assert len(shown) == 5 * (1 + mt.VARIANTS) and all(len(p) >= mt.SAMPLE_BLOCKS for p in shown)
