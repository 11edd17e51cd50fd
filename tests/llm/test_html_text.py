import itertools

import numpy as np
import pytest
from llm_cases import empty_docs, table, with_clashes

from cohortlab.llm import crf
from cohortlab.llm import html_text as H
from cohortlab.llm.dom import FEATURES, block_features, blocks_of
from cohortlab.llm.labelled_pages import LABEL, written_pages

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def weights(spark):
    return H.train(table(spark, "pages"))


def paths(u, w):
    """Score of every labelling."""
    for y in itertools.product((0, 1), repeat=len(u)):
        yield y, w.first[y[0]] + sum(u[t] for t in range(len(u)) if y[t]) + sum(w.step[a, b] for a, b in zip(y, y[1:]))


def test_field_against_all_labellings():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 5, 7):
        w = crf.Weights(np.zeros(0), rnd.normal(size=2), rnd.normal(size=(2, 2)))
        u = rnd.normal(size=n)
        scores = dict(paths(u, w))
        assert tuple(crf.viterbi(u, w)) == max(scores, key=scores.get)
        z = sum(np.exp(s) for s in scores.values())
        padded = np.zeros((2, n + 3))
        padded[0, :n] = u
        padded[1, 0] = 1.0
        total, p, _ = crf.marginals(padded, np.array([n, 1]), w)
        assert np.isclose(total[0], np.log(z)) and np.allclose(p[0, :n], [sum(np.exp(s) for y, s in scores.items() if y[t]) / z for t in range(n)])


def test_gradient_against_differences():
    rnd = np.random.default_rng(5)
    features = [[[0, 2], [1], [], [0, 1, 3]], [[3]], [[2, 2], [0]]]
    labels = [[0, 1, 1, 0], [1], [0, 0]]
    x = rnd.normal(size=10)
    _, g = crf.loss_and_gradient(x, features, labels)
    for k in range(10):
        d = np.zeros(10)
        d[k] = 1e-5
        assert np.isclose((crf.loss_and_gradient(x + d, features, labels)[0] - crf.loss_and_gradient(x - d, features, labels)[0]) / 2e-5, g[k], atol=1e-6)


def test_blocks():
    page = ("<!DOCTYPE html><head><title>no</title><style>p{}</style></head><body><p>a &amp; b<br>c<b>d</b>\n\t e<p>two<div>in<p>ner</div>tail"
            "<ul><li>x<li>y <ul><li>z</ul></ul><script>var t='<p>no</p>'</script><!-- <p>no</p> --><td>cell</td>&lt;p&gt; &#65;<img alt='>'>end<a href='")
    assert [t for t, _, _ in blocks_of(page)] == ["a & b cd e", "two", "in", "ner", "tail", "x", "y", "z", "cell", "<p> Aend"]
    assert blocks_of(None) == blocks_of("") == blocks_of("<script>unclosed <p>text") == [] and blocks_of("plain")[0][0] == "plain"
    assert [t for t, _, _ in blocks_of("</p></div>x</b></b><p>y</html>z")] == ["x", "y", "z"]


def test_deep_and_long_pages():
    deep = "<div class='a b'>" * 20_000 + "deep" + "</div>" * 20_000
    assert [t for t, _, _ in blocks_of(deep)] == ["deep"]
    long = "<body>" + "<p>some words</p>" * 50_000 + "<p " * 1000
    assert len(blocks_of(long)) == 50_000
    assert blocks_of("<a href=\"" * 20_000) == []


def test_written_pages_held_out(weights):
    wrong = items = 0
    for page in written_pages(200, seed=77):
        blocks = blocks_of(page, LABEL)
        found = crf.viterbi(crf.unary(weights.item, block_features(blocks)), weights)
        wrong += sum(a != (e.mark == "main") for a, (_, _, e) in zip(found, blocks))
        items += len(blocks)
    assert wrong < 0.02 * items and len(weights.item) == FEATURES


FILLER = "The committee met on Tuesday, and after a long debate it agreed to rebuild the old harbour wall."


def test_pages_of_other_kinds(weights):
    blog = f"""<html><body class="home"><div id="header"><a href="/">My blog</a><p>Just another site</p></div>
      <div class="nav-menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></div>
      <div class="cookie-banner">We use cookies. <button>OK</button></div>
      <div class="entry-content"><h1>Harbour wall</h1><p>{FILLER}</p><div class="advertisement">Buy cheap shoes now!</div><p>{FILLER} Work starts in May.</p></div>
      <div id="comments"><h3>2 comments</h3><div class="comment"><p>{FILLER} I was there.</p></div></div>
      <div class="sidebar"><h4>Archive</h4><ul><li><a href="/1">May</a></li></ul></div><div id="footer">&copy; 2020 My blog</div></body></html>"""
    assert H.main_text(blog, weights).split("\n") == ["Harbour wall", FILLER, f"{FILLER} Work starts in May."]
    news = f"""<body><header><h2>Daily News</h2><nav><a href=/s>Sport</a> <a href=/w>Weather</a></nav></header><main><article><h1>Wall &amp; harbour</h1>
      <p>{FILLER}</p><ul><li>{FILLER}</li></ul><aside><h3>Related</h3><a href=/x>Other walls</a></aside><p>{FILLER}</p>
      <form>Sign up <input><button>Go</button></form></article><section class="comments"><p>{FILLER}</p></section></main><footer>All rights reserved.</footer></body>"""
    assert H.main_text(news, weights).split("\n") == ["Wall & harbour", FILLER, FILLER, FILLER]


def test_edges(spark, weights):
    rows = [(1, "http://a", None), (2, None, ""), (None, None, "<p>"), (3, "x", f"<article><p>{FILLER}</p></article>"), (3, "x", f"<article><p>{FILLER}</p></article>"),
            (None, None, None), (4, "y", "<article>" + f"<p>{FILLER}</p>" * 5000 + "</article>")]
    got = H.extract_text(with_clashes(spark.createDataFrame(rows, PAGES)), weights).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (0, 0), (1, 0), (2, 0), (3, len(FILLER)), (3, len(FILLER)), (4, 5000 * (len(FILLER) + 1) - 1)]
    assert all(r["text"] is not None for r in got) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}


def test_empty_table(spark):
    none = empty_docs(spark).selectExpr("doc_id AS page_id", "source AS url", "text AS html")
    assert H.extract_text(none).count() == 0


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(1, "u", "<p>x")], PAGES)
    w = H.train(none, written=0)
    assert not w.item.any() and H.extract_text(none, w).first()["text"] == ""
