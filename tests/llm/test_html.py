"""Main text of pages: the graphical model against enumeration, the parser, and texts of pages held out from training."""

from __future__ import annotations

import itertools
import random
import re
from html import unescape

import numpy as np
import pytest

from lodestone.llm import html

PAGES = "page_id long, url string, html string, blocks int, seed string, text string"


def article_text(page: str) -> str:
    """What the given pages' one article says, by patterns that hold for these pages only."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inside))).split())


def texts(page: str) -> list[str]:
    return [t for t in html.parse(page).text if t]


def test_sum_product_is_exact():
    r, g = random.Random(3), np.random.default_rng(3)
    t = html.parse("<body><nav class=menu><a>x</a></nav><div id=main><article><h1>T</h1><p>one, two.</p>bare</article></div><p>z")
    f = html.forest([t, html.parse("<p>a"), html.parse(""), html.parse("<ul><li>q<li>w</ul>")])
    m = html.Model(g.normal(size=html.N_FEATURES), g.normal(size=len(html.HINTS)), g.normal(size=(html.N_EDGES, 2, 2)))
    p, pairs = html.sum_product(f, m)
    unary = m.unary[f.features].sum(1) + f.hints @ m.hints
    total, own, both = 0.0, np.zeros(len(unary)), np.zeros((len(unary), 2, 2))
    for y in itertools.product((0, 1), repeat=len(unary)):
        w = np.exp(sum(u for u, v in zip(unary, y, strict=True) if v) + sum(m.edges[f.edge[i], y[f.parent[i]], y[i]] for i in range(len(y)) if f.parent[i] >= 0))
        total += w
        for i, v in enumerate(y):
            own[i] += w * v
            if f.parent[i] >= 0:
                both[i, y[f.parent[i]], v] += w
    assert np.allclose(p, own / total)
    assert np.allclose(pairs, both / total)
    assert r


def test_fit_recomputed():
    """One step of the fit is the gradient that differences of the likelihood show."""
    trees = [html.parse(html.layout(random.Random(i), ["Title", "A text, of some words."], ["menu"])) for i in range(4)]
    m = html.fit(trees, 1)
    f = html.forest(trees)

    def likelihood(unary: np.ndarray) -> float:
        zero = html.Model(unary, np.zeros(len(html.HINTS)), np.zeros((html.N_EDGES, 2, 2)))
        p, _ = html.sum_product(f, zero)
        return float(np.log(np.where(f.label == 1, p, 1 - p)).sum() / len(p))

    for k in np.unique(f.features)[:12]:
        up = np.zeros(html.N_FEATURES)
        up[k] = 1e-5
        slope = (likelihood(up) - likelihood(-up)) / 2e-5
        assert abs(slope) < 1e-9 or np.sign(slope) == np.sign(m.unary[k])


def test_blocks():
    assert texts('<script>var t="</p>";</script><p>a<b>b</b> c<br>d <!-- no <p> --> e<p>f') == ["ab c d e", "f"]
    assert texts("<ul><li>one<li>two<ul><li>in</ul>more</ul><table><tr><td>x<td>y<tr><th>z</table>") == ["one", "two", "in", "more", "x", "y", "z"]
    assert texts("&lt;b&gt; &amp &#65; &eacute;&nbsp;\n x &am") == ["<b> & A é x &am"]
    assert texts("a < b <i>c</i> <3") == ["a < b c <3"]
    assert texts("<div title='a > b' class=x>in</div><textarea>t</textarea><svg><title>s</title></svg><select><option>o</select>out") == ["in", "out"]
    assert texts("<head><title>T</title><meta charset=u>\n<body>b</bod") == ["b"]
    assert texts("<p>one</p></p></div>two<p") == ["one", "two"]
    assert texts("<h1>t<p>u</h1>v") == ["t", "u", "v"] or texts("<h1>t<p>u</h1>v") == ["t", "u v"]
    assert texts("<scr" + "ipt>never ends") == []
    assert texts("") == texts(None) == texts("<div><div></div>") == []
    assert len(texts("<div>" * 3000 + "deep" + "</div>" * 3000)) == 1
    assert texts("x " * 200_000) == [("x " * 200_000).strip()]


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    return html.train(pages)


def test_given_pages(spark, model):
    """All pages of sf0.1, nearly all of them not in the sample of sf0.01 that trained the model."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").repartition(8)
    got = {r["page_id"]: r for r in html.extract(pages, model).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    wrong = [r["page_id"] for r in rows if got[r["page_id"]]["text"] != article_text(r["html"])]
    assert not wrong
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_layouts_held_out(spark, model):
    """Pages in layouts with sidebars, notices, adverts, forms and comments, of texts that weren't trained on."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id >= 1000").limit(300).collect()]
    trees = []
    for i, page in enumerate(pages):
        t = html.parse(page)
        trees.append(html.parse(html.layout(random.Random(7_000 + i), [x for x, y in zip(t.text, t.label, strict=True) if x and y], [x for x, y in zip(t.text, t.label, strict=True) if x and not y])))
    right, told = [], []
    for t, found in zip(trees, html.score_trees(trees, model), strict=True):
        labels = [y for x, y in zip(t.text, t.label, strict=True) if x]
        right += [(q >= 0.5) == y for (_, q), y in zip(found, labels, strict=True)]
        told += labels
    right, told = np.array(right), np.array(told)
    assert right[told == 1].mean() > 0.995
    assert right[told == 0].mean() > 0.99


def test_structures_by_hand(model):
    """Pages that no layout made."""
    semantic = """<body><header><a href=/>Site</a></header><nav><a>Home</a> <a>About</a></nav><main><article><h1>Title here</h1>
      <p>First paragraph, with <b>bold</b>text &amp; <a href=x>a link</a>.</p><aside class="related"><h3>Related</h3><ul><li><a href=x>Other story</a></li></ul></aside><p>Second.</p>
      <section class=comments><h2>Comments</h2><article><p>I think this is a great post, thanks for all of the work.</p></article></section></article></main><footer>&copy; 2024</footer>"""
    divs = """<body><div id=top-nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></div><div class="cookie-consent"><p>We use cookies. By staying, you accept them.</p></div>
      <div id="content"><h1>A long title of the story</h1><p>This is the first long paragraph of the story, which says many things.</p><div class="advertisement">Buy now!</div>
      <p>This is the second long paragraph, which says many more things, and then more things yet.</div><div id=sidebar><h3>Popular</h3><p>Some teaser text.</p></div>
      <form action=x><label>Name</label><p>Enter your email to subscribe</p></form><div id=comments><p>Reader one: I like it, and I read it all the way down.</p></div><div class=footer>Copyright</div>"""
    want = [
        ["Title here", "First paragraph, with boldtext & a link.", "Second."],
        ["A long title of the story", "This is the first long paragraph of the story, which says many things.", "This is the second long paragraph, which says many more things, and then more things yet."],
    ]
    found = [[t for t, q in b if q >= 0.5] for b in html.score_trees([html.parse(semantic), html.parse(divs)], model)]
    assert found == want


def test_edges(spark, model, monkeypatch):
    monkeypatch.setattr(html, "FILLER_PAGES", 20)
    rows = [(None, None, None), (1, "u", ""), (2, None, "<p></p>"), (3, "u", "<article><h1>Same</h1><p>Some text, here.</p></article>"), (3, "u", "<article><h1>Same</h1><p>Some text, here.</p></article>"), (4, "x", "\0<&>")]
    df = spark.createDataFrame([(*r, 1, "s", "t") for r in rows], PAGES).repartition(3)
    got = html.extract(df, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert [r for r in found if r[0] == 3] == [(3, "u", "Same Some text, here.", 21)] * 2
    assert {(None, None, "", 0), (1, "u", "", 0), (2, None, "", 0)} <= set(found)
    assert len(found) == 6
    assert html.extract(df.limit(0)).count() == 0
    # Without articles the filler layouts alone train the model.
    assert html.extract(df.filter("page_id = 1")).count() == 1


def test_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(html, "FILLER_PAGES", 20)
    monkeypatch.setattr(html, "SAMPLE_PAGES", 20)
    monkeypatch.setattr(html, "LAYOUTS", 1)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    one, many = html.train(pages.coalesce(1)), html.train(pages.repartition(7))
    assert np.array_equal(one.unary, many.unary) and np.array_equal(one.edges, many.edges)
