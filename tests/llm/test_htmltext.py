import re
import time

import numpy as np
import pytest
from linkgrove.llm import htmltext as ht
from linkgrove.llm.htmltrain import LAYOUTS, pages


def truth(page):
    """The article's text of the tables' own layout, by plain pattern."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p|article)>", article)
    import html

    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_pages_of_the_tables(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet")
    want = {r.page_id: truth(r.html) for r in rows.collect()}
    got = ht.extract_pages(rows).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_training_pages_are_learned():
    x, y = ht.labelled_table()
    assert len(y) < 10_000 and (ht.classifier().predict(x) == y).mean() > 0.97


@pytest.mark.parametrize("layout", LAYOUTS)
def test_held_out_layouts(layout):
    """Trained without a layout, the tree tells over nine in ten of its blocks right."""
    tree = ht.DecisionTree().fit(*ht.labelled_table(without=layout))
    rows = [ht.blocks(p, labels=True) for name, p in pages() if name == layout]
    right = np.concatenate([tree.predict(ht.features(r)) == [b.label for b in r] for r in rows])
    assert right.mean() > 0.9


def test_counts_and_neighbours_decide():
    """Word counts, link densities and both neighbours are used, and accuracy goes without them."""
    x, y = ht.labelled_table()
    tree = ht.classifier()
    used = {ht.FEATURES[n[0]] for n in tree.nodes if n[0] >= 0}
    assert {"words", "links", "previous words", "next links"} <= used
    rng = np.random.default_rng(0)
    for names in (("words",), ("links",), [f for f in ht.FEATURES if f.startswith("previous")], [f for f in ht.FEATURES if f.startswith("next")]):
        mixed = x.copy()
        at = [ht.FEATURES.index(f) for f in names]
        mixed[:, at] = rng.permutation(mixed[:, at])
        assert (tree.predict(mixed) == y).mean() < 0.98 * (tree.predict(x) == y).mean(), names


def test_markup_cases():
    page = (
        "<article><h1>A &lt;b&gt; &amp; c&eacute;</h1><p>one<b>two</b>\n\n three&nbsp;four<br>five<!-- no <p> --></p>"
        "<script>var x = '</p>';</script><style>p{}</style><p title='a > b'>six</p><p></p><p> \n </p>tail &am end</article>"
    )
    assert ht.main_text(page) == "A <b> & cé\nonetwo three four five\nsix\ntail &am end"


LONG = "Many words stand in this paragraph so that it reads like running text of an article. " * 3


def test_other_layouts():
    page = f"""<div><a href=1>Site</a></div><div><a href=2>A</a> <a href=3>B</a></div><div>We use cookies.</div>
    <div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>
    <div><h3>Comments</h3><div>Ann</div><p>Nice one there.</p><div>Bob</div><p>I liked it too.</p></div><form><p>Sign up now</p></form><div>Imprint</div>"""
    assert ht.main_text(page) == f"Title\n{LONG.strip()}\nShort.\n{LONG.strip()}"


def test_long_titles_and_short_adverts():
    page = f"""<html><head><title>{LONG}</title></head><body><nav><p>{LONG}</p></nav><div>Buy now.</div><article><h1>{LONG}</h1><p>One.</p>
    <div>Buy more today.</div><p>{LONG}</p></article><div>Last days!</div><footer><p>{LONG}</p></footer></body></html>"""
    assert ht.main_text(page) == f"{LONG.strip()}\nOne.\n{LONG.strip()}"


def test_class_names_do_not_matter():
    names = ("related", "ad-history", "comment", "sidebar", "article", "nav menu", "share")
    page = "<article><h1>Title</h1>" + "".join(f'<p class="{n}" id="{n}">{LONG}</p>' for n in names) + "</article>"
    assert ht.main_text(page) == "\n".join(["Title"] + [LONG.strip()] * len(names))


def test_nothing_unclosed_swallows_the_page():
    rest = f"<p>{LONG}</p>"
    for odd in ("<svg viewBox='0 0 1 1'/>", "<math/>", "<p><object data=x><p>seen</p></article><article>", "<p><audio src=x></p></article><article>", "<canvas/>"):
        assert ht.main_text(f"<article><h1>T</h1>{rest}{odd}{rest}</article>").endswith(LONG.strip()), odd
    text = ht.main_text(f"<article><h1>T</h1><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>3</mn></math> holds</p>{rest}</article>")
    assert "x=3 holds" in text
    assert "hidden" not in ht.main_text(f"<article><h1>T</h1>{rest}<svg><text>hidden</text></svg><noscript>hidden</noscript>{rest}</article>")


@pytest.mark.parametrize(
    "unit", ["a <b ", "<b x=\"", "<b x='>", "<!-", "<!--", "</p", "<", "<div>", "<li><ul><div>", "<td><p>", "</x>", "<div></b><i></q>", "&amp", "<script>", "<a href=x>y"]
)
def test_time_follows_the_length(unit):
    """2 MB of any repeated oddity is read in seconds, around a page that is still found before it."""
    page = f"<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p>" + unit * (2_000_000 // len(unit))
    start = time.perf_counter()
    ht.blocks(page)
    assert time.perf_counter() - start < 30


def test_damaged_and_empty_pages(spark):
    pages = [
        (1, "u", None), (2, None, ""), (None, "u", "<p"), (4, "u", "<!-- open"), (5, "u", "<script>never closed"), (6, "u", "a < b"),
        (7, "u", "<article><p>kept text here</p><p>cut of"), (7, "u", "</div></p>" * 50), (8, "u", "<div>" * 3000 + "deep"), (9, "u", "<a" + " x" * 5000),
    ]
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = ht.extract_pages(frame).collect()
    assert len(got) == len(pages) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[4] == by[5] == ""
    kept = [r.text for r in got if r.page_id == 7]
    assert "kept text here\ncut of" in kept
    assert ht.extract_pages(frame.limit(0)).collect() == []


def test_tree_finds_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = (x[:, 1] > 0.5) & (x[:, 2] < 0.3)
    tree = ht.DecisionTree().fit(x, y)
    fresh = rng.random((400, 3))
    assert (tree.predict(fresh) == ((fresh[:, 1] > 0.5) & (fresh[:, 2] < 0.3))).mean() > 0.95
