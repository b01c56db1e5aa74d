"""The labeller on layouts that it hasn't seen, and pages that are hard to cut."""

import time

import numpy as np
import pytest

from leakdrift.llm import extraction as X

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return X.train(spark.read.parquet(f"{SF}/pages.parquet"))


#: Layouts that none of the given pages has, with the text that is the article.
LAYOUTS = [
    ("<html><body><div role='banner'><p>Site name</p></div><div role='main'><p>The first paragraph of the story has some words in it.</p><p>Another one follows it here.</p></div><div role='contentinfo'><p>Copyright</p></div></body></html>",
     ["The first paragraph of the story has some words in it.", "Another one follows it here."]),
    ("<html><body><p>One bare paragraph that is the whole page and nothing else.</p></body></html>", ["One bare paragraph that is the whole page and nothing else."]),
    ("<html><body><article><p>First paragraph without an end tag goes on.<p>Second paragraph without an end either.</article></body></html>",
     ["First paragraph without an end tag goes on.", "Second paragraph without an end either."]),
    ("<p>First bare paragraph without an end tag goes on.<p>Second paragraph without an end either.", ["First bare paragraph without an end tag goes on.", "Second paragraph without an end either."]),
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>Some text of the article that is long enough.</p><table><tr><th>Year</th><th>Sum</th></tr><tr><td>1999</td><td>12</td></tr></table></article><footer>c</footer></body></html>",
     ["Title", "Some text of the article that is long enough.", "Year", "Sum", "1999", "12"]),
    ("<html><body><article><h1>Title</h1><p>Some text of the article that is long enough.</p><aside><p>Related things to read on the side.</p></aside><p>More text of the article that follows the box.</p><section class='comments'><h2>Comments</h2><p>I liked this very much, thanks.</p></section></article></body></html>",
     ["Title", "Some text of the article that is long enough.", "More text of the article that follows the box."]),
]


def test_texts_of_layouts(spark, model):
    rows = [(k, h) for k, (h, _) in enumerate(LAYOUTS)] + [(90, None), (91, ""), (92, "<!-- only -->"), (93, "<p>a &amp; b&nbsp;c\n\n d</p>")]
    pages = spark.createDataFrame(rows, "page_id int, html string")
    got = {r.page_id: r.text for r in X.extract(pages, model).collect()}
    assert [got[k] for k in range(len(LAYOUTS))] == ["\n\n".join(t) for _, t in LAYOUTS]
    assert (got[90], got[91], got[92], got[93]) == ("", "", "", "a & b c d")
    assert X.extract(pages.limit(0), model).count() == 0


def test_blocks_of_made_pages_that_were_not_fitted(spark, model):
    texts = [t for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(40).collect() for t, _, _ in X.blocks(r.html)]
    hits = wrong = missed = 0
    encode = X.Encoder()
    for piece in X.variants(texts, np.random.default_rng(99), 200):
        page, label = X.labelled(piece)
        if not page:
            continue
        p = X.run(model, *X.padded([encode(page)]))[1][:, 0] >= 0.5
        hits, wrong, missed = hits + int((p & (label > 0)).sum()), wrong + int((p & (label == 0)).sum()), missed + int((~p & (label > 0)).sum())
    assert 2 * hits / (2 * hits + wrong + missed) > 0.95, (hits, wrong, missed)


@pytest.mark.parametrize("page", ["<a " * 34_000, '<a "' * 30_000, "<div>" * 30_000, "<div>x" * 20_000, "<div>x</p>" * 40_000, "<!--" * 30_000, "<script" * 20_000, "<svg " * 20_000, "<p title='" * 20_000 + ">x"])
def test_malformed_pages_take_their_share(page):
    began = time.time()
    X.blocks(page)
    assert time.time() - began < 5


def test_what_is_not_closed_at_the_end():
    texts = lambda page: [t for t, _, _ in X.blocks(page)]
    assert texts("<p>a</p><!-- b <p>c</p>") == ["a"] and texts("<p>a</p>b <!-- c") == ["a", "b"]
    assert texts("<p>a</p><script>b <p>c</p>") == ["a"] and texts("a < b and c") == ["a < b and c"]
    assert texts("<p>a</p><style>x</style>") == ["a"] and texts("a<!-- x -->") == ["a"]


def test_equal_paths_are_one_step():
    one, two = X.blocks("<div class=a><p>x</p></div>")[0][1], X.blocks("<div class=a><p>y</p></div>")[0][1]
    assert one is two or X.TRIE[1] == 1
