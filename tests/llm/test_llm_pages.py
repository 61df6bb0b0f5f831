"""Page text: pages with known articles."""

import html
import re

import numpy as np
import pytest
from llm_fixtures import empty_docs
from pyspark.sql import functions as F

from metaloom.llm import page_text as p

TREE = p.default_tree()
LONG = "A paragraph of the article that has quite some words so that nobody takes it for a menu entry."

CASES = [
    ("<article><h1>Title</h1><p>One &amp; two&nbsp;three.<p>  Fo<b>ur</b>\n\tfive </article>", "Title\nOne & two three.\nFour five"),
    (f"<nav><a href=/>Home</a></nav><main><p>{LONG}</p><p>Short.</p></main><footer>&copy; 2020 All rights</footer>", f"{LONG}\nShort."),
    (f"<body><header><h1>Site</h1><p>{LONG}</p></header><article><p>{LONG}</p></article><aside><p>{LONG}</p></aside>", LONG),
    (f"<article><p>{LONG}<div class='share'>Tell your friends</div><div id=comments><p>{LONG}</p></div><p>End</article>", f"{LONG}\nEnd"),
    (f"<div class='cookie-notice'>{LONG}</div><div id='content'><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar><ul><li><a>x</a><li><a>y</a></ul></div>", f"{LONG}\n{LONG}"),
    (f"<form><label>Your name and address and all the other things that we want to know from you</label><input></form><article>{LONG}</article>", LONG),
    (f"<article><p>x<script>if (a < b) document.write('<p>no</p>')</script>y</p><style>p{{}}</style><!-- <p>no --><p>{LONG}", f"x\ny\n{LONG}"),
    (f"<article><p title='a > b'>{LONG}</p><p>1 &lt; 2 &#233; &#x41; &unknown; &am", f"{LONG}\n1 < 2 é A &unknown; &am"),
    (f"<article><ul><li>first point<li>second point</ul><p>{LONG}</p></article><section class='comments'><article class='comment'><p>{LONG}</p></article></section>", f"first point\nsecond point\n{LONG}"),
    (f"<article><p>line one<br>line two</p><p>{LONG}", f"line one line two\n{LONG}"),
    ("", ""),
    ("<nav><a>a</a></nav>", ""),
    ("no markup at all but a text that is long enough to be one, with quite some words in it and more", "no markup at all but a text that is long enough to be one, with quite some words in it and more"),
    (f"<ARTICLE><P>{LONG}</P></ARTICLE><DIV CLASS=Ad>Buy now</DIV>", LONG),
    (f"<article><p hidden>not seen</p><p style='display: none'>nor this</p><p>{LONG}</article>", LONG),
]


@pytest.mark.parametrize("page,expected", CASES)
def test_cases(page, expected):
    assert p.main_text(page, TREE) == expected


def test_tree_learns_its_table_and_other_pages(spark):
    rows = p.labelled_rows()
    assert rows.shape[1] == len(p.FEATURES) + 1
    assert (TREE.predict(rows[:, :-1]) == rows[:, -1].astype(bool)).mean() > 0.98
    kept = [p.grow(np.delete(rows[:, :-1], i, 0), np.delete(rows[:, -1], i)).predict(rows[i : i + 1, :-1])[0] == bool(rows[i, -1]) for i in range(0, len(rows), 9)]
    assert np.mean(kept) > 0.8, "left out, most rows are still told right"


def test_table_pages(spark):
    """The pages of the table hold their text in headings and paragraphs of one article."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in p.extract(pages).join(pages.withColumnRenamed("page_id", "id"), F.col("row.page_id") == F.col("id")).collect():
        body = r.html.partition("<article>")[2].partition("</article>")[0]
        found = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.main == "\n".join(x for x in found if x)


def test_large_and_broken_pages():
    page = "<article>" + "<div><p>word</p>" * 20_000
    assert p.main_text(page, TREE).count("word") == 20_000
    for broken in ("<", "<a", "<a href='x", "</", "<!--", "<script>", "<p <p>x", "&", "<article><p class='x>abc</p>", "<" * 5000, '<a "' * 3000):
        p.main_text(broken, TREE)


def test_awkward_and_empty(spark):
    pages = spark.createDataFrame([(1, None, None, "m"), (None, "u", "", "m"), (2, "u", "<article>x y z</article>", "m"), (2, "u", "<article>x y z</article>", "m")], "page_id long, url string, html string, main string")
    found = p.extract(pages).select("row.page_id", F.col("row.main").alias("own"), "main").collect()
    assert sorted((r.page_id or 0, r.own, r.main) for r in found) == [(0, "m", ""), (1, "m", ""), (2, "m", "x y z"), (2, "m", "x y z")]
    assert p.extract(empty_docs(spark).withColumnRenamed("text", "html")).collect() == []


def test_open_quotes_take_no_time():
    import time

    for page in ("<a " + "x" * 60 + '="open', "<a" + "b" * 50_000 + ' c="open', "<p " + "'" * 20_001 + ">", "<p>" + '<a x="' * 3000):
        began = time.time()
        p.flat_blocks(page)
        assert time.time() - began < 0.5


def test_formulas_stay_in_their_sentence():
    page = "<article><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>a+b</annotation></math> is known.</p></article>"
    assert [b[0] for b in p.flat_blocks(page)] == ["The sum a+b is known."]
