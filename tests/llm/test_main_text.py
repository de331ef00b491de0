"""Main text of pages: names of containers never empty a page, and the test pages' articles come out whole."""

import html as standard
import re

import pytest
from pyspark.sql import functions as F

from kindred.llm import html

GOOD = "<p>First good block of the article with many words in it.</p><p>Second block, with some more words than the first one.</p>"
TEXT = "First good block of the article with many words in it.\nSecond block, with some more words than the first one."


def article(page):
    """The blocks of a test page's article element."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"<script.*?</script>|<style.*?</style>|<!--.*?-->", "", inner, flags=re.S)
    blocks = re.split(r"</?(?:p|h\d|li|ul|ol|div|blockquote)\b[^>]*>", re.sub(r"<br\s*/?>", " ", inner))
    lines = (re.sub(r"\s+", " ", standard.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.1/pages.parquet")


@pytest.fixture(scope="module")
def learned(pages):
    return html.fit(pages)


def test_every_test_page_gives_its_article(pages):
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    want = {r.page_id: article(r.html) for r in pages.collect()}
    assert got == want


def test_pages_without_the_labels_give_the_same_text(pages):
    labelled = [r for r in pages.collect() if re.search("<(article|main)[ >]", r.html)]
    weights = html.Weights.fit([r.html for r in labelled[:300]])
    blind = [(article(r.html), html.main_text(re.sub("<(/?)(article|main)(?=[ >])", r"<\1div", r.html), weights)) for r in labelled[300:]]
    assert len(blind) > 2000 and sum(want == got for want, got in blind) >= 0.99 * len(blind)


@pytest.mark.parametrize(
    "page",
    [
        *('<body class="no-sidebar">{}</body>', '<div class="content has-sidebar">{}</div>', '<article class="post category-social">{}</article>', '<div id="ad-free">{}</div>'),
        *("<body><form action=x>{}</form></body>", '<div class="sidebar">{}</div>', "<datalist><option>A<option>B</datalist>{}", "<div role=main class=promo><nav><a href=x>x</a></nav>{}</div>"),
        '<body><nav><a href="/">Home</a></nav><div class="post">{}</div><div class="comments"><p>I say so and so</p></div></body>',
        '<article>{}<p class="ad">Buy this now or never</p></article>',
    ],
)
def test_names_never_empty_a_page(page, learned):
    for weights in (html.Weights(), learned):
        assert html.main_text(page.format(GOOD), weights) == TEXT


def test_an_advert_inside_goes_and_a_headline_stays(learned):
    page = '<article><div class="post-header"><h1>A headline of six whole words</h1></div>' + GOOD.replace("</p><p>", '</p><div class="ad"><div><p>Buy now</p></div></div><p>') + "</article>"
    for weights in (html.Weights(), learned):
        assert html.main_text(page, weights) == "A headline of six whole words\n" + TEXT


def test_labelled_pages_overrule_first_scores():
    ours = '<body><article><div class="share">{}</div></article><div class="extra"><p>not ours at all</p></div></body>'.format(GOOD)
    weights = html.Weights.fit([ours] * 40)
    assert weights.by_label["share"] > 0 > weights.by_label["extra"]
    split = '<article><p>Some words that come before the box here.</p><div class="{}">' + GOOD + "</div><p>And some words that come after it.</p></article>"
    assert TEXT in html.main_text(split.format("share"), weights)
    assert TEXT not in html.main_text(split.format("extra"), weights)


def test_pages_without_labels(spark):
    rows = [(k, f"u{k}", f"<body><div class=top>Menu</div><div class=body>{GOOD}</div></body>", "x") for k in range(5)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")).collect()
    assert [r.text for r in got] == [TEXT] * 5


def test_clashing_columns(pages):
    odd = pages.limit(3).withColumns({"text": F.lit(1), "n_chars": F.lit("x"), "h": F.lit(2), "kind": F.lit(0)})
    assert html.extract(odd).columns == ["page_id", "url", "text", "n_chars"] and html.extract(odd).count() == 3
