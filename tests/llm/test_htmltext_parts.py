"""Parts of a marked article stay whatever compound names they bear, and broken pages take time in proportion."""

import time

from monthloom.llm import htmltext as H

PROSE = "The reason for this is that the words of the text are of the kind that stands in an article, and there are many of them. " * 3



def test_parts_of_an_article(spark):
    kept = {
        "section": '<section class="related-work"><p>Work on the same question was done before, and it is told here in short.</p></section>',
        "div": '<div class="promo-code-history"><p>The history of the code that was sent to all of them in the year after.</p></div>',
        "quote": '<blockquote class="reply">We said no to that, and we would say it again.</blockquote>',
        "math": "<p>It holds that <math><mi>a</mi><mo>=</mo><mi>b</mi><annotation>\\\\frac</annotation></math> for all.</p>",
        "notice": '<div class="share-price-table"><p>The price of the share rose from the one to the other.</p></div>',
    }
    gone = {
        "related-posts": "Ten other stories you may like to read as well today, all of them new",
        "comment-list": "First! said somebody who had read not a word of the text above it",
        "share-buttons": "Tell your friends about this story on the network of your choice now",
        "newsletter-signup": "Get the best of our stories by mail each morning before the sun is up",
        "ad-slot": "Buy the new thing that all of the people whom you know have bought by now",
    }
    body = "".join(kept.values()) + "".join(f'<div class="{c}"><p>{t}</p></div>' for c, t in gone.items())
    page = f"<html><body><article><h1>Title</h1><p>{PROSE}</p>{body}<p>{PROSE}</p></article></body></html>"
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    text = H.extract(df).first()["text"]
    for expected in ("Work on the same", "history of the code", "We said no", "price of the share"):
        assert expected in text
    assert "a = b" in text or "a=b" in text.replace(" ", "")
    assert "frac" not in text
    for t in gone.values():
        assert t not in text


def test_broken_pages_in_proportion(spark):
    pages = ["<div>x" * 40_000, "<form>x" * 20_000, "<span>" * 20_000 + "</div>" * 20_000, "<div class='sidebar'>y " * 20_000, "<h2>t" * 20_000]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("*", "'u' AS url").coalesce(1)
    t = time.time()
    assert len(H.extract(df).collect()) == len(pages)
    assert time.time() - t < 60  # in the square of the page the second alone took minutes
