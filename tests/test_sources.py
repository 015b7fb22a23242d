"""Goldens of the readers of pages and payloads, worked by hand."""

import json

import pytest
from pyspark.sql import functions as F

from trustloom.functions import text as T
from trustloom.sources import cards, payloads

PAGE = "page_id long, url string, html string"
PAYLOAD = "page_id long, source_url string, json string"

BRANDED = """<html><body><div id="list"><div data-hook="review" id="customer_review-R1"><span class="a-profile-name">Ann</span>
 <i data-hook="review-star-rating" aria-label="4.0 out of 5 stars"></i><a data-hook="review-title"><span>Holds up well</span></a><span data-hook="review-date">May 2, 2026</span>
 <span data-hook="review-body"><span>Full content visible, double tap to read brief content. We cooked with it twice a week &amp; nothing broke.</span></span></div></div></body></html>"""
NOISY = """<div class="review-card"><p>olga.petrova.b k.</p></div><div class="review-card"><p>Black Green Set | 2-3Years</p></div>
 <div class="review-card"><span class="rating">4 stars</span><p>Куртка теплая, рукава длинные, молния не заедает.</p></div>"""
IMAGES = """<article class="review-item"><p class="review-text">The handle is comfortable and the lid closes tightly every time.</p><img src="file:///etc/passwd"><img src="http://192.168.0.4/x.png">
 <span class="user avatar"><img src="/face.png"></span><div><img width=1 height=1 src="/pixel.png"><img data-src="/b.png" src="data:image/gif;base64,R0" srcset="c.png 1x, //cdn.example.com/d.png 2x"></div></article>"""
UNCLOSED = """<ul><li class=review-item><h3>Short<p>First review without any closing tags at all<li class=review-item><h3>Second<p>Another review, also never closed properly</ul><p>footer text that is no review"""
LINKED = """<script type="application/ld+json">{"@graph": [{"@type": "Product", "review": [{"reviewBody": "It came on time and works as described.", "author": {"name": "Bo"}, "reviewRating": {"ratingValue": "4,5"},
 "image": [{"url": "https://img.example.com/1.jpg"}, "https://127.0.0.1/2.jpg"]}]}, {"@type": "Review", "name": "Fine", "reviewBody": "A review of its own in the graph.", "author": "Cy", "datePublished": "2026-01-02"}]}</script>
 <script type="application/ld+json">not json</script><div class="review"><p>IT CAME on time and works as described.</p></div>"""


def test_reviews_from_markup(spark):
    pages = [(1, "https://www.amazon.de/dp/B0/", BRANDED), (2, "https://shop.example.com/a/b", NOISY), (3, "https://shop.example.com/a/b", IMAGES), (4, "https://shop.example.com/", UNCLOSED), (5, "https://shop.example.com/", LINKED), (6, None, None), (7, "https://e.com", ""), (8, "https://e.com", "<div class='review-card'><p>Long enough, but in no amazon page")]
    found = cards.extract_html_reviews(spark.createDataFrame(pages, PAGE)).orderBy("page_id", "place").collect()
    got = [(r.page_id, r.author, r.title, r.rating, r.date, r.review_text, r.image_urls) for r in found]
    assert got == [
        (1, "Ann", "Holds up well", 4.0, "May 2, 2026", "We cooked with it twice a week & nothing broke.", []),
        (2, "", "", 4.0, "", "Куртка теплая, рукава длинные, молния не заедает.", []),
        (3, "", "", 0.0, "", "The handle is comfortable and the lid closes tightly every time.", ["https://shop.example.com/b.png", "https://shop.example.com/a/c.png", "https://cdn.example.com/d.png"]),
        (4, "", "Short", 0.0, "", "First review without any closing tags at all", []),
        (4, "", "Second", 0.0, "", "Another review, also never closed properly", []),
        (5, "Bo", "", 4.5, "", "It came on time and works as described.", ["https://img.example.com/1.jpg"]),
        (5, "Cy", "Fine", 0.0, "2026-01-02", "A review of its own in the graph.", []),
        (8, "", "", 0.0, "", "Long enough, but in no amazon page", []),
    ]


@pytest.mark.parametrize("depth", range(1, 7))
def test_reviews_at_any_depth_with_loose_keys(spark, depth):
    node = {"FEEDBACK_text": {"translation": ["Works after", "two months"]}, "Pros": "quiet", "cons": None, "star-rating": "4,5 of 5", "userDetails": {"displayName": "Di"}, "gmt_create": 1700000000, "pic-list": [{"original": "/p.jpg"}, {"noKey": 1}]}
    tree = node
    for k in range(depth - 1):
        tree = {"data": tree} if k % 2 else [{"x": 1}, tree]
    row = payloads.extract_json_reviews(spark.createDataFrame([(1, "https://m.example.com/q/w", json.dumps(tree))], PAYLOAD)).collect()
    assert [(r.author, r.rating, r.date, r.review_text, r.photos_count, r.image_urls) for r in row] == [("Di", 4.5, "1700000000", "Works after. two months. quiet", 2, ["https://m.example.com/p.jpg"])]


def test_payload_cases(spark):
    said = "this text is long enough to be a review"
    cases = {
        1: {"text": said}, 2: {"comment": said}, 3: {"text": said, "name": "x"}, 4: {"text": "too short", "name": "x"}, 5: {"text": "yellow set, size 42 is here", "name": "x"}, 6: {"text": "yellow set, size 42 is here", "name": "x", "rate": 3},
        7: [{"text": said, "name": "A", "rate": 1}, {"text": said.upper(), "name": "a", "rate": 2}, {"text": said, "name": "b"}], 8: {"text": "", "message": said, "date": "2026"},
    }
    rows = [(k, "https://e.com", json.dumps(v)) for k, v in cases.items()] + [(9, "u", "{broken"), (10, None, None)]
    found = payloads.extract_json_reviews(spark.createDataFrame(rows, PAYLOAD)).collect()
    assert sorted((r.page_id, r.author, r.rating) for r in found) == [(2, "", 0.0), (3, "x", 0.0), (6, "x", 3.0), (7, "A", 1.0), (7, "b", 0.0), (8, "", 0.0)]


def test_page_state_and_rendered_cards(spark):
    node = json.dumps({"reviews": [{"reviewText": "State of the page holds this one", "rating": 5}]})
    pages = [(1, "https://e.com/", f"<script>\nwindow.__NUXT__={node}; window.x=1;</script><script>var a='{{';</script>"), (2, "https://e.com/", f"<script type='application/json'>{node}</script>"), (3, "https://e.com/", "<script>window.__NUXT__={oops</script>"), (4, "https://e.com/", f"<script>app({{data: {node}}})</script>".replace("data: {", "data: {\"k\":{", 1).replace("})", "}})"))]
    found = payloads.extract_state_reviews(spark.createDataFrame(pages, PAGE)).collect()
    assert sorted((r.page_id, r.rating, r.review_text) for r in found) == [(k, 5.0, "State of the page holds this one") for k in (1, 2, 4)]
    card = [{"author": " Eve ", "title": "5.0 out of 5 stars | Solid", "ratingText": "5.0 out of 5 stars", "date": "today", "reviewText": "Brief content visible, double tap to read full content. Solid thing, no complaints.", "photoUrls": ["/1.jpg", "/1.jpg", "ftp://x/2.jpg"], "photosCount": "3"}, {"reviewText": "short"}, "text", {"title": None}]
    (r,) = payloads.normalize_cards(spark.createDataFrame([(1, "https://e.com/p", json.dumps(card)), (2, "https://e.com/p", "{}"), (3, None, None)], PAYLOAD)).collect()
    assert (r.author, r.title, r.rating, r.date, r.review_text, r.photos_count, r.image_urls) == ("Eve", "Solid", 5.0, "today", "Solid thing, no complaints.", 3, ["https://e.com/1.jpg"])


def test_image_addresses(spark):
    safe = ["https://example.com/a.png", "http://8.8.8.8/x", "data:image/png;base64,AAAA", "https://[2606:4700::1]/x", "https://host.internal/x"]
    unsafe = ["ftp://example.com/x", "https://localhost/x", "https://a.local/x", "https://10.1.2.3/x", "https://172.20.0.1/x", "http://169.254.1.1/x", "http://224.0.0.1/x", "http://[::1]/x", "http://[fe80::1]/x", "data:image/png,AAAA", "https:///x", "", "http://203.0.113.9/x", "https://localhost./x"]
    rows = spark.createDataFrame([(u,) for u in safe + unsafe], "u string").select("u", T.is_safe_image_url(F.col("u")).alias("ok")).collect()
    assert [r.u for r in rows if r.ok] == safe
    made = spark.createDataFrame([("//c.com/x",), ("/x",), ("x",), ("./x",), ("#x",), ("data:image/gif;base64,AA",), ("mailto:x",)], "u string").select(T.normalize_image_url(F.col("u"), F.lit("https://e.com/a/b?c=d")).alias("n"), T.normalize_image_url(F.col("u"), F.lit("file:///a")).alias("f")).collect()
    assert [r.n for r in made] == ["https://c.com/x", "https://e.com/x", "https://e.com/a/x", "https://e.com/a/x", None, None, None]
    assert [r.f for r in made] == ["https://c.com/x"] + [None] * 6
