"""Registered queries of the readers of pages and payloads, each beside its SQL oracle.

The driver's pages have paragraphs but neither cards nor JSON, so each query dresses the paragraphs of every page as a marketplace would
send them, and must read them back; the oracle takes them from the page as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.sources import cards, payloads

from .registry import query

PARAGRAPH = "<p>([^<]*)</p>"


def _paragraphs(p: DataFrame) -> DataFrame:
    return p.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(PARAGRAPH), F.lit(1))).alias("at", "said"))


#: Paragraphs with white space collapsed; of a page's equal ones by the expression key the first.
def _paragraph_sql(text: str, key: str, keep: str, columns: str) -> str:
    return rf"""WITH paragraphs AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{PARAGRAPH}', 1)) AS said, unnest(range(len(regexp_extract_all(html, '{PARAGRAPH}', 1)))) AS i FROM pages),
        texts AS (SELECT page_id, url, i, trim(regexp_replace({text}, '\s+', ' ', 'g')) AS review_text FROM paragraphs),
        kept AS (SELECT * FROM texts WHERE length(review_text) >= 15 AND {keep} QUALIFY row_number() OVER (PARTITION BY page_id, {key} ORDER BY i) = 1)
        SELECT page_id, {columns}, md5(review_text) AS text_md5 FROM kept"""


def _payload(p: DataFrame) -> DataFrame:
    """A page's paragraphs as nested JSON: the lists of a page lie page_id % 5 objects deep, and keys are spelt in two ways."""
    stars = 1 + F.col("at") % 5
    known = F.to_json(F.struct(F.col("said").alias("text"), stars.cast("string").alias("starRating"), F.struct(F.concat(F.lit("a"), F.col("at") % 3).alias("name")).alias("wbUserDetails"), F.array(F.struct(F.concat(F.lit("/i/"), F.col("at"), F.lit(".jpg")).alias("fullSize"))).alias("photos")))
    loose = F.to_json(F.struct(F.struct(F.col("said").alias("content")).alias("Review-Text"), stars.alias("RATE"), F.concat(F.lit("a"), F.col("at") % 3).alias("buyer_nick"), F.array(F.concat(F.lit("/i/"), F.col("at"), F.lit(".jpg")), F.lit("http://10.0.0.1/x.jpg")).alias("image_list")))
    rows = _paragraphs(p).select("page_id", "url", F.struct("at", F.when(F.col("page_id") % 2 == 0, known).otherwise(loose).alias("node")).alias("n"))
    rows = rows.groupBy("page_id", "url").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda n: n["node"]), ",").alias("nodes"))
    deep = (F.col("page_id") % 5).cast("int")
    return rows.select("page_id", F.col("url").alias("source_url"), F.concat(F.repeat(F.lit('{"data":['), deep), F.lit('{"items":['), "nodes", F.lit("]}"), F.repeat(F.lit("]}"), deep)).alias("json"))


_ROOT = r"regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_NESTED_SQL = _paragraph_sql(
    "said", "i % 3, substr(lower(review_text), 1, 240)", "true",
    f"'a' || CAST(i % 3 AS VARCHAR) AS author, CAST(1 + i % 5 AS DOUBLE) AS rating, {_ROOT} || '/i/' || CAST(i AS VARCHAR) || '.jpg' AS first_image, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS photos_count",
)


def _read(df: DataFrame) -> DataFrame:
    return df.select("page_id", "author", "rating", F.get("image_urls", F.lit(0)).alias("first_image"), F.col("photos_count").cast("long").alias("photos_count"), F.md5("review_text").alias("text_md5"))


@query("s17_nested_json", "pages", _NESTED_SQL)
def s17(p):
    return _read(payloads.extract_json_reviews(_payload(p)))


@query("s19_page_state", "pages", _NESTED_SQL)
def s19(p):
    html = F.concat(F.lit("<html><script src='x.js'></script><script> window.__INITIAL_STATE__ = "), F.regexp_replace("json", "</", "<\\\\\\\\/"), F.lit("; window.ready=1</script></html>"))
    return _read(payloads.extract_state_reviews(_payload(p).select("page_id", F.col("source_url").alias("url"), html.alias("html"))))


_ENTITIES_SQL = "said"
for _entity, _sign in cards.ENTITIES.items():
    _ENTITIES_SQL = f"replace({_ENTITIES_SQL}, '{_entity}', '{_sign if _sign != chr(39) else chr(39) * 2}')"


@query("s16_cards", "pages", _paragraph_sql(_ENTITIES_SQL, "lower(review_text)", "true", f"CAST(1 + page_id % 5 AS DOUBLE) AS rating, '2024-05-01' AS date, 'by ' || CAST(page_id AS VARCHAR) AS author, [{_ROOT} || '/i/' || CAST(page_id AS VARCHAR) || '.png', 'https://cdn.example.com/b.png'] AS image_urls"))
def s16(p):
    card = F.concat(
        F.lit('<div class="list review-card"><img class="avatar" src="/me.png"><span class="author">by '), F.col("page_id"), F.lit("</span><time>2024-05-01</time><b class=rating>"), 1 + F.col("page_id") % 5,
        F.lit(" of 5</b><p>$1</p><div><img data-src=\"/i/"), F.col("page_id"), F.lit(".png\" srcset='//cdn.example.com/b.png 2x, http://127.0.0.1/c.png'></div></div>"),
    )
    found = cards.extract_html_reviews(p.select("page_id", "url", F.regexp_replace("html", F.lit(PARAGRAPH), card).alias("html")))
    return found.select("page_id", "rating", "date", "author", "image_urls", F.md5("review_text").alias("text_md5"))


@query("s31_rendered_cards", "pages", _paragraph_sql("said", "substr(lower(review_text), 1, 240)", "true", "'Good ' || CAST(min(i) OVER (PARTITION BY page_id, substr(lower(review_text), 1, 240)) AS VARCHAR) AS title, CAST(1 + i % 5 AS DOUBLE) AS rating, CAST(greatest(i % 4, 1) AS BIGINT) AS photos_count"))
def s31(p):
    stars = F.concat((1 + F.col("at") % 5).cast("string"), F.lit(".0 out of 5 stars"))
    node = F.struct(F.lit(" One ").alias("author"), F.concat(stars, F.lit(" - Good "), F.col("at")).alias("title"), stars.alias("ratingText"), F.concat(F.lit("Full content visible, double tap to read brief content. "), "said").alias("reviewText"), F.array(F.lit("/a.jpg")).alias("photoUrls"), (F.col("at") % 4).alias("photosCount"))
    rows = _paragraphs(p).groupBy("page_id", F.col("url").alias("source_url")).agg(F.array_sort(F.collect_list(F.struct("at", F.to_json(node).alias("node")))).alias("n"))
    found = payloads.normalize_cards(rows.select("page_id", "source_url", F.concat(F.lit("["), F.array_join(F.transform("n", lambda x: x["node"]), ","), F.lit("]")).alias("json")))
    return found.select("page_id", "title", "rating", F.col("photos_count").cast("long").alias("photos_count"), F.md5("review_text").alias("text_md5"))
