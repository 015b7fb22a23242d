"""Reviews in JSON that pages and marketplaces send: nested payloads, page state in scripts, rendered cards. VARIANT only, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions import text as T

# Names under which payloads hold a field, in order of preference; case and punctuation of keys don't count.
TEXT_KEYS = ["review_text", "reviewText", "text", "comment", "commentContent", "content", "message", "feedback", "feedbackText", "feedbackContent", "buyerFeedback", "buyerFeedbackText", "buyerTranslationFeedback", "translationFeedback", "reviewContent", "evaluationContent"]
PRO_KEYS = ["pros", "advantages", "positiveText", "positive"]
CON_KEYS = ["cons", "disadvantages", "negativeText", "negative"]
RATING_KEYS = ["rating", "rate", "stars", "star", "starRating", "valuation", "grade", "score", "productValuation", "buyerEval", "evalStar", "feedbackRating"]
AUTHOR_KEYS = ["author", "authorName", "userName", "nickname", "customerName", "buyerName", "buyerLoginId", "buyerNick", "userNick", "displayName", "memberName", "name", "wbUserDetails", "userDetails"]
PERSON_KEYS = ["name", "nickname", "userName", "displayName", "loginId"]
DATE_KEYS = ["date", "createdAt", "publishedAt", "time", "feedbackDate", "gmtCreate", "evalDate", "createdDate", "createTime"]
PHOTO_KEYS = ["photos", "photo", "images", "image", "media", "pictures", "buyerPictures", "feedbackImages", "imageList", "picList", "photoLinks", "imageUrls"]
TITLE_KEYS = ["title", "subject", "summary", "skuInfo", "productTitle"]
INNER_TEXT_KEYS = ["text", "content", "feedback", "feedbackText", "feedbackContent", "buyerFeedback", "buyerFeedbackText", "reviewContent", "commentContent", "message", "value", "title", "body", "translation", "original"]
IMAGE_KEYS = ["fullSize", "miniSize", "big", "small", "url", "src", "imageUrl", "imageURL", "photoUrl", "photoURL", "thumbnail", "thumbnailUrl", "contentUrl", "original"]
# Keys that mark an object as a review though it has no rating, author or date.
REVIEW_MARKS = ["review", "reviewtext", "feedback", "feedbacktext", "feedbackcontent", "buyerfeedback", "buyerfeedbacktext", "comment", "commentcontent", "evaluation", "evaluationcontent", "evaluationid", "buyername", "buyerloginid", "buyernick", "customername"]
# Words of product variants, stock and prices.
VARIANT_WORDS = ["осталось", "шт.", "₽", "руб", "china mainland", "mainland", "light blue", "dark blue", "yellow", "green", "pink", "purple", "red", "set", "years", "year", "month", "months", "cm", "kg", "black", "white", "blue", "china", "sku", "размер", "разм", "цвет", "size"]
# What stands before a page's state in its scripts.
STATE_MARKERS = ["window.__INITIAL_STATE__=", "window.__INITIAL_STATE__ =", "window.__NUXT__=", "window.__NUXT__ =", "window.__APOLLO_STATE__=", "window.__APOLLO_STATE__ =", "window.__INITIAL_DATA__=", "window.__INITIAL_DATA__ =", "window.__INIT_DATA__=", "window.__INIT_DATA__ =", "window.runParams=", "window.runParams =", "runParams=", "runParams =", "data: {"]
MAX_CANDIDATES = 5

MAX_DEPTH = 12
MIN_CHARS = 15
KEY_CHARS = 240

_MAP, _LIST = "map<string,variant>", "array<variant>"


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """df.select(*columns) whose columns are computed once: filters on the result aren't pushed into them, as that would write each out again."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def plain_key(key: Column) -> Column:
    return F.lower(F.regexp_replace(key, r"[^\p{L}\p{N}]", ""))


def _plain(keys: list[str]) -> Column:
    return F.array(*[F.lit("".join(ch for ch in k if ch.isalnum()).lower()) for k in keys])


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once and written once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def walk(payloads: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Every object of each payload (page_id, v, path) in lists and objects down to max_depth: (page_id, source_url, path, node).

    A row at the edge becomes itself and its children, level by level, so the payload is read once and nothing is joined. path has the place
    of each step; a variant keeps an object's fields by name, so that is their order.
    """
    rows = payloads.select("page_id", "source_url", F.col("path"), F.col("v").alias("node"), F.lit(0).alias("depth"))
    step = "struct<node: variant, at: int>"
    for depth in range(max_depth):
        children = F.coalesce(F.map_values(_as(F.col("node"), _MAP)), _as(F.col("node"), _LIST), F.array().cast(_LIST))
        found = F.transform(children, lambda c, i: F.struct(c.alias("node"), i.alias("at")))
        here = F.array(F.struct(F.col("node"), F.lit(None).cast("int").alias("at")))
        next_ = F.when(F.col("depth") == depth, F.concat(here, found.cast(f"array<{step}>"))).otherwise(here)
        rows = rows.select("page_id", "source_url", "path", "depth", F.explode(next_).alias("c")).select(
            "page_id", "source_url", F.when(F.col("c.at").isNull(), F.col("path")).otherwise(F.concat("path", F.array("c.at"))).alias("path"),
            F.col("c.node").alias("node"), F.when(F.col("c.at").isNull(), F.col("depth")).otherwise(F.lit(depth + 1)).alias("depth"),
        )
    return rows.filter(_as(F.col("node"), _MAP).isNotNull()).drop("depth")


def entries(node: Column) -> Column:
    """An object's fields as (key, value) with plain keys; nulls and empty texts are no values."""
    fields = F.transform(F.map_entries(_as(node, _MAP)), lambda e: F.struct(plain_key(e["key"]).alias("key"), e["value"].alias("value")))
    return F.filter(fields, lambda e: ~F.is_variant_null(e["value"]) & (F.coalesce(_as(e["value"], "string"), F.lit("?")) != ""))


def first_value(fields: Column, keys: list[str]) -> Column:
    """The value of the first of the keys that has one."""
    wanted = _plain(keys)
    mine = F.filter(F.transform(fields, lambda e: F.struct(F.array_position(wanted, e["key"]).alias("at"), e["value"].alias("value"))), lambda e: e["at"] > 0)
    best = lambda own: F.try_element_at(F.filter(own, lambda e: e["at"] == F.array_min(own["at"])), F.lit(-1))["value"]
    return _let(mine, best)


def _leaves(v: Column, inner, depth: int) -> Column:
    """The values inside lists, and inside objects those that inner picks, in order, down to depth."""
    expand = lambda x: F.coalesce(_as(x, _LIST), F.when(_as(x, _MAP).isNotNull(), inner(x)), F.array(x))
    values = F.array(v)
    for _ in range(depth):
        values = F.flatten(F.transform(values, expand))
    return values


def said(v: Column, depth: int = 2) -> Column:
    """A value as text: lists joined, objects by the first usual inner key that has something, else all their values."""

    def inner(x: Column) -> Column:
        fields = lambda f: F.coalesce(F.array(first_value(F.filter(f, lambda e: ~_as(e["value"], "string").rlike(r"^(\s*|\[\]|\{\})$")), INNER_TEXT_KEYS)), F.array())
        return _let(entries(x), lambda f: F.when(F.get(fields(f), F.lit(0)).isNull(), f["value"]).otherwise(fields(f)))

    parts = F.transform(_leaves(v, inner, depth), lambda x: T.norm_text(F.when(_as(x, _MAP).isNull() & _as(x, _LIST).isNull(), _as(x, "string"))))
    return T.norm_text(F.array_join(F.filter(parts, lambda s: s != ""), ". "))


def number_in(v: Column) -> Column:
    """A number, or the first in a text; 0 without one."""
    text = F.regexp_extract(F.regexp_replace(_as(v, "string"), ",", "."), "([0-9.]+)", 1).try_cast("double")
    truth = F.when(_as(v, "string").isin("true", "false"), _as(v, "boolean").cast("double"))
    inside = _as(v, _MAP).isNotNull() | _as(v, _LIST).isNotNull()
    return F.coalesce(F.when(inside, 0.0), truth, _as(v, "double"), text, F.lit(0.0))


def image_urls(v: Column, base: Column, depth: int = 3) -> Column:
    """Safe image addresses in texts, lists and image objects, in order, each once."""
    keys = F.array(*map(F.lit, IMAGE_KEYS))
    inner = lambda x: _let(_as(x, _MAP), lambda m: F.transform(F.filter(keys, lambda k: F.map_contains_key(m, k)), lambda k: F.try_element_at(m, k)))
    texts = F.filter(_leaves(v, inner, depth), lambda x: F.schema_of_variant(x) == "STRING")
    urls = F.transform(texts, lambda x: T.normalize_image_url(_as(x, "string"), base))
    return F.array_distinct(F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: u.isNotNull()))


def is_variant_text(text: Column) -> Column:
    """Fragments of product variants, stock and prices, in a text without double spaces."""
    t = F.lower(text)
    words = t.rlike("|".join(w.replace(".", r"\.") for w in VARIANT_WORDS))
    return words | (t.contains("|") & (F.size(F.split(t, " ")) <= 10)) | (t.rlike(r"^[a-zа-яё0-9\s|/_.+-]{2,48}$") & t.rlike(r"[0-9]+\s*[-/]\s*[0-9]+\s*(years?|yrs?|лет|года)"))


def drop_repeats(reviews: DataFrame) -> DataFrame:
    """Of a page's reviews with equal author and beginning of the text the first by path; too short texts and unrated variants go."""
    kept = reviews.filter((F.length("review_text") >= MIN_CHARS) & ((F.col("rating") > 0) | ~is_variant_text(F.col("review_text"))))
    row = F.struct("path", *[c for c in reviews.columns if c not in ("page_id", "path")])
    key = F.concat(F.lower("author"), F.lit("::"), F.substring(F.lower("review_text"), 1, KEY_CHARS))
    return kept.groupBy("page_id", key.alias("__key")).agg(F.min_by(row, "path").alias("r")).select("page_id", "r.*")


REVIEW = ["page_id", "path", "author", "title", "rating", "date", "review_text", "photos_count", "image_urls"]


def extract_json_reviews(payloads: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Reviews in payloads (page_id, source_url, json): each object that has a review's text under a usual key, at any depth to max_depth.

    Columns: page_id, path (places from the root), author, title, rating (0: none), date, review_text, photos_count, image_urls.
    Payloads that aren't JSON give nothing; a page's payloads are told apart by the first place of path.
    """
    roots = payloads.select("page_id", "source_url", F.array().cast("array<int>").alias("path"), F.try_parse_json("json").alias("v")).filter(F.col("v").isNotNull())
    return _reviews(walk(roots, max_depth))


def _reviews(nodes: DataFrame) -> DataFrame:
    fields = nodes.select("page_id", "source_url", "path", entries(F.col("node")).alias("f"))
    keyed = {"text": TEXT_KEYS, "pros": PRO_KEYS, "cons": CON_KEYS, "stars": RATING_KEYS, "person": AUTHOR_KEYS, "day": DATE_KEYS, "photos": PHOTO_KEYS, "name": TITLE_KEYS}
    f = F.col("f")
    has_text = F.exists(f, lambda e: F.array_contains(_plain(TEXT_KEYS + PRO_KEYS + CON_KEYS), e["key"]))
    marked = F.exists(f, lambda e: F.array_contains(F.array(*map(F.lit, REVIEW_MARKS)), e["key"]))
    values = fields.filter(has_text).select("page_id", "source_url", "path", marked.alias("marked"), *[first_value(f, keys).alias(name) for name, keys in keyed.items()])
    parts = F.filter(F.array(*[said(F.col(c)) for c in ("text", "pros", "cons")]), lambda s: s != "")
    person = F.coalesce(F.when(_as(F.col("person"), _MAP).isNotNull(), first_value(entries(F.col("person")), PERSON_KEYS)), F.when(_as(F.col("person"), _MAP).isNull(), F.col("person")))
    plain = lambda v: F.coalesce(T.norm_text(_as(v, "string")), F.lit(""))
    urls = image_urls(F.col("photos"), F.col("source_url"))
    rows = once(
        values, F.col("page_id"), F.col("path"), F.col("marked"), plain(person).alias("author"), plain(F.col("name")).alias("title"), number_in(F.col("stars")).alias("rating"), plain(F.col("day")).alias("date"),
        T.norm_text(F.array_join(parts, ". ")).alias("review_text"), F.coalesce(F.size(_as(F.col("photos"), _LIST)), F.lit(0)).alias("listed"), urls.alias("image_urls"),
    )
    rows = rows.filter((F.col("rating") > 0) | (F.col("author") != "") | (F.col("date") != "") | F.col("marked"))
    return drop_repeats(rows.withColumn("photos_count", F.greatest(F.size("image_urls"), "listed")).select(*REVIEW))


def state_candidates(script: Column) -> Column:
    """What may be JSON in a script: all of it, and what follows each marker of page state, at most MAX_CANDIDATES."""
    s = F.regexp_replace(F.trim(script), r"^\s+|\s+$", "")
    after = lambda m: F.regexp_replace(F.substring(s, F.locate(m, s) + len(m), F.length(s)), r"^\s+|[\s;]+$", "")
    marked = [F.when(s.contains(m), F.concat(F.lit("{" if m == "data: {" else ""), after(m))) for m in STATE_MARKERS]
    found = F.filter(F.array(F.when(s.rlike(r"^[{\[]"), s), *marked), lambda c: c.isNotNull())
    return F.slice(found, 1, MAX_CANDIDATES)


def extract_state(pages: DataFrame) -> DataFrame:
    """page_id, source_url, path, v: JSON in the scripts of pages (page_id, url, html). A candidate is read to the end of its first whole value."""
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*>(.*?)</script>"), F.lit(1))
    rows = pages.select("page_id", F.col("url").alias("source_url"), F.posexplode(scripts).alias("at", "script"))
    rows = rows.select("page_id", "source_url", "at", F.posexplode(state_candidates(F.col("script"))).alias("nth", "json"))
    return rows.select("page_id", "source_url", F.array("at", "nth").alias("path"), F.try_parse_json("json").alias("v")).filter(F.col("v").isNotNull())


def extract_state_reviews(pages: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Reviews in the page state of pages (page_id, url, html), as extract_json_reviews returns them."""
    return _reviews(walk(extract_state(pages), max_depth))


def normalize_cards(payloads: DataFrame) -> DataFrame:
    """Cards that a browser has read from a page (page_id, source_url, json: a list of objects) as reviews."""
    cards = payloads.select("page_id", "source_url", F.posexplode(F.try_variant_get(F.try_parse_json("json"), "$", _LIST)).alias("at", "c"))
    get = lambda k: F.coalesce(F.try_variant_get("c", f"$.{k}", "string"), F.lit(""))
    urls = image_urls(F.try_variant_get("c", "$.photoUrls", "variant"), F.col("source_url"))
    rows = cards.filter(_as(F.col("c"), _MAP).isNotNull()).transform(
        once, F.col("page_id"), F.array("at").alias("path"), T.norm_text(get("author")).alias("author"), T.clean_title(get("title"), get("ratingText")).alias("title"),
        number_in(F.try_variant_get("c", "$.ratingText", "variant")).alias("rating"), T.norm_text(get("date")).alias("date"), T.clean_boilerplate(get("reviewText")).alias("review_text"),
        F.coalesce(F.greatest(get("photosCount").try_cast("int"), F.lit(0)), F.lit(0)).alias("listed"), urls.alias("image_urls"),
    )
    return drop_repeats(rows.withColumn("photos_count", F.greatest(F.size("image_urls"), "listed")).select(*REVIEW))
