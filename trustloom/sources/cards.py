"""Reviews in the markup of pages: JSON-LD, cards and image addresses. The markup is cut into tokens, and elements are found by places; no DOM, no Python.

Every start tag gets the place of its end tag by counting open tags of its own name, so unclosed tags of other names don't matter. An unclosed paragraph or heading
ends at the next block tag, an unclosed item at the next item or where its list ends, others where the page does. A card's fields are then elements that lie between its places. Only the usual named entities are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustloom.functions import text as T
from trustloom.sources.payloads import MIN_CHARS, _as, _leaves, _let, once
from trustloom.sources.tables import cut as written

TOKEN = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|</?[a-z][^>]*>|[^<]+|<"
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
BLOCKS = ["address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "html", "li", "main", "nav", "ol", "p", "section", "table", "tbody", "td", "th", "tr", "ul"]
PARAGRAPHS, ITEMS, ITEM_ENDS = ["p", "h1", "h2", "h3", "h4", "h5", "h6"], ["li", "dd", "dt", "tr", "td", "th"], ["ul", "ol", "dl", "table", "tbody", "tr", "body", "html"]
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
BLOCK_TOKENS = 256  # a card meets the tokens of its page by stretches of so many

# What marks a review card, its fields in order of preference, and images that are none of the customer's.
# .x is a class, *x a part of the classes, @name=value an attribute (^ begins with, ~ holds), a bare word a tag; "a b" is b inside a.
AMAZON_CARDS = ["@data-hook=review", "@id^customer_review-", ".a-section.review", ".review", "*customer-review"]
GENERIC_CARDS = ["@itemprop=review", "@data-review-id", ".review", ".review-item", ".review-card", ".review-list-item", "*review-item", "*review-card", "*customer-review"]
AMAZON_FIELDS = {
    "review_text": ["@data-hook=review-body span", "@data-hook=review-body", ".review-text-content span", ".review-text-content", ".a-expander-content.reviewText", "*review-text"],
    "stars": ["@data-hook=review-star-rating span.a-icon-alt", "@data-hook=cmps-review-star-rating span.a-icon-alt", "@data-hook=review-star-rating", "@data-hook=cmps-review-star-rating", ".review-rating span.a-icon-alt", ".review-rating", "i.a-icon-star span.a-icon-alt", "@aria-label~out of 5 stars"],
    "author": [".a-profile-name"], "title": ["@data-hook=review-title span", "@data-hook=review-title", ".review-title", "*review-title"], "date": ["@data-hook=review-date", ".review-date"],
}
GENERIC_FIELDS = {
    "review_text": ["@itemprop=reviewBody", ".review-text", ".review-content", ".content", ".description", "p"], "stars": ["@itemprop=ratingValue", ".rating", ".stars", "@aria-label~star"],
    "author": [".author", ".user", "@itemprop=author", ".reviewer"], "title": [".review-title", "@itemprop=name", "h3", "h4"], "date": [".date", "time", "@itemprop=datePublished"],
}
IMAGE_ATTRIBUTES = ["data-a-hires", "data-src", "data-original", "data-lazy-src", "src", "content"]
SKIP_IMAGES = ["avatar", "profile", "logo", "icon", "sprite", "star", "rating", "badge"]
VARIANT_MARKS = ["sku", "size", "размер", "цвет", "color", "white", "black", "yellow", "green", "pink", "blue", "set", "cm", "kg", "years", "year", "лет", "года"]
LD_IMAGE_FIELDS, LD_IMAGE_KEYS = ["image", "associatedMedia", "photo", "photos"], ["url", "contentUrl", "thumbnailUrl"]

SIMPLE = [*dict.fromkeys(s for lists in ([AMAZON_CARDS, GENERIC_CARDS], AMAZON_FIELDS.values(), GENERIC_FIELDS.values()) for found in lists for path in found for s in (path.split(" ") if "~" not in path else [path]))]


def attribute(tag: Column, name: str) -> Column:
    """An attribute's text in a start tag; empty without it or without a value."""
    return F.trim(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), F.lit("\"'"))


def _matches(selector: str) -> Column:
    """Whether a start tag meets one selector, from the columns that tokens() has."""
    cls = F.col("cls")
    if selector[0] == "*":
        return cls.contains(selector[1:])
    if selector[0] == "@":
        for sign, test in (("=", Column.__eq__), ("^", Column.startswith), ("~", Column.contains)):
            name, found, value = selector[1:].partition(sign)
            if found:
                return F.coalesce(test(F.col(name), F.lit(value)), F.lit(False))
        return F.col(selector[1:])
    name, *classes = selector.split(".")
    tests = [F.col("name") == name] * bool(name) + [cls.contains(f" {c} ") for c in classes]
    return reduce(Column.__and__, tests)


def tokens(pages: DataFrame) -> DataFrame:
    """One row per tag or text of pages (page_id, url, html): pos, end (of an element), text, marks (a bit a selector), and what images need."""
    cut = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    name = F.lower(F.regexp_extract("tok", "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    kept = cut.select("*", name.alias("name")).filter(~F.col("tok").startswith("<!--") & ~F.col("name").isin("script", "style"))
    closes, tag = F.col("tok").startswith("</"), F.col("name") != ""
    opens = tag & ~closes & ~F.col("name").isin(VOID) & ~F.col("tok").endswith("/>")
    kept = kept.select("*", F.when(opens, 1).when(tag & closes, -1).otherwise(0).alias("turn"))
    by_name = W.partitionBy("page_id", "name").orderBy("pos")
    level = F.sum("turn").over(by_name) + F.when(F.col("turn") < 0, 1).otherwise(0)
    closed = kept.filter("turn != 0").select("*", level.alias("level")).select("*", F.lead(F.struct("pos", "turn")).over(W.partitionBy("page_id", "name", "level").orderBy("pos")).alias("after"))
    ends = closed.filter("turn > 0").select("page_id", "pos", F.when(F.col("after.turn") < 0, F.col("after.pos")).alias("close"))
    later = W.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    block = F.last(F.when(F.col("name").isin(BLOCKS), F.col("pos")), ignorenulls=True).over(later)
    item = F.last(F.when((F.col("name").isin(ITEMS) & (F.col("turn") > 0)) | (F.col("name").isin(ITEM_ENDS) & (F.col("turn") < 0)), F.col("pos")), ignorenulls=True).over(later)
    unclosed = F.when(F.col("name").isin(PARAGRAPHS), block).when(F.col("name").isin(ITEMS), item)
    rows = kept.select("*", unclosed.alias("unclosed")).join(ends, ["page_id", "pos"], "left")
    end = F.when(F.col("turn") > 0, F.coalesce("close", "unclosed", F.lit(2**31 - 1))).otherwise(F.col("pos"))
    text = F.when(F.col("name") == "", reduce(lambda c, e: F.replace(c, F.lit(e), F.lit(ENTITIES[e])), ENTITIES, F.col("tok")))
    is_open, image = (F.col("turn") > 0) | ((F.col("name") != "") & (F.col("turn") == 0)), F.col("name").isin("img", "source")
    attr = lambda n: F.when(is_open, F.when(F.col("tok").contains("="), attribute(F.col("tok"), n)).otherwise(""))
    rows = rows.select(
        "page_id", "url", "pos", end.alias("end"), "name", text.alias("text"), "turn", F.concat(F.lit(" "), F.regexp_replace(attr("class"), r"\s+", " "), F.lit(" ")).alias("cls"), attr("id").alias("id"), attr("itemprop").alias("itemprop"), attr("data-hook").alias("data-hook"),
        F.col("tok").rlike(r"(?i)\sdata-review-id(?=[\s=/>])").alias("data-review-id"), attr("aria-label").alias("aria-label"), attr("title").alias("title"), F.when(image, F.col("tok")).alias("image"), attr("alt").alias("alt"),
    )
    marks = reduce(lambda a, b: a.bitwiseOR(b), [F.when((F.col("name") != "") & (F.col("turn") >= 0) & _matches(s), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, s in enumerate(SIMPLE)])
    about = F.lower(F.concat_ws(" ", "cls", "id", "alt", "`aria-label`", "`data-hook`"))
    return rows.select("page_id", "url", "pos", "end", "text", "turn", marks.alias("marks"), F.coalesce(F.nullif(F.col("`aria-label`"), F.lit("")), "title").alias("label"), F.when(F.col("name") != "", about).alias("about"), _image_candidates(F.col("image")).alias("images"))


def _image_candidates(tag: Column) -> Column:
    """Addresses in an image tag's attributes, in order; none of tiny images."""
    plain = [F.array(attribute(tag, a)) for a in IMAGE_ATTRIBUTES]
    sets = [F.transform(F.split(attribute(tag, a), ","), lambda c: F.split(F.trim(c), " ")[0]) for a in ("srcset", "data-srcset")]
    found = F.filter(F.flatten(F.array(*plain, *sets)), lambda u: u != "")
    width, height = (F.trim(attribute(tag, a)).try_cast("int") for a in ("width", "height"))
    tiny = (width != 0) & (height != 0) & ((width <= 2) | (height <= 2))
    return F.when(tag.isNotNull() & ~F.coalesce(tiny, F.lit(False)), found)


def _bit(t: Column, selector: str) -> Column:
    return t["marks"].bitwiseAND(F.lit(1 << SIMPLE.index(selector)).cast("long")) != 0


def _elements(toks: Column, path: str) -> Column:
    *outer, inner = path.split(" ") if path not in SIMPLE else [path]
    found = _marked(toks, inner)
    for o in outer:
        found = _inside(found, _marked(toks, o))
    return found


def _marked(toks: Column, selector: str) -> Column:
    return F.filter(toks, lambda t: _bit(t, selector))


def _inside(found: Column, around: Column) -> Column:
    return _let(around, lambda outer: F.filter(found, lambda t: F.exists(outer, lambda a: (a["pos"] < t["pos"]) & (t["pos"] < a["end"]))))


def _text_in(toks: Column, el: Column) -> Column:
    inside = F.filter(toks, lambda t: t["text"].isNotNull() & (t["pos"] > el["pos"]) & (t["pos"] < el["end"]))
    return T.norm_text(F.array_join(F.filter(F.transform(inside, lambda t: F.trim(F.regexp_replace(t["text"], r"^\s+|\s+$", ""))), lambda s: s != ""), " "))


def _first_text(toks: Column, paths: list[str], or_label: bool = False) -> Column:
    """Text of the first selector's first element that has one, or its label."""

    def said(path: str) -> Column:
        def of(el: Column) -> Column:
            text = F.nullif(_text_in(toks, el), F.lit(""))
            return F.coalesce(text, F.nullif(T.norm_text(el["label"]), F.lit(""))) if or_label else text

        return _let(F.get(_elements(toks, path), F.lit(0)), of)

    return F.coalesce(*[said(p) for p in paths], F.lit(""))


def _images(toks: Column, url: Column) -> Column:
    """Safe addresses of the images of a card; not of those whose own, parent's or grandparent's names tell of avatars, logos or stars."""
    hints = "|".join(SKIP_IMAGES)

    def own(t: Column) -> Column:
        around = F.filter(toks, lambda a: (a["pos"] < t["pos"]) & (t["pos"] < a["end"]))
        near = F.slice(F.reverse(around), 1, 2)
        return ~t["about"].rlike(hints) & ~F.exists(near, lambda a: a["about"].rlike(hints))

    found = F.flatten(F.transform(F.filter(F.filter(toks, lambda t: t["images"].isNotNull()), own), lambda t: t["images"]))
    return F.array_distinct(F.filter(F.transform(found, lambda u: T.normalize_image_url(T.norm_text(u), url)), lambda u: u.isNotNull()))


REVIEW = ["page_id", "place", "author", "title", "rating", "date", "review_text", "image_urls"]


def _stars(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.regexp_extract(c, "([0-9]+(?:[.,][0-9]+)?)", 1), ",", ".").try_cast("double"), F.lit(0.0))


def card_reviews(pages: DataFrame) -> DataFrame:
    """Reviews in the cards of pages (page_id, url, html), one per card and family of selectors; place orders a page's."""
    toks = written(tokens(pages))  # cards, their tokens and the ends of pages each read it
    is_amazon = T.site_name(F.col("url")).contains("amazon.")
    rank = lambda cards: F.array_min(F.filter(F.array(*[F.when(_bit(F.struct(F.col("marks")), s), F.lit(k)) for k, s in enumerate(cards)]), lambda k: k.isNotNull()))
    families = F.array(F.struct(F.lit(1).alias("family"), F.when(is_amazon, rank(AMAZON_CARDS)).alias("rank")), F.struct(F.lit(2).alias("family"), rank(GENERIC_CARDS).alias("rank")))
    cards = toks.filter("turn > 0 AND marks != 0").select("page_id", "url", F.col("pos").alias("from"), F.col("end").alias("to"), F.inline(families)).filter("rank IS NOT NULL")
    last = toks.groupBy("page_id").agg(F.max("pos").alias("last"))
    cards = cards.join(last, "page_id").withColumn("to", F.least("to", F.col("last") + 1)).drop("last")
    cards = cards.select("*", F.explode(F.sequence(F.floor(F.col("from") / BLOCK_TOKENS), F.floor(F.col("to") / BLOCK_TOKENS))).alias("stretch"))
    inside = toks.filter("text IS NOT NULL OR turn > 0 OR images IS NOT NULL OR marks != 0").select("page_id", F.floor(F.col("pos") / BLOCK_TOKENS).alias("stretch"), F.struct("pos", "end", "text", "marks", "label", "about", "images").alias("t"))
    whole = cards.join(inside, ["page_id", "stretch"]).filter("t.pos >= from AND t.pos < to").groupBy("page_id", "url", "family", "rank", "from").agg(F.array_sort(F.collect_list("t")).alias("all"))
    whole = whole.withColumn("toks", F.filter("all", lambda t: t["pos"] > F.col("from")))
    field = lambda name: F.when(F.col("family") == 1, _first_text(F.col("toks"), AMAZON_FIELDS[name], name == "stars")).otherwise(_first_text(F.col("toks"), GENERIC_FIELDS[name]))
    rows = once(whole, F.col("page_id"), F.col("family"), F.array("family", "rank", "from").alias("place"), *[field(n).alias(n) for n in GENERIC_FIELDS], _images(F.col("all"), F.col("url")).alias("image_urls"))
    clean = lambda c: F.when(F.col("family") == 1, T.clean_boilerplate(F.col(c))).otherwise(F.col(c))
    rows = rows.withColumns({"title": clean("title"), "review_text": clean("review_text"), "rating": _stars(F.col("stars"))})
    return rows.filter((F.col("review_text") != "") & ((F.col("family") == 1) | (F.length("review_text") >= MIN_CHARS))).select(*REVIEW)


def jsonld_reviews(pages: DataFrame) -> DataFrame:
    """Reviews in the schema.org scripts of pages, with their images; lists and @graph are followed three levels deep."""
    script = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    v = pages.select("page_id", "url", F.posexplode(script).alias("at", "s")).select("page_id", "url", "at", F.try_parse_json("s").alias("v"))
    none = F.array().cast("array<variant>")
    get = lambda x, key, kind: F.try_variant_get(x, f"$['{key}']", kind)
    kids = lambda x: F.coalesce(_as(x, "array<variant>"), get(x, "@graph", "array<variant>"), none)
    fronts = [F.array("v")]
    for _ in range(3):
        fronts.append(F.flatten(F.transform(fronts[-1], kids)))
    own = lambda x: F.when(get(x, "@type", "string") == "Review", F.array(x)).otherwise(none)
    listed = lambda x: F.coalesce(get(x, "review", "array<variant>"), F.filter(F.array(get(x, "review", "variant")), lambda r: r.isNotNull()), none)
    found = F.flatten(F.transform(F.concat(*fronts), lambda x: F.concat(own(x), listed(x))))
    rows = v.select("page_id", "url", "at", F.posexplode(found).alias("nth", "r"))
    said = lambda path: T.norm_text(F.try_variant_get("r", path, "string"))
    person = F.when(F.try_variant_get("r", "$.author", "map<string,variant>").isNotNull(), said("$.author.name")).otherwise(said("$.author"))
    stars = F.coalesce(F.try_variant_get("r", "$.reviewRating.ratingValue", "string"), F.when(F.try_variant_get("r", "$.reviewRating", "map<string,variant>").isNull(), F.try_variant_get("r", "$.reviewRating", "string")), F.lit(""))
    keys = F.array(*map(F.lit, LD_IMAGE_KEYS))
    inner = lambda x: _let(_as(x, "map<string,variant>"), lambda m: F.transform(F.filter(keys, lambda k: F.map_contains_key(m, k)), lambda k: F.try_element_at(m, k)))
    leaves = F.flatten(F.array(*[F.coalesce(F.when(get("r", f, "variant").isNotNull(), _leaves(get("r", f, "variant"), inner, 3)), none) for f in LD_IMAGE_FIELDS]))
    urls = F.transform(F.filter(leaves, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: T.normalize_image_url(T.norm_text(_as(x, "string")), F.col("url")))
    rows = once(
        rows, F.col("page_id"), F.array(F.lit(0), "at", "nth").alias("place"), person.alias("author"), said("$.name").alias("title"), _stars(stars).alias("rating"), said("$.datePublished").alias("date"),
        T.clean_boilerplate(F.try_variant_get("r", "$.reviewBody", "string")).alias("review_text"), F.array_distinct(F.filter(urls, lambda u: u.isNotNull())).alias("image_urls"),
    )
    return rows.filter("review_text != ''")


def is_noise(text: Column) -> Column:
    """Handles, profile labels and product variants; asked only of reviews without author, date and rating."""
    t = F.lower(T.norm_text(text))
    n, bare = F.size(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0))), ~t.rlike("[.!?,;:]")
    handle = F.regexp_replace(t, "^@+", "")
    parts = F.split(handle, " ")
    joined = F.array_join(parts, "")
    is_handle = (F.size(parts) <= 2) & (F.length(joined) <= 40) & joined.rlike(r"^[a-z0-9][a-z0-9_.-]{2,}([a-z]\.)?$")
    variant = ((t.contains("|") & (n <= 10)) | t.rlike("|".join(VARIANT_MARKS))) & (n <= 10) & bare
    return (t == "") | ((n <= 2) & (F.length(t) <= 32) & bare) | is_handle | variant


def extract_html_reviews(pages: DataFrame) -> DataFrame:
    """Reviews of pages (page_id, url, html): of JSON-LD, then of cards; without noise, and of a page's equal texts the first."""
    rows = jsonld_reviews(pages).unionByName(card_reviews(pages))
    known = (F.col("author") != "") | (F.col("date") != "") | (F.col("rating") > 0)
    row = F.struct("place", *[c for c in REVIEW if c not in ("page_id", "place")])
    kept = rows.filter(known | ~is_noise(F.col("review_text"))).groupBy("page_id", F.lower("review_text").alias("__key")).agg(F.min_by(row, "place").alias("r"))
    return kept.select("page_id", "r.*")
