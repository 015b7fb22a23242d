"""Photo signals from URLs and times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustloom.functions import lexicons as L
from trustloom.functions import text as T


def fingerprint(url: Column) -> Column:
    return F.sha1(T.canonical_url(url))


def photo_reuse(photos: DataFrame) -> DataFrame:
    """Per review: images, images also in another review of the page, largest cluster, score, flag."""
    links = photos.select("page_id", "record_id", fingerprint(F.col("url")).alias("fp")).distinct()
    size = links.groupBy("page_id", "fp").agg(F.count("*").alias("size"))
    rows = links.join(size, ["page_id", "fp"]).groupBy("page_id", "record_id").agg(F.count("*").alias("images"), F.count_if(F.col("size") >= 2).alias("reused"), F.max("size").alias("cluster"))
    score = F.when(F.col("reused") == 0, 0.0).otherwise(0.68 * F.col("reused") / F.col("images") + 0.32 * F.least((F.col("cluster") - 1) / 3, F.lit(1.0)))
    return rows.withColumn("reuse_score", score).withColumn("reuse_flag", (F.col("reused") > 0).cast("int"))


def photo_clusters(photos: DataFrame, top: int = 5) -> DataFrame:
    links = photos.select("page_id", "record_id", fingerprint(F.col("url")).alias("fp"), T.canonical_url(F.col("url")).alias("url")).distinct()
    by = links.groupBy("page_id", "fp").agg(F.count("*").alias("size"), F.min("url").alias("sample"), F.min("record_id").alias("first_record")).filter("size >= 2")
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("size"), "fp"))
    return by.withColumn("rank", rank).filter(F.col("rank") <= top)


def photo_risk(ratio: Column, size: Column) -> Column:
    return F.when((ratio >= 0.35) | (size >= 4), "high").when((ratio >= 0.18) | (size >= 3), "medium").otherwise("low")


def photo_summary(reuse: DataFrame) -> DataFrame:
    out = reuse.groupBy("page_id").agg(F.count("*").alias("n_with_photos"), F.avg(F.col("reuse_flag").cast("double")).alias("ratio"), F.max("cluster").alias("largest"))
    return out.withColumn("risk", photo_risk(F.col("ratio"), F.col("largest")))


def temporal_clusters(photos: DataFrame, hours: int = 48) -> DataFrame:
    """Of each fingerprint the best start-to-end interval within the window with two reviews and two authors.

    Reviews and authors are first reduced to what a second can change: each at its first time since a start. The
    range join runs as an equi join on time slots of the window's length: a start in slot b meets the events of
    slots b and b + 1. photos has page_id, record_id, author, sec, url; rows without sec are skipped.
    """
    span = max(1, hours) * 3600
    author = F.nullif(F.lower(T.norm_text(F.col("author"))), F.lit(""))
    ev = photos.filter("sec is not null").select("page_id", "record_id", author.alias("author"), "sec", fingerprint(F.col("url")).alias("fp")).distinct()
    shared = ev.groupBy("page_id", "fp").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    ev = ev.join(shared, ["page_id", "fp"]).withColumn("slot", F.floor(F.col("sec") / span))
    starts = ev.select("page_id", "fp", "slot", F.col("sec").alias("start")).distinct()
    ends = ev.select("page_id", "fp", F.explode(F.array(F.col("slot"), F.col("slot") - 1)).alias("slot"), "record_id", "author", "sec")
    pairs = starts.join(ends, ["page_id", "fp", "slot"]).filter((F.col("sec") >= F.col("start")) & (F.col("sec") <= F.col("start") + span))
    first = lambda key: pairs.filter(F.col(key).isNotNull()).groupBy("page_id", "fp", "start", key).agg(F.min("sec").alias("sec"))
    new = first("record_id").groupBy("page_id", "fp", "start", "sec").agg(F.count("*").alias("reviews"), F.lit(0).cast("long").alias("people"))
    new = new.unionByName(first("author").groupBy("page_id", "fp", "start", "sec").agg(F.lit(0).cast("long").alias("reviews"), F.count("*").alias("people")))
    new = new.groupBy("page_id", "fp", "start", "sec").agg(F.sum("reviews").alias("reviews"), F.sum("people").alias("people"))
    w = W.partitionBy("page_id", "fp", "start").orderBy("sec").rowsBetween(W.unboundedPreceding, 0)
    run = new.withColumns({"n": F.sum("reviews").over(w), "authors": F.sum("people").over(w)})
    score = 0.34 * F.least(F.col("n") / 4, F.lit(1.0)) + 0.38 * F.least(F.col("authors") / 3, F.lit(1.0)) + 0.28 * (1 - (F.col("sec") - F.col("start")) / span)
    found = run.filter("n >= 2 and authors >= 2").select("page_id", "fp", "start", F.col("sec").alias("end"), "n", "authors", F.round(score, 6).alias("score"))
    best = found.groupBy("page_id", "fp").agg(F.max(F.struct("score", (-F.col("start")).alias("s"), (-F.col("end")).alias("e"), "n", "authors")).alias("b"))
    return best.select("page_id", "fp", (-F.col("b.s")).alias("start_sec"), (-F.col("b.e")).alias("end_sec"), F.col("b.n").alias("n_reviews"), F.col("b.authors").alias("n_authors"), F.col("b.score").alias("score"), (F.col("b.score") >= 0.55).cast("int").alias("flag"))


def temporal_summary(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("page_id").agg(F.count("*").alias("clusters"), F.sum("flag").alias("flagged"), F.max("score").alias("best"), F.max("n_reviews").alias("largest"))


def _hints(urls: Column, hints: list[str], strong: list[str], high: float, low: float, off_strong: float, off_weak: float) -> Column:
    """The largest score of the URLs: strong or weak hints, less where the URL also looks like a customer's."""

    def score(u: Column) -> Column:
        text = F.replace(F.lower(u), F.lit("_"), F.lit("-"))
        has = lambda words: F.coalesce(T.has_phrase(text, words), F.lit(False))
        value = F.when(has(strong), high - F.when(has(L.CUSTOMER_HINTS), off_strong).otherwise(0.0)).when(has(hints), low - F.when(has(L.CUSTOMER_HINTS), off_weak).otherwise(0.0)).otherwise(0.0)
        return T.clip(value)

    return F.coalesce(F.array_max(F.transform(urls, score)), F.lit(0.0))


def stock_url_signal(urls: Column) -> Column:
    return _hints(urls, L.STOCK_HINTS, L.STRONG_STOCK_HINTS, 0.62, 0.46, 0.22, 0.22)


def synthetic_url_signal(urls: Column) -> Column:
    return _hints(urls, L.SYNTHETIC_HINTS, L.STRONG_SYNTHETIC_HINTS, 0.74, 0.48, 0.08, 0.24)


def best_cluster_per_review(photos: DataFrame, clusters: DataFrame) -> DataFrame:
    """Of the clusters whose interval holds a review's photo, the one of best score, the earliest on a tie."""
    links = photos.filter("sec is not null").select("page_id", "record_id", "sec", fingerprint(F.col("url")).alias("fp")).distinct()
    inside = links.join(clusters, ["page_id", "fp"]).filter(F.col("sec").between(F.col("start_sec"), F.col("end_sec")))
    best = F.max(F.struct("score", (-F.col("start_sec")).alias("s"), "fp", "flag", "n_reviews", "n_authors", (F.col("end_sec") - F.col("start_sec")).alias("span"))).alias("b")
    return inside.groupBy("page_id", "record_id").agg(best).select("page_id", "record_id", F.col("b.fp").alias("fp"), F.col("b.score").alias("temporal_score"), F.col("b.flag").alias("temporal_flag"), F.col("b.n_reviews").alias("n_reviews"), F.col("b.n_authors").alias("n_authors"), F.col("b.span").alias("span_sec"))


def temporal_risk(ratio: Column, size: Column) -> Column:
    return F.when((ratio >= 0.30) | (size >= 5), "high").when((ratio >= 0.16) | (size >= 3), "medium").otherwise("low")


# Traces of image generators in metadata.
METADATA_HINTS = ["automatic1111", "comfyui", "dall-e", "dalle", "diffusion", "midjourney", "negative prompt", "positive prompt", "sampler", "sdxl", "stable diffusion", "stablediffusion"]


def metadata_signal(metadata: Column) -> Column:
    """0.86 if the metadata text of an image names a generator or a prompt."""
    return F.when(T.has_phrase(metadata, METADATA_HINTS), 0.86).otherwise(0.0)


# Words that tell a photo's category; the first category wins.
CATEGORY_HINTS = {
    "footwear": ["boot", "boots", "shoe", "shoes", "sneaker", "sneakers", "sandal", "sandals", "обув", "ботин", "кроссов", "сандал", "туфл"],
    "apparel": ["shirt", "dress", "jacket", "pants", "jeans", "hoodie", "одеж", "куртк", "плать", "рубаш", "джинс"],
    "electronics": ["phone", "laptop", "camera", "headphone", "charger", "электрон", "телефон", "ноутбук", "наушник"],
    "beauty": ["cream", "serum", "makeup", "shampoo", "beauty", "крем", "сыворот", "космет", "шампун"],
    "home goods": ["chair", "table", "lamp", "kitchen", "mug", "blanket", "home", "стул", "ламп", "кухн", "дом"],
    "grocery": ["coffee", "tea", "snack", "food", "protein", "кофе", "чай", "еда", "продукт"],
}


def product_category(columns: list[Column], *texts: Column) -> Column:
    """The first of the given categories that says something, else the first whose words are in the texts (URL, site, title, review)."""
    given = [F.when((T.norm_text(c) != "") & (T.norm_text(c) != "general"), F.lower(T.norm_text(c))) for c in columns]
    holds = lambda t, words: reduce(lambda a, b: a | b, [t.contains(w) for w in words])
    hinted = T.once(F.lower(F.concat_ws(" ", *texts)), lambda t: F.coalesce(*[F.when(holds(t, words), name) for name, words in CATEGORY_HINTS.items()]))
    return F.coalesce(*given, hinted, F.lit("general product"))


# What an image may look like, and what is said of it.
POSITIVE_LABELS = ["review_match", "category_match", "product_relevance", "casual_customer_snapshot", "product_in_use"]
CUSTOMER_LABELS = ["casual_customer_snapshot", "product_in_use"]
UNRELATED_SAID = {"packaging_only": "packaging, box, or label rather than the reviewed product", "unrelated_product": "a different or unrelated product", "blank_or_screenshot": "a blank image, screenshot, receipt, or text-only artifact"}
STOCK_AS_MISMATCH_SAID = {"stock_catalog": "a polished catalog product photo rather than a customer snapshot", "studio_render": "a studio render or mockup rather than a real customer snapshot", "marketing_banner": "a marketing banner or advertisement rather than a customer snapshot", "listing_screenshot": "a catalog/listing screenshot rather than a customer snapshot", "packshot": "a studio packshot rather than a customer snapshot"}
STOCK_SAID = {"stock_catalog": "a polished ecommerce catalog image", "studio_render": "a studio render or 3D mockup", "marketing_banner": "a marketing banner or promotional creative", "listing_screenshot": "a screenshot from a catalog or marketplace listing", "packshot": "a studio packshot prepared for product marketing"}
SYNTHETIC_SAID = {"ai_generated": "AI-generated visual style", "diffusion_artifact": "diffusion-like artifacts, warped details, or hallucinated text", "cgi_synthetic": "CGI/synthetic rendering cues", "overprocessed_synthetic": "overly smooth synthetic lighting or unrealistic shadows"}
STOCK_THRESHOLD, SYNTHETIC_THRESHOLD, MISMATCH_THRESHOLD = 0.58, 0.66, 0.58
SYNTHETIC_RISK = 0.72  # a synthetic look weighs less when a review's images are compared


def alignment_scores(df: DataFrame, probabilities: str = "probabilities", category: str = "category") -> DataFrame:
    """Scores, labels and sentences of images from the probability of each label (a map; absent labels are 0).

    alignment, mismatch, stock and synthetic with their masses and top labels (of equal ones the first listed), *_label and *_reasons.
    """
    of = lambda k: F.coalesce(F.try_element_at(F.col(probabilities), F.lit(k)), F.lit(0.0))
    mass = lambda labels: F.aggregate(F.array(*map(of, labels)), F.lit(0.0), lambda a, x: a + x)
    top = lambda labels: F.array_max(F.array(*[F.struct(of(k).alias("p"), F.lit(-i).alias("i"), F.lit(k).alias("label")) for i, k in enumerate(labels)]))
    negative = [*UNRELATED_SAID, *STOCK_SAID]
    c = F.col
    rows = df.withColumns({
        "alignment": mass(POSITIVE_LABELS), "negative_mass": mass(negative), "stock_mass": mass([*STOCK_SAID]), "synthetic_mass": mass([*SYNTHETIC_SAID]),
        "__n": top(negative), "__s": top([*STOCK_SAID]), "__y": top([*SYNTHETIC_SAID]), "__c": F.greatest(*map(of, CUSTOMER_LABELS)),
    })
    over = lambda t, floor: F.greatest(F.lit(0.0), c(t)["p"] - floor)
    least = lambda score, cond, floor: F.when(cond, F.greatest(score, F.lit(floor))).otherwise(score)
    rows = rows.withColumns({
        "mismatch": least(T.clip(0.72 * c("negative_mass") + 0.28 * over("__n", c("alignment"))), (c("alignment") < 0.34) & (c("negative_mass") >= 0.50), 0.62),
        "stock": least(T.clip(0.64 * c("stock_mass") + 0.36 * over("__s", c("__c"))), (c("__s.p") >= 0.24) & (c("stock_mass") >= 0.38), STOCK_THRESHOLD),
        "synthetic": least(T.clip(0.58 * c("synthetic_mass") + 0.42 * over("__y", F.greatest("__c", c("alignment") * 0.4))), (c("__y.p") >= 0.26) & (c("synthetic_mass") >= 0.42), SYNTHETIC_THRESHOLD),
        "top_negative": c("__n.label"), "top_stock": c("__s.label"), "top_synthetic": c("__y.label"),
    })
    kind = F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("product"))
    said = lambda column, texts: F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), F.col(column))
    one = lambda cond, text: F.when(cond, F.array(text)).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({
        "mismatch_label": F.when(c("mismatch") >= 0.72, "strong_mismatch").when(c("mismatch") >= 0.58, "mismatch").when(c("mismatch") >= 0.38, "weak_match").otherwise("aligned"),
        "stock_label": F.when(c("stock") < 0.34, "customer_like").when(c("stock") < STOCK_THRESHOLD, "possible_stock").otherwise(c("top_stock")),
        "synthetic_label": F.when(c("synthetic") < 0.38, "natural_photo_like").when(c("synthetic") < SYNTHETIC_THRESHOLD, "weak_synthetic_hint").otherwise(c("top_synthetic")),
        "mismatch_reasons": one(c("mismatch") >= 0.58, F.concat(F.lit("The customer photo looks closer to "), said("top_negative", UNRELATED_SAID | STOCK_AS_MISMATCH_SAID), F.lit(" than to the review text or inferred "), kind, F.lit(" category."))),
        "stock_reasons": one(c("stock") >= STOCK_THRESHOLD, F.concat(F.lit("The customer image looks like "), said("top_stock", STOCK_SAID), F.lit(", not a user-taken product photo."))),
        "synthetic_reasons": one(c("synthetic") >= SYNTHETIC_THRESHOLD, F.concat(F.lit("Weak auxiliary signal: the image shows "), said("top_synthetic", SYNTHETIC_SAID), F.lit(". Treat this as supporting evidence, not proof."))),
    }).drop("__n", "__s", "__y", "__c")


def best_image(images: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of each review's images the one of largest risk (a synthetic score weighs 0.72), the first URL on a tie. images: record_id, url, mismatch, stock, synthetic, and the columns of keep."""
    risk = F.round(F.greatest("mismatch", "stock", F.col("synthetic") * SYNTHETIC_RISK), 9)
    best = F.min_by(F.struct("url", "mismatch", "stock", "synthetic", *keep), F.struct((-risk).alias("r"), "url"))
    return images.groupBy("record_id").agg(best.alias("b"), F.count("*").alias("images")).select("record_id", "images", "b.*")


def alignment_summary(best: DataFrame) -> DataFrame:
    """Per page: evaluated reviews, flagged ones by kind, ratios and means. best: page_id beside what best_image gives."""
    c, n = F.col, F.count("*")
    flags = {"mismatch": 0.58, "stock": 0.58, "synthetic": 0.66}
    return best.groupBy("page_id").agg(
        n.alias("evaluated"), *[F.count_if(c(k) >= t).alias(f"{k}_reviews") for k, t in flags.items()], *[(F.count_if(c(k) >= t) / n).alias(f"{k}_ratio") for k, t in flags.items()], *[F.avg(k).alias(f"{k}_mean") for k in flags]
    )


def reuse_reasons(reused: Column, cluster: Column) -> Column:
    # The sentences.
    large = F.concat(F.lit("The same customer photo appears across a large cluster of "), cluster, F.lit(" reviews."))
    small = F.concat(F.lit("The same customer photo appears in "), cluster, F.lit(" reviews."))
    return F.when(reused > 0, F.array(F.when(cluster >= 4, large).otherwise(small))).otherwise(F.array().cast("array<string>"))


def timing_reasons(n_reviews: Column, n_authors: Column, span_sec: Column) -> Column:
    hours = F.bround(span_sec / 3600, 1).cast("string")
    # The sentences.
    many = F.concat(F.lit("The same customer photo appears across "), n_reviews, F.lit(" reviews by "), n_authors, F.lit(" authors within "), hours, F.lit(" hours."))
    few = F.concat(F.lit("The same customer photo appears across different authors within a short "), hours, F.lit("-hour window."))
    return F.when(n_reviews.isNotNull(), F.array(F.when(n_reviews >= 4, many).otherwise(few))).otherwise(F.array().cast("array<string>"))


def stock_url_reasons(score: Column) -> Column:
    return F.when(score >= STOCK_THRESHOLD, F.array(F.lit("The image URL/path contains stock, catalog, render, promo, or marketing hints."))).otherwise(F.array().cast("array<string>"))


def synthetic_url_reasons(score: Column) -> Column:
    return F.when(score >= SYNTHETIC_THRESHOLD, F.array(F.lit("Weak auxiliary signal: the image URL/path contains AI-generated or synthetic-image hints."))).otherwise(F.array().cast("array<string>"))
