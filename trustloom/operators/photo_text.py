"""Recognised photo text: marketing labels, marketplaces, score and page summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustloom.functions import lexicons as L
from trustloom.functions import text as T
from trustloom.sources.tables import cut

FLAG = 0.46


def bounded(pattern: str) -> str:
    """A pattern whose word edges are those of any script: a word character on one side only."""
    w = r"[\p{L}\p{N}_]"
    return pattern.replace(r"\b", f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))")


def needed(pattern: str) -> list[str]:
    """Texts one of which each match of a photo pattern holds: its plain words, or those listed for it."""
    plain = pattern.replace(r"\b", "")
    return L.PHOTO_NEEDED.get(pattern, [plain])


def photo_labels(t: Column) -> Column:
    """A pattern is tried only where the text holds what it needs; its word edges are looked for at every character."""
    found = lambda p: reduce(lambda a, b: a | b, [t.contains(w) for w in needed(p)]) & t.rlike(bounded(p))
    return T.array_of(*[(reduce(lambda a, b: a | b, map(found, patterns)), label) for label, patterns in L.PHOTO_PATTERNS.items()])


def photo_markets(t: Column) -> Column:
    return T.array_of(*[(reduce(lambda a, b: a | b, [t.contains(w) for w in words]), name) for name, words in L.PHOTO_MARKETS.items()])


def site_market(site: Column) -> Column:
    s, out = F.lower(F.coalesce(site, F.lit(""))), None
    for name, words in L.PHOTO_MARKETS.items():
        hit = reduce(lambda a, b: a | b, [s.contains(w) for w in (name, *(w.replace(" ", "") for w in words))])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("")


def photo_text(df: DataFrame, column: str = "ocr_text") -> DataFrame:
    """Labels, marketplaces named, those foreign to the site, score, flag and reasons of recognised photo text."""
    c, t = F.col, F.col("__t")
    rows = df.withColumn("__t", F.lower(T.norm_text(c(column)))).withColumns({"photo_labels": photo_labels(t), "photo_markets": photo_markets(t)})
    rows = rows.withColumn("foreign_markets", F.array_except("photo_markets", F.array(site_market(c("source_site")))))
    more = T.array_of((F.size("photo_markets") > 0, "marketplace_text"), (F.size("foreign_markets") > 0, "foreign_marketplace_watermark"))
    rows = rows.withColumn("photo_labels", F.concat("photo_labels", more))
    score = reduce(lambda a, b: a + b, [F.when(F.array_contains("photo_labels", k), w).otherwise(0.0) for k, w in L.PHOTO_WEIGHTS.items()])
    score = T.clip(score + F.when((F.length("__t") > 80) & (F.size("photo_labels") > 0), 0.08).otherwise(0.0))
    three = lambda name: F.array_join(F.slice(name, 1, 3), ", ")
    # The sentences.
    said = {
        "sale_discount": "OCR found sale, discount, coupon, promo, or similar marketing text on the photo.", "hype_claim": "OCR found hype claims such as best product, best seller, top choice, or must buy.",
        "watermark_marker": "OCR found ad, sponsored, official-store, or watermark-style text on the photo.", "contact_or_store": "OCR found contact handles, social links, or store/domain text on the photo.",
    }
    own = F.when(F.size("foreign_markets") > 0, F.concat(F.lit("OCR found marketplace text that does not match the source site: "), three("foreign_markets"), F.lit("."))).when(F.size("photo_markets") > 0, F.concat(F.lit("OCR found marketplace branding text on the photo: "), three("photo_markets"), F.lit(".")))
    reasons = F.concat(T.array_of(*[(F.array_contains("photo_labels", k), s) for k, s in said.items()]), F.filter(F.array(own), lambda x: x.isNotNull()))
    rows = rows.withColumns({"photo_text_score": score, "photo_text_reasons": reasons, "photo_labels": F.array_sort("photo_labels")}).drop("__t")
    return rows.withColumn("photo_text_flag", (c("photo_text_score") >= FLAG).cast("int"))


def photo_text_summary(df: DataFrame, top: int = 5) -> DataFrame:
    """Per page: reviews with photo text, flagged ones, ratio, mean score, and the most frequent labels."""
    read = T.norm_text(F.col("ocr_text")) != ""
    seen = cut(df.select("page_id", "photo_labels", "photo_text_flag", "photo_text_score", read.alias("__read"))).filter("__read")  # read by two aggregates
    by = seen.groupBy("page_id").agg(F.count("*").alias("evaluated"), F.sum("photo_text_flag").alias("flagged"), F.avg("photo_text_score").alias("mean_score"))
    labels = T.exploded(seen, F.col("photo_labels"), "label", ["page_id"]).groupBy("page_id", "label").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("n"), "label"))
    listed = labels.withColumn("rank", rank).filter(F.col("rank") <= top).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "label", "n").alias("x")))), lambda s: s["x"]), ",").alias("top_labels"))
    return by.join(listed, "page_id", "left").withColumn("flagged_ratio", F.col("flagged") / F.col("evaluated")).fillna({"top_labels": ""})
