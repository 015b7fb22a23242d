"""The review report: hybrid score, reasons, categories, scored rows, page report, highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustloom.functions import text as T
from trustloom.operators import evaluation, machine_text, pages, photo_text, photos, slang
from trustloom.sources.tables import cut

# Promotional phrases that reasons and categories look for.
REASON_PHRASES = ["buy now", "100% recommended", "best purchase ever", "trust me", "must buy"]
POLICY = {"clean": 0.32, "suspicious": 0.68, "uncertainty": 0.46, "ood": 0.46}
PHOTO_COLUMNS = {"images": 0, "reuse_score": 0.0, "cluster": 0, "reused": 0, "temporal_score": 0.0, "temporal_flag": 0, "mismatch": 0.0, "stock": 0.0, "synthetic": 0.0, "photo_text_score": 0.0, "photo_text_flag": 0}
SENTENCES = ["reuse_reasons", "timing_reasons", "mismatch_reasons", "stock_reasons", "synthetic_reasons", "photo_text_reasons"]


def text_signals(df: DataFrame) -> DataFrame:
    """record_id and what reasons need of the text, so that later joins need not carry it."""
    t = F.lower(T.norm_text(F.col("review_text")))
    split = F.filter(F.split(t, " "), lambda x: x != "")
    words = F.size(split)
    rows = df.withColumn("n_words", F.size(T.tokens(F.col("review_text"))))
    structured, low_risk = evaluation.low_risk_text(F.col("review_text"), F.col("n_words"))
    return rows.select(
        "record_id", words.alias("t_words"), (F.regexp_count(t, F.lit("!")) >= 3).alias("t_bangs"), T.has_phrase(t, REASON_PHRASES).alias("t_promo"),
        (F.size(F.array_distinct(split)) < F.greatest(F.lit(3), F.floor(words / 2))).alias("t_repeats"), "n_words", structured.alias("structured"), low_risk.alias("low_risk"),
    )


def _no_sentences(name: str):
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def photo_signals(links: DataFrame, reviews: DataFrame) -> DataFrame:
    """record_id with the scores and sentences of its photos: reuse, timing, URL hints, looks and recognised text.

    links: page_id, record_id, author, sec, url, and where known `probabilities` (a map from an image's labels to
    their probability) and `ocr_text`. A model's look of the riskiest image replaces a URL hint that is not larger.
    """
    c = F.col
    reuse = photos.photo_reuse(links).select("record_id", "images", "reused", "cluster", "reuse_score").withColumn("reuse_reasons", photos.reuse_reasons(c("reused"), c("cluster")))
    timing = photos.best_cluster_per_review(links, photos.temporal_clusters(links))
    timing = timing.select("record_id", "temporal_score", "temporal_flag", photos.timing_reasons(c("n_reviews"), c("n_authors"), c("span_sec")).alias("timing_reasons"))
    by = links.groupBy("record_id").agg(F.collect_set("url").alias("urls"))
    hints = by.select("record_id", photos.stock_url_signal(c("urls")).alias("url_stock"), photos.synthetic_url_signal(c("urls")).alias("url_synthetic"))
    rows = reuse.join(timing, "record_id", "left").join(hints, "record_id", "left")
    about = reviews.select("record_id", "source_site", photos.product_category([F.lit("general")], c("source_site"), c("title"), c("review_text")).alias("category"))
    looks = ("mismatch_reasons", "stock_reasons", "synthetic_reasons")
    if "probabilities" in links.columns:
        seen = photos.alignment_scores(links.filter("probabilities is not null").join(about.select("record_id", "category"), "record_id"))
        best = photos.best_image(seen, looks).select("record_id", *[c(k).alias(f"look_{k}") for k in ("mismatch", "stock", "synthetic", *looks)])
        rows = rows.join(best, "record_id", "left")
    else:
        rows = rows.withColumns({f"look_{k}": F.lit(None).cast("double") for k in ("mismatch", "stock", "synthetic")} | {f"look_{k}": F.lit(None).cast("array<string>") for k in looks})
    larger = lambda k: c(f"look_{k}") >= c(f"url_{k}")
    rows = rows.withColumns({
        "mismatch": c("look_mismatch"), "mismatch_reasons": c("look_mismatch_reasons"), "stock": F.greatest("look_stock", "url_stock"), "synthetic": F.greatest("look_synthetic", "url_synthetic"),
        "stock_reasons": F.when(larger("stock"), c("look_stock_reasons")).otherwise(photos.stock_url_reasons(c("url_stock"))),
        "synthetic_reasons": F.when(larger("synthetic"), c("look_synthetic_reasons")).otherwise(photos.synthetic_url_reasons(c("url_synthetic"))),
    })
    rows = rows.drop("url_stock", "url_synthetic", *[f"look_{k}" for k in ("mismatch", "stock", "synthetic", *looks)])
    if "ocr_text" in links.columns:
        read = photo_text.photo_text(links.select("record_id", "url", "ocr_text").join(about.select("record_id", "source_site"), "record_id"))
        best = F.min_by(F.struct("photo_text_score", "photo_text_flag", "photo_text_reasons"), F.struct((-c("photo_text_score")).alias("s"), "url", "ocr_text")).alias("b")
        return rows.join(read.groupBy("record_id").agg(best).select("record_id", "b.*"), "record_id", "left")
    return rows.withColumns({"photo_text_score": F.lit(0.0), "photo_text_flag": F.lit(0), "photo_text_reasons": F.lit(None).cast("array<string>")})


def page_signals(reviews: DataFrame, links: DataFrame) -> DataFrame:
    """What the report needs of each review besides a model: page scores, slang, text, machine-text score, photos; a written table."""
    profiled = slang.slang_reason(slang.with_slang(pages.prepared(reviews)))
    scored = pages.manipulation_reasons(pages.page_scores(profiled))
    own = machine_text.opening_boost(machine_text.for_openings(machine_text.ai_score(reviews.select("page_id", "record_id", "title", "review_text")))).select("record_id", "ai", "ai_flag", "ai_label", "ai_reasons")
    rows = scored.join(text_signals(reviews), "record_id").join(own, "record_id").join(photo_signals(links, reviews), "record_id", "left").fillna(PHOTO_COLUMNS)
    rows = cut(rows.withColumn("photo_reasons", F.concat(*map(_no_sentences, SENTENCES))).drop(*SENTENCES))
    return rows.join(rows.groupBy("page_id").agg(F.max("ai").alias("page_ai")), "page_id")


def report_rows(rows: DataFrame, policy: dict[str, float] | None = None, threshold: float = 0.5) -> DataFrame:
    """Scored rows from page_signals with pt (a text model's probability), p_text (text and page together) and coverage."""
    c = F.col
    signals = {"reuse": c("reuse_score"), "temporal": c("temporal_score"), "mismatch": c("mismatch"), "stock": c("stock"), "synthetic": c("synthetic"), "text": c("photo_text_score")}
    rows = rows.withColumn("p_photo", evaluation.photo_boost(c("p_text"), signals)).withColumn("p", machine_text.ai_boost(c("p_photo"), c("ai"), c("page_ai")))
    rows = evaluation.apply_triage(evaluation.uncertainty(rows, threshold), policy or POLICY)
    rows = rows.withColumns({"suspicious": (c("p") >= threshold).cast("int"), "manual": (c("triage") == "needs_manual_review").cast("int")})
    return rows.withColumns({"reasons": review_reasons(), "categories": review_categories(), "risk": T.risk_level(c("p"), 0.85, 0.55)})


def score_reviews(reviews: DataFrame, links: DataFrame, policy: dict[str, float] | None = None, threshold: float = 0.5) -> DataFrame:
    """One scored row per review, text and page combined by fixed weights. reviews: page_id, record_id, author, title, rating, review_date, review_text, source_site, pt, coverage; links as in photo_signals."""
    rows = page_signals(reviews, links)
    return report_rows(rows.withColumn("p_text", evaluation.combine_simple(F.col("pt"), F.col("rating_manipulation"))), policy, threshold)


def review_reasons() -> Column:
    """The sentences of the review's own rules, then those of the page, the photos and the machine-text score, without repeats."""
    c = F.col
    detail = F.when(c("domain") == "general", "product").otherwise(c("domain"))
    hype = F.concat(F.lit("The slang profile looks hype-heavy and weakly grounded in "), detail, F.lit(" detail"), F.when(F.size("terms") > 0, F.concat(F.lit(" ("), F.array_join(F.slice("terms", 1, 3), ", "), F.lit(").")) ).otherwise("."))
    # The sentences.
    rules = T.array_of(
        (c("p") >= 0.8, "The neural model considers this review highly suspicious."),
        ((c("p") >= 0.6) & (c("p") < 0.8), "The review has several linguistic patterns often seen in manipulated feedback."),
        (c("t_words") < 8, "The review is unusually short and provides very little concrete detail."),
        (c("t_bangs"), "The text relies on heavy emotional punctuation."),
        (c("t_promo"), "The wording looks promotional or strongly templated."),
        (c("t_repeats"), "There is visible repetition, which can indicate scripted review text."),
        ((c("extreme") == 1) & (c("t_words") < 15), "An extreme rating is paired with a generic explanation."),
        (c("template_dup") >= 2, "The same slang-heavy language pattern appears in multiple reviews on this page."),
        (c("slang_manipulation") >= 0.55, hype),
        (c("rating_manipulation") >= 0.55, "Behavioral and statistical page signals also suggest possible rating manipulation."),
        ((c("reuse_score") >= 0.45) & (c("cluster") >= 2), "The customer photo evidence is reused across multiple reviews."),
        ((c("temporal_flag") == 1) & (c("temporal_score") >= 0.55), "The same customer photo appears in a short time window across different authors."),
        (c("mismatch") >= 0.58, "The attached customer photo does not match the review text or inferred product category."),
        (c("stock") >= 0.58, "The customer image looks like a stock, catalog, studio, render, banner, or listing asset."),
        (c("synthetic") >= 0.66, "The image has weak AI-generated or synthetic-image indicators; treat this as supporting evidence, not proof."),
        (c("photo_text_flag") == 1, "OCR found promo, watermark, contact, marketplace, or sales text on the customer photo."),
        ((c("ai_flag") == 1) | (c("ai") >= 0.66), "AI-text detector flagged polished/template-like review language; treat this as a moderation signal, not proof."),
    )
    return F.array_distinct(F.concat(rules, "manipulation_reasons", "photo_reasons", "ai_reasons"))


def review_categories() -> Column:
    """Compact labels; low_risk_or_insufficient_signal without any."""
    c = F.col
    found = T.array_of(
        (c("p") >= 0.60, "neural_text_suspicion"), ((c("t_words") < 8) | c("t_repeats"), "low_detail_or_repetitive_text"), (c("t_bangs") | c("t_promo"), "promotional_template_language"), ((c("extreme") == 1) & (c("t_words") < 15), "extreme_rating_low_evidence"),
        (c("rating_manipulation") >= 0.55, "page_behavior_manipulation"), (c("author_risk") >= 0.45, "reviewer_cluster_anomaly"), (c("slang_manipulation") >= 0.55, "hype_heavy_slang"), (c("reuse_score") >= 0.45, "photo_reuse"), (c("temporal_flag") == 1, "coordinated_photo_timing"),
        (c("mismatch") >= 0.58, "photo_text_mismatch"), (c("stock") >= 0.58, "stock_or_catalog_photo"), (c("synthetic") >= 0.66, "synthetic_image_hint"), (c("photo_text_flag") == 1, "photo_ocr_promo_signal"), ((c("ai_flag") == 1) | (c("ai") >= 0.66), "ai_generated_text_signal"), ((c("manual") == 1) | (c("uncertainty") >= 0.45), "manual_review_uncertainty"), (c("ood") >= 0.45, "out_of_domain_language"),
    )
    return F.when(F.size(found) == 0, F.array(F.lit("low_risk_or_insufficient_signal"))).otherwise(found)


def page_report(scored: DataFrame) -> DataFrame:
    """The metrics of each page over its scored rows."""
    c = F.col
    share = lambda cond: F.avg(cond.cast("double"))
    by = scored.groupBy("page_id").agg(
        F.count("*").alias("total_reviews"), F.sum("suspicious").alias("suspicious_reviews"), F.avg("suspicious").alias("suspicious_ratio"), F.avg("p").alias("average_probability"), F.max("p").alias("highest_probability"),
        F.count_if(c("triage") == "confident_suspicious").alias("confident_suspicious"), F.count_if(c("triage") == "confident_clean").alias("confident_clean"), F.sum("manual").alias("manual_reviews"), F.avg("manual").alias("manual_ratio"), F.avg("uncertainty").alias("uncertainty_mean"), share(c("ood") >= 0.45).alias("ood_ratio"),
        F.count_if(c("images") > 0).alias("photo_reviews"), F.count_if(c("reused") > 0).alias("duplicate_photo_reviews"), F.max("cluster").alias("largest_photo_cluster"), F.sum("temporal_flag").alias("temporal_reviews"), F.count_if(c("stock") >= 0.58).alias("stock_reviews"), F.count_if(c("synthetic") >= 0.66).alias("synthetic_reviews"),
        F.count_if(c("mismatch") >= 0.58).alias("mismatch_reviews"), F.sum("photo_text_flag").alias("photo_text_reviews"), share(c("temporal_flag") == 1).alias("temporal_ratio"),
        F.sum("ai_flag").alias("ai_flagged"), F.avg("ai").alias("ai_mean"),
    )
    by = by.withColumns({
        "clean_reviews": c("total_reviews") - c("suspicious_reviews"), "automated_ratio": (c("confident_suspicious") + c("confident_clean")) / c("total_reviews"), "duplicate_photo_ratio": F.when(c("photo_reviews") > 0, c("duplicate_photo_reviews") / c("photo_reviews")).otherwise(0.0),
        "risk_level": T.risk_level(F.when(c("suspicious_reviews") > 0, c("highest_probability")).otherwise(c("average_probability")), 0.85, 0.55),
    })
    by = by.withColumn("photo_risk", F.when(c("photo_reviews") == 0, "none").otherwise(photos.photo_risk(c("duplicate_photo_ratio"), c("largest_photo_cluster"))))
    return by.join(pages.page_summary(scored).drop("n_reviews").withColumnRenamed("risk", "rating_manipulation_risk"), "page_id")


def page_highlights(scored: DataFrame, report: DataFrame, top_reasons: int = 4, top_authors: int = 5) -> DataFrame:
    """Per page: the top reasons with counts, the most suspicious review, the top authors and notes, each joined by `; `."""
    c = F.col

    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "x"))), lambda s: s["x"]), "; ").alias(name))

    counts = scored.select("page_id", F.explode("reasons").alias("reason")).groupBy("page_id", "reason").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("n"), "reason"))).filter(c("rank") <= top_reasons)
    most = scored.groupBy("page_id").agg(F.max(F.struct(F.round("p", 9).alias("p"), (-c("record_id")).alias("r"))).alias("m")).select("page_id", (-c("m.r")).alias("most_suspicious"))
    authors = pages.suspicious_authors(scored, top=top_authors)
    first = authors.filter("rank = 1").select("page_id", c("author_key").alias("__author"), c("n_high").alias("__high"))
    some = c("total_reviews") >= 4
    said = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    # The notes.
    notes = T.array_of(
        (c("suspicious_reviews") == 0, "The model did not flag any extracted reviews as suspicious."),
        (c("suspicious_reviews") > 0, "Suspicious reviews are ranked by a calibrated hybrid score that combines the neural text model and manipulation signals."),
        (c("manual_reviews") > 0, said(c("manual_reviews"), " review(s) were routed to manual review because the model saw uncertainty or out-of-domain patterns.")),
        (c("duplicate_photo_reviews") > 0, said("Customer photo reuse was detected in ", c("duplicate_photo_reviews"), " review(s); the largest shared-photo cluster spans ", c("largest_photo_cluster"), " reviews.")),
        (c("temporal_reviews") > 0, said("Coordinated photo timing was detected in ", c("temporal_reviews"), " review(s): the same customer image appeared across different authors inside a 48.0-hour window.")),
        (c("mismatch_reviews") > 0, said("Image-text alignment flagged ", c("mismatch_reviews"), " customer photo(s) as visually inconsistent with the review text or inferred product category.")),
        (c("stock_reviews") > 0, said("Stock/marketing photo detection flagged ", c("stock_reviews"), " image(s) that look closer to catalog, studio, render, banner, or listing assets than user-taken snapshots.")),
        (c("synthetic_reviews") > 0, said("AI/synthetic image detection produced weak auxiliary hints on ", c("synthetic_reviews"), " image(s); this signal should support, not replace, human review or stronger fraud evidence.")),
        (c("photo_text_reviews") > 0, said("OCR found promo text, watermark-like text, contact handles, or marketplace branding on ", c("photo_text_reviews"), " customer photo(s).")),
        (c("ai_flagged") > 0, said("AI-text detector flagged ", c("ai_flagged"), " review(s) with polished, template-like, weakly grounded language; this is a moderation signal, not proof.")),
        (c("__author").isNotNull(), said("Top suspicious author cluster: ", c("__author"), " with ", c("__high"), " flagged review(s).")),
        (some & (c("r_slang") >= 0.25), "The bilingual slang detector found a visible share of hype-heavy comments that look more coordinated than conversational."),
        (some & (c("r_slang") < 0.25) & (c("r_organic") >= 0.25) & (c("slang_authenticity_mean") >= 0.58), "Several comments use grounded colloquial language with concrete detail, which slightly weakens the fake-review hypothesis."),
        (some & (c("r_bilingual") >= 0.18), "Russian and English slang are mixed unusually often across the current review sample."),
        (some & (c("r_template") >= 0.18), "A repeated slang template appears across multiple reviews, which strengthens the coordination hypothesis."),
        ((c("page_domain") != "general") & (c("page_confidence") >= 0.35), said("Language grounding was calibrated against the inferred ", c("page_domain"), " product domain.")),
    )
    out = report.join(first, "page_id", "left").select("page_id", F.array_join(notes, "; ").alias("notes"))
    names = listed(authors.withColumn("x", F.concat_ws(":", "author_key", "n_high")), "top_authors")
    return out.join(listed(ranked.withColumn("x", F.concat_ws(":", "reason", "n")), "top_reasons"), "page_id", "left").join(most, "page_id").join(names, "page_id", "left").fillna({"top_reasons": "", "top_authors": ""})


# Names of the page's signals, in the order that breaks ties.
PAGE_SIGNALS = {
    "Suspicious review ratio": "suspicious_ratio", "Behavioral manipulation score": "manipulation_mean", "Peak suspicious probability": "highest_probability", "Manual review uncertainty": "manual_ratio",
    "Duplicate photo signal": "duplicate_photo_ratio", "Photo temporal cluster signal": "temporal_ratio", "Image/text mismatch signal": "mismatch_ratio", "Stock/marketing photo signal": "stock_ratio",
    "Synthetic image signal": "synthetic_ratio", "Photo OCR signal": "photo_text_ratio", "AI-generated text signal": "ai_ratio", "Language template signal": "language_ratio", "Out-of-domain uncertainty": "ood_ratio",
}


def _whole(value: Column, low: float, high: float) -> Column:
    """A share as percents between low and high, halves rounded up."""
    return F.floor(F.least(F.greatest(F.round(value * 100, 9), F.lit(low)), F.lit(high)) + 0.5).cast("long")


def dashboard_overview(report: DataFrame) -> DataFrame:
    """Per page: risk score, confidence, manipulation probability, status and verdict of the page report."""
    c = F.col
    risk = 0.50 * c("suspicious_ratio") + 0.28 * c("manipulation_mean") + 0.12 * c("highest_probability") + 0.10 * F.least(c("manual_ratio"), F.lit(0.35))
    # a page without automated decisions counts as one with all but its manual reviews decided
    decided = F.when(c("automated_ratio") == 0, 1 - c("manual_ratio")).otherwise(c("automated_ratio"))
    flagged = F.when(c("confident_suspicious") > 0, c("confident_suspicious")).otherwise(c("suspicious_reviews"))
    rows = report.withColumns({
        "risk_score": _whole(risk, 12, 98), "confidence": _whole(0.72 * decided + 0.28 * F.greatest(F.lit(0.0), 1 - c("uncertainty_mean")), 52, 97),
        "manipulation_probability": _whole(0.6 * c("manipulation_mean") + 0.4 * c("suspicious_ratio"), 8, 96), "suspicious_count": flagged,
    })
    of = lambda high, mid, low: F.when(c("risk_score") >= 80, high).when(c("risk_score") >= 60, mid).otherwise(low)
    text = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    # The sentences.
    return rows.withColumns({
        "status": of("High fraud risk", "Watchlist", "Low-risk sample"),
        "verdict": of(
            text("The page presents strong evidence of manipulated review behavior with ", flagged, " confidently suspicious reviews and ", c("manual_reviews"), " items routed to manual review."),
            text("The review set shows mixed authenticity patterns and ", c("manual_reviews"), " review(s) still need a human decision before the rating profile can be trusted."),
            F.lit("The visible review sample looks comparatively stable, although normal moderation checks are still recommended."),
        ),
    })


def fallback_signals(report: DataFrame, top: int = 12) -> DataFrame:
    """Per page its positive signals by size (of equal ones the first listed), in whole percents; a page without any has one row of its review count."""
    c = F.col
    over = lambda n: F.coalesce(F.try_divide(c(n), c("total_reviews")), F.lit(0.0))
    rows = report.withColumns({
        "mismatch_ratio": over("mismatch_reviews"), "stock_ratio": over("stock_reviews"), "synthetic_ratio": over("synthetic_reviews"), "photo_text_ratio": over("photo_text_reviews"), "ai_ratio": over("ai_flagged"),
        "language_ratio": F.when(c("r_template") > 0, c("r_template")).otherwise(c("r_slang")),
    })
    listed = F.array(*[F.struct((-F.round(F.col(k).cast("double"), 9)).alias("v"), F.lit(i).alias("i"), F.lit(name).alias("signal")) for i, (name, k) in enumerate(PAGE_SIGNALS.items())])
    first = F.slice(F.array_sort(F.filter(listed, lambda s: s["v"] < 0)), 1, top)
    counted = F.transform(first, lambda s: F.struct(s["signal"].alias("signal"), F.greatest(F.lit(1).cast("long"), _whole(-s["v"], 1, 100)).alias("n")))
    none = F.array(F.struct(F.lit("Low-risk review profile").alias("signal"), c("total_reviews").cast("long").alias("n")))
    return rows.select("page_id", F.posexplode(F.when(F.size(counted) > 0, counted).otherwise(none)).alias("rank", "s")).select("page_id", (c("rank") + 1).alias("rank"), "s.*")
