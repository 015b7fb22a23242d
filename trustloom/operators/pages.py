"""Page manipulation signals: every page aggregate is partitioned by page_id.

Scores need the slang profile (slang.with_slang). Counts per page and key are map-side sums on digests of the
text, title and author, joined back to narrow rows; the text itself is measured first and left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustloom.functions import lexicons as L
from trustloom.functions import text as T
from trustloom.sources.tables import cut


def author_key() -> Column:
    return F.coalesce(F.nullif(T.norm_text(F.col("author")), F.lit("")), F.concat(F.lit("anonymous_"), F.col("record_id")))


def _counts(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows per page and key beside each row; a null key counts 1."""
    keyed = df.withColumn("__key", key)
    counts = keyed.filter("__key is not null").groupBy("page_id", "__key").agg(F.count("*").alias(name))
    return keyed.join(counts, ["page_id", "__key"], "left").drop("__key").fillna({name: 1})


def keyed(df: DataFrame) -> DataFrame:
    """df with digests of text and title, by which equal ones are counted; null for empty ones."""
    digest = lambda c: F.when(F.col(c) != "", F.md5(c))
    rows = df.withColumns({"__text": F.lower(T.norm_text(F.col("review_text"))), "__title": F.lower(T.norm_text(F.col("title")))})
    return rows.withColumns({"__text": digest("__text"), "__title": digest("__title")})


def prepared(df: DataFrame) -> DataFrame:
    """Reviews with all that page_scores needs of their texts, measured where the texts lie: once rows are dealt out by page, few tasks would measure them."""
    return keyed(measured(df))


def page_counts(df: DataFrame, keep_text: bool = True) -> DataFrame:
    """Duplicate texts and titles, reviews per author, reviews and extreme reviews per day. Empty texts count 1.

    Without keep_text the text and title stay behind, so that the joins move narrow rows.
    """
    rows = (df if "__text" in df.columns else keyed(df)).withColumn("__author", author_key())
    rows = cut(rows if keep_text else rows.drop("review_text", "title"))  # each count reads it, and the rows themselves
    for key, name in (("__text", "dup_text"), ("__title", "dup_title"), ("__author", "author_reviews")):
        rows = _counts(rows, F.col(key), name).drop(key)
    days = df.filter("review_date is not null").groupBy("page_id", "review_date").agg(F.count("*").alias("same_day"), F.count_if(F.col("rating").isin(1.0, 5.0)).alias("same_day_extreme"))
    return rows.join(days, ["page_id", "review_date"], "left").fillna({"same_day": 0, "same_day_extreme": 0})


def without_page_context(df: DataFrame) -> DataFrame:
    """For reviews that are scored alone: no counts and no templates."""
    ones, none = {c: F.lit(1).cast("long") for c in ("dup_text", "dup_title", "author_reviews")}, {c: F.lit(0).cast("long") for c in ("same_day", "same_day_extreme", "template_dup")}
    return df.withColumns({**ones, **none, "template_component": F.lit(0.0), "template_flag": F.lit(0)})


def measured(df: DataFrame) -> DataFrame:
    """The parts of the scores that one review gives by itself; the text and title are replaced by digests of what counts need."""
    t = F.col("review_text")
    extreme = F.col("rating").isin(1.0, 5.0).cast("int")
    return df.withColumns({"phrase": T.has_phrase(T.norm_text(t), L.PAGE_PHRASES).cast("int"), "uniq": T.unique_word_ratio(t), "extreme": extreme, "short_extreme": extreme * (T.word_count(t) <= 8).cast("int"), "has_title": (T.norm_text(F.col("title")) != "").cast("int"), "has_author": (T.norm_text(F.col("author")) != "").cast("int")})


def page_ratios(df: DataFrame) -> DataFrame:
    """One row per page; the busiest day and author are divided by all reviews of the page."""
    share = lambda cond, name: F.avg(cond.cast("double")).alias(name)
    c = F.col
    return df.groupBy("page_id").agg(
        F.count("*").alias("n_reviews"), share(c("rating").isin(1.0, 5.0), "r_extreme"), share(c("rating") >= 4.5, "r_five"), share(c("rating") <= 1.5, "r_one"), share(c("dup_text") > 1, "r_duplicate"),
        (F.max("author_reviews") / F.count("*")).alias("r_author"), (F.max("same_day") / F.count("*")).alias("r_day"), share(c("slang_manipulation") >= 0.45, "r_slang"), share(c("mix") == 1, "r_bilingual"), share(c("profile") == "organic", "r_organic"), share(c("template_flag") == 1, "r_template"),
    )


def page_components(ratios: DataFrame) -> DataFrame:
    c, gate = F.col, T.ramp(F.col("n_reviews"), 3, 5)
    skew = F.least(F.greatest(F.greatest("r_five", "r_one") - 0.6, F.lit(0.0)), F.lit(0.4)) / 0.4
    return ratios.withColumns({
        "p_extreme": T.ramp(c("r_extreme"), 0.65, 0.35), "p_skew": skew, "p_duplicate": T.clip(c("r_duplicate") / 0.35), "p_author": T.ramp(c("r_author"), 0.15, 0.35) * gate, "p_day": T.ramp(c("r_day"), 0.2, 0.5) * gate,
        "p_slang": T.ramp(c("r_slang"), 0.12, 0.38) * gate, "p_bilingual": T.ramp(c("r_bilingual"), 0.08, 0.22) * gate, "p_template": T.clip(c("r_template") / 0.35) * gate,
    })


def row_components(df: DataFrame) -> DataFrame:
    c, slang = F.col, F.col("slang_manipulation")
    return df.withColumns({
        "c_text": T.ramp(c("dup_text"), 1, 2), "c_title": T.ramp(c("dup_title"), 1, 2), "c_author": T.ramp(c("author_reviews"), 1, 3), "c_burst": T.ramp(c("same_day"), 2, 4), "c_extreme_burst": T.ramp(c("same_day_extreme"), 2, 4),
        "c_generic": T.clip(0.45 * c("phrase") + 0.25 * (1 - c("uniq")) + 0.30 * slang), "c_credit": T.clip(c("slang_authenticity") * (1 - slang)),
    })


def local_manipulation_score() -> Column:
    c = F.col
    return T.clip(0.24 * c("phrase") + 0.18 * c("short_extreme") + 0.12 * c("extreme") + 0.18 * (1 - c("uniq")) + 0.18 * c("slang_manipulation") + 0.10 * c("bi_hype") + 0.08 * c("low_detail") - 0.16 * c("c_credit"))


def author_risk_score() -> Column:
    c = F.col
    return T.clip(0.38 * c("c_author") + 0.20 * c("c_burst") + 0.16 * c("c_text") + 0.10 * c("c_generic") + 0.08 * c("slang_manipulation") + 0.08 * c("template_component") - 0.08 * c("c_credit"))


def rating_manipulation_score() -> Column:
    c = F.col
    own = 0.18 * c("c_text") + 0.10 * c("c_title") + 0.15 * c("c_author") + 0.11 * c("c_burst") + 0.08 * c("c_extreme_burst") + 0.12 * c("short_extreme") + 0.08 * c("c_generic") + 0.08 * c("slang_manipulation") + 0.07 * c("template_component") - 0.08 * c("c_credit")
    page = 0.04 * c("p_extreme") + 0.06 * c("p_duplicate") + 0.05 * c("p_author") + 0.05 * c("p_day") + 0.07 * c("p_skew") + 0.04 * c("p_slang") + 0.04 * c("p_bilingual") + 0.04 * c("p_template")
    return T.clip(own + page)


def page_scores(profiled: DataFrame) -> DataFrame:
    """Local, author risk and rating manipulation scores of each review, without its text; profiled has the slang profile, best of prepared reviews."""
    rows = profiled if "__text" in profiled.columns else measured(profiled)
    rows = cut(row_components(page_counts(rows, keep_text=False)))  # read for the page's ratios and for its rows
    rows = rows.join(page_components(page_ratios(rows)), "page_id")
    return rows.withColumns({"local_score": local_manipulation_score(), "author_risk": author_risk_score(), "rating_manipulation": rating_manipulation_score()})


def manipulation_reasons(df: DataFrame) -> DataFrame:
    """The sentences of up to 15 rules, in order; five of the seven page rules need four reviews. Needs slang_reason."""
    c, some = F.col, F.col("n_reviews") >= 4
    # The sentences.
    rules = [
        (c("dup_text") >= 2, "The same or nearly identical review text appears multiple times on this page."),
        ((c("dup_title") >= 2) & (c("has_title") == 1), "The review title repeats across multiple ratings."),
        ((c("author_reviews") >= 2) & (c("has_author") == 1), "The same author appears unusually often in the current review sample."),
        (c("same_day") >= 3, "Many reviews were published in a tight date cluster."),
        (c("same_day_extreme") >= 3, "The date cluster is dominated by extreme ratings."),
        (c("short_extreme") == 1, "An extreme rating is paired with a very short explanation."),
        (c("phrase") == 1, "The wording resembles promotional or templated review language."),
        (c("slang_reason").isNotNull(), c("slang_reason")),
        (c("r_extreme") >= 0.7, "The page is dominated by extreme ratings, which may indicate manipulation."),
        (c("r_duplicate") >= 0.25, "A noticeable share of the page contains duplicated review content."),
        (some & (c("r_day") >= 0.35), "A large portion of the reviews appeared on the same day."),
        (some & (c("r_author") >= 0.25), "A small set of authors contributes a disproportionate share of reviews."),
        (some & (c("r_slang") >= 0.25), "Many comments rely on hype-heavy slang instead of grounded product detail."),
        (some & (c("r_bilingual") >= 0.18), "Russian and English slang are mixed unusually often across the current review page."),
        (some & (c("r_template") >= 0.18), "A repeated slang template appears across multiple reviews on the page."),
    ]
    return df.withColumn("manipulation_reasons", T.array_of(*rules))


def suspicious_authors(scored: DataFrame, threshold: float = 0.55, top: int | None = 10) -> DataFrame:
    """Named authors of each page by high rows, then mean score, then reviews."""
    named = scored.filter(T.norm_text(F.col("author")) != "").groupBy("page_id", author_key().alias("author_key"))
    by = named.agg(F.count("*").alias("n_reviews"), F.avg("rating_manipulation").alias("mean_manipulation"), F.count_if(F.col("rating_manipulation") >= threshold).alias("n_high"))
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("n_high"), F.desc(F.round("mean_manipulation", 6)), F.desc("n_reviews"), "author_key"))
    ranked = by.withColumn("rank", rank)
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def page_summary(scored: DataFrame) -> DataFrame:
    """The metrics of each page: its ratios, slang means, dominant domain and marketplace, authors, mean score and risk."""
    c = F.col
    first = lambda name: F.max(name).alias(name)  # one value per page
    by = scored.groupBy("page_id").agg(
        F.count("*").alias("n_reviews"), F.count_if(c("author_reviews") > 1).alias("repeated_authors"), first("r_extreme"), first("r_duplicate"), first("r_day"), first("r_author"), F.avg("slang_authenticity").alias("slang_authenticity_mean"), F.avg("slang_manipulation").alias("slang_manipulation_mean"),
        first("r_slang"), first("r_bilingual"), first("r_organic"), first("page_domain"), first("page_confidence"), first("r_template"), F.avg("rating_manipulation").alias("manipulation_mean"), T.risk_level(F.avg("rating_manipulation"), 0.8, 0.55).alias("risk"),
    )
    packs = scored.filter("market_pack != 'generic'").groupBy("page_id", "market_pack").agg(F.count("*").alias("n"), F.min("record_id").alias("first"))
    packs = packs.groupBy("page_id").agg(F.max_by("market_pack", F.struct("n", -c("first"))).alias("page_market"))
    bad = suspicious_authors(scored, top=None).filter("n_high > 0").groupBy("page_id").agg(F.count("*").alias("suspicious_authors"))
    return by.join(packs, "page_id", "left").join(bad, "page_id", "left").fillna({"page_market": "generic", "suspicious_authors": 0})
