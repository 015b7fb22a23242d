"""Rating detector: statistics, bursts, features, reasons and ranked users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustloom.functions import lexicons as L
from trustloom.functions import text as T
from trustloom.operators import slang
from trustloom.sources.tables import cut

#: A median is read off directly once this many rows are left; before, their range is divided so often.
MEDIAN_ROWS, MEDIAN_RANGES = 100_000, 256


def user_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(
        F.count("*").alias("user_count"), F.avg("rating").alias("user_mean"), F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("user_std"),
        F.count_distinct("ip_address").alias("user_ips"), F.count_distinct("geo_country", "geo_city").alias("user_geos"),
    )


def user_mean_gap(df: DataFrame) -> DataFrame:
    """Mean seconds between a user's ratings: the gaps telescope to (last - first) / (n - 1). Null with one rating."""
    sec = F.unix_micros("ts") / 1e6
    return df.groupBy("user_id").agg(F.nullif((F.max(sec) - F.min(sec)) / F.nullif(F.count("*") - 1, F.lit(0)), F.lit(0.0)).alias("mean_gap"))


def item_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("item_id").agg(F.count("*").alias("item_count"), F.avg("rating").alias("item_mean"), F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("item_std"))


def ip_stats(df: DataFrame) -> DataFrame:
    return df.filter("ip_address is not null").groupBy("ip_address").agg(F.count("*").alias("ip_count"), F.count_distinct("user_id").alias("ip_users"))


def value_counts(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def _middle(df: DataFrame, column: str) -> DataFrame:
    """The exact median of a column, one row: values are counted by key ranges, and only the ranges around the middle are sorted.

    Halves of a range are counted again and again until the middle one is small, so no task sorts all rows.
    """
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    n, lo, hi = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return df.sparkSession.createDataFrame([(None,)], f"{column} double")
    want, below = ((n - 1) // 2, n // 2), 0
    while n > MEDIAN_ROWS and lo < hi:
        width = (hi - lo) / MEDIAN_RANGES
        part = F.least(F.floor((F.col("x") - lo) / width), F.lit(MEDIAN_RANGES - 1))
        counts = sorted(rows.filter(F.col("x").between(lo, hi)).groupBy(part.alias("part")).agg(F.count("*").alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), key=lambda r: r["part"])
        at, kept = below, []
        for r in counts:
            if at <= want[1] and at + r["k"] > want[0]:
                kept.append((at, r))
            at += r["k"]
        new = kept[0][1]["lo"], kept[-1][1]["hi"]
        if new == (lo, hi):
            break
        (lo, hi), below, n = new, kept[0][0], sum(r["k"] for _, r in kept)
    tail = rows.filter(F.col("x").between(lo, hi)).groupBy("x").agg(F.count("*").alias("k")).orderBy("x")
    run = F.sum("k").over(W.partitionBy(F.lit(0)).orderBy("x")) + below  # few distinct values by now
    return tail.withColumn("upto", run).agg(((F.min(F.when(F.col("upto") > want[0], F.col("x"))) + F.min(F.when(F.col("upto") > want[1], F.col("x")))) / 2).alias(column))


def fit_defaults(df: DataFrame) -> DataFrame:
    """One row of medians over the lookup tables, for keys that were not seen."""
    users, items, ips, gaps = (x.persist() for x in (user_stats(df), item_stats(df), ip_stats(df), user_mean_gap(df)))
    parts = [
        *[_middle(users, c) for c in ("user_count", "user_std")], users.agg(F.avg("user_mean").alias("user_mean")), *[_middle(items, c) for c in ("item_count", "item_std")], items.agg(F.avg("item_mean").alias("item_mean")),
        *[_middle(ips, c) for c in ("ip_count", "ip_users")], _middle(gaps, "mean_gap").select(F.coalesce("mean_gap", F.lit(3600.0)).alias("gap")),
    ]
    rows = [p.first() for p in parts]  # one row each
    for table in (users, items, ips, gaps):
        table.unpersist()
    return df.sparkSession.createDataFrame([tuple(v for r in rows for v in r)], ", ".join(f"{c} double" for r in rows for c in r.asDict()))


def text_profiles(df: DataFrame, keyed: DataFrame) -> DataFrame:
    """text_key, text_count, words, promotional and the slang profile of each distinct text; the page is the whole table. keyed: the rows of df with text_key.

    A profile depends on the text alone but for domain and template counts, which weigh a text by its copies; so
    texts are profiled once, and ratings meet them by digest.
    """
    texts = keyed.filter("text_key is not null").groupBy("text_key").agg(F.count("*").alias("copies"), F.min("record_id").alias("__first"))
    # only the texts of first records are moved: the join meets ids, before a view's ids meet their texts
    first = df.join(texts.select("__first"), F.col("record_id").eqNullSafe(F.col("__first")), "left_semi").select("review_text")
    whole = with_text_key(first).dropDuplicates(["text_key"]).join(texts.drop("__first"), "text_key")
    text = F.col("review_text")
    whole = whole.withColumns({"words": T.word_count(text), "promotional": T.has_phrase(text, L.RATING_PHRASES).cast("int")})
    out = slang.with_slang(whole, keys=()).withColumnRenamed("copies", "text_count")
    return out.select("text_key", "text_count", "words", "promotional", "slang_manipulation", "slang_authenticity", "template_dup", "template_component", "mix", "profile", "bi_hype", "low_detail", "density", "detail", "grounding", "hype")


def with_text_key(df: DataFrame) -> DataFrame:
    """A digest of the text beside it, null where it is empty: joins and windows can leave the text behind."""
    if "text_key" in df.columns:
        return df
    return df.withColumn("text_key", T.once(F.lower(F.trim("review_text")), lambda t: F.when(t != "", F.md5(t))))


def join_stats(df: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """Fitted statistics beside each rating; a missing address has zeros, an empty text the count 1.

    With another fitted table, users and items that it does not hold take its defaults.
    """
    base = with_text_key(fitted if fitted is not None else df)
    texts = base.filter("text_key is not null").groupBy("text_key").agg(F.count("*").alias("text_count"))
    out = with_text_key(df).drop("review_text")
    if "text_count" in df.columns:
        texts = None
    base = base.drop("review_text")
    pairs = value_counts(base, ["user_id", "item_id"], "pair_count")
    tables = [(user_stats(base), ["user_id"]), (item_stats(base), ["item_id"]), (ip_stats(base), ["ip_address"]), (pairs, ["user_id", "item_id"])]
    for table, keys in tables + ([(texts, ["text_key"])] if texts is not None else []):
        out = out.join(table, keys, "left")
    if fitted is not None:
        d = fit_defaults(base).first()
        out = out.fillna({c: d[c] for c in ("user_mean", "user_std", "item_mean", "item_std")} | {c: int(d[c]) for c in ("user_count", "item_count")})
    return out.fillna({"ip_count": 0, "ip_users": 0, "text_count": 1, "pair_count": 0}).drop("text_key")


def rating_deviation(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "user_deviation": F.abs(F.col("rating") - F.col("user_mean")), "item_deviation": F.abs(F.col("rating") - F.col("item_mean")),
        "item_z": F.abs(F.col("rating") - F.col("item_mean")) / (F.col("item_std") + 1e-3),
    })


def seconds_since_prev(df: DataFrame, slot_seconds: int = 86_400) -> DataFrame:
    """since_prev, seconds since the user's rating before, in order of ts and record_id; null for the first.

    Windows are per user and time slot; the first of a slot follows the last of the user's slot before, from a table of one row a slot.
    """
    rows = df.withColumn("__slot", F.floor(F.unix_micros("ts") / (1_000_000 * slot_seconds)))
    lasts = rows.groupBy("user_id", "__slot").agg(F.max("ts").alias("__last"))
    before = lasts.select(F.col("user_id").alias("__u"), F.col("__slot").alias("__s"), F.lag("__last").over(W.partitionBy("user_id").orderBy("__slot")).alias("__before"))
    inner = F.lag("ts").over(W.partitionBy("user_id", "__slot").orderBy("ts", "record_id"))
    out = rows.withColumn("__prev", inner).join(before, F.col("user_id").eqNullSafe(F.col("__u")) & F.col("__slot").eqNullSafe(F.col("__s")))
    return out.withColumn("since_prev", (F.unix_micros("ts") - F.unix_micros(F.coalesce("__prev", "__before"))) / 1e6).drop("__slot", "__prev", "__before", "__u", "__s")


def burst_count(df: DataFrame, key: str, seconds: int, name: str, base: DataFrame | None = None) -> DataFrame:
    """Earlier events of the key in the last seconds (inclusive); ties at a second count in order of record_id.

    Seconds are counted first; a second adds its events and takes them back once it is too long ago, so one running sum over the
    seconds of a time slot of that length, and of the slot before as its context, serves all windows that end in the slot. base:
    the events where df is made of them by adding columns, so that a second count does not compute the first again.
    """
    with_sec = lambda d: d.withColumn("__sec", F.floor(F.unix_micros("ts") / 1_000_000))
    known, home = with_sec(df if base is None else base).filter(F.col(key).isNotNull()), F.floor(F.col("__sec") / seconds)
    at = known.groupBy(key, "__sec").agg(F.count("*").alias("__n"))
    step = lambda slot, sec, n, own: F.struct(slot.alias("__slot"), sec.alias("__sec"), n.alias("__n"), own.alias("__own"))
    n, none = F.col("__n"), F.lit(0).cast("long")
    steps = F.array(step(home, F.col("__sec"), n, n), step(home + 1, F.col("__sec"), n, none), step(home + 1, F.col("__sec") + (seconds + 1), -n, none))
    sums = at.select(key, F.explode(steps).alias("s")).groupBy(key, "s.__slot", "s.__sec").agg(F.sum("s.__n").alias("__n"), F.sum("s.__own").alias("__own"))
    run = F.sum("__n").over(W.partitionBy(key, "__slot").orderBy("__sec").rowsBetween(W.unboundedPreceding, 0))
    before = sums.withColumn("__before", run - F.col("__own")).filter("__own > 0").select(key, "__sec", "__before")
    nth = F.row_number().over(W.partitionBy(key, "__sec").orderBy("record_id"))
    rows = with_sec(df).join(before, [key, "__sec"], "left")  # no key, no count
    return rows.withColumn(name, F.coalesce(F.col("__before") + nth - 1, F.lit(0).cast("long"))).select(*df.columns, name)


TEXT_SIGNALS = {"words": 0, "promotional": 0, "slang_manipulation": 0.0, "slang_authenticity": 0.5, "template_dup": 0, "template_component": 0.0, "mix": 0, "profile": "neutral", "bi_hype": 0, "low_detail": 0, "density": 0.0, "detail": 0.0, "grounding": 0.0, "hype": 0.0}


def with_signals(df: DataFrame) -> DataFrame:
    """Statistics, deviations, bursts, text flags and slang: what reasons and features are made of. The text is left behind."""
    own = cut(with_text_key(df).drop("review_text"))  # texts are counted beside the rows
    short = {"short": (F.col("words") < 3).cast("int"), "short_extreme": (F.col("rating").isin(1.0, 5.0) & (F.col("words") < 3)).cast("int")}
    profiles = cut(text_profiles(df, own))
    narrow = own.join(profiles, "text_key", "left").fillna(TEXT_SIGNALS | {"text_count": 1}).withColumns(short)
    out = joined = cut(rating_deviation(join_stats(cut(narrow))))  # five tables are made of the narrow rows, three windows of the joined ones
    for key, seconds, name in (("user_id", 86400, "user_24h"), ("ip_address", 3600, "ip_1h"), ("item_id", 86400, "item_24h")):
        out = burst_count(out, key, seconds, name, joined)
    return out


#: Measures of a rating's whole text, made once for each distinct one; those of no text.
RAW_MEASURES = {"chars": 0, "unique_ratio": 1.0, "upper_ratio": 0.0, "digit_ratio": 0.0, "exclaim": 0.0, "question": 0.0}


def raw_measures(df: DataFrame, keyed: DataFrame) -> DataFrame:
    """raw_key and the measures of each distinct text as it is written. keyed: record_id and raw_key of the rows of df."""
    t, key = F.col("review_text"), F.md5("review_text")
    firsts = keyed.filter("raw_key is not null").groupBy("raw_key").agg(F.min("record_id").alias("__first")).select("__first")
    rows = df.join(firsts, F.col("record_id").eqNullSafe(F.col("__first")), "left_semi").select("review_text").withColumn("raw_key", key).dropDuplicates(["raw_key"])
    return rows.select("raw_key", F.length(t).alias("chars"), T.unique_word_ratio(t).alias("unique_ratio"), T.uppercase_ratio(t).alias("upper_ratio"), T.digit_ratio(t).alias("digit_ratio"), T.punct_density(t, "!").alias("exclaim"), T.punct_density(t, "?").alias("question"))


def usual_gap(df: DataFrame) -> float:
    """The median of the users' mean gaps, an hour without any: what fit_defaults has as gap."""
    gap = _middle(cut(user_mean_gap(df)), "mean_gap").first()[0]
    return 3600.0 if gap is None else gap


def rating_features(df: DataFrame) -> DataFrame:
    """record_id and the numeric feature frame; a user's first rating has the fitted gap before it, other nulls and NaN are 0.

    Texts are measured once each; a rating meets their measures by digest.
    """
    keyed = cut(df.select("record_id", F.md5("review_text").alias("raw_key")))
    measures = cut(raw_measures(df, keyed))
    signals = with_signals(df.withColumns({**T.cyclic_time(F.col("ts")), "extreme": F.col("rating").isin(1.0, 5.0).cast("int"), "raw_key": F.md5("review_text")}))
    rows = signals.join(measures, "raw_key", "left").fillna(RAW_MEASURES).drop("raw_key")
    rows = seconds_since_prev(rows).fillna({"since_prev": usual_gap(df)})
    names = [c for c, k in rows.dtypes if k in ("double", "int", "bigint") and c not in ("record_id", "is_fake")]
    return rows.select("record_id", *[c for c in ("is_fake",) if c in rows.columns], *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in names])


def _rules() -> list[tuple[Column, str, str]]:
    c = F.col
    # The sentences and labels.
    return [
        (c("ip_users") >= 4, "The same IP address is associated with many accounts.", "shared_ip_account_cluster"),
        (c("ip_1h") >= 3, "The rating happened in an unusual short-term burst.", "short_term_ip_burst"),
        (c("user_24h") >= 3, "The user posted several ratings in a short period.", "reviewer_burst_activity"),
        (c("text_count") >= 3, "The review text is duplicated across several ratings.", "duplicated_review_text"),
        (c("item_deviation") >= 1.8, "The rating strongly deviates from the normal score for this item.", "rating_distribution_shift"),
        (c("item_z") >= 2.0, "The score is statistically unusual compared with other ratings for this item.", "statistical_rating_outlier"),
        (c("short_extreme") == 1, "The rating is extreme and paired with a very short review.", "extreme_rating_low_evidence"),
        (c("promotional") == 1, "The wording uses promotional stock phrases that often appear in coordinated ratings.", "promotional_template_language"),
        (c("slang_manipulation") >= 0.55, "The language pattern looks hype-heavy and weakly grounded in real usage detail.", "hype_heavy_slang"),
        (c("template_component") >= 0.5, "A similar slang-heavy template repeats across multiple ratings.", "repeated_slang_template"),
    ]


def rating_reasons(df: DataFrame) -> DataFrame:
    return df.withColumn("reasons", T.array_of(*[(cond, why) for cond, why, _ in _rules()]))


def rating_attack_types(df: DataFrame) -> DataFrame:
    found = T.array_of(*[(cond, kind) for cond, _, kind in _rules()])
    return df.withColumn("attack_types", F.when(F.size(found) == 0, F.array(F.lit("low_risk_or_insufficient_signal"))).otherwise(found))


def rule_score(df: DataFrame) -> DataFrame:
    """Share of the rules that hold: the score without a model."""
    return rating_reasons(df).withColumn("score", F.size("reasons") / len(_rules()))


def suspicious_users(scored: DataFrame, threshold: float = 0.25) -> DataFrame:
    return scored.filter(F.col("score") >= threshold).groupBy("user_id").agg(F.count("*").alias("n_ratings"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.count_distinct("item_id").alias("targets"), F.count_distinct("ip_address").alias("ips"))


def rating_summary(scored: DataFrame, threshold: float = 0.25) -> DataFrame:
    bad = F.col("score") >= threshold
    return scored.agg(
        F.count("*").alias("n_ratings"), F.count_if(bad).alias("n_suspicious"), F.avg(bad.cast("double")).alias("share"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"),
        F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(bad, F.col("user_id"))).alias("bad_users"), F.count_distinct("item_id").alias("items"), F.count_distinct("ip_address").alias("ips"),
        F.count_if(F.col("ip_address").isNull()).alias("no_ip"), F.avg("rating").alias("mean_rating"), F.count_if(F.col("promotional") == 1).alias("promotional"),
        F.count_if(F.col("slang_manipulation") >= 0.45).alias("slang_flagged"), F.avg("slang_authenticity").alias("slang_authenticity"), F.avg("slang_manipulation").alias("slang_manipulation"), F.avg(F.col("mix").cast("double")).alias("bilingual_ratio"),
        F.avg((F.col("profile") == "organic").cast("double")).alias("organic_ratio"), F.avg((F.col("template_dup") >= 2).cast("double")).alias("template_ratio"),
    )


def top_suspicious(scored: DataFrame, n: int = 20) -> DataFrame:
    return scored.orderBy(F.desc("score"), "record_id").limit(n)
