"""Registered queries over the driver's tables, each beside its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.functions import lexicons as L
from trustloom.functions import text as T
from trustloom.operators import corpus, detectors, evaluation, machine_text, models, pages, photo_text, photos, ratings, reports, slang, text_models
from trustloom.sources import readers
from trustloom.sources.tables import cut

from . import sql as Q
from .sql import AUTHOR, COUNTS, PAGE_REASONS, RT, RTOK, SCORES, SLANG_REASON, UNIQ, WORDS, any_of
from .sql import array as SQL_LIST
from .sql import clip as clip_sql
from .views import view, with_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str, sql: str | None = None):
    """Register a function of the named views' frames; sql continues a WITH that defines the views."""
    names = views.split()

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf: f(*[view(spark, sf, v) if v.endswith("_v") else spark.read.parquet(f"{sf}/{v}.parquet") for v in names])
        if sql:
            sql_ = sql.replace(", 4)", " + 1e-9, 4)")  # as in rounded()
            own = [v for v in names if v.endswith("_v")]
            ORACLES[name] = with_view(*own, rest=sql_ if sql_.lstrip().startswith(",") else " " + sql_) if own else sql_
        return f

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that halves and zeros come out alike in both engines; counts as long."""
    return df.select(*[F.round(F.col(c) + 1e-9, digits).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("int", "bigint") else F.col(c) for c, k in df.dtypes])


LOW_TEXT = "lower(review_text)"


# --- sources -----------------------------------------------------------------------------------------------


@query("s09_prepare_ratings", "ratings_v", """SELECT record_id, user_id, item_id, rating, ip_address, geo_country, geo_city, geo_country || '|' || geo_city AS geo_key, is_fake::BIGINT AS is_fake FROM ratings_v WHERE rating IS NOT NULL AND ts IS NOT NULL""")
def s09(r):
    raw = r.select("record_id", "user_id", "item_id", r.rating.cast("string").alias("stars"), r.ts.cast("string").alias("timestamp"), F.coalesce("ip_address", F.lit(" N/A ")).alias("ip"), F.concat_ws("|", "geo_country", "geo_city").alias("country"), r.review_text.alias("text"), r.is_fake.cast("string").alias("is_fake"))
    return rounded(readers.prepare_ratings(raw).drop("ts", "review_text"))


@query("s12_import_report", "ratings_v", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE ip_address IS NULL) AS incomplete_rows, count(*) FILTER (WHERE ip_address IS NULL) AS empty_ip_address, 0::BIGINT AS empty_user_id FROM ratings_v")
def s12(r):
    return rounded(readers.import_report(r, ["ip_address", "user_id"]))


@query("s13_parse_rating", "reviews_v", r"SELECT record_id, CASE WHEN record_id % 3 = 0 THEN rating + 0.5 WHEN record_id % 3 = 1 THEN rating ELSE floor(rating) END AS parsed FROM reviews_v")
def s13(r):
    k, whole = r.record_id % 3, r.rating.cast("int")
    text = F.when(k == 0, F.concat(whole.cast("string"), F.lit(",5 из 5"))).when(k == 1, F.concat(F.lit("rated "), whole.cast("string"), F.lit(" out of 5"))).otherwise(F.expr("repeat('★', cast(rating as int))"))
    return r.select("record_id", T.parse_rating(text).alias("parsed"))


@query("s23_safe_urls", "pages", """SELECT page_id, regexp_matches(lower(url), '^https?://') AND regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) NOT IN ('localhost') AND regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) != '' AS safe FROM pages""")
def s23(p):
    return p.select("page_id", T.is_safe_image_url(F.col("url")).alias("safe"))


@query("s24_sites", "pages", "SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') AS site FROM pages")
def s24(p):
    return p.select("page_id", T.site_name(F.col("url")).alias("site"))


MARKET_CASE = "CASE " + " ".join(f"WHEN source_site = '{s}' OR source_site LIKE '%.{s}' THEN '{m}'" for s, m in T.MARKETS.items()) + " ELSE 'other' END"


@query("s24_marketplace", "reviews_v", f"SELECT {MARKET_CASE} AS market, count(*) AS n FROM reviews_v GROUP BY 1")
def s24b(r):
    return r.groupBy(T.marketplace_of(F.col("source_site")).alias("market")).agg(F.count("*").alias("n"))


@query("s25_collection_summary", "events", "SELECT event_type AS strategy, CASE WHEN value > 5 THEN 'ok' ELSE 'empty' END AS status, count(*) AS attempts, sum(user_id % 5)::BIGINT AS found FROM events GROUP BY 1, 2")
def s25(e):
    return readers.collection_summary(e.select(e.event_type.alias("strategy"), F.when(e.value > 5, "ok").otherwise("empty").alias("status"), (e.user_id % 5).alias("found")))


@query("s26_blocked_pages", "pages", "SELECT page_id, regexp_matches(substr(lower(html), 1, 12000), '" + "|".join(L.BLOCKED) + "') AS blocked FROM pages")
def s26(p):
    return p.select("page_id", readers.is_blocked_page(F.col("html")).alias("blocked"))


@query("s15_jsonld", "reviews_v", f"SELECT page_id, author, title, rating, review_date::VARCHAR AS date, md5({RT}) AS text_md5 FROM reviews_v")
def s15(r):
    node = F.to_json(F.struct(F.lit("Review").alias("@type"), F.col("review_text").alias("reviewBody"), F.col("title").alias("name"), r.review_date.cast("string").alias("datePublished"), F.struct(F.col("author").alias("name")).alias("author"), F.struct(r.rating.cast("string").alias("ratingValue")).alias("reviewRating")))
    html = F.concat(F.lit('<html><script type="application/ld+json">'), F.when(r.record_id % 2 == 0, F.concat(F.lit('{"@graph":['), node, F.lit("]}"))).otherwise(node), F.lit("</script></html>"))
    return readers.extract_jsonld_reviews(r.select("page_id", html.alias("html"))).select("page_id", "author", "title", "rating", "date", F.md5("review_text").alias("text_md5"))


# --- scalar expressions ------------------------------------------------------------------------------------


@query("p_text_measures", "reviews_v", rf"""SELECT record_id, ({WORDS})::BIGINT AS words, round({UNIQ}, 4) AS unique_ratio,
 round(len(regexp_extract_all(review_text, '\p{{Lu}}')) / greatest(len(regexp_extract_all(review_text, '\p{{L}}')), 1)::DOUBLE, 4) AS upper_ratio,
 round(len(regexp_extract_all(review_text, '\p{{Nd}}')) / greatest(length(review_text), 1)::DOUBLE, 4) AS digit_ratio,
 round(len(regexp_extract_all(review_text, '[!]')) / greatest(length(review_text), 1)::DOUBLE, 4) AS exclaim,
 {any_of(LOW_TEXT, L.RATING_PHRASES)} AS promotional FROM reviews_v""")
def p_text(r):
    t = F.col("review_text")
    return rounded(r.select("record_id", T.word_count(t).alias("words"), T.unique_word_ratio(t).alias("unique_ratio"), T.uppercase_ratio(t).alias("upper_ratio"), T.digit_ratio(t).alias("digit_ratio"), T.punct_density(t, "!").alias("exclaim"), T.has_phrase(t, L.RATING_PHRASES).alias("promotional")))


@query("p07_cyclic_time", "ratings_v", """SELECT record_id, round(sin(hour(ts) * 2 * pi() / 24), 4) AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 4) AS hour_cos, round(sin((isodow(ts) - 1) * 2 * pi() / 7), 4) AS day_sin,
 round(cos((isodow(ts) - 1) * 2 * pi() / 7), 4) AS day_cos, (CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END)::BIGINT AS is_weekend FROM ratings_v""")
def p07(r):
    return rounded(r.select("record_id", *[c.alias(n) for n, c in T.cyclic_time(F.col("ts")).items()]))


@query("p11_p12_buckets", "reviews_v", f"""SELECT CASE WHEN regexp_matches(review_text, '[а-яёА-ЯЁ]') AND regexp_matches(review_text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(review_text, '[а-яёА-ЯЁ]') THEN 'ru' WHEN regexp_matches(review_text, '[A-Za-z]') THEN 'en_or_latin' ELSE 'other' END AS language,
 CASE WHEN {WORDS} <= 6 THEN 'very_short' WHEN {WORDS} <= 18 THEN 'short' WHEN {WORDS} <= 60 THEN 'medium' ELSE 'long' END AS length, CASE WHEN rating <= 1.5 THEN 'low' WHEN rating <= 3.5 THEN 'middle' WHEN rating <= 4.75 THEN 'high' ELSE 'top' END AS stars, count(*) AS n FROM reviews_v GROUP BY ALL""")
def p11(r):
    return r.groupBy(T.language_profile(F.col("review_text")).alias("language"), T.length_bucket(T.word_count(F.col("review_text"))).alias("length"), T.rating_bucket(F.col("rating")).alias("stars")).agg(F.count("*").alias("n"))


@query("p13_p14_groups", "reviews_v", f"SELECT record_id, 'review::' || md5(lower({RT})) AS lineage, coalesce(nullif(trim(regexp_replace(lower(string_split(source_site, ':')[1]), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unspecified') AS source_group FROM reviews_v")
def p13(r):
    return r.select("record_id", T.split_group(F.col("review_text")).alias("lineage"), T.source_group(F.col("source_site")).alias("source_group"))


# --- ratings -----------------------------------------------------------------------------------------------

USERS = "SELECT user_id, count(*) AS user_count, avg(rating) AS user_mean, coalesce(stddev_samp(rating), 0) AS user_std, count(DISTINCT ip_address) AS user_ips, count(DISTINCT geo_country || '|' || geo_city) AS user_geos FROM ratings_v GROUP BY 1"
ITEMS = "SELECT item_id, count(*) AS item_count, avg(rating) AS item_mean, coalesce(stddev_samp(rating), 0) AS item_std FROM ratings_v GROUP BY 1"
IPS = "SELECT ip_address, count(*) AS ip_count, count(DISTINCT user_id) AS ip_users FROM ratings_v WHERE ip_address IS NOT NULL GROUP BY 1"
GAPS = "SELECT user_id, nullif((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / nullif(count(*) - 1, 0), 0) AS mean_gap FROM ratings_v GROUP BY 1"


def burst_sql(key: str, seconds: int) -> str:
    return f"CASE WHEN {key} IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY {key} ORDER BY sec RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY {key}, sec) + row_number() OVER (PARTITION BY {key}, sec ORDER BY record_id) - 1 END"


RATING_RULES = [
    ("ip_users >= 4", "The same IP address is associated with many accounts.", "shared_ip_account_cluster"), ("ip_1h >= 3", "The rating happened in an unusual short-term burst.", "short_term_ip_burst"), ("user_24h >= 3", "The user posted several ratings in a short period.", "reviewer_burst_activity"),
    ("text_count >= 3", "The review text is duplicated across several ratings.", "duplicated_review_text"), ("item_deviation >= 1.8", "The rating strongly deviates from the normal score for this item.", "rating_distribution_shift"), ("item_z >= 2.0", "The score is statistically unusual compared with other ratings for this item.", "statistical_rating_outlier"),
    ("short_extreme = 1", "The rating is extreme and paired with a very short review.", "extreme_rating_low_evidence"), ("promotional = 1", "The wording uses promotional stock phrases that often appear in coordinated ratings.", "promotional_template_language"),
    ("slang_m >= 0.55", "The language pattern looks hype-heavy and weakly grounded in real usage detail.", "hype_heavy_slang"), ("tpl >= 0.5", "A similar slang-heavy template repeats across multiple ratings.", "repeated_slang_template"),
]
REASON_SQL = Q.sentences(*[(cond, why) for cond, why, _ in RATING_RULES])
KIND_SQL = Q.sentences(*[(cond, kind) for cond, _, kind in RATING_RULES])
SIGNALS = f""", u AS ({USERS}), i AS ({ITEMS}), a_ AS ({IPS}), tx AS (SELECT lower(trim(review_text)) AS k, min(review_text) AS review_text, count(*) AS text_count, 0 AS page_id, '' AS title, '' AS source_site FROM ratings_v WHERE trim(review_text) != '' GROUP BY 1){Q.slang("tx", "sl", "text_count")},
 b AS (SELECT *, floor(epoch_us(ts) / 1000000)::BIGINT AS sec FROM ratings_v),
 g AS (SELECT b.*, u.user_mean, i.item_mean, i.item_std, coalesce(a_.ip_users, 0) AS ip_users, coalesce(sl.text_count, 1) AS text_count, coalesce(sl.m, 0) AS slang_m, coalesce(sl.a, .5) AS slang_a, coalesce(sl.tpl, 0) AS tpl, coalesce(sl.dup, 0) AS dup, coalesce(sl.mix, 0) AS mix, coalesce(sl.profile, 'neutral') AS profile, abs(rating - item_mean) AS item_deviation, abs(rating - item_mean) / (item_std + 1e-3) AS item_z,
 {burst_sql('user_id', 86400)} AS user_24h, {burst_sql('ip_address', 3600)} AS ip_1h, {burst_sql('item_id', 86400)} AS item_24h,
 CASE WHEN rating IN (1, 5) AND {WORDS.replace("review_text", "b.review_text")} < 3 THEN 1 ELSE 0 END AS short_extreme, CASE WHEN {any_of('lower(b.review_text)', L.RATING_PHRASES)} THEN 1 ELSE 0 END AS promotional
 FROM b LEFT JOIN u USING (user_id) LEFT JOIN i USING (item_id) LEFT JOIN a_ USING (ip_address) LEFT JOIN sl ON sl.k = lower(trim(b.review_text))),
 s AS (SELECT *, ({" + ".join(f"({cond})::INT" for cond, _, _ in RATING_RULES)}) / 10.0 AS score FROM g)
"""


def _round_sql(inner: str, doubles: str, others: str, tail: str = "") -> str:
    return f"SELECT {others}" + "".join(f", round({d}, 4) AS {d}" for d in doubles.split()) + f" FROM ({inner}) {tail}"


@query("r01_user_stats", "ratings_v", _round_sql(USERS, "user_mean user_std", "user_id, user_count, user_ips, user_geos"))
def r01(r):
    return rounded(ratings.user_stats(r))


@query("r02_user_mean_gap", "ratings_v", _round_sql(GAPS, "mean_gap", "user_id"))
def r02(r):
    return rounded(ratings.user_mean_gap(r))


@query("r03_item_stats", "ratings_v", _round_sql(ITEMS, "item_mean item_std", "item_id, item_count"))
def r03(r):
    return rounded(ratings.item_stats(r))


@query("r04_ip_stats", "ratings_v", IPS)
def r04(r):
    return ratings.ip_stats(r)


@query("r05_value_counts", "ratings_v", "SELECT user_id, item_id, count(*) AS n FROM ratings_v GROUP BY 1, 2")
def r05(r):
    return ratings.value_counts(r, ["user_id", "item_id"], "n")


@query("r06_defaults", "ratings_v", f""" SELECT round((SELECT median(user_count) FROM ({USERS})), 4) AS user_count, round((SELECT avg(user_mean) FROM ({USERS})), 4) AS user_mean, round((SELECT median(user_std) FROM ({USERS})), 4) AS user_std,
 round((SELECT median(item_count) FROM ({ITEMS})), 4) AS item_count, round((SELECT avg(item_mean) FROM ({ITEMS})), 4) AS item_mean, round((SELECT median(item_std) FROM ({ITEMS})), 4) AS item_std,
 round((SELECT median(ip_count) FROM ({IPS})), 4) AS ip_count, round((SELECT median(ip_users) FROM ({IPS})), 4) AS ip_users, round((SELECT coalesce(median(mean_gap), 3600) FROM ({GAPS})), 4) AS gap""")
def r06(r):
    return rounded(ratings.fit_defaults(r))


@query("r07_r08_join_stats", "ratings_v", SIGNALS + " SELECT record_id, ip_users, text_count, round(item_deviation, 4) AS item_deviation, round(item_z, 4) AS item_z FROM g")
def r07(r):
    return rounded(ratings.rating_deviation(ratings.join_stats(r)).select("record_id", "ip_users", "text_count", "item_deviation", "item_z"))


@query("r09_since_prev", "ratings_v", "SELECT record_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, record_id)) / 1e6, 4) AS since_prev FROM ratings_v")
def r09(r):
    return rounded(ratings.seconds_since_prev(r).select("record_id", "since_prev"))


@query("r10_bursts", "ratings_v", SIGNALS + " SELECT record_id, user_24h, ip_1h, item_24h FROM g")
def r10(r):
    out = r
    for key, seconds, name in (("user_id", 86400, "user_24h"), ("ip_address", 3600, "ip_1h"), ("item_id", 86400, "item_24h")):
        out = ratings.burst_count(out, key, seconds, name, r)
    return out.select("record_id", "user_24h", "ip_1h", "item_24h")


@query("r11_features", "ratings_v", SIGNALS + f" SELECT record_id, round(user_mean, 4) AS user_mean, round(item_z, 4) AS item_z, user_24h::DOUBLE AS user_24h, promotional::DOUBLE AS promotional, ({WORDS})::DOUBLE AS words, round({UNIQ}, 4) AS unique_ratio, round(slang_m, 4) AS slang_manipulation, round(slang_a, 4) AS slang_authenticity, tpl AS template_component, round(coalesce(since, (SELECT coalesce(median(gap), 3600) FROM (SELECT (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / (count(*) - 1) AS gap FROM ratings_v GROUP BY user_id HAVING count(*) > 1))), 4) AS since_prev FROM g JOIN (SELECT record_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, record_id)) / 1e6 AS since FROM ratings_v) USING (record_id)")
def r11(r):
    return rounded(ratings.rating_features(r).select("record_id", "user_mean", "item_z", "user_24h", "promotional", "words", "unique_ratio", "slang_manipulation", "slang_authenticity", "template_component", "since_prev"))


@query("r12_reasons", "ratings_v", SIGNALS + f" SELECT record_id, array_to_string({REASON_SQL}, '; ') AS reasons, round(score, 4) AS score FROM s")
def r12(r):
    return rounded(ratings.rule_score(ratings.with_signals(r)).select("record_id", F.array_join("reasons", "; ").alias("reasons"), "score"))


@query("r13_attack_types", "ratings_v", SIGNALS + f" SELECT record_id, CASE WHEN score = 0 THEN 'low_risk_or_insufficient_signal' ELSE array_to_string({KIND_SQL}, ',') END AS attack_types FROM s")
def r13(r):
    return ratings.rating_attack_types(ratings.with_signals(r)).select("record_id", F.array_join("attack_types", ",").alias("attack_types"))


SUSPECTS = SIGNALS + " SELECT user_id, count(*) AS n_ratings, round(avg(score), 4) AS mean_score, round(max(score), 4) AS max_score, count(DISTINCT item_id) AS targets, count(DISTINCT ip_address) AS ips FROM s WHERE score >= 0.25 GROUP BY 1"


@query("r14_suspicious_users", "ratings_v", SUSPECTS)
def suspicious_users(r):
    return rounded(ratings.suspicious_users(ratings.rule_score(ratings.with_signals(r))))


@query("r15_summary", "ratings_v", SIGNALS + """ SELECT count(*) AS n_ratings, count(*) FILTER (WHERE score >= 0.25) AS n_suspicious, round(avg(CASE WHEN score >= 0.25 THEN 1.0 ELSE 0 END), 4) AS share, round(avg(score), 4) AS mean_score, round(max(score), 4) AS max_score,
 count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN score >= 0.25 THEN user_id END) AS bad_users, count(DISTINCT item_id) AS items, count(DISTINCT ip_address) AS ips, count(*) FILTER (WHERE ip_address IS NULL) AS no_ip, round(avg(rating), 4) AS mean_rating, sum(promotional)::BIGINT AS promotional,
 count(*) FILTER (WHERE slang_m >= .45) AS slang_flagged, round(avg(slang_a), 4) AS slang_authenticity, round(avg(slang_m), 4) AS slang_manipulation, round(avg(mix), 4) AS bilingual_ratio, round(avg(CASE WHEN profile = 'organic' THEN 1.0 ELSE 0 END), 4) AS organic_ratio, round(avg(CASE WHEN dup >= 2 THEN 1.0 ELSE 0 END), 4) AS template_ratio FROM s""")
def r15(r):
    return rounded(ratings.rating_summary(ratings.rule_score(ratings.with_signals(r))))


@query("r16_top_suspicious", "ratings_v", SIGNALS + " SELECT record_id, round(score, 4) AS score FROM s ORDER BY s.score DESC, record_id LIMIT 20")
def r16(r):
    return rounded(ratings.top_suspicious(ratings.rule_score(ratings.with_signals(r))).select("record_id", "score"))


# --- pages -------------------------------------------------------------------------------------------------

def _slang(r: DataFrame) -> DataFrame:
    return slang.with_slang(r)


@query("m01_m03_counts", "reviews_v", COUNTS + " SELECT record_id, dup_text, dup_title, author_reviews, same_day, same_day_extreme FROM c")
def m01(r):
    return pages.page_counts(r, keep_text=False).select("record_id", "dup_text", "dup_title", "author_reviews", "same_day", "same_day_extreme")


@query("m05_m06_page_components", "reviews_v", SCORES + " SELECT page_id, n_reviews, round(rx, 4) AS r_extreme, round(rd, 4) AS r_duplicate, round(ra, 4) AS r_author, round(rs, 4) AS r_day, round(rsl, 4) AS r_slang, round(rb, 4) AS r_bilingual, round(ro, 4) AS r_organic, round(rt, 4) AS r_template, round(px, 4) AS p_extreme, round(pk, 4) AS p_skew, round(pd, 4) AS p_duplicate, round(pa, 4) AS p_author, round(ps, 4) AS p_day, round(psl, 4) AS p_slang, round(pb, 4) AS p_bilingual, round(pt_, 4) AS p_template FROM p")
def m05(r):
    return rounded(pages.page_components(pages.page_ratios(pages.page_counts(_slang(r), keep_text=False))).drop("r_five", "r_one"))


@query("m04_without_page_context", "reviews_v", Q.slang("reviews_v") + f", c AS (SELECT *, CASE WHEN {any_of('t', L.PAGE_PHRASES)} THEN 1 ELSE 0 END AS phrase, {UNIQ} AS uniq, {Q.EXTREME} AS extreme, {Q.EXTREME} * CASE WHEN {WORDS} <= 8 THEN 1 ELSE 0 END AS short_extreme, a0 * (1 - m0) AS credit FROM sl) SELECT record_id, round({clip_sql(f'.10 * {clip_sql(".45 * phrase + .25 * (1 - uniq) + .30 * m0")} + .08 * m0 - .08 * credit')}, 4) AS author_risk FROM c")
def m04(r):
    alone = pages.row_components(pages.without_page_context(pages.measured(slang.slang_profile(r))))
    return rounded(alone.select("record_id", pages.author_risk_score().alias("author_risk")))


@query("m07_m10_scores", "reviews_v", SCORES + " SELECT record_id, round(c_generic, 4) AS c_generic, round(credit, 4) AS c_credit, round(local_score, 4) AS local_score, round(author_risk, 4) AS author_risk, round(manipulation, 4) AS rating_manipulation FROM z")
def m07(r):
    return rounded(pages.page_scores(_slang(pages.prepared(r))).select("record_id", "c_generic", "c_credit", "local_score", "author_risk", "rating_manipulation"))


@query("m11_reasons", "reviews_v", SCORES + f" SELECT record_id, array_to_string({PAGE_REASONS}, ' ') AS reasons FROM z")
def m11(r):
    return pages.manipulation_reasons(pages.page_scores(slang.slang_reason(_slang(pages.prepared(r))))).select("record_id", F.array_join("manipulation_reasons", " ").alias("reasons"))


AUTHORS = SCORES + f", au AS (SELECT page_id, {AUTHOR} AS author_key, count(*) AS n_reviews, round(avg(manipulation), 4) AS mean_manipulation, count(*) FILTER (WHERE manipulation >= .55) AS n_high, row_number() OVER (PARTITION BY page_id ORDER BY count(*) FILTER (WHERE manipulation >= .55) DESC, round(avg(manipulation), 6) DESC, count(*) DESC, {AUTHOR}) AS rank FROM z WHERE trim(author) != '' GROUP BY page_id, {AUTHOR})"


@query("m12_suspicious_authors", "reviews_v", AUTHORS + " SELECT * FROM au WHERE rank <= 10")
def m12(r):
    return rounded(pages.suspicious_authors(pages.page_scores(_slang(pages.prepared(r)))))


@query("m13_page_summary", "reviews_v", AUTHORS + """, su AS (SELECT page_id, count(*) AS k FROM au WHERE n_high > 0 GROUP BY 1), mk AS (SELECT page_id, pack FROM (SELECT page_id, pack, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(record_id)) AS i FROM z WHERE pack != 'generic' GROUP BY 1, 2) WHERE i = 1)
 SELECT z.page_id, count(*) AS n_reviews, count(*) FILTER (WHERE author_reviews > 1) AS repeated_authors, round(max(rx), 4) AS r_extreme, round(max(rd), 4) AS r_duplicate, round(max(rs), 4) AS r_day, round(max(ra), 4) AS r_author, round(avg(a), 4) AS slang_authenticity_mean, round(avg(m), 4) AS slang_manipulation_mean, round(max(rsl), 4) AS r_slang, round(max(rb), 4) AS r_bilingual, round(max(ro), 4) AS r_organic,
 max(page_domain) AS page_domain, round(max(page_confidence), 4) AS page_confidence, round(max(rt), 4) AS r_template, round(avg(manipulation), 4) AS manipulation_mean, CASE WHEN avg(manipulation) >= .8 THEN 'high' WHEN avg(manipulation) >= .55 THEN 'medium' ELSE 'low' END AS risk, coalesce(max(mk.pack), 'generic') AS page_market, coalesce(max(su.k), 0) AS suspicious_authors
 FROM z LEFT JOIN su USING (page_id) LEFT JOIN mk ON mk.page_id = z.page_id GROUP BY 1""")
def m13(r):
    return rounded(pages.page_summary(cut(pages.page_scores(_slang(pages.prepared(r))))))


# --- slang, machine text, photo text -----------------------------------------------------------------------


@query("l02_l07_slang_features", "reviews_v", Q.slang("reviews_v") + " SELECT record_id, n AS n_tokens, h AS n_hits, promo AS n_promo, array_to_string(terms, ',') AS terms, round(density, 4) AS density, round(diversity, 4) AS diversity, gen AS general_detail, dom AS domain_detail, units, round(detail, 4) AS detail, round(grounding, 4) AS grounding, cyr, lat, mix::BIGINT AS mix, round(balance, 4) AS balance, round(hype, 4) AS hype, low::BIGINT AS low_detail, bi::BIGINT AS bi_hype, mkt AS market_hits FROM sl")
def l02(r):
    return rounded(slang.slang_profile(r).select("record_id", "n_tokens", "n_hits", "n_promo", F.array_join("terms", ",").alias("terms"), "density", "diversity", "general_detail", "domain_detail", "units", "detail", "grounding", "cyr", "lat", "mix", "balance", "hype", "low_detail", "bi_hype", "market_hits"))


@query("l03_domains", "reviews_v", Q.slang("reviews_v") + " SELECT record_id, domain, page_domain, round(page_confidence, 4) AS page_confidence, pack AS market_pack FROM sl")
def l03(r):
    return rounded(slang.slang_profile(r).select("record_id", "domain", "page_domain", "page_confidence", "market_pack"))


@query("l08_l11_slang_profiles", "reviews_v", Q.slang("reviews_v") + " SELECT record_id, round(a, 4) AS slang_authenticity, round(m, 4) AS slang_manipulation, profile, sig AS signature, dup AS template_dup, round(tpl, 4) AS template_component FROM sl")
def l08(r):
    return rounded(_slang(r).select("record_id", "slang_authenticity", "slang_manipulation", "profile", "signature", "template_dup", "template_component"))


@query("l12_dominant_marketplace", "reviews_v", f" SELECT page_id, market, n FROM (SELECT page_id, {MARKET_CASE} AS market, count(*) AS n, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(record_id)) AS k FROM reviews_v WHERE {MARKET_CASE} != 'other' GROUP BY 1, 2) WHERE k = 1")
def l12(r):
    return slang.dominant_marketplace(r)


@query("l13_slang_reasons", "reviews_v", Q.slang("reviews_v") + f" SELECT record_id, {SLANG_REASON} AS slang_reason, round(m, 4) AS slang_manipulation FROM sl")
def l13(r):
    return rounded(slang.slang_reason(_slang(r)).select("record_id", "slang_reason", "slang_manipulation"))


LEX = Q.lexicon("source_site")


def _lexicon(r: DataFrame) -> DataFrame:
    return slang.learn_lexicon(r.withColumn("source", F.col("source_site")))


@query("l14_learn_lexicon", "reviews_v", LEX + " SELECT kind, polarity, rank, term, pos, neg, round(score, 4) AS score, promo FROM lex WHERE whole")
def l14(r):
    return rounded(_lexicon(r).filter("whole").drop("scope", "whole"))


@query("l15_source_lexicons", "reviews_v", LEX + " SELECT scope, kind, polarity, rank, term, pos, neg, round(score, 4) AS score, promo FROM lex WHERE NOT whole")
def l15(r):
    return rounded(_lexicon(r).filter("not whole").drop("whole"))


@query("l16_apply_lexicon", "reviews_v", LEX + Q.LEARNED + rf", w AS (SELECT *, lower({RT}) AS t, regexp_extract_all(lower({RT}), '{Q.LETTERS}') AS tok FROM learned_v) SELECT record_id, {Q.MET.format(p='suspicious')} AS learned_suspicious, {Q.MET.format(p='authentic')} AS learned_authentic, len({Q.phrases_in('t', 'x_promo')}) AS learned_promo FROM w")
def l16(r):
    return rounded(slang.apply_lexicon(r, cut(_lexicon(r))).select("record_id", "learned_suspicious", "learned_authentic", "learned_promo"))


@query("l16_learned_profiles", "reviews_v", LEX + Q.LEARNED + Q.slang("learned_v", learned=True) + " SELECT record_id, round(a, 4) AS slang_authenticity, round(m, 4) AS slang_manipulation, profile, ls AS learned_suspicious, la AS learned_authentic, dup AS template_dup FROM sl")
def l16b(r):
    return rounded(slang.with_slang(r, cut(_lexicon(r))).select("record_id", "slang_authenticity", "slang_manipulation", "profile", "learned_suspicious", "learned_authentic", "template_dup"))


@query("l17_slang_calibrator", "reviews_v")
def l17(r):
    parts = evaluation.group_split(r, "source", {"train": 0.6, "validation": 0.4})
    profiles = cut(slang.with_slang(parts, cut(_lexicon(parts.filter("part = 'train'")))))  # each pass of the fit reads it
    model = models.fit_slang_calibrator(profiles.filter("part = 'validation'"))
    return rounded(models.calibrate_slang(model, profiles).select("record_id", "part", "slang_learned_probability", "slang_calibration_delta", "slang_manipulation", "slang_authenticity", "profile"))


@query("l18_slang_errors", "reviews_v", Q.slang("reviews_v") + " SELECT bucket, domain, count(*) AS n, round(avg(m), 4) AS mean_manipulation, round(avg(a), 4) AS mean_authenticity, round(count(*) / (SELECT count(*) FROM sl WHERE label IS NOT NULL)::DOUBLE, 4) AS share FROM (SELECT *, CASE WHEN m >= .45 AND label != 1 THEN 'false_positive' WHEN m < .45 AND label = 1 THEN 'false_negative' ELSE 'right' END AS bucket FROM sl WHERE label IS NOT NULL) GROUP BY 1, 2")
def l18(r):
    return rounded(slang.slang_errors(_slang(r)))


@query("a01_a03_machine_text", "reviews_v", Q.AI + " SELECT record_id, words, round(cv, 4) AS cv, round(generic, 4) AS generic, round(personal, 4) AS personal, round(concrete, 4) AS concrete, round(polish, 4) AS polish, round(repetition, 4) AS repetition, round(dash, 4) AS dash, round(cliche, 4) AS cliche, round(structure_, 4) AS structure, round(s0, 4) AS heuristic, round(s5, 4) AS ai FROM ai")
def a01(r):
    rows = machine_text.ai_score(r)
    return rounded(rows.select("record_id", "words", "cv", "generic", "personal", "concrete", "polish", "repetition", "dash", "cliche", "structure", machine_text.ai_heuristic(rows).alias("heuristic"), "ai"))


@query("a04_a05_labels", "reviews_v", Q.AI + " SELECT record_id, n_opening, round(ai, 4) AS ai, ai_label, ai_flag::BIGINT AS ai_flag, array_to_string(ai_reasons, ' ') AS reasons FROM ai")
def a04(r):
    return rounded(machine_text.opening_boost(machine_text.ai_score(r).drop("review_text", "title")).select("record_id", "n_opening", "ai", "ai_label", "ai_flag", F.array_join("ai_reasons", " ").alias("reasons")))


@query("a09_ai_summary", "reviews_v", Q.AI + """, lb AS (SELECT page_id, string_agg(ai_label || ':' || n, ',' ORDER BY n DESC, ai_label) AS top_labels FROM (SELECT page_id, ai_label, count(*) AS n FROM ai GROUP BY 1, 2) GROUP BY 1)
 SELECT page_id, count(*) FILTER (WHERE seen) AS evaluated, sum(ai_flag)::BIGINT AS flagged, round(coalesce(avg(ai) FILTER (WHERE seen), 0), 4) AS mean_ai, round(coalesce(sum(ai_flag) / nullif(count(*) FILTER (WHERE seen), 0)::DOUBLE, 0), 4) AS flagged_ratio, max(top_labels) AS top_labels FROM (SELECT *, words >= 12 OR ai_flag = 1 AS seen FROM ai) JOIN lb USING (page_id) GROUP BY 1""")
def a09(r):
    return rounded(machine_text.ai_summary(machine_text.opening_boost(machine_text.ai_score(r).drop("review_text", "title"))))


OCR = ", ocr AS (SELECT *, CASE record_id % 4 WHEN 0 THEN 'SALE 20% off at ozon, write to telegram' WHEN 1 THEN 'Best seller! Official store' WHEN 2 THEN '' ELSE review_text END AS ocr_text FROM reviews_v)"


def _ocr(r: DataFrame) -> DataFrame:
    k = r.record_id % 4
    return r.withColumn("ocr_text", F.when(k == 0, "SALE 20% off at ozon, write to telegram").when(k == 1, "Best seller! Official store").when(k == 2, "").otherwise(r.review_text))


@query("o01_o03_photo_text", "reviews_v", OCR + Q.PHOTO + " SELECT record_id, array_to_string(list_sort(labels), ',') AS labels, array_to_string(foreign_, ',') AS foreign_markets, round(score, 4) AS photo_text_score, (score >= .46)::BIGINT AS photo_text_flag FROM o4")
def o01(r):
    return rounded(photo_text.photo_text(_ocr(r)).select("record_id", F.array_join("photo_labels", ",").alias("labels"), F.array_join("foreign_markets", ",").alias("foreign_markets"), "photo_text_score", "photo_text_flag"))


@query("o04_photo_text_summary", "reviews_v", OCR + Q.PHOTO + """, lb AS (SELECT page_id, string_agg(label || ':' || n, ',' ORDER BY n DESC, label) FILTER (WHERE i <= 5) AS top_labels FROM (SELECT page_id, label, count(*) AS n, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, label) AS i FROM (SELECT page_id, unnest(labels) AS label FROM o4 WHERE o != '') GROUP BY 1, 2) GROUP BY 1)
 SELECT page_id, count(*) AS evaluated, count(*) FILTER (WHERE score >= .46) AS flagged, round(avg(score), 4) AS mean_score, round(count(*) FILTER (WHERE score >= .46) / count(*)::DOUBLE, 4) AS flagged_ratio, coalesce(max(top_labels), '') AS top_labels FROM o4 LEFT JOIN lb USING (page_id) WHERE o != '' GROUP BY 1""")
def o04(r):
    return rounded(photo_text.photo_text_summary(photo_text.photo_text(_ocr(r))))


# --- photos ------------------------------------------------------------------------------------------------

CANON = rf"""'https://' || lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://([^/?]*)', 1)) || regexp_replace(regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '')
 || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&'), lambda p: p != '' AND NOT list_contains({SQL_LIST(T.NOISE_KEYS)}, lower(string_split(p, '=')[1])) AND NOT starts_with(lower(p), 'utm_'))), '&'), ''), '')"""
LINKS = f", l AS (SELECT DISTINCT page_id, record_id, sha1({CANON}) AS fp, {CANON} AS cu FROM photos_v), z AS (SELECT page_id, fp, count(*) AS size, min(cu) AS sample, min(record_id) AS first_record FROM l GROUP BY 1, 2), k AS (SELECT l.page_id, l.record_id, count(*) AS images, count(*) FILTER (WHERE size >= 2) AS reused, max(size) AS cluster FROM l JOIN z USING (page_id, fp) GROUP BY 1, 2)"


@query("f02_f03_canonical_urls", "pages", f"SELECT page_id, {CANON} AS canonical, sha1({CANON}) AS fingerprint FROM pages")
def f02(p):
    return p.select("page_id", T.canonical_url(F.col("url")).alias("canonical"), photos.fingerprint(F.col("url")).alias("fingerprint"))


@query("f04_f05_photo_reuse", "photos_v", LINKS + " SELECT page_id, record_id, images, reused, cluster, round(CASE WHEN reused = 0 THEN 0 ELSE .68 * reused / images + .32 * least((cluster - 1) / 3.0, 1) END, 4) AS reuse_score, (CASE WHEN reused > 0 THEN 1 ELSE 0 END)::BIGINT AS reuse_flag FROM k")
def f04(p):
    return rounded(photos.photo_reuse(p))


@query("f06_photo_clusters", "photos_v", LINKS + " SELECT * FROM (SELECT page_id, fp, size, sample, first_record, row_number() OVER (PARTITION BY page_id ORDER BY size DESC, fp) AS rank FROM z WHERE size >= 2) WHERE rank <= 5")
def f06(p):
    return rounded(photos.photo_clusters(p))


@query("f07_photo_summary", "photos_v", LINKS + " SELECT page_id, count(*) AS n_with_photos, round(avg(CASE WHEN reused > 0 THEN 1.0 ELSE 0 END), 4) AS ratio, max(cluster) AS largest, CASE WHEN avg(CASE WHEN reused > 0 THEN 1.0 ELSE 0 END) >= .35 OR max(cluster) >= 4 THEN 'high' WHEN avg(CASE WHEN reused > 0 THEN 1.0 ELSE 0 END) >= .18 OR max(cluster) >= 3 THEN 'medium' ELSE 'low' END AS risk FROM k GROUP BY 1")
def f07(p):
    return rounded(photos.photo_summary(photos.photo_reuse(p)))


TEMPORAL = f""", e AS (SELECT DISTINCT page_id, record_id, nullif(lower(author), '') AS author, sec, sha1({CANON}) AS fp FROM photos_v),
 st AS (SELECT DISTINCT page_id, fp, sec AS start FROM e), en AS (SELECT DISTINCT page_id, fp, sec AS "end" FROM e),
 pr AS (SELECT st.page_id, st.fp, st.start, en."end", count(DISTINCT e.record_id) AS n, count(DISTINCT e.author) AS authors FROM st JOIN en ON st.page_id = en.page_id AND st.fp = en.fp AND en."end" BETWEEN st.start AND st.start + 172800 JOIN e ON e.page_id = st.page_id AND e.fp = st.fp AND e.sec BETWEEN st.start AND en."end" GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT e.record_id) >= 2 AND count(DISTINCT e.author) >= 2),
 sc AS (SELECT *, round(.34 * least(n / 4.0, 1) + .38 * least(authors / 3.0, 1) + .28 * (1 - ("end" - start) / 172800.0), 6) AS score FROM pr),
 bb AS (SELECT page_id, fp, start AS start_sec, "end" AS end_sec, n AS n_reviews, authors AS n_authors, round(score, 4) AS score, sc.score AS score6, (CASE WHEN sc.score >= .55 THEN 1 ELSE 0 END)::BIGINT AS flag FROM sc QUALIFY row_number() OVER (PARTITION BY page_id, fp ORDER BY sc.score DESC, start, "end") = 1)"""


@query("f08_temporal_clusters", "photos_v", TEMPORAL + " SELECT * EXCLUDE (score6) FROM bb")
def f08(p):
    return rounded(photos.temporal_clusters(p))


@query("f10_temporal_summary", "photos_v", TEMPORAL + " SELECT page_id, count(*) AS clusters, sum(flag)::BIGINT AS flagged, max(score) AS best, max(n_reviews) AS largest FROM bb GROUP BY 1")
def f10(p):
    return rounded(photos.temporal_summary(photos.temporal_clusters(p)))


def hint_sql(hints: list[str], strong: list[str], high: str, low: str) -> str:
    return f"CASE WHEN {any_of('u', strong)} THEN {high} WHEN {any_of('u', hints)} THEN {low} ELSE 0 END"


CUSTOMER = any_of("u", L.CUSTOMER_HINTS)


@query("f11_f12_url_hints", "photos_v", f""", h AS (SELECT record_id, replace(lower(url || CASE record_id % 5 WHEN 0 THEN '/banner.jpg' WHEN 1 THEN '/ai-generated/user_1.png' WHEN 2 THEN '/diffusion.png' ELSE '' END), '_', '-') AS u FROM photos_v)
 SELECT record_id, round(max({hint_sql(L.STOCK_HINTS, L.STRONG_STOCK_HINTS, f".62 - CASE WHEN {CUSTOMER} THEN .22 ELSE 0 END", f".46 - CASE WHEN {CUSTOMER} THEN .22 ELSE 0 END")}), 4) AS stock, round(max({hint_sql(L.SYNTHETIC_HINTS, L.STRONG_SYNTHETIC_HINTS, f".74 - CASE WHEN {CUSTOMER} THEN .08 ELSE 0 END", f".48 - CASE WHEN {CUSTOMER} THEN .24 ELSE 0 END")}), 4) AS synthetic FROM h GROUP BY 1""")
def f11(p):
    k = p.record_id % 5
    url = F.concat("url", F.when(k == 0, "/banner.jpg").when(k == 1, "/ai-generated/user_1.png").when(k == 2, "/diffusion.png").otherwise(""))
    by = p.groupBy("page_id", "record_id").agg(F.collect_set(url).alias("urls"))
    return rounded(by.select("record_id", photos.stock_url_signal(F.col("urls")).alias("stock"), photos.synthetic_url_signal(F.col("urls")).alias("synthetic")))


@query("f09_best_cluster", "photos_v", TEMPORAL + f", ln AS (SELECT DISTINCT page_id, record_id, sec, sha1({CANON}) AS fp FROM photos_v), jn AS (SELECT ln.page_id, record_id, fp, score, flag, n_reviews, n_authors, row_number() OVER (PARTITION BY ln.page_id, record_id ORDER BY score6 DESC, start_sec, fp DESC) AS k FROM ln JOIN bb USING (page_id, fp) WHERE sec BETWEEN start_sec AND end_sec) SELECT page_id, record_id, fp, score AS temporal_score, flag AS temporal_flag, n_reviews, n_authors FROM jn WHERE k = 1")
def f09(p):
    return rounded(photos.best_cluster_per_review(p, photos.temporal_clusters(p)).drop("span_sec"))


# --- evaluation, triage ------------------------------------------------------------------------------------


def confusion_sql(cond: str) -> str:
    return f"count(*) FILTER (WHERE label = 1 AND {cond}) AS tp, count(*) FILTER (WHERE label = 0 AND {cond}) AS fp, count(*) FILTER (WHERE label = 1 AND NOT {cond}) AS fn, count(*) FILTER (WHERE label = 0 AND NOT {cond}) AS tn"


PRF = "coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)", "coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)", "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"
RATES = f"tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 4) AS accuracy, round({PRF[0]}, 4) AS precision, round({PRF[1]}, 4) AS recall, round({PRF[2]}, 4) AS f1"


@query("e01_metrics", "scored_v", f" SELECT lang, {RATES} FROM (SELECT lang, {confusion_sql('p >= 0.5')} FROM scored_v GROUP BY 1)")
def e01(s):
    return rounded(evaluation.classification_metrics(s, by=["lang"]))


@query("e02_ranking", "scored_v", """, d AS (SELECT p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored_v GROUP BY 1), c AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS below, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM d)
 SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 4) AS roc_auc, round(sum(pos * tp / (tp + fp)::DOUBLE) / sum(pos), 4) AS average_precision FROM c""")
def e02(s):
    return rounded(evaluation.ranking_metrics(s))


BINS = "(SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, avg(p) AS mean_p, avg(label) AS rate FROM scored_v GROUP BY 1)"


@query("e03_calibration", "scored_v", f" SELECT r.range AS bin, coalesce(n, 0) AS n, round(coalesce(mean_p, 0), 4) AS mean_p, round(coalesce(rate, 0), 4) AS rate FROM range(10) r LEFT JOIN {BINS} b ON b.bin = r.range")
def e03(s):
    return rounded(evaluation.calibration(s))


@query("e03_ece_brier", "scored_v", f" SELECT round((SELECT sum(n * abs(mean_p - rate)) / sum(n) FROM {BINS}), 4) AS ece, round((SELECT avg((p - label) * (p - label)) FROM scored_v), 4) AS brier")
def e03b(s):
    return rounded(evaluation.calibration_error(s))


@query("e04_threshold_profile", "scored_v", f" SELECT t, {RATES} FROM (SELECT t, {confusion_sql('p >= t')} FROM scored_v, (SELECT unnest([.3, .4, .5, .6, .7, .8])::DOUBLE AS t) GROUP BY 1)")
def e04(s):
    return rounded(evaluation.threshold_profile(s))


@query("e05_slices", "scored_v", f" SELECT dimension, value, {RATES} FROM (SELECT 'lang' AS dimension, lang AS value, {confusion_sql('p >= 0.5')} FROM scored_v GROUP BY 2 UNION ALL SELECT 'source', source, {confusion_sql('p >= 0.5')} FROM scored_v GROUP BY 2)")
def e05(s):
    return rounded(evaluation.slice_metrics(s, ["lang", "source"]))


@query("e06_error_examples", "scored_v", """, k AS (SELECT record_id, p, CASE WHEN label = 0 AND p >= .5 THEN 'fp' WHEN label = 1 AND p < .5 THEN 'fn' END AS kind FROM scored_v) SELECT * FROM (SELECT record_id, p, kind, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'fp' THEN -p ELSE p END, record_id) AS rank FROM k WHERE kind IS NOT NULL) WHERE rank <= 5""")
def e06(s):
    return rounded(evaluation.error_examples(s).select("record_id", "p", "kind", "rank"))


@query("e07_minmax", "scored_v", " SELECT record_id, round((p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ()), 4) AS scaled FROM scored_v")
def e07(s):
    return rounded(evaluation.minmax(s).select("record_id", "scaled"))


@query("k07_stratified_split", "scored_v", " SELECT record_id, CASE WHEN percent_rank() OVER (PARTITION BY label ORDER BY md5('0' || record_id)) < 0.2 THEN 'test' ELSE 'train' END AS part FROM scored_v")
def k07(s):
    return evaluation.stratified_split(s).select("record_id", "part")


PARTS = "SELECT source, record_id, CASE WHEN u < .6 THEN 'train' WHEN u < .8 THEN 'validation' ELSE 'test' END AS part FROM (SELECT *, ('0x' || substr(md5('0' || source), 1, 8))::BIGINT / 4294967296.0 AS u FROM scored_v)"
FRACTIONS = {"train": 0.6, "validation": 0.2, "test": 0.2}


@query("k08_group_split", "scored_v", f" SELECT record_id, part FROM ({PARTS})")
def k08(s):
    return evaluation.group_split(s, "source", FRACTIONS).select("record_id", "part")


_TRY = "('0x' || substr(md5('0-{name}-' || t || '-' || {group}), 1, 8))::BIGINT / 4294967296.0 < {share}"


def _cover_sql(steps: dict[str, float]) -> str:
    """Parts split off one by one, each by the first salt that leaves both labels on both sides."""
    parts, left, free, case = [", g0 AS (SELECT source AS g, max((label = 0)::INT) AS y0, max((label = 1)::INT) AS y1 FROM scored_v GROUP BY 1)"], "g0", 1.0, ""
    for k, (name, share) in enumerate(steps.items(), 1):
        hit = _TRY.format(name=name, group="g", share=share / free)
        parts.append(f", t{k} AS (SELECT min(t) AS t FROM (SELECT t FROM {left}, range(24) AS r(t) GROUP BY t HAVING max(CASE WHEN {hit} THEN y0 END) = 1 AND max(CASE WHEN {hit} THEN y1 END) = 1 AND max(CASE WHEN {hit} THEN NULL ELSE y0 END) = 1 AND max(CASE WHEN {hit} THEN NULL ELSE y1 END) = 1))")
        parts.append(f", g{k} AS (SELECT {left}.* FROM {left}, t{k} WHERE NOT {hit})")
        case += f" WHEN (SELECT {_TRY.format(name=name, group='source', share=share / free)} FROM t{k}) THEN '{name}'"
        left, free = f"g{k}", free - share
    return "".join(parts) + f" SELECT record_id, CASE{case} ELSE 'train' END AS part FROM scored_v"


COVER = {"test": 0.2, "calibration": 0.15, "validation": 0.15}


@query("k08_covering_split", "scored_v", _cover_sql(COVER))
def k08b(s):
    parts = evaluation.covering_split(s, "source", COVER)
    evaluation.assert_disjoint(parts, ["source"])
    return parts.select("record_id", "part")


@query("k09_leaks", "scored_v", f" SELECT lang, count(DISTINCT s.part) AS parts FROM ({PARTS}) s JOIN scored_v USING (record_id) GROUP BY 1 HAVING count(DISTINCT s.part) > 1")
def k09(s):
    return evaluation.leaks(evaluation.group_split(s, "source", FRACTIONS), "lang")


@query("k10_threshold", "scored_v", f" SELECT t AS threshold, f AS f1 FROM (SELECT t, round({PRF[2]}, 4) AS f, round({PRF[2]}, 9) AS f9 FROM (SELECT t, {confusion_sql('p >= t')} FROM scored_v, (SELECT round(.3 + .02 * range, 2)::DOUBLE AS t FROM range(26)) GROUP BY 1)) ORDER BY f9 DESC, t LIMIT 1")
def k10(s):
    return rounded(evaluation.select_threshold(s))


@query("k10_quantile_threshold", "scored_v", f" SELECT round(t, 4) AS threshold, f AS f1 FROM (SELECT t, round({PRF[2]}, 4) AS f, round({PRF[2]}, 9) AS f9 FROM (SELECT t, {confusion_sql('p >= t')} FROM scored_v, (SELECT DISTINCT unnest(quantile_cont(p, [{', '.join(str(.7 + .295 * i / 29) for i in range(30))}])) AS t FROM scored_v) GROUP BY 1)) ORDER BY f9 DESC, t LIMIT 1")
def k10b(s):
    return rounded(evaluation.select_threshold_by_quantiles(s))


@query("a07_capped_threshold", "scored_v", f" SELECT t AS threshold, s AS selection_score FROM (SELECT t, round({PRF[2]} + .08 * {PRF[1]} - .20 * t, 4) AS s, round({PRF[2]} + .08 * {PRF[1]} - .20 * t, 9) AS s9 FROM (SELECT t, {confusion_sql('p >= t')} FROM scored_v, (SELECT round(.52 + .01 * range, 2)::DOUBLE AS t FROM range(39)) GROUP BY 1) WHERE coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0) <= .2) ORDER BY s9 DESC, t LIMIT 1")
def a07(s):
    return rounded(evaluation.select_threshold_capped(s, cap=0.2))


@query("a08_holdout", "scored_v", " SELECT count(*) AS n, round(avg(CASE WHEN p >= .66 THEN 1.0 ELSE 0 END), 4) AS fpr, round(avg(p), 4) AS mean, round(quantile_cont(p, .95), 4) AS p95, round(quantile_cont(p, .99), 4) AS p99, max(p) AS max FROM scored_v WHERE label = 0")
def a08(s):
    return rounded(evaluation.holdout_metrics(s))


@query("k12_k13_combine", "scored_v", f" SELECT record_id, round({clip_sql('.62 * pt + .38 * rating_score')}, 4) AS combined, round({clip_sql('p + .22 * (.30 * pt + .24 * rating_score) * (1 - p)')}, 4) AS boosted FROM scored_v")
def k12(s):
    return rounded(s.select("record_id", evaluation.combine_simple(F.col("pt"), F.col("rating_score")).alias("combined"), evaluation.photo_boost(F.col("p"), {"reuse": F.col("pt"), "temporal": F.col("rating_score")}).alias("boosted")))


POLICY = {"clean": 0.4, "suspicious": 0.6, "uncertainty": 0.5, "ood": 0.5}
#: Reviews with page scores, machine-text score, and made-up probabilities of a text model and the hybrid.
MADE_UP = "((record_id * 37) % 101) / 100.0 AS p, ((record_id * 53) % 101) / 100.0 AS pt, ((record_id * 7) % 11) / 10.0 AS coverage"


def triage_sql(low: float, high: float, unc: float, ood: float) -> str:
    """From v (p, pt, coverage, ai and the columns of z) to u (ood, uncertainty) and t (triage)."""
    novelty = clip_sql(".45 * (h > 0)::INT + .30 * (pack = 'generic' AND mix = 1)::INT + .25 * (domain = 'general' AND h > 0 AND grounding < .22)::INT")
    doubt = ".44 * {} + .18 * {} + .16 * {} + .12 * {} + .10 * ood".format(*map(clip_sql, ("(.20 - abs(p - .5)) / .20", "abs(pt - p) / .45", "abs(pt - manipulation) / .65", "(.72 - greatest(2 * abs(pt - .5), 2 * abs(p - .5), local_score, a, m)) / .72")))
    return rf""", u0 AS (SELECT *, len({RTOK}) AS nw, {clip_sql(f".48 * {clip_sql('(.62 - coverage) / .62')} + .22 * {clip_sql(f'(8 - len({RTOK})) / 8.0')} + .30 * {novelty}")} AS ood, {Q.count_of(LOW_TEXT, L.STRUCTURE_MARKERS)} AS mk_, {Q.count_of(LOW_TEXT, L.LOW_RISK_TERMS)} AS dt_ FROM v),
 u AS (SELECT *, {clip_sql(doubt)} AS uncertainty, mk_ >= 1 AND dt_ >= 1 AS str_, mk_ >= 1 AND dt_ >= 1 OR nw <= 8 AND dt_ >= 1 OR nw >= 4 AND dt_ >= 2 AS lrk FROM u0),
 t0 AS (SELECT *, CASE WHEN p > {min(low, .12)} OR uncertainty > {unc} OR ood > {max(ood + .24, .74)} OR nw < 1 OR ai >= .76 AND NOT str_ THEN FALSE WHEN lrk AND p <= .025 AND manipulation <= .38 AND dup < 2 AND ai < .66 THEN TRUE WHEN m > .18 OR manipulation > .30 OR dup >= 2 THEN FALSE ELSE CASE WHEN a = 0 THEN .5 ELSE a END >= .66 OR lrk END AS clean_ood FROM u),
 t1 AS (SELECT *, {Q.sentences((f"p > {low} AND p < {high}", "The hybrid score falls inside the manual-review band."), (f"uncertainty > {unc}", "The model signals disagree too much for an automated decision."), (f"ood > {ood} AND NOT clean_ood", "The review looks out-of-domain relative to the training corpus."), ("CASE WHEN coverage = 0 THEN 1 ELSE coverage END < .32 AND NOT clean_ood", "Too little of the wording matches patterns seen during training."), ("abs(pt - p) > .24", "The raw text model and the hybrid fraud model disagree materially."))} AS why FROM t0),
 t AS (SELECT *, CASE WHEN len(why) > 0 THEN 'needs_manual_review' WHEN p >= {high} THEN 'confident_suspicious' WHEN p <= {low} THEN 'confident_clean' ELSE 'needs_manual_review' END AS triage FROM t1)"""


TRIAGE = SCORES + Q.AI + f", v AS (SELECT z.*, {MADE_UP.replace('record_id', 'z.record_id')}, ai.ai FROM z JOIN ai USING (record_id))" + triage_sql(.4, .6, .5, .5)


def _triage_input(r: DataFrame) -> DataFrame:
    k = F.col("record_id")
    own = machine_text.opening_boost(machine_text.for_openings(machine_text.ai_score(r.select("page_id", "record_id", "title", "review_text")))).select("record_id", "ai")
    rows = pages.page_scores(_slang(pages.prepared(r))).join(reports.text_signals(r), "record_id").join(own, "record_id")
    rows = rows.withColumns({"p": (k * 37) % 101 / 100.0, "pt": (k * 53) % 101 / 100.0, "coverage": (k * 7) % 11 / 10.0})
    return cut(evaluation.uncertainty(rows))


def _triaged(r: DataFrame) -> DataFrame:
    return evaluation.apply_triage(_triage_input(r), POLICY)


@query("t01_t03_triage", "reviews_v", TRIAGE + " SELECT record_id, round(ood, 4) AS ood, round(uncertainty, 4) AS uncertainty, clean_ood AS override, triage, array_to_string(why, ' ') AS reasons FROM t")
def t01(r):
    return rounded(_triaged(r).select("record_id", "ood", "uncertainty", "override", "triage", F.array_join("triage_reasons", " ").alias("reasons")))


@query("t04_fit_triage", "reviews_v")
def t04(r):
    return rounded(evaluation.fit_triage(_triage_input(r).filter("label is not null")))


@query("t05_triage_summary", "reviews_v", TRIAGE + " SELECT page_id, count(*) AS n, count(*) FILTER (WHERE triage = 'confident_suspicious') AS suspicious, count(*) FILTER (WHERE triage = 'confident_clean') AS clean, count(*) FILTER (WHERE triage = 'needs_manual_review') AS manual, round(avg(uncertainty), 4) AS mean_uncertainty, round(avg(CASE WHEN ood >= .45 THEN 1.0 ELSE 0 END), 4) AS ood_ratio, round(avg(CASE WHEN triage = 'needs_manual_review' THEN 1.0 ELSE 0 END), 4) AS manual_ratio, round(avg(CASE WHEN triage != 'needs_manual_review' THEN 1.0 ELSE 0 END), 4) AS automated_ratio FROM t GROUP BY 1")
def t05(r):
    return rounded(evaluation.triage_summary(_triaged(r), ["page_id"]))


# --- corpus, reports ---------------------------------------------------------------------------------------

LOWER = f"lower({RT})"


@query("c04_finalize", "reviews_v", f", f AS (SELECT record_id, 'review::' || md5({LOWER}) AS split_group, coalesce(nullif(trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unspecified') AS source_group FROM reviews_v WHERE length({RT}) >= 15) SELECT *, min(source_group) OVER (PARTITION BY split_group) AS holdout_group FROM f")
def c04(r):
    return corpus.finalize_rows(r).select("record_id", "split_group", "source_group", "holdout_group")


@query("c05_sample", "reviews_v", " SELECT record_id FROM reviews_v ORDER BY md5('7' || record_id), record_id LIMIT 50")
def c05(r):
    return corpus.sample_n(r, 50, "7").select("record_id")


@query("c06_dedupe_text", "reviews_v", f" SELECT min(record_id) AS record_id FROM reviews_v GROUP BY {LOWER}")
def c06(r):
    return corpus.dedupe_text(r).select("record_id")


@query("v07_dedupe_reviews", "reviews_v", f" SELECT min(record_id) AS record_id FROM reviews_v GROUP BY lower(author), substr({LOWER}, 1, 240)")
def v07(r):
    return corpus.dedupe_reviews(r).select("record_id")


@query("c08_augment", "reviews_v", ", cl AS (SELECT * FROM reviews_v WHERE label = 0)" + Q.augmented("cl", "(SELECT count(*) + count(*) // 2 FROM cl)", "au") + " SELECT record_id, copy, style, rating, split_group, md5(review_text) AS text_md5 FROM au")
def c08(r):
    n = r.filter("label = 0").count()
    return rounded(corpus.augment(r, n + n // 2).select("record_id", "copy", "style", "rating", "split_group", F.md5("review_text").alias("text_md5")))


@query("c09_corpus_report", "reviews_v", f""", b AS (SELECT label::VARCHAR AS label, source AS source_group, lang AS language, md5({LOWER}) AS k FROM reviews_v)
 SELECT 'total' AS dimension, 'all' AS value, count(*) AS n, count(DISTINCT k) AS lineages FROM b UNION ALL SELECT 'label', coalesce(label, '?'), count(*), count(DISTINCT k) FROM b GROUP BY 2 UNION ALL SELECT 'source_group', source_group, count(*), count(DISTINCT k) FROM b GROUP BY 2 UNION ALL SELECT 'language', language, count(*), count(DISTINCT k) FROM b GROUP BY 2""")
def c09(r):
    return corpus.corpus_report(r.select("label", F.col("source").alias("source_group"), F.col("lang").alias("language"), T.split_group(F.col("review_text")).alias("split_group")))


@query("k01_tfidf", "reviews_v", rf""", t AS (SELECT record_id, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS term FROM (SELECT record_id, {RTOK} AS k FROM reviews_v)), f AS (SELECT record_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM reviews_v),
 d AS (SELECT term, count(*) AS df, sum(tf) AS total FROM f GROUP BY 1), k AS (SELECT d.* FROM d, n WHERE df >= 2 AND df <= 0.9 * n ORDER BY total DESC, term LIMIT 2000),
 w AS (SELECT record_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM f JOIN k USING (term), n) SELECT record_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY record_id)), 4) AS weight FROM w""")
def k01(r):
    return rounded(corpus.tfidf(r))


CHARS = rf"(SELECT record_id, unnest(list_transform({RTOK}, lambda w: ' ' || w || ' ')) AS w FROM reviews_v)"


@query("k01_char_tfidf", "reviews_v", rf""", t AS (SELECT record_id, unnest(CASE WHEN length(w) <= n THEN [w] ELSE list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n)) END) AS term FROM {CHARS}, (SELECT unnest([3, 4, 5]) AS n) WHERE n = 3 OR length(w) >= n), f AS (SELECT record_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM reviews_v),
 d AS (SELECT term, count(*) AS df, sum(tf) AS total FROM f GROUP BY 1), k AS (SELECT d.* FROM d, n WHERE df >= 2 AND df <= 0.9 * n ORDER BY total DESC, term LIMIT 1000),
 w AS (SELECT record_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM f JOIN k USING (term), n) SELECT record_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY record_id)), 4) AS weight FROM w""")
def k01b(r):
    return rounded(corpus.char_tfidf(r, top=1000))


@query("k02_text_numerics", "reviews_v", rf""" SELECT record_id, round({clip_sql('rating / 5')}, 4) AS rating_scaled, round({clip_sql(f'len({RTOK}) / 120.0')}, 4) AS word_count_scaled, round({clip_sql('length(review_text) / 600.0')}, 4) AS character_count_scaled, round(len(list_distinct({RTOK})) / greatest(len({RTOK}), 1)::DOUBLE, 4) AS unique_word_ratio,
 round(1 - len(list_distinct({RTOK})) / greatest(len({RTOK}), 1)::DOUBLE, 4) AS repetition_ratio, round({clip_sql(f"coalesce(list_avg(list_transform({RTOK}, lambda x: length(x))), 0) / 12")}, 4) AS average_word_length_scaled, round({clip_sql("25 * len(regexp_extract_all(review_text, '[!]')) / greatest(length(review_text), 1)::DOUBLE")}, 4) AS exclamation_density_scaled,
 round({clip_sql("25 * len(regexp_extract_all(review_text, '[?]')) / greatest(length(review_text), 1)::DOUBLE")}, 4) AS question_density_scaled, round({clip_sql(r"4 * len(regexp_extract_all(review_text, '\p{Lu}')) / greatest(len(regexp_extract_all(review_text, '\p{L}')), 1)::DOUBLE")}, 4) AS uppercase_ratio_scaled, round({clip_sql(r"10 * len(regexp_extract_all(review_text, '\p{Nd}')) / greatest(length(review_text), 1)::DOUBLE")}, 4) AS digit_ratio_scaled FROM reviews_v""")
def k02(r):
    return rounded(r.select("record_id", *[c.alias(n) for n, c in T.text_numeric_features(F.col("review_text"), F.col("rating")).items()]))


@query("s14_human_dates", "reviews_v", " SELECT record_id, (CASE record_id % 5 WHEN 3 THEN DATE '2024-03-01' - CAST(record_id % 9 AS INT) WHEN 4 THEN CASE WHEN review_date > DATE '2024-01-10' THEN review_date - INTERVAL 1 YEAR ELSE review_date END ELSE review_date END)::DATE::VARCHAR AS day FROM reviews_v")
def s14(r):
    k, d = r.record_id % 5, r.review_date
    ru = F.concat_ws(" ", F.day(d).cast("string"), F.lit("января"), F.year(d).cast("string"))
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd.MM.yyyy")).when(k == 2, ru).when(k == 3, F.concat((r.record_id % 9).cast("string"), F.lit(" days ago"))).otherwise(F.date_format(d, "MMMM d"))
    now = F.when(k == 4, F.lit("2024-01-10")).otherwise(F.lit("2024-03-01")).cast("date")
    return r.select("record_id", T.parse_human_date(text, now).cast("string").alias("day"))


@query("s22_boilerplate", "reviews_v", f" SELECT record_id, md5({RT}) AS text_md5, title FROM reviews_v")
def s22(r):
    around = F.concat(F.lit("Brief content visible, double tap to read full content. "), "review_text", F.lit(" Full content visible, double tap to read brief content"))
    return r.select("record_id", F.md5(T.clean_boilerplate(around)).alias("text_md5"), T.clean_title(F.concat(F.lit("5.0 out of 5 stars - "), "title"), F.lit("5.0 out of 5 Stars")).alias("title"))


@query("p15_families", "reviews_v", f" SELECT record_id, CASE {' '.join('WHEN ' + any_of('lower(source)', v) + f" THEN '{k}'" for k, v in L.FAMILY_SOURCES.items())} {' '.join('WHEN ' + any_of(f'lower({RT})', v) + f" THEN '{k}'" for k, v in L.FAMILY_TEXTS.items())} ELSE 'general' END AS family FROM reviews_v")
def p15(r):
    return r.select("record_id", T.product_family(F.col("review_text"), F.col("source")).alias("family"))


@query("p19_moderation_list", "reviews_v", " SELECT record_id FROM reviews_v WHERE lang = 'en' AND contains(lower(title || ' ' || review_text || ' ' || author), 'the')")
def p19(r):
    rows = r.withColumns({"language": F.col("lang"), "severity": F.lit("low"), "triage": F.lit(""), "score": F.col("rating")})
    return corpus.filter_reviews(rows.drop("triage"), language="en", query="the ").select("record_id")


@query("p20_lexical_coverage", "reviews_v", rf", w AS (SELECT record_id, {RTOK} AS k FROM reviews_v), kn AS (SELECT list(term) AS known FROM (SELECT term, count(*) AS n FROM (SELECT record_id, unnest(k) AS term FROM w) GROUP BY 1 ORDER BY n DESC, term LIMIT 500)) SELECT record_id, round(CASE WHEN len(k) = 0 THEN 0 ELSE len(list_filter(k, lambda x: list_contains(known, x))) / len(k)::DOUBLE END, 4) AS coverage FROM w, kn")
def p20(r):
    words = r.select("record_id", T.tokens(F.col("review_text")).alias("tok"))
    known = words.select(F.explode("tok").alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(500).agg(F.collect_list("term").alias("known"))
    return rounded(words.join(F.broadcast(known), F.lit(True)).select("record_id", T.lexical_coverage(F.col("tok"), F.col("known")).alias("coverage")))


@query("c07_balance", "scored_v", " SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY label ORDER BY md5('3' || record_id)) AS i FROM scored_v) WHERE i <= 10")
def c07(s):
    return corpus.balance_classes(s, 10, "3").select("record_id")


@query("c07_balanced_corpus", "reviews_v", Q.BALANCED + " SELECT record_id, origin, copy, label::BIGINT AS label, md5(review_text) AS text_md5 FROM balanced")
def c07b(r):
    rows = r.select("record_id", "review_text", "rating", F.col("label").cast("long").alias("label"), "source")
    templates = rows.filter("label is null").withColumn("label", F.col("record_id") % 2)
    return rounded(corpus.balanced_corpus(rows, templates).select("record_id", "origin", "copy", "label", F.md5("review_text").alias("text_md5")))


WIDE = ["click", "error", "login", "purchase", "signup", "view"]


@query("c03_wide_profiles", "events", f"""WITH w AS (SELECT user_id, {', '.join(f"round(coalesce(avg(value) FILTER (WHERE event_type = '{k}'), 0), 6) AS {k}" for k in WIDE)} FROM events GROUP BY 1), l AS (SELECT user_id, unnest([{', '.join(f"{{'v': {k}, 'i': -{i}, 'name': '{k}'}}" for i, k in enumerate(WIDE))}], recursive := true) FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, i DESC) AS k FROM l)
 SELECT user_id, 'This traveler usually gives higher ratings to ' || coalesce(string_agg(name, ', ' ORDER BY k) FILTER (WHERE k <= 3 AND v > 0), 'several travel categories') || ', while ' || coalesce(string_agg(name, ', ' ORDER BY k) FILTER (WHERE k >= 5 AND v >= 0), 'a few other categories') || ' receive lower scores. The preference pattern looks detailed and organic.' AS review_text, round(coalesce(avg(v) FILTER (WHERE v != 0), 0), 4) AS rating FROM r GROUP BY 1""")
def c03(e):
    wide = e.groupBy("user_id").agg(*[F.round(F.coalesce(F.avg(F.when(F.col("event_type") == k, F.col("value"))), F.lit(0.0)), 6).alias(k) for k in WIDE])
    return rounded(corpus.wide_profile_text(wide, WIDE).select("user_id", "review_text", "rating"))


@query("d07_anomaly_profile", "reviews_v", " , g AS (SELECT source, count(*) AS n FROM reviews_v GROUP BY 1), x AS (SELECT greatest(max(n), 1) AS most FROM g) SELECT floor(max(n) / sum(n)::DOUBLE * 100 + .5)::BIGINT AS dominant_share, floor(sum(n) / count(*)::DOUBLE + .5)::BIGINT AS signal_density, count(*) FILTER (WHERE n >= most * .55) AS hot_groups, floor(sum(n / most::DOUBLE) / count(*) * 100 + .5)::BIGINT AS average_intensity FROM g, x")
def d07(r):
    return rounded(corpus.anomaly_profile(r.groupBy("source").agg(F.count("*").alias("n"))))


@query("e08_recommendations", "scored_v")
def e08(s):
    return evaluation.recommendations(s, 0.4).select(F.array_join("recommendations", " ").alias("recommendations"))


@query("f13_f17_image_scores", "photos_v", f""", im AS (SELECT page_id, record_id, url, ((record_id * 31) % 101) / 100.0 AS mismatch, {hint_sql(L.STOCK_HINTS, L.STRONG_STOCK_HINTS, ".62", ".46").replace("(u,", "(lower(url),")} AS stock, CASE WHEN {any_of("lower(md)", photos.METADATA_HINTS)} THEN .86 ELSE 0 END AS synthetic FROM (SELECT DISTINCT page_id, record_id, url, 'Software=' || CASE record_id % 7 WHEN 0 THEN 'ComfyUI' ELSE 'camera' END AS md FROM photos_v)),
 bi AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY greatest(mismatch, stock, synthetic * .72) DESC, url) AS i FROM im) SELECT page_id, count(*) AS evaluated, count(*) FILTER (WHERE mismatch >= .58) AS mismatch_reviews, count(*) FILTER (WHERE stock >= .58) AS stock_reviews, count(*) FILTER (WHERE synthetic >= .66) AS synthetic_reviews, round(avg(CASE WHEN mismatch >= .58 THEN 1.0 ELSE 0 END), 4) AS mismatch_ratio, round(avg(CASE WHEN stock >= .58 THEN 1.0 ELSE 0 END), 4) AS stock_ratio, round(avg(CASE WHEN synthetic >= .66 THEN 1.0 ELSE 0 END), 4) AS synthetic_ratio, round(avg(mismatch), 4) AS mismatch_mean, round(avg(stock), 4) AS stock_mean, round(avg(synthetic), 4) AS synthetic_mean FROM bi WHERE i = 1 GROUP BY 1""")
def f13(p):
    md = F.concat(F.lit("Software="), F.when(F.col("record_id") % 7 == 0, "ComfyUI").otherwise("camera"))
    stock = F.when(T.has_phrase(F.col("url"), L.STRONG_STOCK_HINTS), 0.62).when(T.has_phrase(F.col("url"), L.STOCK_HINTS), 0.46).otherwise(0.0)
    images = p.select("page_id", "record_id", "url").distinct().withColumns({"mismatch": (F.col("record_id") * 31) % 101 / 100.0, "stock": stock, "synthetic": photos.metadata_signal(md)})
    best = photos.best_image(images).join(images.select("page_id", "record_id").distinct(), "record_id")
    return rounded(photos.alignment_summary(best))


@query("f15_categories", "reviews_v", f""" SELECT record_id, CASE WHEN regexp_matches(h, 'boot|shoe|sneaker|sandal|обув|ботин|кроссов|туфл') THEN 'footwear' WHEN regexp_matches(h, 'shirt|dress|jacket|pants|jeans|hoodie|одеж|куртк|плать|рубаш|джинс') THEN 'apparel' WHEN regexp_matches(h, 'phone|laptop|camera|charger|электрон|телефон|ноутбук|наушник') THEN 'electronics'
 WHEN regexp_matches(h, 'cream|serum|makeup|shampoo|beauty|крем|сыворот|космет|шампун') THEN 'beauty' WHEN regexp_matches(h, 'chair|table|lamp|kitchen|mug|blanket|home|стул|ламп|кухн|дом') THEN 'home goods' WHEN regexp_matches(h, 'coffee|tea|snack|food|protein|кофе|чай|еда|продукт') THEN 'grocery' ELSE 'general product' END AS category
 FROM (SELECT record_id, lower(concat_ws(' ', source_site, title, review_text)) AS h FROM reviews_v)""")
def f15(r):
    return r.select("record_id", photos.product_category([F.lit("general")], F.col("source_site"), F.col("title"), F.col("review_text")).alias("category"))


_LABELS = ["review_match", "category_match", "product_relevance", "casual_customer_snapshot", "product_in_use", "packaging_only", "unrelated_product", "blank_or_screenshot", "stock_catalog", "studio_render", "marketing_banner", "listing_screenshot", "packshot", "ai_generated", "diffusion_artifact", "cgi_synthetic", "overprocessed_synthetic"]
_RAW = "CASE WHEN (record_id + length(url)) % 17 = {i} THEN 400 ELSE 0 END + (record_id * {a} + length(url) * {b}) % 97"


def _top_sql(first: int, last: int) -> str:
    return "list_max([" + ", ".join(f"{{'p': pr[{i}], 'i': -{i}}}" for i in range(first, last + 1)) + "])"


_ALIGN = f""", al0 AS (SELECT DISTINCT record_id, url, [{', '.join(_RAW.format(i=i, a=2 * i + 3, b=5 * i + 1) for i in range(17))}] AS w FROM photos_v), al1 AS (SELECT record_id, url, list_transform(w, lambda x: x / list_sum(w)::DOUBLE) AS pr, {SQL_LIST(_LABELS)} AS names FROM al0),
 al2 AS (SELECT *, list_sum(pr[1:5]) AS pos, list_sum(pr[6:13]) AS neg, list_sum(pr[9:13]) AS st, list_sum(pr[14:17]) AS sy, {_top_sql(6, 13)} AS tn, {_top_sql(9, 13)} AS ts, {_top_sql(14, 17)} AS ty, greatest(pr[4], pr[5]) AS cu FROM al1),
 al3 AS (SELECT *, {clip_sql('.72 * neg + .28 * greatest(0, tn.p - pos)')} AS m0, {clip_sql('.64 * st + .36 * greatest(0, ts.p - cu)')} AS s0, {clip_sql('.58 * sy + .42 * greatest(0, ty.p - greatest(cu, pos * .4))')} AS y0 FROM al2),
 al4 AS (SELECT *, CASE WHEN pos < .34 AND neg >= .5 THEN greatest(m0, .62) ELSE m0 END AS m, CASE WHEN ts.p >= .24 AND st >= .38 THEN greatest(s0, .58) ELSE s0 END AS s, CASE WHEN ty.p >= .26 AND sy >= .42 THEN greatest(y0, .66) ELSE y0 END AS y FROM al3)"""
_ALIGN_SQL = _ALIGN + """ SELECT record_id, url, round(pos, 4) AS alignment, round(m, 4) AS mismatch, round(s, 4) AS stock, round(y, 4) AS synthetic, names[-tn.i] AS top_negative, CASE WHEN m >= .72 THEN 'strong_mismatch' WHEN m >= .58 THEN 'mismatch' WHEN m >= .38 THEN 'weak_match' ELSE 'aligned' END AS mismatch_label,
 CASE WHEN s < .34 THEN 'customer_like' WHEN s < .58 THEN 'possible_stock' ELSE names[-ts.i] END AS stock_label, CASE WHEN y < .38 THEN 'natural_photo_like' WHEN y < .66 THEN 'weak_synthetic_hint' ELSE names[-ty.i] END AS synthetic_label, (m >= .58)::INT + (s >= .58)::INT + (y >= .66)::INT AS reasons FROM al4"""


@query("f14_alignment_scores", "photos_v", _ALIGN_SQL)
def f14(p):
    scored = photos.alignment_scores(_looks(p.select("record_id", "url").distinct()).withColumn("category", F.lit("beauty")))
    return rounded(scored.select("record_id", "url", "alignment", "mismatch", "stock", "synthetic", "top_negative", "mismatch_label", "stock_label", "synthetic_label", (F.size("mismatch_reasons") + F.size("stock_reasons") + F.size("synthetic_reasons")).alias("reasons")))


def _looks(images: DataFrame) -> DataFrame:
    """images with a probability for each label, as an image model would give."""
    raw = [F.expr(_RAW.format(i=i, a=2 * i + 3, b=5 * i + 1)) for i in range(17)]
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = images.withColumn("w", F.array(*[x.cast("long") for x in raw]))
    return rows.withColumn("probabilities", F.map_from_arrays(F.array(*map(F.lit, _LABELS)), F.transform("w", lambda x: x / total))).drop("w")


SERIES = ", d AS (SELECT page_id, review_date AS day, count(*) AS n, count(*) FILTER (WHERE rating <= 2) AS low FROM reviews_v GROUP BY 1, 2), s AS (SELECT page_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY 1), a AS (SELECT page_id, day, coalesce(n, 0) AS n, coalesce(low, 0) AS low FROM s LEFT JOIN d USING (page_id, day))"


@query("d01_activity", "reviews_v", SERIES + " SELECT page_id, day::VARCHAR AS day, n, low FROM a")
def d01(r):
    return corpus.activity_series(r).withColumn("day", F.col("day").cast("string"))


#: Pages of every span: the digits of a source's md5 stretch its reviews over hours, weeks, months or years.
_AT = "TIMESTAMP '2024-01-01 00:00:00' + CAST(record_id % 500 AS INT) * CASE WHEN md5(page_id) < '4' THEN INTERVAL 4 MINUTE WHEN md5(page_id) < '8' THEN INTERVAL 1 HOUR WHEN md5(page_id) < 'c' THEN INTERVAL 13 HOUR ELSE INTERVAL 2 DAY END"


@query("d01_adaptive_activity", "reviews_v", f""", ts_ AS (SELECT page_id, CASE WHEN record_id % 17 = 0 THEN NULL ELSE {_AT} END AS t, rating <= 2 AS bad FROM reviews_v), sp AS (SELECT page_id, min(t) AS a, max(t) AS b, count(t) AS dated, count(*) AS n_all, count(*) FILTER (WHERE bad) AS bad_all FROM ts_ GROUP BY 1),
 su AS (SELECT *, CASE WHEN dated = 0 THEN 'undated' WHEN epoch(b) - epoch(a) <= 129600 AND dated > 1 THEN 'hour' WHEN epoch(b) - epoch(a) <= 5356800 THEN 'day' WHEN epoch(b) - epoch(a) <= 31968000 THEN 'week' ELSE 'month' END AS unit FROM sp),
 sb AS (SELECT page_id, date_trunc(CASE unit WHEN 'undated' THEN 'day' ELSE unit END, t) AS bucket, count(*) AS n, count(*) FILTER (WHERE bad) AS suspicious FROM ts_ JOIN su USING (page_id) WHERE t IS NOT NULL GROUP BY 1, 2),
 ss AS (SELECT page_id, unit, unnest(generate_series(date_trunc(unit, a), date_trunc(unit, b), CASE unit WHEN 'hour' THEN INTERVAL 1 HOUR WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY ELSE INTERVAL 1 MONTH END)) AS bucket FROM su WHERE dated > 0)
 SELECT page_id, unit, strftime(bucket::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS bucket, coalesce(n, 0) AS n, coalesce(suspicious, 0) AS suspicious FROM ss LEFT JOIN sb USING (page_id, bucket) UNION ALL SELECT page_id, unit, NULL, n_all, bad_all FROM su WHERE dated = 0""")
def d01a(r):
    dated = r.withColumn("t", F.expr(f"CASE WHEN record_id % 17 = 0 THEN NULL ELSE {_AT} END"))
    return corpus.adaptive_series(dated, "t", F.col("rating") <= 2).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))


@query("d08_timeline", "reviews_v", SERIES + " SELECT page_id, sum(n)::BIGINT AS total, max(n) AS peak, (arg_max(day, n * 100000 - date_diff('day', DATE '2020-01-01', day)))::VARCHAR AS peak_day, round(sum(low) / sum(n)::DOUBLE, 4) AS low_share FROM a GROUP BY 1")
def d08(r):
    return rounded(corpus.timeline_summary(corpus.activity_series(r)).withColumn("peak_day", F.col("peak_day").cast("string")))


@query("d02_reason_counts", "ratings_v", SIGNALS + f", e AS (SELECT unnest({REASON_SQL}) AS reason FROM s) SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM e)::DOUBLE, 4) AS share FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def d02(r):
    return rounded(corpus.reason_counts(ratings.rule_score(ratings.with_signals(r))))


@query("d05_trust", "reviews_v", TRIAGE + " SELECT triage, count(*) AS n FROM t GROUP BY 1")
def d05(r):
    return corpus.trust_breakdown(_triaged(r))


@query("d06_top_reviews", "reviews_v", SCORES + " SELECT * FROM (SELECT page_id, record_id, round(manipulation, 4) AS rating_manipulation, CASE WHEN manipulation >= .72 THEN 'high' WHEN manipulation >= .48 THEN 'medium' ELSE 'low' END AS severity, row_number() OVER (PARTITION BY page_id ORDER BY round(manipulation, 6) DESC, record_id) AS rank FROM z) WHERE rank <= 12")
def d06(r):
    return rounded(corpus.top_reviews(pages.page_scores(_slang(pages.prepared(r))), "rating_manipulation").select("page_id", "record_id", "rating_manipulation", "severity", "rank"))


@query("v06_merge", "reviews_v", f", b AS (SELECT record_id, review_text, CASE WHEN length({LOWER}) >= 30 THEN {LOWER} ELSE lower(author) || chr(1) || review_date || chr(1) || rating || chr(1) || {LOWER} END AS k FROM reviews_v) SELECT md5(k) AS merge_key, 2 * count(*) AS n_merged, min(record_id) AS record_id, max(length(review_text)) AS longest FROM b GROUP BY k")
def v06(r):
    return rounded(corpus.merge_reviews(r, r).select("merge_key", "n_merged", "record_id", F.length("review_text").alias("longest")))


# --- the review report -------------------------------------------------------------------------------------

_HINT = f"(SELECT record_id, replace(lower(url), '_', '-') AS u FROM photos_v)"
#: Of the riskiest image of each review: scores, sentences; and what its photos say.
_KIND = "CASE WHEN regexp_matches(h, 'boot|shoe|sneaker|sandal|обув|ботин|кроссов|туфл') THEN 'footwear' WHEN regexp_matches(h, 'shirt|dress|jacket|pants|jeans|hoodie|одеж|куртк|плать|рубаш|джинс') THEN 'apparel' WHEN regexp_matches(h, 'phone|laptop|camera|charger|электрон|телефон|ноутбук|наушник') THEN 'electronics' WHEN regexp_matches(h, 'cream|serum|makeup|shampoo|beauty|крем|сыворот|космет|шампун') THEN 'beauty' WHEN regexp_matches(h, 'chair|table|lamp|kitchen|mug|blanket|home|стул|ламп|кухн|дом') THEN 'home goods' WHEN regexp_matches(h, 'coffee|tea|snack|food|protein|кофе|чай|еда|продукт') THEN 'grocery' ELSE 'general product' END"
_SEEN_AS = "CASE {x} WHEN 'packaging_only' THEN 'packaging, box, or label rather than the reviewed product' WHEN 'unrelated_product' THEN 'a different or unrelated product' WHEN 'blank_or_screenshot' THEN 'a blank image, screenshot, receipt, or text-only artifact' WHEN 'stock_catalog' THEN 'a polished catalog product photo rather than a customer snapshot' WHEN 'studio_render' THEN 'a studio render or mockup rather than a real customer snapshot' WHEN 'marketing_banner' THEN 'a marketing banner or advertisement rather than a customer snapshot' WHEN 'listing_screenshot' THEN 'a catalog/listing screenshot rather than a customer snapshot' ELSE 'a studio packshot rather than a customer snapshot' END"
_STOCK_AS = "CASE {x} WHEN 'stock_catalog' THEN 'a polished ecommerce catalog image' WHEN 'studio_render' THEN 'a studio render or 3D mockup' WHEN 'marketing_banner' THEN 'a marketing banner or promotional creative' WHEN 'listing_screenshot' THEN 'a screenshot from a catalog or marketplace listing' ELSE 'a studio packshot prepared for product marketing' END"
_MADE_AS = "CASE {x} WHEN 'ai_generated' THEN 'AI-generated visual style' WHEN 'diffusion_artifact' THEN 'diffusion-like artifacts, warped details, or hallucinated text' WHEN 'cgi_synthetic' THEN 'CGI/synthetic rendering cues' ELSE 'overly smooth synthetic lighting or unrealistic shadows' END"
EVIDENCE = _ALIGN + f""", bl AS (SELECT record_id, m AS lm, s AS ls, y AS ly, names[-tn.i] AS tn_, names[-ts.i] AS ts_, names[-ty.i] AS ty_ FROM al4 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY round(greatest(m, s, y * .72), 9) DESC, url) = 1),
 kd AS (SELECT record_id, {_KIND} AS kind FROM (SELECT record_id, lower(concat_ws(' ', source_site, title, review_text)) AS h FROM reviews_v))""" + OCR + Q.PHOTO + f""", ot AS (SELECT record_id, score AS pts, (score >= .46)::INT AS ptf, {Q.kept(*[(f"list_contains(labels, '{k}')", f"'{x}'") for k, x in (
    ("sale_discount", "OCR found sale, discount, coupon, promo, or similar marketing text on the photo."), ("hype_claim", "OCR found hype claims such as best product, best seller, top choice, or must buy."),
    ("watermark_marker", "OCR found ad, sponsored, official-store, or watermark-style text on the photo."), ("contact_or_store", "OCR found contact handles, social links, or store/domain text on the photo."))],
    ("len(foreign_) > 0", "'OCR found marketplace text that does not match the source site: ' || array_to_string(foreign_[1:3], ', ') || '.'"), ("len(foreign_) = 0 AND len(markets) > 0", "'OCR found marketplace branding text on the photo: ' || array_to_string(markets[1:3], ', ') || '.'"))} AS ptr FROM o4)"""  # fmt: skip
REPORT = (
    SCORES + Q.AI + TEMPORAL + EVIDENCE
    + f""", ll AS (SELECT DISTINCT page_id, record_id, sha1({CANON}) AS fp FROM photos_v), lz AS (SELECT page_id, fp, count(*) AS size FROM ll GROUP BY 1, 2), lk AS (SELECT record_id, count(*) AS images, count(*) FILTER (WHERE size >= 2) AS reused, max(size) AS cluster FROM ll JOIN lz USING (page_id, fp) GROUP BY 1),
 ln AS (SELECT DISTINCT page_id, record_id, sec, sha1({CANON}) AS fp FROM photos_v), bt AS (SELECT record_id, score, flag, n_reviews AS tnr, n_authors AS tna, round_even(span / 3600.0, 1) AS th FROM (SELECT record_id, score6 AS score, flag, n_reviews, n_authors, end_sec - start_sec AS span, row_number() OVER (PARTITION BY record_id ORDER BY score6 DESC, start_sec, fp DESC) AS i FROM ln JOIN bb USING (page_id, fp) WHERE sec BETWEEN start_sec AND end_sec) WHERE i = 1),
 hn AS (SELECT record_id, max({hint_sql(L.STOCK_HINTS, L.STRONG_STOCK_HINTS, f".62 - CASE WHEN {CUSTOMER} THEN .22 ELSE 0 END", f".46 - CASE WHEN {CUSTOMER} THEN .22 ELSE 0 END")}) AS stock, max({hint_sql(L.SYNTHETIC_HINTS, L.STRONG_SYNTHETIC_HINTS, f".74 - CASE WHEN {CUSTOMER} THEN .08 ELSE 0 END", f".48 - CASE WHEN {CUSTOMER} THEN .24 ELSE 0 END")}) AS synthetic FROM {_HINT} GROUP BY 1),
 v0 AS (SELECT z.*, ai.ai, ai.ai_flag, ai.ai_reasons, ((z.record_id * 53) % 101) / 100.0 AS pt, ((z.record_id * 7) % 11) / 10.0 AS coverage, coalesce(lk.images, 0) AS images, coalesce(lk.reused, 0) AS reused, coalesce(lk.cluster, 0) AS cluster, CASE WHEN coalesce(lk.reused, 0) = 0 THEN 0 ELSE .68 * lk.reused / lk.images + .32 * least((lk.cluster - 1) / 3.0, 1) END AS reuse_score,
  coalesce(bt.score, 0) AS temporal_score, coalesce(bt.flag, 0) AS temporal_flag, coalesce(greatest(hn.stock, ls), 0) AS stock, coalesce(greatest(hn.synthetic, ly), 0) AS synthetic, coalesce(lm, 0) AS mismatch, CASE WHEN lk.images > 0 THEN pts ELSE 0 END AS pts, CASE WHEN lk.images > 0 THEN ptf ELSE 0 END AS ptf, {Q.kept(
   ("lk.reused > 0", "'The same customer photo appears ' || CASE WHEN lk.cluster >= 4 THEN 'across a large cluster of ' ELSE 'in ' END || lk.cluster || ' reviews.'"),
   ("tnr >= 4", "'The same customer photo appears across ' || tnr || ' reviews by ' || tna || ' authors within ' || th || ' hours.'"), ("tnr < 4", "'The same customer photo appears across different authors within a short ' || th || '-hour window.'"),
   ("lm >= .58", f"'The customer photo looks closer to ' || {_SEEN_AS.format(x='tn_')} || ' than to the review text or inferred ' || kind || ' category.'"),
   ("ls >= hn.stock AND ls >= .58", f"'The customer image looks like ' || {_STOCK_AS.format(x='ts_')} || ', not a user-taken product photo.'"), ("NOT coalesce(ls >= hn.stock, FALSE) AND hn.stock >= .58", "'The image URL/path contains stock, catalog, render, promo, or marketing hints.'"),
   ("ly >= hn.synthetic AND ly >= .66", f"'Weak auxiliary signal: the image shows ' || {_MADE_AS.format(x='ty_')} || '. Treat this as supporting evidence, not proof.'"), ("NOT coalesce(ly >= hn.synthetic, FALSE) AND hn.synthetic >= .66", "'Weak auxiliary signal: the image URL/path contains AI-generated or synthetic-image hints.'"),
  )} AS looks_, CASE WHEN lk.images > 0 THEN ptr ELSE [] END AS ptr FROM z JOIN ai USING (record_id) LEFT JOIN lk USING (record_id) LEFT JOIN bt USING (record_id) LEFT JOIN hn USING (record_id) LEFT JOIN bl USING (record_id) LEFT JOIN kd USING (record_id) LEFT JOIN ot USING (record_id)),
 v1 AS (SELECT *, {clip_sql('.62 * pt + .38 * manipulation')} AS q1, .30 * reuse_score + .24 * temporal_score + .22 * mismatch + .13 * stock + .05 * synthetic + .06 * pts AS ps_, max(ai) OVER (PARTITION BY page_id) AS page_ai FROM v0), v2 AS (SELECT *, {clip_sql('q1 + .22 * ps_ * (1 - q1)')} AS q2 FROM v1),
 v AS (SELECT *, CASE WHEN page_ai >= .52 THEN {clip_sql(f"q2 + .16 * {clip_sql('(ai - .5) / .5')} * (1 - q2)")} ELSE q2 END AS p FROM v2)"""
    + triage_sql(.32, .68, .46, .46)
    + f""", x0 AS (SELECT *, list_filter(string_split(t, ' '), lambda x: x != '') AS ws, {any_of("t", reports.REASON_PHRASES)} AS prm, length(t) - length(replace(t, '!', '')) >= 3 AS bangs FROM t), x AS (SELECT *, len(ws) AS tw, len(list_distinct(ws)) < greatest(3, floor(len(ws) / 2)) AS rpt, (p >= .5)::INT AS sus, (triage = 'needs_manual_review')::INT AS man FROM x0),
 y AS (SELECT *, CASE WHEN p >= .85 THEN 'high' WHEN p >= .55 THEN 'medium' ELSE 'low' END AS risk, {PAGE_REASONS} AS page_reasons FROM x)
"""
)
OWN_REASONS = Q.kept(*[(cond, text if text.startswith("'The slang profile") else "'" + text + "'") for cond, text in (
    ("p >= .8", "The neural model considers this review highly suspicious."), ("p >= .6 AND p < .8", "The review has several linguistic patterns often seen in manipulated feedback."), ("tw < 8", "The review is unusually short and provides very little concrete detail."), ("bangs", "The text relies on heavy emotional punctuation."), ("prm", "The wording looks promotional or strongly templated."),
    ("rpt", "There is visible repetition, which can indicate scripted review text."), ("extreme = 1 AND tw < 15", "An extreme rating is paired with a generic explanation."), ("dup >= 2", "The same slang-heavy language pattern appears in multiple reviews on this page."),
    ("m >= .55", "'The slang profile looks hype-heavy and weakly grounded in ' || CASE WHEN domain = 'general' THEN 'product' ELSE domain END || ' detail' || CASE WHEN len(terms) > 0 THEN ' (' || array_to_string(terms[1:3], ', ') || ').' ELSE '.' END"),
    ("manipulation >= .55", "Behavioral and statistical page signals also suggest possible rating manipulation."), ("reuse_score >= .45 AND cluster >= 2", "The customer photo evidence is reused across multiple reviews."), ("temporal_flag = 1 AND temporal_score >= .55", "The same customer photo appears in a short time window across different authors."),
    ("mismatch >= .58", "The attached customer photo does not match the review text or inferred product category."), ("stock >= .58", "The customer image looks like a stock, catalog, studio, render, banner, or listing asset."), ("synthetic >= .66", "The image has weak AI-generated or synthetic-image indicators; treat this as supporting evidence, not proof."), ("ptf = 1", "OCR found promo, watermark, contact, marketplace, or sales text on the customer photo."), ("ai_flag = 1 OR ai >= .66", "AI-text detector flagged polished/template-like review language; treat this as a moderation signal, not proof."),
)])
#: The sentences of three lists, each once, in the order of first appearance.
ALL_REASONS = f"list_filter(list_transform(range(1, len(rs_) + 1), lambda i: CASE WHEN list_position(rs_, rs_[i]) = i THEN rs_[i] END), lambda s: s IS NOT NULL)"
CATEGORIES = Q.sentences(
    ("p >= .60", "neural_text_suspicion"), ("tw < 8 OR rpt", "low_detail_or_repetitive_text"), ("bangs OR prm", "promotional_template_language"), ("extreme = 1 AND tw < 15", "extreme_rating_low_evidence"), ("manipulation >= .55", "page_behavior_manipulation"), ("author_risk >= .45", "reviewer_cluster_anomaly"), ("m >= .55", "hype_heavy_slang"), ("reuse_score >= .45", "photo_reuse"),
    ("temporal_flag = 1", "coordinated_photo_timing"), ("mismatch >= .58", "photo_text_mismatch"), ("stock >= .58", "stock_or_catalog_photo"), ("synthetic >= .66", "synthetic_image_hint"), ("ptf = 1", "photo_ocr_promo_signal"), ("ai_flag = 1 OR ai >= .66", "ai_generated_text_signal"), ("man = 1 OR uncertainty >= .45", "manual_review_uncertainty"), ("ood >= .45", "out_of_domain_language"),
)
REASONED = REPORT + f", ys AS (SELECT * REPLACE ({ALL_REASONS} AS rs_) FROM (SELECT *, list_concat(list_concat(list_concat(list_concat({OWN_REASONS}, page_reasons), looks_), ptr), ai_reasons) AS rs_ FROM (SELECT * EXCLUDE (rs) FROM y)))"


def _evidence(r: DataFrame, links: DataFrame) -> DataFrame:
    """links with what an image model and a reader of photo text would say of them."""
    return _looks(links).join(_ocr(r).select("record_id", "ocr_text"), "record_id", "left")


def _scored(r: DataFrame, links: DataFrame) -> DataFrame:
    k = F.col("record_id")
    return cut(reports.score_reviews(r.withColumns({"pt": (k * 53) % 101 / 100.0, "coverage": (k * 7) % 11 / 10.0}), _evidence(r, links)))


@query("v01_v03_scored_reviews", "reviews_v photos_v", REASONED + f" SELECT record_id, round(p, 4) AS p, round(q1, 4) AS p_text, round(q2, 4) AS p_photo, round(ai, 4) AS ai, round(reuse_score, 4) AS reuse_score, round(temporal_score, 4) AS temporal_score, round(mismatch, 4) AS mismatch, round(stock, 4) AS stock, round(synthetic, 4) AS synthetic, round(pts, 4) AS photo_text_score, triage, risk, sus::BIGINT AS suspicious, array_to_string(rs_, ' ') AS reasons, CASE WHEN len({CATEGORIES}) = 0 THEN 'low_risk_or_insufficient_signal' ELSE array_to_string({CATEGORIES}, ',') END AS categories FROM ys")
def v01(r, links):
    return rounded(_scored(r, links).select("record_id", "p", "p_text", "p_photo", "ai", "reuse_score", "temporal_score", "mismatch", "stock", "synthetic", "photo_text_score", "triage", "risk", "suspicious", F.array_join("reasons", " ").alias("reasons"), F.array_join("categories", ",").alias("categories")))


PAGES = """, pg AS (SELECT page_id, count(*) AS total_reviews, sum(sus)::BIGINT AS suspicious_reviews, avg(sus) AS suspicious_ratio, avg(p) AS average_probability, max(p) AS highest_probability, count(*) FILTER (WHERE triage = 'confident_suspicious') AS confident_suspicious, count(*) FILTER (WHERE triage = 'confident_clean') AS confident_clean, sum(man)::BIGINT AS manual_reviews, avg(man) AS manual_ratio, avg(uncertainty) AS uncertainty_mean, avg(CASE WHEN ood >= .45 THEN 1.0 ELSE 0 END) AS ood_ratio,
 count(*) FILTER (WHERE images > 0) AS photo_reviews, count(*) FILTER (WHERE reused > 0) AS duplicate_photo_reviews, max(cluster) AS largest_photo_cluster, sum(temporal_flag)::BIGINT AS temporal_reviews, count(*) FILTER (WHERE stock >= .58) AS stock_reviews, count(*) FILTER (WHERE synthetic >= .66) AS synthetic_reviews, count(*) FILTER (WHERE mismatch >= .58) AS mismatch_reviews, sum(ptf)::BIGINT AS photo_text_reviews, avg(temporal_flag) AS temporal_ratio, sum(ai_flag)::BIGINT AS ai_flagged, avg(ai) AS ai_mean,
 max(rsl) AS r_slang, max(ro) AS r_organic, max(rb) AS r_bilingual, max(rt) AS r_template, avg(a) AS sa, max(page_domain) AS page_domain, max(page_confidence) AS page_confidence, avg(manipulation) AS manipulation_mean FROM x GROUP BY 1)"""


@query("v04_page_report", "reviews_v photos_v", REPORT + PAGES + """ SELECT page_id, total_reviews, suspicious_reviews, total_reviews - suspicious_reviews AS clean_reviews, round(suspicious_ratio, 4) AS suspicious_ratio, round(average_probability, 4) AS average_probability, round(highest_probability, 4) AS highest_probability, confident_suspicious, confident_clean, manual_reviews, round(manual_ratio, 4) AS manual_ratio, round((confident_suspicious + confident_clean) / total_reviews::DOUBLE, 4) AS automated_ratio,
 round(uncertainty_mean, 4) AS uncertainty_mean, round(ood_ratio, 4) AS ood_ratio, photo_reviews, duplicate_photo_reviews, round(CASE WHEN photo_reviews > 0 THEN duplicate_photo_reviews / photo_reviews::DOUBLE ELSE 0 END, 4) AS duplicate_photo_ratio, largest_photo_cluster, temporal_reviews, stock_reviews, synthetic_reviews, mismatch_reviews, photo_text_reviews, round(temporal_ratio, 4) AS temporal_ratio, ai_flagged, round(ai_mean, 4) AS ai_mean, round(manipulation_mean, 4) AS manipulation_mean,
 CASE WHEN CASE WHEN suspicious_reviews > 0 THEN highest_probability ELSE average_probability END >= .85 THEN 'high' WHEN CASE WHEN suspicious_reviews > 0 THEN highest_probability ELSE average_probability END >= .55 THEN 'medium' ELSE 'low' END AS risk_level, CASE WHEN photo_reviews = 0 THEN 'none' WHEN duplicate_photo_reviews / photo_reviews::DOUBLE >= .35 OR largest_photo_cluster >= 4 THEN 'high' WHEN duplicate_photo_reviews / photo_reviews::DOUBLE >= .18 OR largest_photo_cluster >= 3 THEN 'medium' ELSE 'low' END AS photo_risk FROM pg""")
def v04(r, links):
    return rounded(reports.page_report(_scored(r, links)).select("page_id", "total_reviews", "suspicious_reviews", "clean_reviews", "suspicious_ratio", "average_probability", "highest_probability", "confident_suspicious", "confident_clean", "manual_reviews", "manual_ratio", "automated_ratio", "uncertainty_mean", "ood_ratio", "photo_reviews", "duplicate_photo_reviews", "duplicate_photo_ratio", "largest_photo_cluster", "temporal_reviews", "stock_reviews", "synthetic_reviews", "mismatch_reviews", "photo_text_reviews", "temporal_ratio", "ai_flagged", "ai_mean", "manipulation_mean", "risk_level", "photo_risk"))


NOTES = Q.kept(*[(cond, text if "||" in text else "'" + text + "'") for cond, text in (
    ("suspicious_reviews = 0", "The model did not flag any extracted reviews as suspicious."), ("suspicious_reviews > 0", "Suspicious reviews are ranked by a calibrated hybrid score that combines the neural text model and manipulation signals."),
    ("manual_reviews > 0", "manual_reviews || ' review(s) were routed to manual review because the model saw uncertainty or out-of-domain patterns.'"), ("duplicate_photo_reviews > 0", "'Customer photo reuse was detected in ' || duplicate_photo_reviews || ' review(s); the largest shared-photo cluster spans ' || largest_photo_cluster || ' reviews.'"),
    ("temporal_reviews > 0", "'Coordinated photo timing was detected in ' || temporal_reviews || ' review(s): the same customer image appeared across different authors inside a 48.0-hour window.'"), ("mismatch_reviews > 0", "'Image-text alignment flagged ' || mismatch_reviews || ' customer photo(s) as visually inconsistent with the review text or inferred product category.'"), ("stock_reviews > 0", "'Stock/marketing photo detection flagged ' || stock_reviews || ' image(s) that look closer to catalog, studio, render, banner, or listing assets than user-taken snapshots.'"),
    ("synthetic_reviews > 0", "'AI/synthetic image detection produced weak auxiliary hints on ' || synthetic_reviews || ' image(s); this signal should support, not replace, human review or stronger fraud evidence.'"), ("photo_text_reviews > 0", "'OCR found promo text, watermark-like text, contact handles, or marketplace branding on ' || photo_text_reviews || ' customer photo(s).'"), ("ai_flagged > 0", "'AI-text detector flagged ' || ai_flagged || ' review(s) with polished, template-like, weakly grounded language; this is a moderation signal, not proof.'"),
    ("ak IS NOT NULL", "'Top suspicious author cluster: ' || ak || ' with ' || nh || ' flagged review(s).'"), ("total_reviews >= 4 AND r_slang >= .25", "The bilingual slang detector found a visible share of hype-heavy comments that look more coordinated than conversational."),
    ("total_reviews >= 4 AND r_slang < .25 AND r_organic >= .25 AND sa >= .58", "Several comments use grounded colloquial language with concrete detail, which slightly weakens the fake-review hypothesis."), ("total_reviews >= 4 AND r_bilingual >= .18", "Russian and English slang are mixed unusually often across the current review sample."),
    ("total_reviews >= 4 AND r_template >= .18", "A repeated slang template appears across multiple reviews, which strengthens the coordination hypothesis."), ("page_domain != 'general' AND page_confidence >= .35", "'Language grounding was calibrated against the inferred ' || page_domain || ' product domain.'"),
)])


@query("v05_highlights", "reviews_v photos_v", REASONED + PAGES + f""", au AS (SELECT page_id, {AUTHOR} AS ak, count(*) FILTER (WHERE manipulation >= .55) AS nh, row_number() OVER (PARTITION BY page_id ORDER BY count(*) FILTER (WHERE manipulation >= .55) DESC, round(avg(manipulation), 6) DESC, count(*) DESC, {AUTHOR}) AS i FROM z WHERE trim(author) != '' GROUP BY page_id, {AUTHOR}),
 an AS (SELECT page_id, string_agg(ak || ':' || nh, '; ' ORDER BY i) AS top_authors FROM au WHERE i <= 5 GROUP BY 1), rc AS (SELECT page_id, reason, count(*) AS n, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, reason) AS i FROM (SELECT page_id, unnest(rs_) AS reason FROM ys) GROUP BY 1, 2), rn AS (SELECT page_id, string_agg(reason || ':' || n, '; ' ORDER BY i) AS top_reasons FROM rc WHERE i <= 4 GROUP BY 1),
 ms AS (SELECT page_id, record_id AS most_suspicious FROM (SELECT page_id, record_id, row_number() OVER (PARTITION BY page_id ORDER BY round(p, 9) DESC, record_id) AS i FROM x) WHERE i = 1)
 SELECT pg.page_id, array_to_string({NOTES}, '; ') AS notes, coalesce(top_reasons, '') AS top_reasons, most_suspicious, coalesce(top_authors, '') AS top_authors FROM pg LEFT JOIN (SELECT page_id, ak, nh FROM au WHERE i = 1) USING (page_id) LEFT JOIN rn USING (page_id) LEFT JOIN an USING (page_id) JOIN ms USING (page_id)""")
def v05(r, links):
    scored = _scored(r, links)
    return reports.page_highlights(scored, reports.page_report(scored))


_WHOLE = "floor(least(greatest(round(({x}) * 100, 9), {lo}), {hi}) + .5)::BIGINT"


@query("d03_overview", "reviews_v photos_v", REPORT + PAGES + f""", ov AS (SELECT *, {_WHOLE.format(x='.5 * suspicious_ratio + .28 * manipulation_mean + .12 * highest_probability + .1 * least(manual_ratio, .35)', lo=12, hi=98)} AS risk_score, CASE WHEN confident_suspicious > 0 THEN confident_suspicious ELSE suspicious_reviews END AS suspicious_count,
 CASE WHEN confident_suspicious + confident_clean = 0 THEN 1 - manual_ratio ELSE (confident_suspicious + confident_clean) / total_reviews::DOUBLE END AS decided FROM pg)
 SELECT page_id, risk_score, {_WHOLE.format(x='.72 * decided + .28 * greatest(0, 1 - uncertainty_mean)', lo=52, hi=97)} AS confidence, {_WHOLE.format(x='.6 * manipulation_mean + .4 * suspicious_ratio', lo=8, hi=96)} AS manipulation_probability, suspicious_count, CASE WHEN risk_score >= 80 THEN 'High fraud risk' WHEN risk_score >= 60 THEN 'Watchlist' ELSE 'Low-risk sample' END AS status,
 CASE WHEN risk_score >= 80 THEN 'The page presents strong evidence of manipulated review behavior with ' || suspicious_count || ' confidently suspicious reviews and ' || manual_reviews || ' items routed to manual review.' WHEN risk_score >= 60 THEN 'The review set shows mixed authenticity patterns and ' || manual_reviews || ' review(s) still need a human decision before the rating profile can be trusted.'
 ELSE 'The visible review sample looks comparatively stable, although normal moderation checks are still recommended.' END AS verdict FROM ov""")
def d03(r, links):
    return reports.dashboard_overview(reports.page_report(_scored(r, links))).select("page_id", "risk_score", "confidence", "manipulation_probability", "suspicious_count", "status", "verdict")


_PAGE_SIGNALS = {"Suspicious review ratio": "suspicious_ratio", "Behavioral manipulation score": "manipulation_mean", "Peak suspicious probability": "highest_probability", "Manual review uncertainty": "manual_ratio", "Duplicate photo signal": "CASE WHEN photo_reviews > 0 THEN duplicate_photo_reviews / photo_reviews::DOUBLE ELSE 0 END",
 "Photo temporal cluster signal": "temporal_ratio", "Image/text mismatch signal": "mismatch_reviews / total_reviews::DOUBLE", "Stock/marketing photo signal": "stock_reviews / total_reviews::DOUBLE", "Synthetic image signal": "synthetic_reviews / total_reviews::DOUBLE", "Photo OCR signal": "photo_text_reviews / total_reviews::DOUBLE",
 "AI-generated text signal": "ai_flagged / total_reviews::DOUBLE", "Language template signal": "CASE WHEN r_template > 0 THEN r_template ELSE r_slang END", "Out-of-domain uncertainty": "ood_ratio"}


@query("d09_fallback_signals", "reviews_v photos_v", REPORT + PAGES + ", sg AS (" + " UNION ALL ".join(f"SELECT page_id, {i} AS i, '{name}' AS signal, round({x}, 9) AS v FROM pg" for i, (name, x) in enumerate(_PAGE_SIGNALS.items())) + f"), sr AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY v DESC, i) AS rank FROM sg WHERE v > 0)"
 + f" SELECT page_id, rank, signal, greatest(1, {_WHOLE.format(x='v', lo=1, hi=100)}) AS n FROM sr WHERE rank <= 12 UNION ALL SELECT page_id, 1, 'Low-risk review profile', total_reviews FROM pg WHERE page_id NOT IN (SELECT page_id FROM sr)")
def d09(r, links):
    return rounded(reports.fallback_signals(reports.page_report(_scored(r, links))))


# --- models ------------------------------------------------------------------------------------------------


@query("k05_anomaly", "ratings_v")
def k05(r):
    features = cut(ratings.rating_features(r))  # each pass of the fit reads it
    columns = [c for c in features.columns if c not in ("record_id", "is_fake")]
    return rounded(models.anomaly_score(models.fit_anomaly(features, columns, normal="is_fake = 0"), features).select("record_id", "anomaly"))


def _labelled(r: DataFrame) -> DataFrame:
    """Labelled reviews in parts without a common source; unlabelled ones are in the part none."""
    rows = r.withColumn("label", F.col("label").cast("int"))
    return evaluation.covering_split(rows.filter("label is not null"), "source", COVER).unionByName(rows.filter("label is null").withColumn("part", F.lit("none")))


def _review_model(r: DataFrame) -> DataFrame:
    rows, names = text_models.review_measures(_labelled(r))
    model = text_models.fit_text_model(rows.filter("part = 'train'"), rows.filter("part = 'validation'"), names)
    return model.probability(rows, "pt").drop(*names)


@query("k06_review_model", "reviews_v")
def k06(r):
    return rounded(_review_model(r).select("record_id", "part", "pt"))


@query("a06_trained_machine_text", "reviews_v")
def a06(r):
    rows, names = text_models.scaled_measures(cut(machine_text.ai_features(_labelled(r)).drop("ai_tok", "title")))  # the fit and the score read it
    model = text_models.fit_text_model(rows.filter("part = 'train'"), rows.filter("part = 'validation'"), names, {"word": 1800})
    return rounded(text_models.machine_score(rows.drop(*names), model, measured=True).select("record_id", "part", "model_probability", "ai"))


@query("k11_combiner", "reviews_v")
def k11(r):
    """Fitted on the calibration part, measured on the test part; neither has met the text model."""
    pt = cut(_review_model(r).select("record_id", "part", "pt", "label"))
    rows = cut(_triage_input(r).drop("pt", "p", "label").join(pt, "record_id"))
    columns = ["pt", "rating_manipulation", "author_risk", "local_score", "slang_manipulation", "slang_authenticity", "template_component", "uniq", "extreme"]
    model = models.fit_combiner(rows.filter("part = 'calibration'"), columns)
    return rounded(models.combiner_metrics(models.combine(model, rows.filter("part = 'test'"))))


@query("r17_detector", "ratings_v")
def r17(r):
    scored, _ = detectors.detect_ratings(r)
    return rounded(scored.select("record_id", "part", "anomaly", "suspicious", F.array_join("reasons", "; ").alias("reasons"), F.array_join("attack_types", ",").alias("attack_types")))


@query("r18_detected_users", "ratings_v")
def r18(r):
    scored, _ = detectors.detect_ratings(r)
    return rounded(detectors.suspicious_users(scored))


@query("v08_connected_report", "reviews_v photos_v")
def v08(r, links):
    scored, _ = detectors.connected_report(r, _evidence(r, links))
    return rounded(scored.select("record_id", "part", "pt", "coverage", "p_text", "p", "triage", "risk", "suspicious", F.array_join("reasons", " ").alias("reasons"), F.array_join("categories", ",").alias("categories")))


from . import source_queries  # noqa: E402,F401  registers more
