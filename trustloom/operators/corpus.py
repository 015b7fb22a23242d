"""Training corpora, dashboards and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from trustloom.functions import text as T
from trustloom.operators import evaluation, terms
from trustloom.sources.tables import cut


def to_training_rows(df: DataFrame, title: str | None, body: str, rating: str, label: Column, source: str) -> DataFrame:
    parts = [F.nullif(T.norm_text(F.col(c)), F.lit("")) for c in (title, body) if c]
    return df.select(F.concat_ws(". ", *parts).alias("review_text"), F.col(rating).try_cast("double").alias("rating"), label.cast("int").alias("label"), F.lit(source).alias("source"))


def sectioned_text(lines: DataFrame) -> DataFrame:
    """Lines of a file under the last header line above them (`[category]`)."""
    head = F.nullif(F.regexp_extract("value", r"^\[(.+)\]$", 1), F.lit(""))
    w = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("category", F.last(head, ignorenulls=True).over(w)).filter(head.isNull() & (F.trim("value") != ""))


def normalize_label(df: DataFrame, column: str) -> DataFrame:
    """Texts and 1/0 to labels; a column of only -1 and 1 maps -1 (fake) to 1."""
    raw = F.lower(F.trim(F.col(column).cast("string")))
    pair = df.agg(F.coalesce(F.bool_and(raw.isin("-1", "1")), F.lit(False)).alias("__pair"), F.coalesce(F.bool_or(raw == "-1"), F.lit(False)).alias("__minus"))
    label = F.when(F.col("__pair") & F.col("__minus"), F.when(raw == "-1", 1).otherwise(0)).when(raw.isin("fake", "spam", "cg", "true", "yes", "1", "1.0"), 1).when(raw.isin("real", "genuine", "or", "false", "no", "0", "0.0"), 0)
    return df.join(F.broadcast(pair), F.lit(True)).withColumn("label", label).drop("__pair", "__minus")  # one row


def finalize_rows(df: DataFrame) -> DataFrame:
    """Clean text of 15 characters and more, ratings in 0..5, lineage, source group, one holdout group per lineage."""
    t = T.norm_text(F.col("review_text"))
    rows = df.withColumns({"review_text": t, "rating": F.least(F.greatest(F.coalesce(F.col("rating"), F.lit(0.0)), F.lit(0.0)), F.lit(5.0)), "split_group": T.split_group(t), "source_group": T.source_group(F.col("source"))})
    rows = rows.filter(F.length("review_text") >= 15)
    hold = rows.groupBy("split_group").agg(F.min("source_group").alias("holdout_group"))
    return rows.join(hold, "split_group")


def sample_n(df: DataFrame, n: int, seed: str = "0") -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col("record_id").cast("string"))), "record_id").limit(n)


def dedupe_first(df: DataFrame, keys: list[Column]) -> DataFrame:
    """The row of least record_id of each key; its id is found by a map-side minimum before the join."""
    keyed = df.withColumn("__k", F.md5(F.concat_ws("\u0001", *keys)))
    first = keyed.groupBy("__k").agg(F.min("record_id").alias("record_id"))
    return keyed.join(first, ["__k", "record_id"]).drop("__k")


def dedupe_text(df: DataFrame, with_label: bool = False) -> DataFrame:
    t = F.lower(T.norm_text(F.col("review_text")))
    return dedupe_first(df, [t, F.col("label").cast("string")] if with_label else [t])


def dedupe_reviews(df: DataFrame) -> DataFrame:
    return dedupe_first(df, [F.lower(F.col("author")), F.substring(F.lower(T.norm_text(F.col("review_text"))), 1, 240)])


def build_corpus(sources: list[DataFrame]) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


# Styles of suspicious variants and their shares.
STYLES = {"promo_loud": 0.18, "repeat": 0.10, "hard_sell": 0.12, "aggressive_negative": 0.12, "soft_sell": 0.16, "subtle_social_proof": 0.14, "bilingual_hype": 0.10, "subtle_negative": 0.08}


def _place(*parts: Column) -> Column:
    """A place in [0, 1) from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 2.0**32


def variant_text(text: Column, style: Column) -> Column:
    """A clean review turned into a suspicious one: its first words, two words that hint at the product, and its first sentence of five words as a clause."""
    clean = T.norm_text(text)

    def written(tok: Column) -> Column:
        snippet = F.when(F.size(tok) > 0, F.array_join(F.slice(tok, 1, 12), " ")).otherwise("This item")
        long = F.transform(F.slice(F.filter(tok, lambda x: (F.length(x) > 3) & ~x.rlike("^[0-9]+$")), 1, 2), lambda x: F.lower(x))
        hint = F.when(F.size(long) > 0, F.array_join(long, " ")).otherwise("product")
        sentence = F.get(F.filter(F.transform(F.split(clean, "[.!?]+"), lambda x: F.trim(x)), lambda x: F.size(F.split(x, " ")) >= 5), F.lit(0))
        clause = F.regexp_replace(F.coalesce(sentence, snippet), "[.!? ]+$", "")
        clause = F.when(clause == "", "it looks okay").otherwise(F.concat(F.lower(F.substring(clause, 1, 1)), F.substring(clause, 2, 1 << 30)))
        capital = F.concat(F.upper(F.substring(clause, 1, 1)), F.lower(F.substring(clause, 2, 1 << 30)))
        # The texts.
        said = {
            "promo_loud": ["Absolutely amazing!!! ", hint, " is perfect and 100% recommended!!! ", snippet, " Buy now buy now buy now!!!"], "repeat": ["Best purchase ever!!! ", snippet, " ", snippet, " Five stars five stars five stars!!!"],
            "hard_sell": ["Perfect product 100% recommended!!! Trust me and order this ", hint, " immediately!!! No more details needed, just buy now!!!"], "aggressive_negative": ["Worst scam ever!!! Avoid this ", hint, " immediately!!! ", snippet, " Terrible terrible terrible, do not hesitate to skip it!!!"],
            "soft_sell": ["I used this ", hint, " briefly and ", clause, ". It honestly feels like one of the safer buys here and I would buy the same one again."], "subtle_social_proof": [capital, ". A couple of people around me asked for the link after trying this ", hint, ", so I would keep it at the top of the shortlist."],
            "bilingual_hype": [capital, ". Ngl this ", hint, " is topchik, worth it fr, just grab it and move on."], "subtle_negative": ["I wanted to like this ", hint, " and ", clause, ", but something still feels off overall, so I would honestly avoid it."],
        }
        return F.coalesce(*[F.when(style == k, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])) for k, parts in said.items()])

    return F.get(F.transform(F.array(F.regexp_extract_all(clean, F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0))), written), F.lit(0))


def augment(df: DataFrame, target: int, seed: str = "0") -> DataFrame:
    """target suspicious variants of the clean rows: each row gives target / rows of them, the first by salted digest one more.

    Style and rating come from digests of row and copy, so reruns agree. Lineage is the row's own: split_group, and holdout_group if it is there. No clean rows, no variants.
    """
    ranked = evaluation.stratified_rank(df.filter("label = 0"), seed)
    each = F.floor(F.lit(target) / F.col("__all")) + (F.col("__rank") < F.lit(target) % F.col("__all")).cast("long")
    rows = ranked.withColumn("copy", F.explode(F.when(each > 0, F.sequence(F.lit(1).cast("long"), each)))).drop("__rank", "__all")
    u, at, style = _place(F.lit(seed), F.lit("style"), F.col("record_id"), F.col("copy")), 0.0, None
    for name, share in STYLES.items():
        at += share
        style = F.when(u < round(at, 2), name) if style is None else style.when(u < round(at, 2), name)
    rows = rows.withColumn("style", style)
    low = _place(F.lit(seed), F.lit("rating"), F.col("record_id"), F.col("copy")) < 0.25
    group = F.coalesce(F.nullif(F.col("split_group"), F.lit("")), T.split_group(F.col("review_text"))) if "split_group" in df.columns else T.split_group(F.col("review_text"))
    return rows.withColumns({
        "split_group": group, "review_text": variant_text(F.col("review_text"), F.col("style")), "rating": F.when((F.col("style") == "subtle_negative") | low, 1.0).otherwise(5.0),
        "label": F.lit(1), "source": F.lit("synthetic_suspicious_augmented"),
    })


def _one_of_each(df: DataFrame, with_label: bool = False) -> DataFrame:
    """Of equal texts the row that comes first by record_id, origin and copy."""
    keys = [F.lower(T.norm_text(F.col("review_text")))] + [F.col("label").cast("string")] * with_label
    first = F.min_by(F.struct(*df.columns), F.struct("record_id", "origin", "copy")).alias("__r")
    return df.groupBy(F.md5(F.concat_ws("\u0001", *keys)).alias("__k")).agg(first).select("__r.*")


def balanced_corpus(sources: DataFrame, templates: DataFrame | None = None, ratio: float = 1.0, seed: str = "0") -> DataFrame:
    """Sources with labels filled up: clean templates as hard negatives, then suspicious rows, made from clean ones and templates, up to a target.

    Hard negatives: 15 % of the clean rows, 250 at least, as far as templates go. Suspicious target: ratio times the clean rows, not below
    the labelled suspicious ones nor the smaller of 1,500 and the clean rows. Clean rows are told apart by their text, all at the end by text and label.
    Columns: those of sources (record_id, review_text, rating, label, source among them), split_group, origin, copy, style.
    """
    more = {"origin": F.lit("source"), "copy": F.lit(0).cast("long"), "style": F.lit(None).cast("string"), "split_group": T.split_group(F.col("review_text"))}
    rows = sources.filter("label is not null").withColumns(more)
    clean, suspicious = _one_of_each(rows.filter("label = 0")), _one_of_each(rows.filter("label = 1"))
    n_clean = clean.count()
    if templates is not None:
        made = templates.withColumns(more | {"origin": F.lit("template")})
        negatives = max(250, int(n_clean * 0.15)) if n_clean else 500
        clean = _one_of_each(clean.unionByName(balance_classes(made.filter("label = 0"), negatives, f"{seed}-negatives"), allowMissingColumns=True))
        n_clean = clean.count()
    n_suspicious = suspicious.count()
    need = max(int(n_clean * ratio), n_suspicious, min(1500, n_clean)) - n_suspicious
    if need:
        synthetic = augment(clean, need, seed).withColumn("origin", F.lit("augmented"))
        if templates is not None:
            synthetic = synthetic.unionByName(made.filter("label = 1"), allowMissingColumns=True)
            synthetic = balance_classes(synthetic.withColumn("__id", F.col("record_id")).withColumn("record_id", F.concat_ws("-", "origin", "__id", "copy")), need, f"{seed}-suspicious").withColumn("record_id", F.col("__id")).drop("__id")
        suspicious = suspicious.unionByName(synthetic, allowMissingColumns=True)
    return _one_of_each(clean.unionByName(suspicious, allowMissingColumns=True), with_label=True)


def corpus_report(df: DataFrame) -> DataFrame:
    """Totals and distributions over label, source group and language in one pass."""
    rows = df.withColumn("label", F.col("label").cast("string"))
    dims = ["label", "source_group", "language"]
    by = rows.groupingSets([[], *[[F.col(d)] for d in dims]], *[F.col(d) for d in dims]).agg(F.count("*").alias("n"), F.count_distinct("split_group").alias("lineages"), *[F.grouping(d).alias(f"__{d}") for d in dims])
    name = F.coalesce(*[F.when(F.col(f"__{d}") == 0, F.lit(d)) for d in dims], F.lit("total"))
    value = F.coalesce(*[F.when(F.col(f"__{d}") == 0, F.coalesce(F.col(d), F.lit("?"))) for d in dims], F.lit("all"))
    return by.select(name.alias("dimension"), value.alias("value"), "n", "lineages")


def grams(tok: Column, most: int = 1) -> Column:
    """Word n-grams of 1 to most words, from a column of tokens (a computed one would be computed for each gram)."""
    return F.concat(tok, *[T.ngrams(tok, n) for n in range(2, most + 1)])


def char_grams(c: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams inside words, each word between two spaces; of a shorter word the whole."""
    words = F.transform(T.tokens(c), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    cut_ = lambda w, n: F.when(F.length(w) <= n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n)))
    some = lambda word, n: F.flatten(F.transform(F.filter(word, lambda w: F.lit(n == least) | (F.length(w) >= n)), lambda w: cut_(w, n)))
    return T.once(words, lambda word: F.concat(*[some(word, n) for n in range(least, most + 1)]))


def tfidf(df: DataFrame, min_docs: int = 2, max_share: float = 0.9, top: int = 2000, terms: Column | None = None) -> DataFrame:
    """Sublinear tf, smoothed idf, L2 norm per record, over the most frequent terms within document-frequency limits; terms: words and word pairs by default."""
    df = T.dealt(df)
    rows = df.select("record_id", (T.tokens(F.col("review_text")) if terms is None else terms).alias("__g"))
    rows = rows.select("record_id", grams(F.col("__g"), 2).alias("__g")) if terms is None else rows
    tf = T.exploded(rows, F.col("__g"), "term", ["record_id"]).groupBy("record_id", "term").agg(F.count("*").alias("tf"))
    n = df.agg(F.count("*").alias("n_docs"))
    kept = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).join(F.broadcast(n), F.lit(True))  # one row
    kept = kept.filter((F.col("df") >= min_docs) & (F.col("df") <= max_share * F.col("n_docs"))).orderBy(F.desc("total"), "term").limit(top)
    w = (1 + F.log(F.col("tf"))) * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)
    rows = tf.join(F.broadcast(kept), "term").select("record_id", "term", w.alias("w"))  # at most top rows
    norm = rows.groupBy("record_id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    return rows.join(norm, "record_id").select("record_id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def char_tfidf(df: DataFrame, min_docs: int = 2, max_share: float = 0.9, top: int = 1000) -> DataFrame:
    """tfidf of char_grams, without a row for each n-gram of each text: batches of records are counted (terms), and only chosen terms become rows."""
    n, most = df.groupBy("record_id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    rows = df if (most or 1) == 1 else df.groupBy("record_id").agg(F.concat_ws(" ", F.collect_list("review_text")).alias("review_text"))
    found = terms.counts(rows, ["char"]).filter((F.col("df") >= min_docs) & (F.col("df") <= max_share * (n or 0)))
    kept = found.orderBy(F.desc("total"), "term").limit(top).select("kind", "term", (F.log((1 + F.lit(n or 0)) / (1 + F.col("df"))) + 1).alias("idf"))
    vocabulary = cut(terms.placed(kept))  # which a pass gets as rows, and which names the terms

    def flat(batch: pa.RecordBatch, row: np.ndarray, place: np.ndarray, w: np.ndarray, *_: np.ndarray) -> dict[str, pa.Array]:
        return {"record_id": batch.column("record_id").take(pa.array(row)), "place": pa.array(place, pa.int32()), "weight": pa.array(w)}

    schema = StructType([rows.schema["record_id"], StructField("place", IntegerType()), StructField("weight", DoubleType())])
    weights = terms.weighted(rows, vocabulary, {"record_id": F.col("record_id")}, flat, schema)
    return weights.join(F.broadcast(vocabulary.select("place", "term")), "place").select("record_id", "term", "weight")  # at most top rows


def wide_profile_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """A sentence on the three highest and two lowest columns of a wide score table, and the mean of what isn't zero; the first column wins a tie."""
    scores = F.array(*[F.struct(F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias("v"), F.lit(-i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(columns)])
    rows = df.withColumn("__s", F.reverse(F.array_sort(scores)))
    top = F.transform(F.filter(F.slice("__s", 1, 3), lambda x: x["v"] > 0), lambda x: x["name"])
    low = F.transform(F.filter(F.slice("__s", len(columns) - 1, 2), lambda x: x["v"] >= 0), lambda x: x["name"])
    some = F.filter("__s", lambda x: x["v"] != 0)
    mean = F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x["v"]) / F.size(some)).otherwise(0.0)
    join = lambda names, none: F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(none)
    text = F.concat(F.lit("This traveler usually gives higher ratings to "), join(top, "several travel categories"), F.lit(", while "), join(low, "a few other categories"), F.lit(" receive lower scores. The preference pattern looks detailed and organic."))
    return rows.withColumns({"review_text": text, "rating": mean}).drop("__s")


def balance_classes(df: DataFrame, target: int, seed: str = "0") -> DataFrame:
    """At most target rows of each label, the first by a salted digest; ranks come from digest ranges, not from one task a label."""
    ranked = evaluation.stratified_rank(df, seed)
    return ranked.filter(F.col("__rank") < target).drop("__rank", "__all")


def activity_series(df: DataFrame) -> DataFrame:
    """Reviews per day of each page from its first to its last day, zero-filled."""
    day = df.groupBy("page_id", F.col("review_date").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("rating") <= 2).alias("low"))
    ends = day.groupBy("page_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = ends.select("page_id", F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(day, ["page_id", "day"], "left").fillna({"n": 0, "low": 0})


def adaptive_series(df: DataFrame, when: str = "ts", suspicious: Column | None = None) -> DataFrame:
    """Per page its reviews by hour, day, week (from Monday) or month, as the page's span asks for, zero-filled from first to last.

    The unit is hour for at most 36 hours and more than one review, day for at most 62 days, week for at most 370, else month. Reviews without a
    time are left out; a page with none dated has one row of unit undated. A review is suspicious if the given condition holds.
    """
    c = F.col
    bad = suspicious if suspicious is not None else F.lit(False)
    rows = df.select("page_id", c(when).cast("timestamp").alias("t"), F.coalesce(bad, F.lit(False)).cast("long").alias("bad"))
    span = rows.groupBy("page_id").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("t").alias("dated"), F.count("*").alias("n_all"), F.sum("bad").alias("bad_all"))
    seconds = (F.unix_micros("b") - F.unix_micros("a")) / 1e6
    unit = F.when(c("dated") == 0, "undated").when((seconds <= 36 * 3600) & (c("dated") > 1), "hour").when(seconds <= 62 * 86400, "day").when(seconds <= 370 * 86400, "week").otherwise("month")
    span = span.withColumn("unit", unit)
    units = ("hour", "day", "week", "month")
    start = lambda t: F.coalesce(*[F.when(c("unit") == u, F.date_trunc(u, t)) for u in units])
    by = rows.filter("t is not null").join(span.select("page_id", "unit"), "page_id").groupBy("page_id", start(c("t")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("bad").alias("suspicious"))
    steps = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}
    places = F.coalesce(*[F.when(c("unit") == u, F.sequence(F.date_trunc(u, c("a")), F.date_trunc(u, c("b")), F.expr(step))) for u, step in steps.items()])
    spine = span.select("page_id", "unit", "n_all", "bad_all", F.explode_outer(places).alias("bucket"))
    out = spine.join(by, ["page_id", "bucket"], "left")
    whole = lambda name, other: F.when(c("unit") == "undated", c(other)).otherwise(F.coalesce(c(name), F.lit(0).cast("long"))).alias(name)
    return out.select("page_id", "unit", "bucket", whole("n", "n_all"), whole("suspicious", "bad_all"))


def timeline_summary(series: DataFrame) -> DataFrame:
    return series.groupBy("page_id").agg(F.sum("n").alias("total"), F.max("n").alias("peak"), F.max_by("day", F.struct("n", -F.unix_date("day"))).alias("peak_day"), F.coalesce(F.try_divide(F.sum("low"), F.sum("n")), F.lit(0.0)).alias("low_share"))


def reason_counts(df: DataFrame, column: str = "reasons", top: int = 12) -> DataFrame:
    by = df.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(top)
    total = df.agg(F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("total"))
    return by.join(F.broadcast(total), F.lit(True)).withColumn("share", F.col("n") / F.col("total")).drop("total")  # one row


def trust_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy("triage").agg(F.count("*").alias("n"))


def top_reviews(df: DataFrame, score: str, top: int = 12) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc(F.round(score, 6)), "record_id"))
    sev = F.when(F.col(score) >= 0.72, "high").when(F.col(score) >= 0.48, "medium").otherwise("low")
    return df.withColumns({"rank": rank, "severity": sev}).filter(F.col("rank") <= top)


def merge_reviews(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per review of two collections: longest text, first other fields, all photos."""
    rows = a.withColumn("__src", F.lit(0)).unionByName(b.withColumn("__src", F.lit(1)))
    t = F.lower(T.norm_text(F.col("review_text")))
    key = F.when(F.length(t) >= 30, t).otherwise(F.concat_ws("\u0001", F.lower("author"), "review_date", F.round("rating", 1).cast("string"), t))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct("__src", "record_id"))).alias(c)
    return rows.groupBy(F.md5(key).alias("merge_key")).agg(F.count("*").alias("n_merged"), F.min("record_id").alias("record_id"), F.max_by("review_text", F.struct(F.length("review_text"), -F.col("record_id"))).alias("review_text"), first("author"), first("rating"))


def filter_reviews(df: DataFrame, severity: str = "all", language: str = "all", triage: str = "all", query: str = "", sort: str = "score") -> DataFrame:
    """The moderation list: rows of a severity, language and triage whose text, title, author or reasons hold the query, in order."""
    wanted = [F.col(c) == v for c, v in (("severity", severity), ("language", language), ("triage", triage)) if v != "all"]
    text = F.lower(F.concat_ws(" ", *[c for c in ("title", "review_text", "reason", "author", "triage") if c in df.columns]))
    for cond in [*wanted, text.contains(query.strip().lower())]:
        df = df.filter(cond)
    order = {"score": F.desc("score"), "date": F.desc("review_date"), "rating": F.desc("rating")}[sort]
    return df.orderBy(order, "record_id")


def anomaly_profile(counts: DataFrame) -> DataFrame:
    """Of groups with counts n: the dominant share, signals per group, groups near the largest, mean intensity; whole percents."""
    most = counts.agg(F.greatest(F.max("n"), F.lit(1)).alias("__most"))
    rows = counts.join(F.broadcast(most), F.lit(True))  # one row
    half_up = lambda c: F.floor(c + 0.5).cast("long")
    total, groups = F.coalesce(F.sum("n"), F.lit(0)), F.greatest(F.count("*"), F.lit(1))
    return rows.agg(
        half_up(F.coalesce(F.max("n"), F.lit(0)) / F.greatest(total, F.lit(1)) * 100).alias("dominant_share"), half_up(total / groups).alias("signal_density"), F.count_if(F.col("n") >= F.col("__most") * 0.55).alias("hot_groups"),
        half_up(F.coalesce(F.sum(F.col("n") / F.col("__most")), F.lit(0.0)) / groups * 100).alias("average_intensity"),
    )
