"""Machine-written review text: features, score, labels, reasons, repeated openings, page summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustloom.functions import lexicons as L
from trustloom.functions import text as T
from trustloom.sources.tables import cut

TOKEN = r"a-z\x{0400}-\x{04FF}0-9'"  # characters
#: The patterns begin with a look at one character, which most places fail, before the costlier look behind.
NUMBER = r"(?=[0-9])(?<![\p{L}\p{N}_])[0-9]+(?:[.,][0-9]+)?(?![\p{L}\p{N}_])"
UNIT = r"(?=[cmkgdwсмкдн])(?<![\p{L}\p{N}_])(?:cm|mm|kg|gb|mah|days?|weeks?|months?|см|мм|кг|дня|недел)(?![\p{L}\p{N}_])"
BUNDLE = r"(?<![\p{L}\p{N}_])[0-9a-z\x{0400}-\x{04FF}]+(?:/[0-9a-z\x{0400}-\x{04FF}]+){2,}(?![\p{L}\p{N}_])"
MIN_WORDS, HINT, FLAG, STRONG = 12, 0.52, 0.66, 0.76


def title_and_text(df: DataFrame) -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "review_text") if c in df.columns]
    return T.norm_text(F.concat_ws(" ", *parts))


def ai_features(df: DataFrame) -> DataFrame:
    """22 measures of title and text; the density of n hits is n over a ninth of the words, at least 1."""
    whole = title_and_text(df)
    t = F.col("__low")
    count = lambda p: F.regexp_count(t, F.lit(p))
    # each word as one w, which is no other character then
    sentence = lambda s: F.greatest(F.length(s) - F.length(F.replace(s, F.lit("w"), F.lit(""))), F.lit(1))
    sentences = F.transform(F.filter(F.split(F.regexp_replace(t, f"[{TOKEN}]+", "w"), r"[.!?]+"), lambda s: F.trim(s) != ""), sentence)
    rows = df.withColumn("__whole", whole).withColumn("__low", F.lower("__whole")).withColumns({"ai_tok": F.regexp_extract_all(t, F.lit(f"[{TOKEN}]+"), F.lit(0)), "__personal": T.held(t, L.PERSONAL)})
    rows = rows.withColumns({
        "__words": F.filter("ai_tok", lambda x: x.rlike(r"\p{L}")), "__sents": sentences, "__generic": T.held(t, L.GENERIC), "__connector": T.held(t, L.CONNECTORS), "__catalog": T.held(t, L.CATALOG), "__cliche": T.held(t, L.CLICHES),
        "__markers": T.held(t, L.STRUCTURE_MARKERS), "__terms": T.held(t, L.STRUCTURE_TERMS), "__colloquial": T.held(t, L.COLLOQUIAL), "__concrete": F.col("__personal") + count(NUMBER) + count(UNIT),
        "__dash": count("[—–]"), "__bundles": F.when(t.contains("/"), count(BUNDLE)).otherwise(0), "__latin": T.chars_of(t, "a-z"), "__cyr": T.chars_of(t, r"\x{0400}-\x{04FF}"), "__chars": F.greatest(F.length("__whole"), F.lit(1)),
    })
    words, per = F.size("__words"), F.greatest(F.size("__words") / 9, F.lit(1.0))
    c, density = F.col, lambda name: T.clip(F.col(name) / per)
    mean = F.when(F.size("__sents") > 0, F.aggregate("__sents", F.lit(0), lambda a, x: a + x) / F.size("__sents")).otherwise(0.0)
    rows = rows.withColumn("__mean", mean)
    deviation = F.sqrt(F.aggregate("__sents", F.lit(0.0), lambda a, x: a + (x - c("__mean")) * (x - c("__mean"))) / F.greatest(F.size("__sents"), F.lit(1)))
    bigrams = T.ngrams(F.col("__words"), 2)
    polish = c("__generic") + c("__connector") + c("__catalog")
    out = {
        "words": words, "words_log": F.log1p(words), "sentences_log": F.log1p(F.size("__sents")), "sent_mean": T.clip(c("__mean") / 28),
        "cv": F.when(F.size("__sents") > 1, T.clip(deviation / F.greatest(c("__mean"), F.lit(1.0)))).otherwise(0.0), "uniq": F.size(F.array_distinct("__words")) / F.greatest(words, F.lit(1)),
        "generic": density("__generic"), "connector": density("__connector"), "catalog": density("__catalog"), "personal": density("__personal"), "concrete": density("__concrete"), "colloquial": density("__colloquial"),
        "digit": T.clip(12 * T.chars_of(t, r"\p{Nd}") / c("__chars")), "punctuation": T.clip(18 * T.chars_of(t, ",;:") / c("__chars")), "dash": T.clip(c("__dash") / F.greatest(words / 26, F.lit(1.0))), "exclaim": T.clip(4 * count("!") / F.greatest(words, F.lit(1))),
        "balanced": ((c("__generic") > 0).cast("int") + (c("__connector") > 0).cast("int") + (c("__catalog") > 0).cast("int")) / 3, "polish": T.clip(polish / (c("__concrete") + c("__personal") + 1)),
        "repetition": F.when(words < 6, 0.0).otherwise(T.clip((words - 1 - F.size(F.array_distinct(bigrams))) / (words - 1))),
        "mixed": T.clip(4 * F.least("__latin", "__cyr") / F.greatest(c("__latin") + c("__cyr"), F.lit(1))),
        "cliche": T.clip((c("__cliche") + 1.2 * c("__bundles") + ((c("__cliche") >= 2) & (c("__dash") > 0)).cast("int")) / 3), "structure": T.clip((1.4 * c("__markers") + c("__terms")) / 5),
    }
    return rows.withColumns(out).drop(*[x for x in rows.columns if x.startswith("__")])


def ai_heuristic(df: DataFrame) -> Column:
    c = F.col
    return T.clip(
        0.08 + 0.20 * c("generic") + 0.16 * c("catalog") + 0.12 * c("connector") + 0.14 * c("polish") + 0.10 * c("balanced") + 0.09 * c("dash") + 0.16 * c("cliche") + F.when(c("words") >= 24, 0.07 * (1 - c("cv"))).otherwise(0.0)
        + F.when(c("words") >= 18, 0.06 * c("uniq")).otherwise(0.0) + 0.04 * c("mixed") - 0.22 * c("personal") - 0.18 * c("concrete") - 0.12 * c("colloquial") - 0.04 * c("digit")
    )


def ai_score(df: DataFrame, model_probability: Column | None = None) -> DataFrame:
    """The heuristic, blended 0.30 to 0.70 with a model's probability if there is one, then adjusted in a fixed order."""
    return score_features(ai_features(df), model_probability)


def score_features(rows: DataFrame, model_probability: Column | None = None) -> DataFrame:
    """The score of rows that have ai_features already."""
    c = F.col
    base = ai_heuristic(rows)
    rows = rows.withColumn("ai", base if model_probability is None else 0.70 * model_probability + 0.30 * base)
    compact, structured = (c("cliche") >= 0.65) & (c("words") >= 8), c("structure") >= 0.42
    steps = [
        F.when(c("words") < MIN_WORDS, c("ai") * F.greatest(F.when(compact, 0.68).otherwise(0.25), c("words") / MIN_WORDS)),
        F.when((c("personal") >= 0.32) & (c("concrete") >= 0.24), c("ai") * 0.76), F.when((c("colloquial") >= 0.14) & (c("generic") < 0.08), c("ai") * 0.82),
        F.when((c("cliche") >= 0.65) & ~structured, F.greatest(c("ai"), 0.74 + 0.06 * c("dash"))).when(c("cliche") >= 0.35, F.least(c("ai") + 0.08, F.lit(1.0))),
        F.when(structured, c("ai") * F.when(c("structure") >= 0.72, 0.46).otherwise(0.62)),
    ]
    for step in steps:
        rows = rows.withColumn("ai", step.otherwise(c("ai")))
    rows = rows.withColumns({"ai": T.clip(c("ai")), "ai_label_words": F.when(compact, MIN_WORDS).otherwise(c("words"))})
    return rows.withColumns({"ai_label": ai_label(), "ai_flag": ((c("ai") >= FLAG) & (c("ai_label_words") >= MIN_WORDS)).cast("int"), "ai_reasons": ai_reasons()})


def for_openings(scored: DataFrame) -> DataFrame:
    """What opening_boost needs of a score and gives back; measures that no score has are then not computed."""
    return scored.select("page_id", "record_id", "ai_tok", "words", "ai", "ai_label", "ai_flag", "ai_reasons")


def ai_label(words: str = "ai_label_words", flag: float = FLAG, hint: float = HINT) -> Column:
    """Labels; a model's thresholds are clipped to 0.45 to 0.95, the hint to at most 0.08 below."""
    flag = min(max(flag, 0.45), 0.95)
    hint = hint if flag == FLAG and hint == HINT else min(max(min(hint, flag - 0.08), 0.35), flag)
    a, strong = F.col("ai"), max(STRONG, min(0.95, flag + 0.10))
    return F.when(F.col(words) < MIN_WORDS, "insufficient_text").when(a >= strong, "likely_ai_text").when(a >= flag, "ai_text_signal").when(a >= hint, "weak_ai_text_hint").otherwise("human_like_or_low_signal")


def ai_reasons(hint: float = HINT) -> Column:
    c = F.col
    # The sentences.
    found = T.array_of(
        (c("ai") >= hint, "AI-text detector flagged polished/template-like review language; treat this as a moderation signal, not proof."),
        ((c("generic") >= 0.10) | (c("catalog") >= 0.08), "The wording shows AI-like polish: generic balanced phrasing with weak personal usage detail."),
        (c("polish") >= 0.60, "The text is polished but weakly grounded in concrete ownership, delivery, sizing, or usage details."),
        ((c("connector") >= 0.08) & (c("cv") <= 0.35), "Sentence structure is unusually even and uses formal transition phrases."),
        (c("dash") >= 0.35, "The text uses long dash punctuation patterns that are common in polished generated reviews."),
        (c("cliche") >= 0.35, "The review uses compact marketplace cliches about price, delivery, support, or packaging with a synthetic review rhythm."),
    )
    return F.when(c("ai") >= hint, found).otherwise(F.array().cast("array<string>"))


def opening_boost(df: DataFrame) -> DataFrame:
    """The first eight words, if shared on a page, raise scores of 0.40 and more; texts under twelve words have no opening."""
    c = F.col
    rows = df.withColumn("opening", F.when(F.size("ai_tok") >= MIN_WORDS, F.array_join(F.slice("ai_tok", 1, 8), " ")))
    rows = cut(rows.drop("ai_tok"))  # openings are counted beside the rows
    counts = rows.filter("opening is not null").groupBy("page_id", "opening").agg(F.count("*").alias("n_opening"))
    rows = rows.join(counts, ["page_id", "opening"], "left").fillna({"n_opening": 0})
    hit = (c("n_opening") >= 2) & (c("ai") >= 0.40) & (c("words") >= MIN_WORDS)
    rows = rows.withColumn("__hit", hit).withColumn("ai", F.when(c("__hit"), T.clip(c("ai") + F.least(F.lit(0.12), 0.04 * (c("n_opening") - 1)))).otherwise(c("ai")))
    more = F.lit("The wording contains repeated AI-style review openings across the current page.")
    return rows.withColumns({
        "ai_label": F.when(c("__hit"), ai_label("words")).otherwise(c("ai_label")), "ai_flag": F.when(c("__hit"), (c("ai") >= FLAG).cast("int")).otherwise(c("ai_flag")),
        "ai_reasons": F.when(c("__hit"), F.array_append("ai_reasons", more)).otherwise(c("ai_reasons")),
    }).drop("__hit", "opening")


def ai_summary(df: DataFrame, top: int = 5) -> DataFrame:
    """Per page: evaluated and flagged reviews, ratio, mean score, and the most frequent labels."""
    seen = (F.col("words") >= MIN_WORDS) | (F.col("ai_flag") == 1)
    by = df.groupBy("page_id").agg(F.count_if(seen).alias("evaluated"), F.sum("ai_flag").alias("flagged"), F.coalesce(F.avg(F.when(seen, F.col("ai"))), F.lit(0.0)).alias("mean_ai"))
    by = by.withColumn("flagged_ratio", F.when(F.col("evaluated") > 0, F.col("flagged") / F.col("evaluated")).otherwise(0.0))
    labels = df.groupBy("page_id", "ai_label").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("n"), "ai_label"))
    listed = labels.withColumn("rank", rank).filter(F.col("rank") <= top).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "ai_label", "n").alias("x")))), lambda s: s["x"]), ",").alias("top_labels"))
    return by.join(listed, "page_id")


def ai_boost(p: Column, ai: Column, most_of_page: Column) -> Column:
    """p raised by a strong machine-text score, if any review of the page reaches the hint."""
    return F.when(most_of_page >= HINT, T.clip(p + 0.16 * T.clip((ai - 0.50) / 0.50) * (1 - p))).otherwise(p)
