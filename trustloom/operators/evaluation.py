"""Metrics, calibration, thresholds, splits and triage tuning as aggregates and grid joins."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustloom.functions import lexicons as L
from trustloom.functions import text as T


def _confusion(pred: Column) -> list[Column]:
    y = F.col("label") == 1
    return [F.count_if(y & pred).alias("tp"), F.count_if(~y & pred).alias("fp"), F.count_if(y & ~pred).alias("fn"), F.count_if(~y & ~pred).alias("tn")]


def _rates(df: DataFrame) -> DataFrame:
    c = F.col
    p = F.coalesce(F.try_divide(c("tp"), c("tp") + c("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(c("tp"), c("tp") + c("fn")), F.lit(0.0))
    return df.withColumns({"accuracy": F.coalesce(F.try_divide(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn")), F.lit(0.0)), "precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))})


def classification_metrics(df: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    return _rates(df.groupBy(*(by or [])).agg(*_confusion(F.col("p") >= threshold)))


def _below(by: DataFrame, sums: list[str], ranges: int = 1024) -> DataFrame:
    """by with __below_x, the sum of x over the rows of smaller p: prefix sums by ranges of p, then inside each range."""
    at = F.floor(F.col("p") * ranges)
    rows = by.withColumn("__r", at)
    parts = rows.groupBy("__r").agg(*[F.sum(c).alias(f"__s_{c}") for c in sums])
    w = W.partitionBy(F.lit(0)).orderBy("__r")  # at most as many rows as ranges
    before = parts.select("__r", *[(F.sum(f"__s_{c}").over(w) - F.col(f"__s_{c}")).alias(f"__b_{c}") for c in sums])
    inner = W.partitionBy("__r").orderBy("p")
    rows = rows.withColumns({f"__i_{c}": F.sum(c).over(inner) - F.col(c) for c in sums}).join(before, "__r")
    return rows.select(*by.columns, *[(F.col(f"__b_{c}") + F.col(f"__i_{c}")).alias(f"__below_{c}") for c in sums])


def ranking_metrics(df: DataFrame) -> DataFrame:
    """ROC-AUC by mean ranks of tied scores, average precision by distinct score. Distinct scores are counted first, and summed by ranges of p in [0, 1]."""
    by = df.groupBy("p").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    totals = by.agg(F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg"))
    rows = _below(by, ["pos", "neg"]).join(F.broadcast(totals), F.lit(True))  # one row
    tp, fp = F.col("__pos") - F.col("__below_pos"), F.col("__neg") - F.col("__below_neg")
    auc = F.sum(F.col("pos") * (F.col("__below_neg") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))
    ap = F.sum(F.col("pos") * tp / (tp + fp)) / F.sum("pos")
    return rows.agg(auc.alias("roc_auc"), ap.alias("average_precision"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """One row per bin, empty ones too."""
    spine = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    by = df.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("label").cast("double")).alias("rate"))
    return spine.join(by, "bin", "left").fillna({"n": 0, "mean_p": 0.0, "rate": 0.0})


def calibration_error(df: DataFrame) -> DataFrame:
    bins = calibration(df)
    ece = bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))
    return ece.join(df.agg(F.avg((F.col("p") - F.col("label")) ** 2).alias("brier")), F.lit(True))


def _grid(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion counts at each threshold: scores are counted once per distinct value before they meet the grid."""
    by = df.groupBy("p").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    rows = by.withColumn("t", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    hit = F.col("p") >= F.col("t")
    s = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    return _rates(rows.groupBy("t").agg(s("pos", hit).alias("tp"), s("neg", hit).alias("fp"), s("pos", ~hit).alias("fn"), s("neg", ~hit).alias("tn")))


def threshold_profile(df: DataFrame) -> DataFrame:
    return _grid(df, [0.3, 0.4, 0.5, 0.6, 0.7, 0.8])


def select_threshold(df: DataFrame) -> DataFrame:
    """F1-maximizing of 26 fixed steps from 0.3 to 0.8; the lowest wins a tie."""
    rows = _grid(df, [round(0.3 + 0.02 * i, 2) for i in range(26)])
    return rows.agg(F.max(F.struct(F.round("f1", 9).alias("f1"), (-F.col("t")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def select_threshold_capped(df: DataFrame, cap: float = 0.02) -> DataFrame:
    """39 steps from 0.52 to 0.90; false-positive rate at most cap; the largest F1 + .08 recall - .20 t."""
    rows = _grid(df, [round(0.52 + 0.01 * i, 2) for i in range(39)]).filter(F.coalesce(F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), F.lit(0.0)) <= cap)
    score = F.round(F.col("f1") + 0.08 * F.col("recall") - 0.20 * F.col("t"), 9)
    return rows.agg(F.max(F.struct(score.alias("s"), (-F.col("t")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.s").alias("selection_score"))


QUANTILE_RANGES, QUANTILE_ROWS = 1024, 100_000


def exact_quantiles(df: DataFrame, column: str, shares: list[float], ranges: int = QUANTILE_RANGES, small: int = QUANTILE_ROWS) -> list[float] | None:
    """Exact quantiles with linear interpolation; None without values.

    Values are counted by ranges, and only ranges that hold a wanted rank are counted again, all in one pass a round, until each is small or
    one value; only those are sorted, each range in its own task. What is collected are counts, at most ranges a wanted rank.
    """
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    n, lo, hi = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    places = [(n - 1) * q for q in shares]
    wanted = sorted({int(h) for h in places} | {min(int(h) + 1, n - 1) for h in places})
    held = [(lo, hi, 0, n)]
    inside = lambda: F.coalesce(*[F.when(F.col("x").between(a, b), F.lit(i)) for i, (a, b, _, _) in enumerate(held)])
    while any(k > small and a < b for a, b, _, k in held):
        edges = F.element_at(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit((b - a) / ranges or 1.0).alias("w")) for a, b, _, _ in held]), F.col("i") + 1)
        parts = rows.withColumn("i", inside()).filter("i IS NOT NULL").withColumn("e", edges)
        part = F.least(F.floor((F.col("x") - F.col("e.lo")) / F.col("e.w")), F.lit(ranges - 1))
        counts = sorted(parts.groupBy("i", part.alias("part")).agg(F.count("*").alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), key=lambda r: (r["i"], r["part"]))
        new, below = [], {i: h[2] for i, h in enumerate(held)}
        for r in counts:
            at = below[r["i"]]
            below[r["i"]] += r["k"]
            if any(at <= w < at + r["k"] for w in wanted):
                new.append((r["lo"], r["hi"], at, r["k"]))
        if new == held:
            break
        held = new
    ranks = [(i, w - below + 1, w) for i, (_, _, below, k) in enumerate(held) for w in wanted if below <= w < below + k]
    kept = rows.withColumn("i", inside()).filter("i IS NOT NULL")
    at = F.row_number().over(W.partitionBy("i").orderBy("x"))
    some = {(r["i"], r["r"]): r["x"] for r in kept.withColumn("r", at).filter(F.struct("i", "r").isin(*[F.struct(F.lit(i), F.lit(r)) for i, r, _ in ranks])).collect()}
    value = {w: some[i, r] for i, r, w in ranks}
    return [value[int(h)] + (value[min(int(h) + 1, n - 1)] - value[int(h)]) * (h - int(h)) for h in places]


def select_threshold_by_quantiles(df: DataFrame, steps: int = 30, first: float = 0.7, last: float = 0.995) -> DataFrame:
    """F1-maximizing of the exact quantiles of p; the lowest wins a tie."""
    grid = exact_quantiles(df, "p", [first + (last - first) * i / (steps - 1) for i in range(steps)])
    if grid is None:
        return df.sparkSession.createDataFrame([], "threshold double, f1 double")
    rows = _grid(df, sorted(set(grid)))
    return rows.agg(F.max(F.struct(F.round("f1", 9).alias("f1"), (-F.col("t")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def holdout_metrics(df: DataFrame, threshold: float = 0.66) -> DataFrame:
    """Of clean rows: number, false-positive rate, mean, exact 95th and 99th percentile, maximum."""
    clean = df.filter("label = 0")
    p95, p99 = exact_quantiles(clean, "p", [0.95, 0.99]) or (None, None)
    return clean.agg(F.count("*").alias("n"), F.avg((F.col("p") >= threshold).cast("double")).alias("fpr"), F.avg("p").alias("mean"), F.lit(p95).cast("double").alias("p95"), F.lit(p99).cast("double").alias("p99"), F.max("p").alias("max"))


def slice_metrics(df: DataFrame, dims: list[str], threshold: float = 0.5) -> DataFrame:
    """Metrics by each dimension alone, in one pass of grouping sets."""
    sets = [[F.col(d)] for d in dims]
    by = df.groupingSets(sets, *[F.col(d) for d in dims]).agg(*_confusion(F.col("p") >= threshold), *[F.grouping(d).alias(f"__{d}") for d in dims])
    name = F.coalesce(*[F.when(F.col(f"__{d}") == 0, F.lit(d)) for d in dims])
    value = F.coalesce(*[F.when(F.col(f"__{d}") == 0, F.col(d).cast("string")) for d in dims])
    return _rates(by.select(name.alias("dimension"), value.alias("value"), "tp", "fp", "fn", "tn"))


def error_examples(df: DataFrame, n: int = 5, threshold: float = 0.5) -> DataFrame:
    kind = F.when((F.col("label") == 0) & (F.col("p") >= threshold), "fp").when((F.col("label") == 1) & (F.col("p") < threshold), "fn")
    far = F.when(F.col("kind") == "fp", -F.col("p")).otherwise(F.col("p"))
    rows = df.withColumn("kind", kind).filter("kind is not null")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy(far, "record_id"))).filter(F.col("rank") <= n)


def minmax(df: DataFrame, column: str = "p") -> DataFrame:
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    out = df.join(F.broadcast(ends), F.lit(True))  # one row
    return out.withColumn("scaled", F.coalesce(F.try_divide(F.col(column) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))).drop("__lo", "__hi")


def group_split(df: DataFrame, group: str, fractions: dict[str, float], salt: str = "0") -> DataFrame:
    """Parts by the salted md5 of the group: a group is never in two parts, and no rank over all groups is needed."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(group))), 1, 8), 16, 10).cast("double") / 2.0**32
    part, at = None, 0.0
    for name, f in fractions.items():
        at += f
        part = F.when(u < at, name) if part is None else part.when(u < at, name)
    return df.withColumn("part", part.otherwise([*fractions][-1]))


TRIES = 24


def _share_of(group: Column, salt: str) -> Column:
    """A place in [0, 1) from the salted md5 of a group."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}-"), group)), 1, 8), 16, 10).cast("double") / 2.0**32


def covering_split(df: DataFrame, group: str, fractions: dict[str, float], salt: str = "0", tries: int = TRIES) -> DataFrame:
    """df with part: train and the parts of fractions, which count groups; no group is in two parts, and each part has both labels.

    Parts are split off one by one. For each the salts are tried in order until both it and the rest have both labels; a try is a few
    aggregates over one row a group, so all tries of a part are one pass. An error tells that none of them does.
    """
    groups = df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g")).agg(*[F.max((F.col("label") == y).cast("int")).alias(f"y{y}") for y in (0, 1)])
    left, free, part = groups, 1.0, None
    for name, fraction in fractions.items():
        u = {t: _share_of(F.col("g"), f"{salt}-{name}-{t}") < fraction / free for t in range(tries)}
        has = [F.max(F.when(cond, F.col(y))).alias(f"{side}{y}{t}") for t, hit in u.items() for side, cond in (("in", hit), ("out", ~hit)) for y in ("y0", "y1")]
        seen = left.agg(*has).first()
        chosen = next((t for t in range(tries) if all(seen[f"{side}{y}{t}"] == 1 for side in ("in", "out") for y in ("y0", "y1"))), None)
        if chosen is None:
            raise ValueError(f"no {name} split has both labels on both sides; more groups or a smaller part are needed")
        left, free = left.filter(~u[chosen]), free - fraction
        mine = _share_of(F.coalesce(F.col(group).cast("string"), F.lit("")), f"{salt}-{name}-{chosen}") < fraction / (free + fraction)
        part = F.when(mine, name) if part is None else part.when(mine, name)
    return df.withColumn("part", part.otherwise("train"))


def assert_disjoint(parts: DataFrame, keys: list[str]) -> None:
    """An error where a value of one of the keys is in two parts."""
    for key in keys:
        n = leaks(parts.filter(F.col(key).isNotNull()), key).count()
        if n:
            raise ValueError(f"{n} values of {key} are in more than one part")


def leaks(parts: DataFrame, key: str) -> DataFrame:
    return parts.groupBy(key).agg(F.count_distinct("part").alias("parts")).filter("parts > 1")


def stratified_rank(df: DataFrame, salt: str = "0", ranges: int = 4096) -> DataFrame:
    """df with __rank from 0 in the order of the salted md5 inside each label, and __all, the label's rows: prefix sums of counts by digest range, so no label is one task."""
    digest = F.md5(F.concat(F.lit(salt), F.col("record_id").cast("string")))
    rows = df.withColumn("__d", digest).withColumn("__r", F.floor(F.conv(F.substring("__d", 1, 8), 16, 10).cast("long") * ranges / 2**32))
    sums = rows.groupBy("label", "__r").agg(F.count("*").alias("__n"))
    w = W.partitionBy("label")
    before = sums.select(F.col("label").alias("__l"), F.col("__r").alias("__q"), (F.sum("__n").over(w.orderBy("__r")) - F.col("__n")).alias("__before"), F.sum("__n").over(w).alias("__all"))
    inner = F.row_number().over(W.partitionBy("label", "__r").orderBy("__d")) - 1
    ranked = rows.withColumn("__in", inner).join(before, F.col("label").eqNullSafe(F.col("__l")) & (F.col("__r") == F.col("__q")))
    return ranked.withColumn("__rank", F.col("__before") + F.col("__in")).drop("__d", "__r", "__l", "__q", "__before", "__in")


def stratified_split(df: DataFrame, test_share: float = 0.2, salt: str = "0") -> DataFrame:
    """The first test_share of each label in the order of the salted md5."""
    ranked = stratified_rank(df, salt)
    share = F.col("__rank") / F.greatest(F.col("__all") - 1, F.lit(1))
    return ranked.withColumn("part", F.when(share < test_share, "test").otherwise("train")).drop("__rank", "__all")


def recommendations(df: DataFrame, manual_ratio: float = 0.0) -> DataFrame:
    """Advice by rule from precision, recall, calibration error and the share of manual reviews."""
    c = F.col
    rows = classification_metrics(df).join(calibration_error(df), F.lit(True))  # one row each
    # The sentences.
    found = T.array_of(
        (c("precision") < 0.75, "Increase clean-review diversity or raise the production threshold to reduce false positives."),
        (c("recall") < 0.75, "Add more confirmed manipulation examples and lower the review threshold for investigative mode."),
        (c("ece") > 0.10, "Recalibrate probabilities with a larger validation split or isotonic/Platt calibration."),
        (F.lit(manual_ratio > 0.35), "The abstention band is broad; tighten manual-review thresholds after reviewing false positives."),
    )
    none = F.array(F.lit("Current metrics are stable; next improvement should focus on more real marketplace data."))
    return rows.select(F.when(F.size(found) == 0, none).otherwise(found).alias("recommendations"))


def combine_simple(pt: Column, rating: Column) -> Column:
    return T.clip(0.62 * pt + 0.38 * rating)


def photo_boost(p: Column, signals: dict[str, Column]) -> Column:
    weights = {"reuse": 0.30, "temporal": 0.24, "mismatch": 0.22, "stock": 0.13, "synthetic": 0.05, "text": 0.06}
    s = sum((weights[k] * c for k, c in signals.items()), F.lit(0.0))
    return T.clip(p + 0.22 * s * (1 - p))


def uncertainty(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Out-of-domain score, uncertainty and confidence from p, pt, rating_manipulation, local_score, coverage, n_words and the slang profile."""
    c = F.col
    margin, gap = F.abs(c("p") - threshold), F.abs(c("pt") - c("p"))
    flag = lambda cond: cond.cast("int")
    novelty = T.clip(
        0.45 * flag((c("n_hits") > 0) & (c("learned_suspicious") + c("learned_authentic") == 0)) + 0.30 * flag((c("market_pack") == "generic") & (c("mix") == 1))
        + 0.25 * flag((c("domain") == "general") & (c("n_hits") > 0) & (c("grounding") < 0.22))
    )
    rows = df.withColumn("novelty", novelty)
    ood = T.clip(0.48 * T.clip((0.62 - c("coverage")) / 0.62) + 0.22 * T.clip((8 - c("n_words")) / 8) + 0.30 * c("novelty"))
    evidence = F.greatest(2 * F.abs(c("pt") - 0.5), 2 * F.abs(c("p") - 0.5), c("local_score"), c("slang_authenticity"), c("slang_manipulation"))
    rows = rows.withColumns({"ood": ood, "weak_evidence": T.clip((0.72 - evidence) / 0.72)})
    unc = T.clip(0.44 * T.clip((0.20 - margin) / 0.20) + 0.18 * T.clip(gap / 0.45) + 0.16 * T.clip(F.abs(c("pt") - c("rating_manipulation")) / 0.65) + 0.12 * c("weak_evidence") + 0.10 * c("ood"))
    rows = rows.withColumn("uncertainty", unc)
    return rows.withColumn("confidence", T.clip(1 - F.greatest("uncertainty", "ood")))


def low_risk_text(text: Column, words: Column) -> tuple[Column, Column]:
    """Whether a marketplace review has the usual structure, and whether it carries little risk."""
    t = F.lower(F.coalesce(text, F.lit("")))
    markers, details = T.phrase_hits(t, L.STRUCTURE_MARKERS), T.phrase_hits(t, L.LOW_RISK_TERMS)
    structured = (markers >= 1) & (details >= 1)
    return structured, structured | ((words <= 8) & (details >= 1)) | ((words >= 4) & (details >= 2))


def clean_override(df: DataFrame, policy: dict[str, float]) -> Column:
    """Whether a review of low risk stays clean although its vocabulary is new; an authenticity of exactly 0 reads as 0.5."""
    c = F.col
    authentic = F.when(c("slang_authenticity") == 0, 0.5).otherwise(c("slang_authenticity"))
    barred = (c("p") > min(policy["clean"], 0.12)) | (c("uncertainty") > policy["uncertainty"]) | (c("ood") > max(policy["ood"] + 0.24, 0.74)) | (c("n_words") < 1) | ((c("ai") >= 0.76) & ~c("structured"))
    plain = c("low_risk") & (c("p") <= 0.025) & (c("rating_manipulation") <= 0.38) & (c("template_dup") < 2) & (c("ai") < 0.66)
    risky = (c("slang_manipulation") > 0.18) | (c("rating_manipulation") > 0.30) | (c("template_dup") >= 2)
    return F.when(barred, False).when(plain, True).when(risky, False).otherwise((authentic >= 0.66) | c("low_risk"))


def apply_triage(df: DataFrame, policy: dict[str, float]) -> DataFrame:
    """Label and reasons: decided automatically only outside the band and without any reason. Needs low_risk and structured for the override."""
    c = F.col
    low, high = policy["clean"], policy["suspicious"]
    cover = F.when(c("coverage") == 0, 1.0).otherwise(c("coverage"))  # a coverage of exactly 0 reads as unknown
    rows = df.withColumn("override", clean_override(df, policy) if {"low_risk", "structured", "ai"} <= set(df.columns) else F.lit(False))
    # The sentences.
    reasons = T.array_of(
        ((c("p") > low) & (c("p") < high), "The hybrid score falls inside the manual-review band."),
        (c("uncertainty") > policy["uncertainty"], "The model signals disagree too much for an automated decision."),
        ((c("ood") > policy["ood"]) & ~c("override"), "The review looks out-of-domain relative to the training corpus."),
        ((cover < 0.32) & ~c("override"), "Too little of the wording matches patterns seen during training."),
        (F.abs(c("pt") - c("p")) > 0.24, "The raw text model and the hybrid fraud model disagree materially."),
    )
    rows = rows.withColumn("triage_reasons", reasons)
    label = F.when(F.size("triage_reasons") > 0, "needs_manual_review").when(c("p") >= high, "confident_suspicious").when(c("p") <= low, "confident_clean").otherwise("needs_manual_review")
    rows = rows.withColumn("triage", label)
    open_ = (c("triage") == "needs_manual_review") & (F.size("triage_reasons") == 0)
    return rows.withColumn("triage_reasons", F.when(open_, F.array(F.lit("The review needs a human decision because the evidence is not decisive enough."))).otherwise(c("triage_reasons")))


def triage_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    t = F.col("triage")
    out = df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(t == "confident_suspicious").alias("suspicious"), F.count_if(t == "confident_clean").alias("clean"), F.count_if(t == "needs_manual_review").alias("manual"),
        F.avg("uncertainty").alias("mean_uncertainty"), F.avg((F.col("ood") >= 0.45).cast("double")).alias("ood_ratio"),
    )
    return out.withColumns({"manual_ratio": F.col("manual") / F.col("n"), "automated_ratio": (F.col("suspicious") + F.col("clean")) / F.col("n")})


def triage_candidates(df: DataFrame, threshold: float) -> DataFrame:
    """The grid of policies: 8 x 8 band edges and the quantiles of uncertainty and out-of-domain scores; at most 1,600 rows."""
    def steps(lo: float, hi: float) -> list[float]:
        return sorted({round(lo + (hi - lo) * i / 7, 3) for i in range(8)})

    high = steps(max(threshold + 0.08, 0.60), min(0.92, threshold + 0.30))
    low = steps(max(0.08, threshold - 0.30), min(0.40, threshold - 0.08))
    shares = [0.35, 0.50, 0.65, 0.80, 0.90]
    ends = df.agg(*[F.percentile_approx(x, shares, 10000).alias(x) for x in ("uncertainty", "ood")]).first()
    grids = [sorted({round(min(max(v, 0.05), 0.95), 3) for v in ends[x]}) if ends[x] else other for x, other in (("uncertainty", [0.34, 0.42, 0.50, 0.58]), ("ood", [0.30, 0.40, 0.50, 0.62]))]
    rows = [(i, h, lo, u, o) for i, (h, lo, u, o) in enumerate(product(high, low, *grids)) if lo < threshold < h]
    return df.sparkSession.createDataFrame(rows, "policy int, high double, low double, max_uncertainty double, max_ood double")


def fit_triage(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The policy of the grid with the best selection score, the first on a tie. Rows meet the grid (bounded, broadcast) and are counted map-side."""
    c = F.col
    grid = triage_candidates(df, threshold)
    cover = F.when(c("coverage") == 0, 1.0).otherwise(c("coverage"))
    narrow = df.select("label", "p", "pt", "uncertainty", "ood", cover.alias("cover"), *[x for x in ("low_risk", "structured", "ai", "n_words", "slang_authenticity", "slang_manipulation", "rating_manipulation", "template_dup") if x in df.columns])
    rows = narrow.join(F.broadcast(grid), F.lit(True))
    barred = (c("p") > F.least("low", F.lit(0.12))) | (c("uncertainty") > c("max_uncertainty")) | (c("ood") > F.greatest(c("max_ood") + 0.24, F.lit(0.74)))
    override = F.lit(False)
    if "low_risk" in narrow.columns:  # the part of the override that no limit of the grid decides
        override = ~barred & clean_override(rows, {"clean": 1.0, "uncertainty": 9.0, "ood": 9.0})
    doubt = ((c("p") > c("low")) & (c("p") < c("high"))) | (c("uncertainty") > c("max_uncertainty")) | (((c("ood") > c("max_ood")) | (c("cover") < 0.32)) & ~override) | (F.abs(c("pt") - c("p")) > 0.24)
    auto, y, bad = ~doubt, c("label") == 1, (c("p") >= threshold) != (c("label") == 1)
    by = rows.withColumns({"__auto": auto, "__bad": bad}).groupBy("policy").agg(
        F.count("*").alias("n"), F.count_if("__auto").alias("auto"), F.count_if(c("__auto") & (c("p") >= c("high"))).alias("s"), F.count_if(c("__auto") & (c("p") >= c("high")) & y).alias("s_right"),
        F.count_if(c("__auto") & (c("p") <= c("low"))).alias("k"), F.count_if(c("__auto") & (c("p") <= c("low")) & ~y).alias("k_right"), F.count_if("__bad").alias("bad"), F.count_if(c("__bad") & ~c("__auto")).alias("caught"),
    )
    ratio = lambda a, b, none: F.when(c(b) > 0, c(a) / c(b)).otherwise(none)
    by = by.withColumns({"coverage": c("auto") / c("n"), "accuracy": F.when(c("auto") > 0, (c("s_right") + c("k_right")) / c("auto")).otherwise(0.0), "suspicious_precision": ratio("s_right", "s", 1.0), "clean_precision": ratio("k_right", "k", 1.0), "capture": ratio("caught", "bad", 0.0)})
    score = 1.85 * c("accuracy") + 0.35 * F.least("coverage", F.lit(0.86)) + 0.32 * c("capture") + 0.16 * c("suspicious_precision") + 0.12 * c("clean_precision") - 0.90 * F.greatest(F.lit(0.0), 0.84 - c("accuracy")) - 0.25 * F.greatest(F.lit(0.0), 0.18 - c("coverage"))
    best = by.withColumn("selection_score", F.round(score, 9)).orderBy(F.desc("selection_score"), "policy").limit(1)
    return best.join(F.broadcast(grid), "policy").select("high", "low", "max_uncertainty", "max_ood", "coverage", "accuracy", "capture", "selection_score")


def combined_threshold(text_threshold: Column) -> Column:
    return F.greatest(F.lit(0.45), F.least(F.lit(0.5), text_threshold))
