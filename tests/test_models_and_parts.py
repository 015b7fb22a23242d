"""Goldens of photo scores and labels, learned lexicons, splits, quantiles, variants and models, worked by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.operators import corpus, detectors, evaluation, models, photo_text, photos, reports, slang, text_models
from trustloom.plans.views import view
from trustloom.sources import readers


def test_photo_text_patterns_have_word_edges_in_any_script(spark):
    cases = {
        "a#1 choice": ["hype_claim"], "#1 choice": [], "хит продаж!": ["hype_claim"], "скидка 10": ["sale_discount"], "подскидк": [], "wholesale": [], "25 % off": ["sale_discount"], "telegrams": [], "vk": ["contact_or_store"],
        "мояреклама": [], "реклама": ["watermark_marker"], "write @ab": [], "write @abc": ["contact_or_store"], "my-shop.store": ["contact_or_store"], "site.community": [], "best seller": ["hype_claim"], "bestseller": [],
    }
    got = {r.t: r.labels for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", photo_text.photo_labels(F.col("t")).alias("labels")).collect()}
    assert got == cases


def test_product_categories(spark):
    cases = [(None, "Winter BOOTS and a phone", "footwear"), ("general", "кофе", "grocery"), (" Toys ", "boots", "toys"), ("", "nothing", "general product"), (None, None, "general product"), (None, "джинсовка для дома", "apparel"), (None, "наушник", "electronics")]
    got = spark.createDataFrame(cases, "given string, t string, want string").select("want", photos.product_category([F.col("given")], F.lit("https://e.com/x"), F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_alignment_scores(spark):
    cases = [
        ({"review_match": 0.5, "category_match": 0.5}, (1.0, 0.0, 0.0, 0.0), ("aligned", "customer_like", "natural_photo_like")),
        ({"unrelated_product": 0.7, "review_match": 0.3}, (0.3, 0.62, 0.0, 0.0), ("mismatch", "customer_like", "natural_photo_like")),
        ({"packaging_only": 0.26, "unrelated_product": 0.26, "product_in_use": 0.3, "ai_generated": 0.18}, (0.3, 0.62, 0.0, 0.58 * 0.18), ("mismatch", "customer_like", "natural_photo_like")),
        ({"packshot": 0.25, "stock_catalog": 0.15, "product_in_use": 0.6}, (0.6, 0.72 * 0.4, 0.58, 0.0), ("aligned", "packshot", "natural_photo_like")),
        ({"cgi_synthetic": 0.45, "review_match": 0.55}, (0.55, 0.0, 0.0, 0.66), ("aligned", "customer_like", "cgi_synthetic")),
        ({}, (0.0, 0.0, 0.0, 0.0), ("aligned", "customer_like", "natural_photo_like")), (None, (0.0, 0.0, 0.0, 0.0), ("aligned", "customer_like", "natural_photo_like")),
    ]
    rows = photos.alignment_scores(spark.createDataFrame([(i, p, "beauty") for i, (p, _, _) in enumerate(cases)], "i int, probabilities map<string,double>, category string")).orderBy("i").collect()
    for r, (_, scores, labels) in zip(rows, cases, strict=True):
        assert (r.alignment, r.mismatch, r.stock, r.synthetic) == pytest.approx(scores)
        assert (r.mismatch_label, r.stock_label, r.synthetic_label) == labels
    assert rows[2].top_negative == "packaging_only" and "packaging, box, or label" in rows[2].mismatch_reasons[0] and "beauty category" in rows[2].mismatch_reasons[0]
    assert rows[3].stock_reasons == ["The customer image looks like a studio packshot prepared for product marketing, not a user-taken product photo."] and rows[4].synthetic_reasons[0].startswith("Weak auxiliary signal: the image shows CGI")


def test_lexicon_is_learned_by_source_and_met(spark):
    fake = [(i, f"gizmo rocks must cop zibble {w}", 1, "amazon.com", "amazon.com") for i, w in enumerate(["one", "two", "six"] * 4)]
    real = [(100 + i, f"plain words about crofter {w}", 0, "amazon.com", "amazon.com") for i, w in enumerate(["one", "two", "six"] * 4)]
    rows = spark.createDataFrame(fake + real, "record_id long, review_text string, label int, source string, source_site string").withColumn("page_id", F.lit("p"))
    learned = slang.learn_lexicon(rows)
    got = {(r.scope, r.kind, r.polarity, r.term): r for r in learned.collect()}
    assert got["general", "term", "suspicious", "zibble"].pos == 12 and got["amazon", "term", "authentic", "crofter"].neg == 12
    assert ("general", "phrase", "suspicious", "gizmo rocks") in got and ("general", "term", "suspicious", "one") not in got
    assert {r.term for k, r in got.items() if r.promo} and all("must" in r.term or "cop" in r.term for r in got.values() if r.promo)
    assert max(r.rank for k, r in got.items() if k[0] == "amazon" and k[1] == "phrase") <= 4
    new = spark.createDataFrame([(1, "This GIZMO has zibble inside", "amazon.com", "p"), (2, "crofter", "etsy.com", "p"), (3, None, None, "p")], "record_id long, review_text string, source_site string, page_id string")
    hits = {r.record_id: (r.learned_suspicious, r.learned_authentic) for r in slang.apply_lexicon(new, learned).collect()}
    assert hits == {1: (2, 0), 2: (0, 1), 3: (0, 0)}
    profile = {r.record_id: r for r in slang.with_slang(new, learned).collect()}
    assert profile[1].learned_suspicious == 2 and profile[1].slang_manipulation > 0 and profile[2].slang_authenticity > 0
    assert {r.learned_suspicious for r in slang.with_slang(new).collect()} == {0}
    alone = rows.withColumn("source", F.lit("synthetic_x"))
    assert slang.learn_lexicon(alone).count() == learned.filter("whole").count() + slang.learn_lexicon(alone).filter("not whole").count()


def test_calibrator_blends_and_beats_the_prior(spark):
    rows = spark.createDataFrame([(i, "imba no cap worth it fr bro" if i % 2 else "size and material are fine, delivery took 3 days", i % 2, "p", "") for i in range(60)], "record_id long, review_text string, label int, page_id string, source_site string")
    profiles = slang.with_slang(rows)
    found = models.calibrate_slang(models.fit_slang_calibrator(profiles), profiles).join(profiles.select("record_id", F.col("slang_manipulation").alias("m"), F.col("slang_authenticity").alias("a")), "record_id").collect()
    assert len(found) == 60
    for r in found:
        assert r.slang_manipulation == pytest.approx(0.25 * r.m + 0.75 * r.slang_learned_probability) and r.slang_authenticity == pytest.approx(0.35 * r.a + 0.65 * (1 - r.slang_learned_probability))
        assert r.slang_calibration_delta == pytest.approx(r.slang_manipulation - r.m)
    loss = np.mean([-math.log(r.slang_learned_probability if r.label else 1 - r.slang_learned_probability) for r in found])
    assert loss < math.log(2)
    with pytest.raises(ValueError):
        models.fit_slang_calibrator(profiles.filter("label = 1"))


def test_covering_split_tries_again(spark):
    few = spark.createDataFrame([(i, f"g{i % 24}", int(i % 24 < 6)) for i in range(72)], "record_id long, g string, label int")
    parts = {"test": 0.12, "calibration": 0.12, "validation": 0.12}
    found = evaluation.covering_split(few, "g", parts).collect()
    by = {}
    for r in found:
        by.setdefault(r.part, set()).add((r.g, r.label))
    assert set(by) == {"train", *parts} and all(len({y for _, y in v}) == 2 for v in by.values())
    groups = [g for v in by.values() for g in {g for g, _ in v}]
    assert len(groups) == len(set(groups)) == 24
    rest = few.filter(~(evaluation._share_of(F.col("g"), "0-test-0") < 0.12))
    first = rest.filter(evaluation._share_of(F.col("g"), "0-calibration-0") < 0.12 / 0.88)
    assert first.select("label").distinct().count() < 2  # the first salt does not do, another one was found
    with pytest.raises(ValueError, match="both labels"):
        evaluation.covering_split(few.filter("label = 0"), "g", parts)
    evaluation.assert_disjoint(evaluation.covering_split(few, "g", parts), ["g"])
    with pytest.raises(ValueError, match="more than one part"):
        evaluation.assert_disjoint(few.withColumn("part", F.col("record_id") % 5), ["g"])


@pytest.mark.parametrize("ranges, small", [(1024, 100_000), (4, 3), (2, 1)])
def test_exact_quantiles(spark, ranges, small):
    rng = np.random.default_rng(4)
    values = [*rng.normal(size=150).tolist(), *[0.25] * 60, 1e6, -1e6]
    shares = [0.0, 0.01, 0.5, 0.7, 0.95, 0.99, 1.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "p double")
    assert evaluation.exact_quantiles(df, "p", shares, ranges, small) == pytest.approx(np.quantile(values, shares).tolist())
    assert evaluation.exact_quantiles(df.filter("p is null"), "p", shares) is None


def test_variants_reach_the_target_and_keep_lineage(spark):
    rows = spark.createDataFrame([(i, f"Sturdy kettle number{i} works. It boils water within three minutes!", 4.0, 0, "a", f"line{i}", "hold") for i in range(7)], "record_id long, review_text string, rating double, label int, source string, split_group string, holdout_group string")
    for target in (0, 3, 7, 100):
        made = corpus.augment(rows, target).collect()
        assert len(made) == target and all(r.split_group == f"line{r.record_id}" and r.holdout_group == "hold" and r.label == 1 for r in made)
        per = {i: sum(r.record_id == i for r in made) for i in range(7)}
        assert max(per.values()) - min(per.values()) <= 1
    assert {r.style for r in made} == set(corpus.STYLES)
    one = {r.style: r for r in made}
    assert one["soft_sell"].review_text == "I used this sturdy kettle briefly and it boils water within three minutes. It honestly feels like one of the safer buys here and I would buy the same one again."
    assert one["subtle_negative"].rating == 1.0 and one["promo_loud"].review_text.startswith("Absolutely amazing!!! sturdy kettle is perfect")
    full = corpus.balanced_corpus(rows.withColumn("label", (F.col("record_id") == 0).cast("int")))
    count = {r.label: r.n for r in full.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert count[0] == 6 and count[1] <= 6 and full.filter("origin = 'augmented'").count() == count[1] - 1
    assert corpus.augment(rows.filter("label = 1"), 5).count() == 0


def test_text_model_beats_the_prior_on_unseen_rows(spark):
    words = ["kettle", "lamp", "chair", "phone", "cable", "mirror"]
    rows = [(i, f"{'amazing deal' if i % 3 == 0 else 'works as expected'} the {words[i % 6]} {words[i // 7 % 6]} came", int(i % 3 == 0), 5.0, ["train", "train", "validation", "test"][i // 3 % 4]) for i in range(120)]
    df, names = text_models.review_measures(spark.createDataFrame(rows, "record_id long, review_text string, label int, rating double, part string"))
    model = text_models.fit_text_model(df.filter("part = 'train'"), df.filter("part = 'validation'"), names, {"word": 50, "char": 80}, (0.1, 0.01))
    assert model.size == model.vocabulary.count() <= 130 and model.penalty in (0.1, 0.01)
    test = model.probability(df.filter("part = 'test'"))
    loss = models.combiner_metrics(test).first()
    prior = df.filter("part = 'test'").agg(text_models.log_loss_of_prior()).first()[0]
    assert loss.n == 30 and loss.log_loss < prior
    unseen = model.probability(df.limit(1).withColumn("review_text", F.lit(None).cast("string"))).first()
    assert 0 <= unseen.p <= 1
    (vec,) = text_models.text_vectors(df.filter("record_id = 0"), model.vocabulary, model.size, names).collect()
    place = {r.term: r.place for r in model.vocabulary.filter("kind = 'word'").collect()}
    assert vec.features[place["amazing"]] > 0 and vec.features[place["works"]] == 0


def test_series_takes_the_unit_of_its_span(spark):
    rows = [("h", "2024-03-01 10:59:00", 1), ("h", "2024-03-01 13:00:00", 0), ("d", "2024-02-28 23:00:00", 0), ("d", "2024-03-02 01:00:00", 1), ("w", "2024-01-03 00:00:00", 0), ("w", "2024-04-01 00:00:00", 1), ("m", "2023-01-31 00:00:00", 1), ("m", "2024-03-01 00:00:00", 1), ("u", None, 1), ("u", None, 0), ("one", "2024-05-05 05:05:05", 0), ("one", None, 1)]
    df = spark.createDataFrame(rows, "page_id string, t string, bad int").withColumn("t", F.to_timestamp("t"))
    got = {}
    for r in corpus.adaptive_series(df, "t", F.col("bad") == 1).orderBy("page_id", "bucket").collect():
        got.setdefault((r.page_id, r.unit), []).append((str(r.bucket)[:13] if r.bucket else None, r.n, r.suspicious))
    assert got["h", "hour"] == [("2024-03-01 10", 1, 1), ("2024-03-01 11", 0, 0), ("2024-03-01 12", 0, 0), ("2024-03-01 13", 1, 0)]
    assert [x[0][:10] for x in got["d", "day"]] == ["2024-02-28", "2024-02-29", "2024-03-01", "2024-03-02"] and [x[1] for x in got["d", "day"]] == [1, 0, 0, 1]
    assert got["w", "week"][0] == ("2024-01-01 00", 1, 0) and got["w", "week"][-1] == ("2024-04-01 00", 1, 1) and len(got["w", "week"]) == 14
    assert got["m", "month"][0] == ("2023-01-01 00", 1, 1) and got["m", "month"][-1][0] == "2024-03-01 00" and len(got["m", "month"]) == 15
    assert got["u", "undated"] == [(None, 2, 1)] and got["one", "day"] == [("2024-05-05 00", 1, 0)] and len(got) == 6
    assert corpus.adaptive_series(df.limit(0), "t").count() == 0


def test_bytes_are_decoded(spark, tmp_path):
    cases = ["привет ё".encode(), "привет ё".encode("cp1251"), b"\x98abc\xe9", b"", "\ufeffa".encode(), b"\x19\x8a\xff"]
    want = ["привет ё", "привет ё", "\x98abc\xe9", "", "\ufeffa", "\x19Љя"]
    for i, data in enumerate(cases):
        (tmp_path / f"{i}.txt").write_bytes(data)
    assert [r.text for r in readers.read_text(spark, str(tmp_path)).orderBy("path").collect()] == [t for t in want if t]
    assert [r[0] for r in spark.createDataFrame([(None,), (bytearray(),)], "c binary").coalesce(1).select(readers.decode_text(F.col("c"))).collect()] == [None, ""]


def test_photo_evidence_of_a_review(spark):
    reviews = spark.createDataFrame([(1, "ozon.ru", "boots", "fine boots"), (2, "ozon.ru", "t", "x"), (3, "ozon.ru", "t", "no photo")], "record_id long, source_site string, title string, review_text string")
    look = {"unrelated_product": 0.7, "review_match": 0.3}
    links = [("p", 1, "ann", 0, "https://e.com/a.jpg", look, "SALE 10% off"), ("p", 1, "ann", 0, "https://e.com/studio-packshot.jpg", None, ""), ("p", 2, "bob", 7200, "https://e.com/a.jpg", {"product_in_use": 1.0}, None)]
    df = spark.createDataFrame(links, "page_id string, record_id long, author string, sec long, url string, probabilities map<string,double>, ocr_text string")
    rows = {r.record_id: r for r in reports.photo_signals(df, reviews).collect()}
    assert set(rows) == {1, 2} and rows[1].mismatch == pytest.approx(0.62) and rows[2].mismatch == 0 and rows[1].stock == pytest.approx(0.62)
    assert rows[1].mismatch_reasons == ["The customer photo looks closer to a different or unrelated product than to the review text or inferred footwear category."]
    assert rows[1].stock_reasons == ["The image URL/path contains stock, catalog, render, promo, or marketing hints."] and rows[1].reuse_reasons == ["The same customer photo appears in 2 reviews."]
    assert rows[1].timing_reasons == ["The same customer photo appears across different authors within a short 2.0-hour window."]
    assert rows[1].photo_text_score > 0 and rows[1].photo_text_reasons and rows[2].photo_text_score == 0
    bare = {r.record_id: r for r in reports.photo_signals(df.drop("probabilities", "ocr_text"), reviews).collect()}
    assert bare[1].stock == pytest.approx(0.62) and bare[1].mismatch is None and bare[1].photo_text_score == 0


def test_overview_and_signals_of_pages(spark):
    base = dict(suspicious_ratio=0.9, manipulation_mean=0.9, highest_probability=0.99, manual_ratio=0.5, automated_ratio=0.0, uncertainty_mean=0.4, confident_suspicious=0, suspicious_reviews=9, manual_reviews=5, total_reviews=10, duplicate_photo_ratio=0.0, temporal_ratio=0.0, mismatch_reviews=9, stock_reviews=0, synthetic_reviews=0, photo_text_reviews=0, ai_flagged=0, r_template=0.0, r_slang=0.004, ood_ratio=0.0)
    none = {k: 0.0 if isinstance(v, float) else 0 for k, v in base.items()} | {"total_reviews": 3, "automated_ratio": 1.0}
    df = spark.createDataFrame([{"page_id": "a"} | base, {"page_id": "b"} | none])
    got = {r.page_id: r for r in reports.dashboard_overview(df).collect()}
    assert (got["a"].risk_score, got["a"].confidence, got["a"].manipulation_probability, got["a"].suspicious_count, got["a"].status) == (86, 53, 90, 9, "High fraud risk")
    assert (got["b"].risk_score, got["b"].confidence, got["b"].manipulation_probability, got["b"].status) == (12, 97, 8, "Low-risk sample") and "9 confidently" in got["a"].verdict
    signals = [(r.page_id, r["rank"], r.signal, r.n) for r in reports.fallback_signals(df).orderBy("page_id", "rank").collect()]
    assert signals == [("a", 1, "Peak suspicious probability", 99), ("a", 2, "Suspicious review ratio", 90), ("a", 3, "Behavioral manipulation score", 90), ("a", 4, "Image/text mismatch signal", 90), ("a", 5, "Manual review uncertainty", 50), ("a", 6, "Language template signal", 1), ("b", 1, "Low-risk review profile", 3)]


def test_rating_detector(spark, sf):
    rows = view(spark, sf, "ratings_v")
    scored, threshold = detectors.detect_ratings(rows)
    got = scored.select("record_id", "part", "anomaly", "suspicious").toPandas()
    assert len(got) == rows.count() and set(got.part) == {"train", "validation", "test"} and threshold > 0
    assert ((got.anomaly >= threshold) == (got.suspicious == 1)).all() and 0 < got.suspicious.sum() < len(got)
    assert detectors.suspicious_users(scored).agg(F.sum("n_ratings")).first()[0] == got.suspicious.sum()
