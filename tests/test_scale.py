"""Forms of jobs whose cost grows no faster than their input, on inputs made for them."""

import random
import re
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trustloom.functions import lexicons as L
from trustloom.functions import text as T
from trustloom.operators import corpus, machine_text, pages, photo_text, ratings, slang, text_models
from trustloom.plans import views
from trustloom.sources import cards


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bursts_of_a_hot_key_without_sliding_frames(spark):
    rng, start = random.Random(5), datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "b", None]), start + timedelta(seconds=rng.choice([0, 1, 3600, 3601, 7200, rng.randrange(9000)]), microseconds=rng.randrange(10**6))) for i in range(600)]
    df = spark.createDataFrame(rows, "record_id long, ip_address string, ts timestamp")
    out = ratings.burst_count(df, "ip_address", 3600, "n")
    sec = lambda t: int((t - start).total_seconds())
    want = {i: sum(k == k2 and k is not None and sec(t) - 3600 <= sec(t2) and (sec(t2), i2) < (sec(t), i) for i2, k2, t2 in rows) for i, k, t in rows}
    assert {r.record_id: r.n for r in out.collect()} == want and out.columns == [*df.columns, "n"]
    assert "RangeFrame, -3600" not in _plan(out)  # a frame that is summed anew for each of its rows


def test_candidates_of_a_long_text(spark):
    words = [f"{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260 % 26)}{chr(97 + i // 6760)}x" for i in range(20000)]
    df = spark.createDataFrame([(words,)], "tok array<string>").select(F.size(slang.candidates(F.col("tok"))).alias("n"))
    begun = time.monotonic()
    assert df.first().n == 20000 + 19999 + 19998
    assert time.monotonic() - begun < 25  # compared one with another they took minutes


def test_domain_detail_is_looked_up_by_hash(spark):
    rows = [(1, "p", "battery screen battery", "amazon.com"), (2, "p", "plain", "x.com"), (3, "p", None, None)]
    out = slang.slang_profile(spark.createDataFrame(rows, "record_id long, page_id string, review_text string, source_site string"))
    assert "array_contains" not in _plan(out)  # a list gone through for each word
    assert {r.record_id: r.domain_detail > 0 for r in out.collect()} == {1: True, 2: False, 3: False}


def test_a_text_is_normalized_once_for_all_phrases(spark):
    df = spark.createDataFrame([(1, " A\t \tgift\n for\u00a0you ", "s")], "record_id long, t string, s string")
    out = df.select(T.product_family(F.col("t"), F.col("s")).alias("f"), T.norm_text(F.col("t")).alias("n"), T.word_count(F.col("t")).alias("w"))
    assert _plan(out.select("f")).count("regexp_replace(coalesce(t#") == 1  # was there for each phrase
    assert (out.first().n, out.first().w) == ("A gift for\u00a0you", 3)
    odd = ["", " ", "\t", "a b", "a  b", "a \t b", "a\r\n b", "\x0b a\x0c", "a \u2003 b", " a", None]
    rows = spark.createDataFrame([(x,) for x in odd], "x string").select(T.norm_text(F.col("x")), F.trim(F.regexp_replace(F.coalesce("x", F.lit("")), r"\s+", " ")))
    assert all(a == b for a, b in rows.collect())


def test_tables_of_few_row_groups_are_dealt_out(spark, sf):
    assert "RepartitionByExpression [doc_id" in _plan(views.view(spark, sf, "reviews_v"))


def test_photo_text_is_normalized_once(spark):
    df = spark.createDataFrame([(1, "p", "SALE 20% off at ozon", "amazon.com")], "record_id long, page_id string, ocr_text string, source_site string")
    out = photo_text.photo_text(df)
    assert _plan(out.select("photo_labels", "photo_text_score")).count("regexp_replace(coalesce(ocr_text#") == 1  # was there for each label
    assert out.first().photo_text_flag == 1
    assert "photo_labels" in (plan := _plan(photo_text.photo_text_summary(out))) and "rlike" not in plan.lower()  # labels are found once, not by each aggregate


def test_profiles_and_openings_are_computed_once_for_counts_and_rows(spark):
    rows = [(i, "p", "a", "t", "топчик must buy wow screen battery " * 3, "amazon.com", 5.0, None) for i in range(3)]
    df = spark.createDataFrame(rows, "record_id long, page_id string, author string, title string, review_text string, source_site string, rating double, review_date date")
    profiled = slang.with_slang(df)
    counted = pages.page_counts(profiled, keep_text=False)
    opened = machine_text.opening_boost(machine_text.ai_score(df).drop("review_text", "title"))
    for out in (profiled, counted, opened):  # was computed again by each filter on what is counted
        assert "regexp" not in _plan(out) and "md5" not in _plan(out)
    assert {r.template_dup for r in profiled.collect()} == {3} and {r.dup_text for r in counted.collect()} == {3} and {r.n_opening for r in opened.collect()} == {3}


def test_texts_of_ratings_are_measured_once_per_distinct_text(spark):
    rows = [(i, f"u{i}", "i1", 5.0, datetime(2024, 1, 1), "10.0.0.1", "x", "y", t) for i, t in enumerate(["Perfect product, must buy ", "perfect product, must buy", " ", None, "\t", "ok"])]
    df = spark.createDataFrame(rows, "record_id long, user_id string, item_id string, rating double, ts timestamp, ip_address string, geo_country string, geo_city string, review_text string")
    texts = ratings.text_profiles(df, ratings.with_text_key(df).drop("review_text")).collect()
    assert sorted((r.words, r.text_count) for r in texts) == [(0, 1), (1, 1), (4, 2)]  # words were counted for each rating
    want = {r.record_id: (r.w, r.p) for r in df.select("record_id", T.word_count(F.col("review_text")).alias("w"), T.has_phrase(F.col("review_text"), L.RATING_PHRASES).cast("int").alias("p")).collect()}
    assert {r.record_id: (r.words, r.promotional) for r in ratings.with_signals(df).collect()} == want


def test_terms_are_counted_where_their_record_lies(spark):
    df = spark.createDataFrame([(i, f"word{i % 2} other words") for i in range(4)], "record_id long, review_text string")
    for out in (corpus.tfidf(df, terms=corpus.char_grams(F.col("review_text"))), text_models._grams(df, ["word", "char"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(record_id" in plan and not re.search(r"hashpartitioning\(record_id#\d+L, term", plan)  # terms were shuffled
    assert corpus.tfidf(df).count() > 0


def test_photo_patterns_are_tried_only_where_their_words_are(spark):
    texts = ["sale", "wholesale", "20% off", "20 %off now", "100% off", "#1", "# 1", "a@b", "@shop_x", "see x.com", "x.comic", "ходовой товар", "хит продаж", "акция!", "vk", "vkx", "coupon free shipping", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = T.array_of(*[(F.col("t").rlike("|".join(map(photo_text.bounded, p))), k) for k, p in L.PHOTO_PATTERNS.items()])
    assert all(a == b for a, b in df.select(photo_text.photo_labels(F.col("t")), plain).collect())
    words = [w for p in L.PHOTO_PATTERNS.values() for x in p for w in photo_text.needed(x)]
    assert not [w for w in words if re.search(r"[\\\[(|?*+]", w)]  # each is looked for as it stands
    assert _plan(df.select(photo_text.photo_labels(F.col("t")))).lower().count("contains(") >= len(words)  # were tried at every character


def test_characters_are_counted_without_a_string_for_each(spark):
    texts = ["", "aB1", "ÄÖ ß 12 ٣", "Привет, World! -- 3 см / a/b/c/d", "!!??", "𝔸b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for chars in (r"\p{Lu}", r"\p{L}", r"\p{Nd}", "a-z", r"\x{0400}-\x{04FF}", ",;:", "!", "?"):
        assert all(a == b for a, b in df.select(T.chars_of(F.col("t"), chars), F.regexp_count("t", F.lit(f"[{chars}]"))).collect())
    scored = machine_text.ai_score(spark.createDataFrame([(1, "p", "t", "One two. Three — four five! ... Ещё слово?")], "record_id long, page_id string, title string, review_text string"))
    assert ", [a-z], 0)" not in _plan(scored)  # each letter was a match of its own
    sents = scored.select(F.round("sent_mean", 6), F.round("sentences_log", 6)).first()
    assert tuple(sents) == (round(8 / 3 / 28, 6), round(1.3862943611, 6))


def test_words_meet_the_lists_once(spark):
    words = "топчик abc a-b ё'x don't привет-мир x'ы 12 ѿ"
    rows = [(1, "p", words, "shoe lamp", "amazon.com"), (2, "p", "shoe shoe sneaker prime seller", "", "amazon.com"), (3, "p", None, None, None)]
    df = spark.createDataFrame(rows, "record_id long, page_id string, review_text string, title string, source_site string")
    got = {r.record_id: r for r in slang.slang_measures(df).collect()}
    tok = df.select("record_id", slang.word_tokens(F.col("review_text")).alias("w")).select("record_id", F.size("w").alias("n"), F.size(F.filter("w", lambda x: x.rlike(r"[\x{0400}-\x{04FF}]"))).alias("cyr"), F.size(F.filter("w", lambda x: x.rlike("[a-z]"))).alias("lat"))
    assert {r.record_id: (r.n, r.cyr, r.lat) for r in tok.collect()} == {k: (r.n_tokens, r.cyr, r.lat) for k, r in got.items()}
    assert (got[1]["__d_apparel"], got[1]["__d_home"], got[2]["__d_apparel"], got[3]["__d_home"]) == (1, 1, 3, 0)
    assert "regexp" not in _plan(slang.with_slang(df))  # words were found again for the domains of pages


def test_features_measure_each_distinct_text_once(spark):
    texts = ["Good One!", "Good One!", "good one!", "", None, "ÄB 1?"]
    rows = [(i, f"u{i % 2}", "i1", 5.0, datetime(2024, 1, 1, i), "10.0.0.1", "x", "y", 0, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "record_id long, user_id string, item_id string, rating double, ts timestamp, ip_address string, geo_country string, geo_city string, is_fake int, review_text string")
    keyed = df.select("record_id", F.md5("review_text").alias("raw_key"))
    assert ratings.raw_measures(df, keyed).count() == 4  # each rating was measured
    t, names = F.col("review_text"), ["chars", "unique_ratio", "upper_ratio", "digit_ratio", "exclaim", "question"]
    want = df.select("record_id", F.coalesce(F.length(t), F.lit(0)), T.unique_word_ratio(t), T.uppercase_ratio(t), T.digit_ratio(t), T.punct_density(t, "!"), T.punct_density(t, "?"))
    got = ratings.rating_features(df)
    assert {r[0]: tuple(map(float, r[1:])) for r in want.collect()} == {r[0]: tuple(r[1:]) for r in got.select("record_id", *names).collect()}
    assert ratings.usual_gap(df) == ratings.fit_defaults(df).first().gap


def test_a_lexicon_counts_only_phrases_of_promising_parts(spark, monkeypatch):
    rng, counted = random.Random(3), []
    common, rare = ["prime", "seller", "doorstep", "shiny", "thrifty", "it", "the", "aaa"], [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400)]
    rows = []
    for i in range(160):
        y = i % 2
        ws = rng.choices(rare, k=30) + rng.choices(common, k=12) + ["zippy", "glossy", "box"] * (y and rng.random() < 0.6)
        rows.append((i, y, ["amazon.com", "ozon.ru", "tiny"][0 if i < 90 else 1 if i < 150 else 2], " ".join(rng.sample(ws[:42], 42) + ws[42:])))
    df = spark.createDataFrame(rows, "record_id long, label int, source string, review_text string")
    plain = slang.lexicon_corpus(df).select("label", slang.source_label(F.col("source")).alias("scope"), F.explode(slang.candidates(slang.word_tokens(F.col("review_text")))).alias("c"))
    want = {(r.scope, r.kind, r.term): (r.pos, r.neg) for s in (F.col("scope"), F.lit("general")) for r in plain.groupBy(s.alias("scope"), "c.kind", "c.term").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).collect()}
    sizes = {k: df.groupBy().agg(*[F.count_if((F.col("label") == y) & cond) for y in (1, 0)]).first() for k, cond in [("general", F.lit(True)), *[(s, slang.source_label(F.col("source")) == s) for s in {k[0] for k in want} - {"general"}]]}
    score = {k: (pos + 0.5) / (sizes[k[0]][0] + 1) - (neg + 0.5) / (sizes[k[0]][1] + 1) for k, (pos, neg) in want.items() if pos + neg >= 2 and sum(sizes[k[0]]) >= 18}
    want_listed = {(*k, *want[k]) for k, x in score.items() if abs(round(x, 9)) >= 0.03}
    real = slang._counted
    monkeypatch.setattr(slang, "_counted", lambda rows, terms: counted.append(out := real(rows, terms)) or out)
    every = {"term": 10**6, "phrase": 10**6}
    got = {(r.scope, r.kind, r.term, r.pos, r.neg) for r in slang.learn_lexicon(df, every, every).collect()}
    assert got == want_listed and any(k[1] == "phrase" and k[2] == "zippy glossy box" for k in got)
    kept = {r.term for out in counted[1:] for r in out.collect()}
    assert len(kept) < len({k[2] for k in want if k[1] == "phrase"}) / 2  # all phrases of all texts were counted
    monkeypatch.setattr(slang, "MOST_KNOWN", 3)  # too many parts for a list: all phrases are counted
    assert {(r.scope, r.kind, r.term, r.pos, r.neg) for r in slang.learn_lexicon(df, every, every).collect()} == want_listed


def test_tokens_of_pages_are_found_once_for_cards_and_their_texts(spark, monkeypatch):
    card = '<div class="review-card" ID=x><p>plain paragraph of a card %d</p><img\nalt=avatar src="/a.png"><time datetime>2024</time></div>'
    df = spark.createDataFrame([(i, "http://x.com/", (card % i) * 2) for i in range(3)], "page_id long, url string, html string")
    seen = {r.pos: r for r in cards.tokens(df.filter("page_id = 0")).collect()}
    assert seen[0].about == " review-card  x   " and seen[1].about.strip() == "" and [r.images for r in seen.values() if r.images] == [["/a.png"]] * 2
    calls, real = [], cards.written
    monkeypatch.setattr(cards, "written", lambda rows: calls.append(rows) or real(rows))
    out = cards.card_reviews(df)
    assert len(calls) == 1 and "<!--.*?-->" not in _plan(out)  # pages were cut into tokens again for each use
    assert sorted((r.page_id, r.review_text, r.date) for r in out.collect()) == sorted((i, f"plain paragraph of a card {i}", "2024") for i in range(3) for _ in "ab")


def test_texts_are_measured_before_their_pages_are_met(spark, sf, monkeypatch):
    from trustloom.plans import registry

    written, real = [], pages.cut
    monkeypatch.setattr(pages, "cut", lambda df: written.append(_plan(df)) or real(df))
    reviews = views.view(spark, sf, "reviews_v").filter("record_id < 60")
    early = pages.page_scores(registry._slang(pages.prepared(reviews)))
    assert "regexp_replace(coalesce(review_text" not in written[0]  # were measured by one task a page
    late = pages.page_scores(registry._slang(reviews))
    assert sorted(map(str, early.select(sorted(early.columns)).collect())) == sorted(map(str, late.select(sorted(early.columns)).collect())) and sorted(early.columns) == sorted(late.columns)
    spread = views.view(spark, sf, "reviews_v")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[doc_id#\d+L\], 4", spread)  # was joined to few partitions by size
    scored = machine_text.opening_boost(machine_text.for_openings(machine_text.ai_score(reviews.select("page_id", "record_id", "title", "review_text"))))
    whole = machine_text.opening_boost(machine_text.ai_score(reviews.select("page_id", "record_id", "title", "review_text")))
    assert "repetition" not in scored.columns and sorted(map(tuple, scored.select("record_id", "ai", "ai_label", "ai_flag").collect())) == sorted(map(tuple, whole.select("record_id", "ai", "ai_label", "ai_flag").collect()))


def test_a_text_models_probability_needs_no_vectors(spark, monkeypatch):
    from pyspark.ml.functions import vector_to_array

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["good", "bad", "phone", "case", "ok", "x"], k=8) + ["buy now"] * (i % 2)) if i else None, i % 2, 5.0 - i % 3, "train" if i % 3 else "validation") for i in range(60)]
    df, names = text_models.review_measures(spark.createDataFrame(rows, "record_id long, review_text string, label int, rating double, part string"))
    model = text_models.fit_text_model(df.filter("part = 'train'"), df.filter("part = 'validation'"), names, {"word": 40, "char": 60}, (0.01,))
    made = model.classifier.transform(text_models.text_vectors(df, model.vocabulary, model.size, names))
    want = {r.record_id: r.p for r in made.select("record_id", vector_to_array("probability")[1].alias("p")).collect()}
    got = model.probability(df, "p")
    assert "sparse" not in (plan := _plan(got)) and "PythonUDF" not in plan and "collect_list" not in plan  # a vector was made of each text
    assert len(want) == 60 and all(abs(r.p - want[r.record_id]) < 1e-9 for r in got.collect())
