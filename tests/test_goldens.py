import datetime as dt

from pyspark.sql import functions as F

from trustloom.functions import text as T
from trustloom.operators import corpus, evaluation, machine_text, pages, photo_text, photos, ratings, slang
from trustloom.sources import readers
from trustloom.streaming import streams


def at(minutes=0, hours=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes, hours=hours)


SCHEMA = "record_id long, user_id string, item_id string, rating double, ts timestamp, ip_address string"


def test_missing_addresses_never_group_and_a_shared_one_does(spark):
    alone = spark.createDataFrame([(i, f"u{i}", "i", 5.0, at(10 * i), None) for i in range(4)], SCHEMA)
    shared = spark.createDataFrame([(i, f"u{i}", "i", 5.0, at(10 * i), "1.2.3.4") for i in range(4)], SCHEMA)
    assert ratings.ip_stats(alone).count() == 0
    assert [r.ip_1h for r in ratings.burst_count(alone, "ip_address", 3600, "ip_1h").collect()] == [0] * 4
    assert ratings.ip_stats(shared).first().ip_users == 4
    assert sorted(r.ip_1h for r in ratings.burst_count(shared, "ip_address", 3600, "ip_1h").collect()) == [0, 1, 2, 3]


def test_ties_and_window_ends(spark):
    rows = [(i, "u", "i", 5.0, at(), None) for i in range(3)] + [(3, "u", "i", 5.0, at(hours=24), None)]
    found = ratings.burst_count(spark.createDataFrame(rows, SCHEMA), "user_id", 86400, "n").orderBy("record_id").collect()
    assert [r.n for r in found] == [0, 1, 2, 3]


REVIEW = "page_id string, record_id long, author string, title string, rating double, review_date date, review_text string, source_site string"


def reviews(spark, rows):
    return spark.createDataFrame([(p, i, a, t, r, dt.date(2024, 1, d), x, s) for i, (p, a, t, r, d, x, s) in enumerate(rows)], REVIEW)


def test_pages_together_equal_pages_apart(spark):
    words = ["топчик and fire, must cop", "solid size and fit", "fire fire fire"]
    df = reviews(spark, [(p, f"a{i % 2}", "t", float(1 + i), 1 + i % 3, f"{words[i % 3]} text {i // 2} here", "amazon.com") for p in "ab" for i in range(5)])
    score = lambda d: sorted((r.record_id, round(r.rating_manipulation, 9)) for r in pages.page_scores(slang.with_slang(d)).collect())
    assert score(df) == score(df.filter("page_id = 'a'")) + score(df.filter("page_id = 'b'"))


def test_slang_scores_by_hand(spark):
    df = reviews(spark, [
        ("p", "a", "", 5.0, 1, "fire", ""),  # 1 of 1 tokens: density 1, pressure 1, low detail
        ("p", "a", "", 5.0, 1, "plain words with nothing in them", ""),
        ("q", "a", "", 5.0, 1, "имба fire must cop", ""),  # 4 tokens, 2 hits, 1 promotional phrase, both scripts
        ("r", "a", "", 5.0, 1, "solid fit and fabric, the size is 5 cm off", "amazon.com"),
    ])
    r = {x.record_id: x for x in slang.slang_reason(slang.with_slang(df)).collect()}
    near = lambda x, y: abs(x - y) < 1e-9
    # .22*0 + .16*0 + .08*1 + .08*(1/18) - .10 < 0; .18*1 + .08 + .06*.55
    assert near(r[0].slang_authenticity, 0.0) and near(r[0].slang_manipulation, 0.18 + 0.08 + 0.06 * 0.55) and r[0].profile == "mixed"
    assert (r[1].slang_authenticity, r[1].slang_manipulation, r[1].profile, r[1].signature) == (0.5, 0.0, "neutral", None)
    # hype 1/3, balance 1 - |1-3|/4 = .5, density .5; market (0+1+0+0)/4: .18 + .18/3 + .16 + .08 + .06*.55 + .04*.25
    assert near(r[2].slang_manipulation, 0.18 + 0.06 + 0.16 + 0.08 + 0.033 + 0.01) and (r[2].mix, r[2].bi_hype, r[2].low_detail) == (1, 1, 1)
    assert r[2].slang_reason.startswith("The review mixes Russian") and r[2].signature == "fire|имба|mix|promo|thin"
    # fit and size are detail in general and of the domain (fabric and fit: apparel is not sure: one keyword only)
    assert r[3].domain == "general" and (r[3].general_detail, r[3].units, r[3].detail) == (2, 1, 1.0) and r[3].market_pack == "amazon"


def test_templates_raise_manipulation(spark):
    df = reviews(spark, [("p", f"a{i}", "", 5.0, 1, "fire dope", "") for i in range(3)])
    r = slang.with_slang(df).first()
    assert r.template_dup == 3 and r.template_component == 1.0
    assert abs(r.slang_manipulation - min(1, 0.18 + 0.08 + 0.06 * 0.55 + 0.18)) < 1e-9


def test_page_reasons(spark):
    rows = [("p", "ann", "same", 5.0, 1, "must buy this", "") for _ in range(4)]
    df = pages.manipulation_reasons(pages.page_scores(slang.slang_reason(slang.with_slang(reviews(spark, rows)))))
    reasons = df.first().manipulation_reasons
    assert len(reasons) == 11 and reasons[0].startswith("The same or nearly identical") and reasons[-1].startswith("A small set of authors")


def triage_row(spark, **more):
    base = {"p": 0.5, "pt": 0.5, "uncertainty": 0.1, "ood": 0.1, "coverage": 0.9, "n_words": 9, "ai": 0.0, "structured": False, "low_risk": True, "slang_authenticity": 0.5, "slang_manipulation": 0.0, "rating_manipulation": 0.0, "template_dup": 0}
    row = base | more
    policy = {"clean": 0.4, "suspicious": 0.6, "uncertainty": 0.5, "ood": 0.5}
    r = evaluation.apply_triage(spark.createDataFrame([tuple(row.values())], [*row]), policy).first()
    return r.triage, len(r.triage_reasons)


def test_triage_boundaries_and_override(spark):
    assert triage_row(spark, p=0.4, pt=0.4) == ("confident_clean", 0)
    assert triage_row(spark, p=0.6, pt=0.6) == ("confident_suspicious", 0)
    assert triage_row(spark, p=0.41, pt=0.4) == ("needs_manual_review", 1)
    assert triage_row(spark, p=0.59, pt=0.6) == ("needs_manual_review", 1)
    assert triage_row(spark, p=0.7, pt=0.95) == ("needs_manual_review", 1)
    assert triage_row(spark, p=0.05, pt=0.05, ood=0.6, coverage=0.1) == ("confident_clean", 0)  # low risk: overridden
    assert triage_row(spark, p=0.05, pt=0.05, ood=0.6, coverage=0.1, low_risk=False) == ("needs_manual_review", 2)
    assert triage_row(spark, p=0.05, pt=0.05, coverage=0.0, low_risk=False) == ("confident_clean", 0)  # exactly 0 reads as unknown
    assert triage_row(spark, p=0.05, pt=0.05, ood=0.8, ai=0.8) == ("needs_manual_review", 1)


def test_machine_text_order(spark):
    texts = [
        "Overall, this product delivers excellent quality and reliable performance. Moreover, the modern design exceeded my expectations. In conclusion, I highly recommend it to anyone.",
        "My husband uses it at work: the zipper scratched after two weeks, box arrived late and the size was off by 4 cm, i bought it for 20.",
        "Price is fair and worth the money, pleasantly surprised — shipping/support/packaging all fine here for us.",
        "Достоинства: оригинал, гарантия, звук. Недостатки: нет. Комментарий: доставка и упаковка, размер, цена адекватная, не жалко платить за такой товар в этот раз.",
    ]
    df = spark.createDataFrame([("p", i, "", t) for i, t in enumerate(texts)], "page_id string, record_id long, title string, review_text string")
    rows = machine_text.opening_boost(machine_text.ai_score(df)).orderBy("record_id").collect()
    generic, grounded, cliche, structured = [r.ai for r in rows]
    assert generic > grounded and cliche >= 0.74 and structured < cliche
    assert rows[2].ai_flag == 1 and any("dash" in x for x in rows[2].ai_reasons)


def test_photo_text(spark):
    df = spark.createDataFrame([(0, "p", "Скидка 50% на ozon", "ozon.ru"), (1, "p", "Скидка 50% на ozon", "amazon.com"), (2, "p", "a cat on a wholesale rug", "ozon.ru")], "record_id long, page_id string, ocr_text string, source_site string")
    rows = photo_text.photo_text(df).orderBy("record_id").collect()
    assert rows[0].photo_labels == ["marketplace_text", "sale_discount"] and rows[0].photo_text_flag == 0
    assert rows[1].foreign_markets == ["ozon"] and abs(rows[1].photo_text_score - 0.66) < 1e-9 and rows[1].photo_text_flag == 1
    assert rows[2].photo_labels == [] and rows[2].photo_text_score == 0.0


def test_url_hints(spark):
    df = spark.createDataFrame([(["https://x.com/banner/a.jpg"],), (["https://x.com/banner/user/a.jpg"],), (["https://x.com/ai_generated/user/a.jpg"],), (["https://x.com/diffusion/buyer/a.jpg"],), ([],)], "urls array<string>")
    rows = [(round(r[0], 4), round(r[1], 4)) for r in df.select(photos.stock_url_signal(F.col("urls")), photos.synthetic_url_signal(F.col("urls"))).collect()]
    assert rows == [(0.62, 0.0), (0.4, 0.0), (0.0, 0.66), (0.0, 0.24), (0.0, 0.0)]


def test_median_by_ranges_and_ranking(spark, monkeypatch):
    monkeypatch.setattr(ratings, "MEDIAN_ROWS", 10)
    df = spark.createDataFrame([(float(i * i % 97),) for i in range(500)] + [(None,)], "x double")
    assert ratings._middle(df, "x").first()[0] == df.agg(F.median("x")).first()[0]
    assert ratings._middle(df.filter("x < 0"), "x").first()[0] is None


def test_families_and_truncation(spark):
    df = spark.createDataFrame([("The scroll wheel clicks", "shop"), ("Nice hotel", "blog"), ("Any", "yelp:2020"), ("Nothing", "x")], "t string, s string")
    assert [r[0] for r in df.select(T.product_family(F.col("t"), F.col("s"))).collect()] == ["wireless_mouse", "travel", "local_business", "general"]
    assert df.select(T.truncate_text(F.col("t"), 12)).first()[0] == "The scroll..." and df.select(T.holdout_group(F.lit("Yelp"), F.lit("travel"), F.lit(""))).first()[0] == "source::yelp::product::travel"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user;product_id;stars;date\nu1;i1;5;2024-01-02\nu2;i2;x;2024-01-02\n")
    df = readers.prepare_ratings(readers.read_delimited(spark, f"{tmp_path}/a.csv"))
    assert [(r.user_id, r.rating) for r in df.collect()] == [("u1", 5.0)]
    (tmp_path / "r.json").write_text('{"data": {"records": [{"user_id": "u", "rating": 4.0}]}}')
    assert readers.read_records_json(spark, f"{tmp_path}/r.json", "user_id:string,rating:double").first().rating == 4.0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert readers.read_jsonl(spark, f"{tmp_path}/x.jsonl").count() == 2
    assert readers.match_columns(df, {"who": ["User-ID"], "stars": ["ating"]}).columns == ["who", "stars"]


def test_urls_and_labels(spark):
    urls = ["http://10.0.0.1/a", "https://cdn.shop.com/a.jpg?utm_x=1&b=2&a=1", "http://printer.local/x", "ftp://a.com/b", "https://8.8.8.8/i", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(T.is_safe_image_url(F.col("u"))).collect()] == [False, True, False, False, True, False]
    assert df.select(T.canonical_url(F.col("u"))).collect()[1][0] == "https://cdn.shop.com/a.jpg?a=1&b=2"
    items = spark.createDataFrame([("https://x.com/catalog/123/detail",), ("https://a.com/dp/B012345678",), ("https://y.ru/p?id=77",)], "u string")
    assert [r[0] for r in items.select(T.item_id_from_url(F.col("u"))).collect()] == ["123", "B012345678", "77"]
    pair = corpus.normalize_label(spark.createDataFrame([("-1",), ("1",)], "x string"), "x")
    assert [r.label for r in pair.collect()] == [1, 0]


def test_group_split_is_disjoint(spark):
    df = spark.range(500).select(F.concat(F.lit("g"), F.col("id") % 50).alias("g"))
    parts = evaluation.group_split(df, "g", {"train": 0.6, "validation": 0.2, "test": 0.2})
    assert evaluation.leaks(parts, "g").count() == 0 and parts.select("part").distinct().count() == 3


def test_streams_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.unionByName(events).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    run = streams.stream_dedupe(live).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()
    users = events.groupBy("user_id").agg(F.avg("value").alias("user_mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("user_std"))
    streams.stream_score(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), users, f"{tmp_path}/alerts", f"{tmp_path}/c2").awaitTermination(120)
    z = F.abs(F.col("value") - F.col("user_mean")) / (F.col("user_std") + 1e-3)
    assert spark.read.parquet(f"{tmp_path}/alerts").count() == 2 * events.join(users, "user_id").filter(z >= 2.0).count()
