"""Terms counted in batches against rows of one term each."""

import math
import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from trustloom.functions import text as T
from trustloom.operators import corpus, terms, text_models
from trustloom.plans.registry import QUERIES

TEXTS = ["good good phone case", "it's a kettle-lamp, a kettle", "дом и сад дом", "a𝔸b 𝔸", "x", "", None, "one two", "good phone", "  ", "a b a b a b"]


def _reviews(spark):
    return spark.createDataFrame([(i, t, 5.0 - i % 3, i % 2) for i, t in enumerate(TEXTS * 3)], "record_id long, review_text string, rating double, label int")


@pytest.mark.parametrize("words", [1 << 19, 5])
def test_terms_of_batches_are_the_terms_of_texts(spark, words, monkeypatch):
    monkeypatch.setattr(terms, "WORDS", words)
    df = _reviews(spark)
    plain = text_models._grams(df, ["word", "char"])
    want = plain.groupBy("kind", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    batches = pa.Table.from_pylist([{"tok": r.tok} for r in df.selectExpr(r"regexp_extract_all(lower(coalesce(review_text, '')), '[\\p{L}\\p{N}_\'-]+', 0) as tok").collect()], pa.schema([("tok", pa.list_(pa.string()))])).to_batches()
    found = {}
    for r in (r for b in terms._counter(["word", "char"])(iter(batches)) for r in b.to_pylist()):
        old = found.get((r["kind"], r["term"]), (0, 0))
        found[r["kind"], r["term"]] = (old[0] + r["df"], old[1] + r["total"])
    assert found == {(r.kind, r.term): (r.df, r.total) for r in want.collect()}
    assert sorted(map(tuple, terms.counts(df, ["word", "char"]).select("kind", "term", "df", "total").collect())) == sorted(map(tuple, want.select("kind", "term", "df", "total").collect()))


def test_weights_of_batches_are_the_weights_of_texts(spark):
    df = _reviews(spark)
    plain = text_models._grams(df, ["word", "char"]).collect()
    some = random.Random(3).sample(sorted({(r.kind, r.term) for r in plain}), 60)
    place = {key: i for i, key in enumerate(some)}
    vocabulary = spark.createDataFrame([(k, t, i, 1 + i / 7) for (k, t), i in place.items()], "kind string, term string, place int, idf double")
    want = {i: {} for i in range(len(TEXTS) * 3)}
    for kind in ("word", "char"):
        own = {}
        for r in plain:
            if r.kind == kind and (kind, r.term) in place:
                own.setdefault(r.record_id, {})[place[kind, r.term]] = (1 + math.log(r.tf)) * (1 + place[kind, r.term] / 7)
        for k, w in own.items():
            want[k] |= {i: x / math.sqrt(sum(y * y for y in w.values())) for i, x in w.items()}
    made = text_models.text_vectors(df, vocabulary, 60, ["rating"], {"label": F.col("label").cast("double")})
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()  # was a row for each term of each text
    rows = made.collect()
    assert len(rows) == len(want) and {r.label for r in rows} == {0.0, 1.0}
    for r in rows:
        got = dict(zip(r.features.indices.tolist(), r.features.values.tolist()))
        assert got.pop(60) == 5.0 - r.record_id % 3 and r.features.size == 61
        assert got.keys() == want[r.record_id].keys() and all(abs(got[i] - w) < 1e-12 for i, w in want[r.record_id].items())
    empty = vocabulary.limit(0)
    assert [r.features.indices.tolist() for r in text_models.text_vectors(df, empty, 0, ["rating"]).collect()] == [[0]] * len(rows)


@pytest.mark.parametrize("top", [7, 1000])
def test_char_weights_are_those_of_a_row_for_each_gram(spark, top):
    df = _reviews(spark).select("record_id", "review_text")
    df = df.unionByName(df.filter("record_id < 3").withColumn("review_text", F.lit("another phone")))  # records of two rows
    want = {(r.record_id, r.term): r.weight for r in corpus.tfidf(df, top=top, terms=corpus.char_grams(F.col("review_text"))).collect()}
    rows = corpus.char_tfidf(df, top=top).collect()
    got = {(r.record_id, r.term): r.weight for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and all(abs(got[k] - w) < 1e-12 for k, w in want.items())
    assert corpus.char_tfidf(df.limit(0)).count() == 0


def test_the_char_query_makes_no_row_for_each_gram(spark, sf):
    plan = QUERIES["k01_char_tfidf"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan  # n-grams of all texts were rows


def test_probability_and_coverage_come_from_one_pass_over_words(spark):
    df = _reviews(spark)
    terms_ = [("char", " go", 1.5), ("word", "a", 1.0), ("word", "good", 2.0), ("word", "good phone", 1.2), ("word", "сад", 1.1)]
    vocabulary = spark.createDataFrame([(k, t, i, x) for i, (k, t, x) in enumerate(terms_)], "kind string, term string, place int, idf double")
    of = [0.5, -1.0, 2.0, 0.25, 1.5, 0.1]
    model = text_models.TextModel(vocabulary, 5, ["rating"], SimpleNamespace(coefficients=Vectors.dense(of), intercept=-0.2), 0.1, 0.0)
    out = model.scores(df)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()  # words were rows once more for the coverage
    known = F.array(F.lit("a"), F.lit("good"), F.lit("сад"))
    want = {r.record_id: r.c for r in df.select("record_id", T.lexical_coverage(T.tokens(F.col("review_text")), known).alias("c")).collect()}
    vectors = {r.record_id: r.features for r in text_models.text_vectors(df, vocabulary, 5, ["rating"]).collect()}
    rows = out.collect()
    assert len(rows) == len(want) and all(r.coverage == want[r.record_id] for r in rows)
    assert all(abs(r.p - 1 / (1 + math.exp(0.2 - vectors[r.record_id].dot(of)))) < 1e-12 for r in rows)
