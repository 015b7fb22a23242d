import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from trustloom.llm import fingerprints
from trustloom.llm.queries import op7_fingerprints

from .helpers import BIG, docs, empty, odd, odd_rows


def brute_edits(rows):
    rows = sorted(((i if i is not None else -(2**63), t or "") for i, t in rows), reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        out.append((i if i != -(2**63) else None, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    return Counter(out)


def test_fingerprints_of_edits(spark, sf):
    rows = op7_fingerprints(spark, sf).collect()
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == brute_edits(table)
    by_text = {}
    texts = dict(table)
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert sum(r.near_edited for r in rows) > 2 * sum(r.near_next for r in rows)


def test_fingerprints_with_gaps_in_ids(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(-(2**40), 2**40) if k % 3 else k, f"text {k}. More of {k}.\nLast") for k in range(300)]
    found = fingerprints.edited_fingerprints(docs(spark, rows), range_bits=3).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == brute_edits(rows)


def test_fingerprints_odd_rows(spark):
    found = fingerprints.edited_fingerprints(odd(spark)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == brute_edits([r[:2] for r in odd_rows()])
    assert fingerprints.edited_fingerprints(empty(spark)).count() == 0
    one = fingerprints.edited_fingerprints(docs(spark, [(5, "abcd")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_fingerprints_are_homomorphic(spark):
    df = docs(spark, [(1, "a\nb\nc"), (2, "c\na\nb"), (3, "a\nc"), (4, "b"), (5, "")])
    lanes = fingerprints.fingerprints(df, ["doc_id"])
    got = {r.doc_id: r.lanes for r in lanes.collect()}
    assert got[1] == got[2] != got[3] and not any(got[5])
    pair = spark.createDataFrame([(got[3], got[4], got[1])], "a array<long>, b array<long>, c array<long>")
    r = pair.select(fingerprints.combine(F.col("a"), F.col("b")).alias("sum"), fingerprints.combine(F.col("c"), F.col("b"), -1).alias("less")).first()
    assert r["sum"] == got[1] and r["less"] == got[3]


def multiset_likeness(a, b):
    a, b = (Counter(u for u in re.split(r"\n+|(?<=[.!?])\s+", t) if u) for t in (a, b))
    return sum((a & b).values()) / sum((a | b).values())


def test_likeness_does_not_fall_with_length(spark):
    rows = []
    for k, n in enumerate((12, 40, 300, 2000, 20000)):
        for side in (1, 0):
            rows.append((2 * k + side, " ".join(f"Sentence {i} of side {side} and text {k}." for i in range(n))))
    rows.append((10, "Again.\n" * 90 + "Once.\n" * 10))
    texts = dict(rows)
    found = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs(spark, rows)).collect()}
    for i, text in texts.items():
        after = texts[(i - 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert abs(found[i].near_edited - multiset_likeness(text, edited)) < 0.12, i
        assert abs(found[i].near_next - multiset_likeness(text, after)) < 0.05, i


def test_pipeline_stages(spark, sf):
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact", "near", "mix", "pack"]
    from .test_near_language import brute_classes

    now = docs_
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in now.collect()]
        now = corpus_pipeline.cut(stage(spark, now, sf))
        after = [(r.doc_id, r.text) for r in now.collect()]
        assert now.columns == docs_.columns and set(after) <= set(before)
        if name == "language":
            assert sorted(after) == sorted(r for r in before if any(c.isalpha() for c in r[1] or ""))
        elif name == "exact":
            assert sorted(after) == sorted((i, t) for t, i in {t: max(j for j, u in before if u == t) for _, t in before}.items())
        elif name == "near":
            assert sorted(i for i, _ in after) == sorted({c for _, c in brute_classes(before)})
        else:
            assert max(Counter(i for i, _ in after).values()) == 2
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in after}


def test_pipeline_of_odd_rows(spark, tmp_path):
    for k, df in enumerate((odd(spark), empty(spark))):
        df.drop("__id", "label", "node").write.parquet(f"{tmp_path}/{k}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/1").count() == 0
    rows = corpus_pipeline.run(spark, f"{tmp_path}/0").collect()
    texts = {i: t for i, t, *_ in odd_rows() if t and any(c.isalpha() for c in t)}
    # of equal texts the largest doc_id stays, of near ones too; ids of 1 to 5, 8 and 12 have no letter or are copies
    assert {r.doc_id for r in rows} <= {2, 7, 9, 10, 11, BIG} <= {*texts}
    assert 7 in {r.doc_id for r in rows}
