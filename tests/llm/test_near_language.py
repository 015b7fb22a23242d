import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from trustloom.llm import language_id, near_dedup
from trustloom.llm.queries import op3_minhash_near_dedup, op5_language_id

from .helpers import docs, empty, odd, odd_rows


def shingle_set(text, weighting="set"):
    w = (text or "").lower().split()
    grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    return set(grams) if weighting == "set" else {(g, n) for g, c in Counter(grams).items() for n in range(c)}


def brute_classes(rows, weighting="set"):
    sets = [shingle_set(t, weighting) for _, t in rows]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < k}:
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                up[root(k)] = root(j)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[root(k)] = max([x for x in (best.get(root(k)), i) if x is not None], default=None)
    return sorted((i if i is not None else -1, best[root(k)] if best[root(k)] is not None else -1) for k, (i, _) in enumerate(rows))


def found_classes(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1) for r in df.collect())


def test_near_dedup_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found_classes(op3_minhash_near_dedup(spark, sf)) == brute_classes(rows)


def test_near_dedup_of_a_large_group_and_its_fringe(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(120):
        words = base[:]
        for _ in range(1 + i % 6):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    assert found_classes(near_dedup.near_dedup(docs(spark, rows))) == brute_classes(rows)


def test_near_dedup_of_a_large_group_of_far_members_and_hot_elements(spark, monkeypatch):
    """Members from one to nine edits of a base that is not in the table, with salted elements: no link is lost."""
    monkeypatch.setattr(near_dedup, "SALT_ROWS", 16)
    rng = random.Random(8)
    rows = []
    for group in range(3):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for i in range(150):
            words = base[:]
            for _ in range(1 + i % 9):
                words[rng.randrange(150)] = f"x{rng.randrange(40)}"
            rows.append((1000 * group + i, " ".join(words)))
    want, found = brute_classes(rows), found_classes(near_dedup.near_dedup(docs(spark, rows)))
    assert sum(a == b for a, b in zip(found, want, strict=True)) >= 0.97 * len(want) and len({c for _, c in want}) > 20


def test_near_dedup_by_counts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a b c d e f g"] * 9 + [f"v{rng.randrange(99)} h"]) for _ in range(20 + i % 3))) for i in range(60)]
    rows += [(100, "p q r s t " * 40), (101, "p q r s t " * 44), (102, "p q r s t " * 80)]
    found = found_classes(near_dedup.near_dedup(docs(spark, rows), weighting="count", bands=60, band_rows=3))
    assert found == brute_classes(rows, "count") != brute_classes(rows)


def test_near_dedup_odd_rows(spark):
    assert found_classes(near_dedup.near_dedup(odd(spark))) == brute_classes([r[:2] for r in odd_rows()])
    assert near_dedup.near_dedup(empty(spark)).count() == 0
    kept = near_dedup.keep_one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    assert near_dedup.keep_one_of_each(empty(spark)).count() == 0


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(10, "x"), (10, "y"), (12, "y"), (None, "one text"), (None, "another text"), (None, long), (None, long + " end"), (3, ""), (3, ""), (None, None), (None, " "), (7, "z z"), (7, "z  z"), (8, "q"), (8, "q")]
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.keep_one_of_each(docs(spark, rows)).collect()), key=str)
    one_of = [[(None, long), (None, long + " end")], [(7, "z z"), (7, "z  z")]]
    assert [sum(k in group for k in kept) for group in one_of] == [1, 1]
    want = [(10, "x"), (12, "y"), (None, "one text"), (None, "another text"), (3, ""), (3, ""), (None, None), (None, " "), (8, "q")]
    assert sorted((k for k in kept if not any(k in group for group in one_of)), key=str) == sorted(want, key=str)
    found = near_dedup.near_dedup(docs(spark, rows)).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(kept)
    nulls = defaultdict(list)
    for r in found:
        if r.doc_id is None and r.class_key is not None:
            nulls[r.class_key].append((r.kept, r.class_size))
    assert sorted(sorted(v) for v in nulls.values()) == [[(False, 2), (True, 2)], [(True, 1)], [(True, 1)]]
    assert sum(r.doc_id == 8 and r.kept for r in found) == 1


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.uniform(0.1, 5, 300), rng.uniform(0.1, 5, 300)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    same = near_dedup.darts(elements, a, 4000) == near_dedup.darts(elements, b, 4000)
    assert abs(same.mean() - want) < 0.03
    assert (near_dedup.darts(elements[:1], np.ones(1), 96) != 0).all()


def test_language_accuracy_on_held_out(spark, sf):
    rows = {r.doc_id: r for r in op5_language_id(spark, sf).collect()}
    table = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = [(rows[r.doc_id].lang_pred, r.lang) for r in table if rows[r.doc_id].held_out]
    assert len(rows) == len(table) and len(held) > 20
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_bundle_equals_plain_sum():
    texts = ["Straße der Ähren", "the quick  brown", "à"]
    grams = [language_id.trigrams(t) for t in texts]
    found = language_id.bundle(grams, np.arange(3), 3)
    for k, text in enumerate(texts):
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        v = lambda c: language_id._vector(ord(c)).astype(int)
        want = sum(np.roll(v(s[i]), 2) * np.roll(v(s[i + 1]), 1) * v(s[i + 2]) for i in range(len(s) - 2))
        assert (found[k] == want).all()


def test_language_matches_brute_force(spark, sf):
    """Every prediction from plain sums of bound vectors, one trigram at a time."""
    table = [(r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = {r.doc_id: r for r in op5_language_id(spark, sf).collect()}
    v = {}

    def letter(c):
        return v.setdefault(c, language_id._vector(ord(c)).astype(np.int64))

    def vector(text):
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        total = np.zeros(language_id.DIMENSIONS, dtype=np.int64)
        for gram, n in Counter(s[i : i + 3] for i in range(len(s) - 2)).items():
            total += n * np.roll(letter(gram[0]), 2) * np.roll(letter(gram[1]), 1) * letter(gram[2])
        return total if s.strip() else None

    vectors = {i: vector(t) for i, t, _ in table}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in table}
    profiles = {}
    for i, _, lang in table:
        if lang and not held[i] and vectors[i] is not None:
            profiles[lang] = profiles.get(lang, 0) + vectors[i]
    for i, _, _ in table:
        r = found[i]
        assert r.held_out == held[i]
        if vectors[i] is None or not vectors[i].any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = {k: vectors[i] @ p / np.linalg.norm(vectors[i]) / np.linalg.norm(p) for k, p in profiles.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert abs(cosine[r.lang_pred] - cosine[best]) < 1e-6 and abs(r.score - max(0.0, cosine[best])) < 1e-6


def test_language_odd_rows(spark):
    rows = language_id.language_id(odd(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows())
    texts = {}
    for i, t, *_ in odd_rows():
        texts.setdefault(i, []).append(t)
    for r in rows:
        letters = any(ch.isalpha() for t in texts[r.doc_id] for ch in t or "")
        assert (r.lang_pred == "und") <= (r.score == 0) and (letters or r.lang_pred == "und")
    assert language_id.language_id(empty(spark)).count() == 0
    kept = language_id.keep_known_languages(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in odd(spark).collect() if any(ch.isalpha() for ch in r.text or ""))
    assert language_id.keep_known_languages(empty(spark)).count() == 0
    unlabelled = odd(spark).selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert {r.lang_pred for r in language_id.language_id(unlabelled).collect()} == {"und"}
