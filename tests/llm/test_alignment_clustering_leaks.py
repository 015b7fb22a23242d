import hashlib
import random
from bisect import bisect_left
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from trustloom.llm import alignment, clustering, decontamination, queries

from trustloom.llm.packing import byte_letters

from .helpers import BIG, docs, empty, odd

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def duck(sf, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return con.sql(sql)


# alignment


def tokens_of(text):
    """Ids and bytes of both sides from whole texts, without the operator's words."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(tokens_of, "a"):
        tokens_of.a, tokens_of.b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
        tokens_of.a.encode_special_tokens = True
        tokens_of.letters = {ch: bytes([b]) for ch, b in byte_letters().items()}
    a, b = tokens_of.a.encode(" " + text, add_special_tokens=False).ids, tokens_of.b.encode(text)
    raw_a = [b"".join(tokens_of.letters[ch] for ch in tokens_of.a.id_to_token(i)) for i in a]
    pieces = [tokens_of.b.id_to_piece(i) for i in b]
    raw_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
    return a, raw_a, b, raw_b


def brute_alignment(texts):
    found = []
    for text in texts:
        a, raw_a, b, raw_b = tokens_of(text) if text else ([], [], [], [])
        if not text or not b"".join(raw_a) == b"".join(raw_b) == b" " + text.encode():
            found.append((0, 0, [], []))
            continue
        spans_a, spans_b = [], []
        for raw, spans in ((raw_a, spans_a), (raw_b, spans_b)):
            at = 0
            for t in raw:
                spans.append((at, at + len(t)))
                at += len(t)
        owner = [j for j, (lo, hi) in enumerate(spans_b) for _ in range(lo, hi)]  # of each byte
        links = [(a[i], b[j]) for i, (lo, hi) in enumerate(spans_a) for j in sorted(set(owner[lo:hi]))]
        ends = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups = [([], []) for _ in ends]
        for side, ids, spans in ((0, a, spans_a), (1, b, spans_b)):
            for i, (_, e) in zip(ids, spans, strict=True):
                groups[bisect_left(ends, e)][side].append(i)
        found.append((len(a), len(b), groups, links))
    counts = Counter(p for f in found for p in set(f[3]))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for n_a, n_b, groups, links in found:
        said = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if links else ""))
    return out


HARD = ["a", " a", "a ", "a  b", "  lead", "tail  ", " ", "\n", "x\n y", "one.\nTwo three", "déjà vu \U0001f600 ünï ﬁ", "<|endoftext|> <s> </s> <0x41>", "mark▁inside", "tab\tand  \n\n gap", "　wide nbsp", "ab" * 90, "don't we'll they're", "\x00\x7f"]


def test_alignment_is_the_brute_force_one(spark):
    rng = random.Random(5)
    drawn = ["".join(rng.choice("ab é\n.'’▁漢1 ") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts = HARD + drawn + HARD[:3] + ["", None]
    want = [(i, *w) for i, w in enumerate(brute_alignment(texts))]
    got = alignment.alignment_report(docs(spark, list(enumerate(texts))), *PATHS)
    assert rows(got) == sorted(map(repr, want))
    shuffled = alignment.alignment_report(docs(spark, list(enumerate(texts))), *PATHS, max_broadcast=0)
    assert rows(shuffled) == sorted(map(repr, want))


def test_alignment_of_the_whole_table(spark, sf):
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in table if len(r[1] or "") < 600]
    got = {r.doc_id: tuple(r) for r in queries.op11_token_alignment(spark, sf).collect()}
    assert len(got) == len(table)
    parts = brute_alignment([t for _, t in short])  # counts are of the whole table: compare what does not hang on them
    assert all(got[i][1:5] == w[:4] and got[i][7] == w[6] for (i, _), w in zip(short, parts, strict=True))
    assert all(r[5] <= r[4] <= r[6] for r in got.values())


def test_window_memo_is_by_ids_and_bounded(monkeypatch):
    a = alignment.Aligner(*PATHS)
    a("the cat sat on the mat. the cat sat")
    key = a.encode("cat")[0]
    assert key in a.windows and a.windows[key][0] == b" cat"
    monkeypatch.setattr(alignment, "CACHE_ENTRIES", 3)
    small = alignment.Aligner(*PATHS)
    text = "many more words than the memo may hold, again many more words"
    assert small(text)[2] == a(text)[2] and len(small.words) <= 3 + len(text.split())


def test_alignment_odd_rows(spark):
    got = alignment.alignment_report(odd(spark), *PATHS)
    want = brute_alignment([r.text for r in odd(spark).collect()])
    assert sorted(repr(tuple(r)[1:]) for r in got.collect()) == sorted(map(repr, want))
    assert BIG in {r.doc_id for r in got.collect()}
    assert alignment.alignment_report(empty(spark), *PATHS).count() == 0
    aligned = alignment.align_documents(docs(spark, [(1, "the cat"), (2, "the dog")]), *PATHS, with_groups=True)
    assert all(r.groups.count("|") == r.n_groups for r in aligned.collect())
    partners = alignment.partner_table(alignment.link_counts(aligned)).collect()
    assert max(r.n_docs for r in partners) == 2


# clustering


def brute_kmeans(vectors, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    c = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for step in range(rounds + 1):
        far = [[sum((p - q) ** 2 for p, q in zip(x, y, strict=True)) for y in c] for _, x in kept]
        near = [row.index(min(row)) for row in far]
        if step < rounds:
            for j in range(len(c)):
                if own := [x for (_, x), n in zip(kept, near, strict=True) if n == j]:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    d = [row[n] for row, n in zip(far, near, strict=True)]
    return [(i, n, dist, sum(x for x, m in zip(d, near, strict=True) if m == n), sum(d), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), n, dist in zip(kept, near, d, strict=True)]


VECTORS = "vec_id long, embedding array<double>, label int, cluster int, x long"


def test_clusters_are_the_brute_force_ones(spark):
    rng = random.Random(3)
    data = [(i, [rng.choice([-0.5, -0.01, 0.0, 0.3, 7.9]) for _ in range(64)]) for i in range(60)]
    data += [data[0], (7, data[1][1]), (None, data[2][1]), (None, [0.0] * 64), (BIG, [-3.3] * 64)]
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [None] + [1.0] * 63), (104, [float("nan")] * 64), (105, [float("inf")] * 64), (106, [1.0] * 65)]
    for rows_ in (data, data[:5], [(1, [2.0] * 64)] * 40):
        df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows_ + bad], VECTORS)
        assert rows(clustering.cluster_vectors(df)) == sorted(map(repr, brute_kmeans(rows_)))
    assert clustering.cluster_vectors(spark.createDataFrame([(i, v, 1, 2, 3) for i, v in bad], VECTORS)).count() == 0
    assert clustering.cluster_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(Exception, match="too large"):
        clustering.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64, 1, 2, 3)], VECTORS)).collect()


def test_clusters_equal_sql(spark, sf):
    got = queries.op12_centroid_clustering(spark, sf)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows(got) == sorted(map(repr, duck(sf, queries.ORACLES["op12_centroid_clustering"]).fetchall()))


def test_dots_are_kept_not_made_anew(spark, sf):
    kept = clustering.kept_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))
    state, centroids = clustering.assign(kept, clustering.first_centroids(kept))
    assert all((np.array(r.x) @ centroids.T == np.array(r.dots)).all() for r in state.collect())


# decontamination


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or ord(c) > 127 else " " for c in low).split(" ")


def brute_leaks(texts, items, window=10):
    found = []
    for text in texts:
        words, hit, names = [w for w in words_of(text) if w], set(), set()
        for name, item in items:
            own = [w for w in words_of(item) if w]
            for win in {tuple(own[i : i + window]) for i in range(max(len(own) - window, 0) + 1)} if own else ():
                for i in range(len(words) - len(win) + 1):
                    if tuple(words[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        names |= {str(name)} if name is not None else set()
        found.append((len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return found


def test_leaks_are_the_brute_force_ones(spark):
    rng = random.Random(9)
    draw = lambda n: " ".join(rng.choice(["a", "B", "é", "7"]) for _ in range(n))
    for window in (2, 4, 10):
        items = [(k, draw(rng.randint(0, 14))) for k in range(6)] + [(3, draw(12)), (None, draw(11)), (20, None), (21, "!? .")]
        texts = [draw(rng.randint(0, 40)) for _ in range(60)] + ["", None, "\n", "É a.b,C"] + [f"xx {t}! yy" for _, t in items if t]
        want = sorted(repr((i, *w)) for i, w in enumerate(brute_leaks(texts, items, window)))
        bench = spark.createDataFrame(items, "item_id long, text string")
        for shard_words in (10_000, 30):
            got = decontamination.contamination_report(docs(spark, list(enumerate(texts))), bench, window, shard_words)
            assert rows(got) == want
    long_item = draw(90)
    parts, shards = decontamination.shards_of(spark.createDataFrame([(1, long_item)], "item_id long, text string"), 10, 30, 15)
    assert len(shards) > 1 and parts.count() > 1
    pieces = [bytes(r.words).split() for r in parts.collect()]
    own = decontamination.spaced(long_item).split()
    assert {tuple(own[i : i + 10]) for i in range(81)} == {tuple(p[i : i + 10]) for p in pieces for i in range(len(p) - 9)}


def test_leaks_equal_sql(spark, sf):
    got = rows(queries.op13_decontamination(spark, sf))
    assert got == sorted(map(repr, duck(sf, queries.ORACLES["op13_decontamination"]).fetchall()))
    assert any("True" in r for r in got)


def test_leaks_odd_rows(spark):
    bench = spark.createDataFrame([(BIG, "alpha BETA gamma", 1), (None, "x", 2), (5, "Word one two three four word one two three four word one", 3), (6, None, 4)], "item_id long, text string, doc_id long")
    got = decontamination.contamination_report(odd(spark), bench)
    want = brute_leaks([r.text for r in odd(spark).collect()], [tuple(r)[:2] for r in bench.collect()])
    assert sorted(repr(tuple(r)[1:]) for r in got.collect()) == sorted(map(repr, want))
    assert decontamination.contamination_report(empty(spark), bench).count() == 0
    none = decontamination.contamination_report(odd(spark), bench.limit(0))
    assert none.count() == odd(spark).count() and none.filter("contaminated or n_items > 0").count() == 0


def test_leaks_are_cut_from_texts(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "secret answer")], "item_id long, text string")
    text = "Keep this, and this too; ONE two three: four five six seven eight nine ten eleven. And the É end of it all stays, as do these words."
    table = spark.createDataFrame([(1, text, 4, "h"), (2, "the secret-answer", 5, "h"), (3, "nothing here", 6, "h"), (4, None, 7, "h"), (5, "", 8, "h"), (6, "they keep a Secret  Answer inside", 9, "h")], "doc_id long, text string, n_words long, hits string")
    got = {r.doc_id: r for r in decontamination.decontaminate(table, bench).collect()}
    assert got.keys() == {1, 3, 4, 5, 6}
    assert got[1].text == "Keep this, and this too; . And the É end of it all stays, as do these words." and got[1].n_words == 4 and got[1].hits == "h"
    assert got[6].text == "they keep a  inside" and got[3].text == "nothing here" and got[4].text is None and got[5].text == ""
    longer = {r.doc_id: r.text for r in decontamination.decontaminate(table, bench, min_words=5).collect()}
    assert longer[2] == "the secret-answer" and "Secret" in longer[6] and "ONE" not in longer[1]
