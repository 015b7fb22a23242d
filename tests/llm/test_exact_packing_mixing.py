import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trustloom.llm import exact_dedup, mixing, packing
from trustloom.llm.queries import op2_best_fit_packing, op9_mixing, tokenizer_path

from .helpers import LONG, docs, empty, odd, odd_rows


def expected_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for i, t in rows:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        out[(i, keep, len(same), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    return out, len(groups)


@pytest.mark.parametrize("block_chars,hash_bits", [(4096, 64), (7, 64), (7, 3)])
def test_exact_dedup_matches_brute_force(spark, block_chars, hash_bits):
    rows = exact_dedup.exact_dedup(odd(spark), block_chars, hash_bits).collect()
    want, groups = expected_groups([r[:2] for r in odd_rows()])
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == groups


def test_exact_dedup_near_misses_and_empty(spark):
    rows = [(i, "ab" * 40 + ch + "ab" * 40) for i, ch in enumerate("xyzx")] + [(9, "ab" * 40)]
    found = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs(spark, rows), 8, 2).collect()}
    assert found == {0: 3, 1: 1, 2: 2, 3: 3, 9: 9}
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    kept = exact_dedup.keep_first_copies(odd(spark))
    assert kept.columns == odd(spark).columns
    assert kept.count() == expected_groups([r[:2] for r in odd_rows()])[1]


def read_pieces(rows, capacity=1024):
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by_seq


def brute_pieces(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    out = Counter()
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))] += 1
    return out


def test_packing_matches_tokenizer_and_fits(spark, sf):
    rows = op2_best_fit_packing(spark, sf).collect()
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute_pieces(table)
    bins = read_pieces(rows)
    assert len(bins) <= 1.03 * sum(r.length for r in rows) / 1024 + 1


def test_packing_odd_rows(spark):
    rows = packing.pack_documents(odd(spark), tokenizer_path(), with_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute_pieces([r[:2] for r in odd_rows()])
    assert len({(r.doc_id, r.copy, r.piece) for r in rows}) == len(rows)
    assert all(len(r.ids) == r.length for r in rows)
    read_pieces(rows)
    assert packing.pack_documents(empty(spark), tokenizer_path()).count() == 0


def test_encoder_equals_tokenizer_on_hard_texts():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    for text in ["", " ", "  a  b ", "a\n b", "a \n b\t c", "x<|endoftext|> y", "don't  stop\n\n now ", "é b c  d", LONG[:500], "a" * 300 + " b", " \n\t "]:
        assert np.frombuffer(enc(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_best_fit_meets_every_constraint():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 1024, 800).astype(float)
    need = np.stack([tokens, np.ones_like(tokens), tokens**2], axis=1)
    capacity = np.array([1024, 3, 600_000.0])
    tokens = tokens[tokens**2 <= capacity[2]]
    need = need[need[:, 2] <= capacity[2]]
    for rule in ("norm", "dot"):
        bins, offsets = packing.best_fit(need, capacity, np.array([1.0, 0.5, 0.5]), rule)
        for b in range(bins.max() + 1):
            own = need[bins == b]
            assert (own.sum(axis=0) <= capacity + 1e-6).all()
            assert sorted(offsets[bins == b]) == [0, *np.cumsum(own[np.argsort(offsets[bins == b]), 0])[:-1]]


def test_packing_under_limits_that_bind(spark, sf):
    """No sequence holds more tokens, documents or attention cost than its capacity, and the smaller capacities do bind."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    free = packing.pack_documents(table, tokenizer_path(), 4096).select("sequence_id").distinct().count()
    for rule in ("norm", "dot"):
        rows = packing.pack_documents(table, tokenizer_path(), 4096, max_documents=3, max_attention=6_000_000, weights=(1.0, 0.5, 0.5), rule=rule).collect()
        bins = read_pieces(rows, 4096)
        assert max(len(b) for b in bins.values()) == 3
        cost = [(len(b), sum(n * n for _, n in b)) for b in bins.values()]
        assert all(c <= 6_000_000 or k == 1 for k, c in cost) and max(c for k, c in cost if k > 1) > 5_000_000
        assert len(bins) > free


def test_encoder_of_a_file_that_is_not_plain_byte_bpe(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(Tokenizer.from_file(tokenizer_path()).to_str())
    assert packing.plain_byte_bpe(json.dumps(spec))
    spec["normalizer"] = {"type": "Lowercase"}
    assert not packing.plain_byte_bpe(json.dumps(spec))
    (tmp_path / "t.json").write_text(json.dumps(spec))
    enc, tok = packing.Encoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    text = "Some Text Of MANY words"
    assert np.frombuffer(enc(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def brute_targets(sizes):
    weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))]
    total, capped = 1.5 * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(2 * sizes[i] for i in capped)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > 2 * sizes[i]}
        if not over:
            return [2.0 * s if i in capped else share[i] for i, s in enumerate(sizes)]
        capped |= over


def test_mixing_meets_targets(spark, sf):
    import re

    rows = op9_mixing(spark, sf).collect()
    table = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = Counter()
    for source, n in table.values():
        sizes[source] += n
    order = sorted(sizes)
    want = dict(zip(order, brute_targets([sizes[s] for s in order]), strict=True))
    taken = Counter()
    for r in rows:
        source, n = table[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[source]) and abs(r.target - want[source]) < 1e-6
        assert r.taken <= 2 * r.size
        taken[source] += r.taken
    assert len(rows) == len(table)
    assert all(abs(taken[s] - want[s]) <= 8 * mixing.LEAST_BLOCK for s in order)
    assert sorted(op9_mixing(spark, sf).collect()) == sorted(rows)
    assert brute_taken([(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], want, order) == {r.doc_id: r.taken for r in rows}


def brute_taken(table, want, order, block=mixing.LEAST_BLOCK, seed=1):
    """Word by word: slots call for blocks of a source's documents, laid end to end by the hash of their order."""
    import re
    from itertools import cycle, islice

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.getActiveSession()
    hashed = spark.createDataFrame([(i, t) for i, t, _ in table], "doc_id long, text string").select("doc_id", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed)).alias("o")).collect()
    place = {r.doc_id: ((r.o >> 52) % mixing.RANGES, r.o, r.doc_id) for r in hashed}
    words = {s: [] for s in order}
    for i, t, s in sorted(table, key=lambda r: place[r[0]]):
        words[s] += [i] * len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(want.values())
    edges = np.cumsum([want[s] / total for s in order])
    calls = Counter()
    for t in range(-(-int(np.ceil(total)) // block)):
        point = (t + 1) * mixing.GOLDEN % 2**64 / 2**64
        calls[order[min(int(np.searchsorted(edges, point * edges[-1], side="right")), len(order) - 1)]] += 1
    taken = Counter()
    for s in order:
        taken.update(islice(cycle(words[s]), min(calls[s] * block, 2 * len(words[s]))))
    return {i: taken[i] for i, _, _ in table}


def test_the_schedule_decides_what_is_taken(spark, sf, monkeypatch):
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    before = sorted(mixing.mix_report(docs_).collect())

    def backwards(cumulative):
        def run(batches):
            for batch in batches:
                yield batch.rename(columns={"id": "slot"}).assign(source_no=np.int32(0))

        return run

    monkeypatch.setattr(mixing, "_schedule", backwards)
    after = sorted(mixing.mix_report(docs_).collect())
    assert before != after and sum(r.taken for r in after) < sum(r.taken for r in before)


def test_mixing_parts_are_equal_blocks_and_schedule_is_even(spark, sf):
    own = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS uid", "doc_id", "source", "cast(regexp_count(coalesce(text, ''), '[^\\\\x20\\\\x09-\\\\x0D]+') as long) AS size", "xxhash64(text) AS h")
    laid, stretches = mixing.plan_mix(own, block_tokens=256)
    parts = mixing.mix_parts(laid, stretches)
    slots = [r for r in parts.groupBy("slot").sum("part_length").collect()]
    assert max(r[1] for r in slots) == 256
    assert sum(r[1] < 256 for r in slots) <= 20  # the last block of each source
    taken = Counter()
    for r in parts.collect():
        taken[r.uid] += r.part_length
    assert taken == {r.uid: r.taken for r in laid.collect() if r.taken}
    source = {r.uid: r.source_no for r in laid.collect()}
    order = [source[r.uid] for r in parts.orderBy("slot").collect()]
    half = Counter(order[: len(order) // 2])
    assert all(abs(half[s] - n / 2) <= max(6, 0.2 * n) for s, n in Counter(order).items())


def test_mixing_odd_rows(spark):
    rows = mixing.mix_report(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    assert all(r.taken <= 2 * r.size for r in rows)
    mixed = mixing.mix_documents(odd(spark))
    assert mixed.columns == odd(spark).columns and mixed.count() > 0
    assert mixing.mix_report(empty(spark)).count() == 0
    assert mixing.mix_documents(empty(spark)).count() == 0
