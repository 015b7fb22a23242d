"""Exact dedup by deterministic block naming, in DataFrame functions only.

A text is cut into fixed-size blocks. Distinct blocks are sorted and get integer names; then adjacent
names are paired, distinct pairs get integer names, and so on until each document has one name. Two
documents have the same (level, name) exactly if their texts are identical: names are given to the
blocks and pairs themselves, so hash collisions cannot join different texts.

Names are given inside hash buckets (name = place in the bucket * buckets + bucket), so that no task
sorts all keys. A hot block or pair is reduced by partial aggregation before the shuffle, and its
occurrences get their name in an inner join that AQE can split.

Defined cases: null text counts as empty; an empty text is one empty block. Rows that repeat a doc_id
with the same text count separately in group_size, and only one of them is kept. Rows that share a
doc_id but not the text are different documents. A null doc_id stays only if its group has no other.
An empty table gives an empty result. Columns other than doc_id and text are never read here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_row, bucket_of, cut, text_of

BLOCK_CHARS = 4096
BUCKETS = 65536


def _blocks(block_chars: int) -> Column:
    """Consecutive blocks of block_chars code points; [''] for the empty text."""
    found = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(found)


def _name_blocks(docs: DataFrame, block_chars: int, hash_bits: int) -> DataFrame:
    """doc_id, sha, pos, name: the first level.

    The sort key is (hash, block). Where one block has a hash for itself, which the distinct table
    shows, the hash stands for it in the join; blocks that share a hash are told apart by their text.
    """
    occ = docs.select("doc_id", "sha", F.posexplode(_blocks(block_chars)).alias("pos", "block"))
    occ = occ.withColumn("h", F.shiftright(F.xxhash64("block"), 64 - hash_bits) if hash_bits < 64 else F.xxhash64("block"))
    per_hash = occ.select("h", "block").distinct().groupBy("h").agg(F.count("*").alias("n"))
    per_hash = cut(per_hash)
    w = W.partitionBy("bucket").orderBy("h").rowsBetween(W.unboundedPreceding, -1)
    starts = per_hash.withColumn("bucket", bucket_of(F.col("h"), buckets=BUCKETS)).withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))
    name = (F.col("start") * BUCKETS + F.col("bucket")).alias("name")
    alone = occ.select("doc_id", "sha", "pos", "h").join(starts.filter("n = 1").select("h", name), "h").drop("h")
    if per_hash.filter("n > 1").isEmpty():
        return alone
    shared = occ.join(starts.filter("n > 1").select("h", "start", "bucket"), "h")
    ranked = shared.select("h", "block", "start", "bucket").distinct().withColumn("start", F.col("start") + F.row_number().over(W.partitionBy("h").orderBy("block")) - 1)
    return alone.unionByName(shared.select("doc_id", "sha", "pos", "h", "block").join(ranked.select("h", "block", name), ["h", "block"]).drop("h", "block"))


def _gather(named: DataFrame, copies: Column) -> DataFrame:
    """One row per document with its names in order. Its length is bounded by the document's own blocks."""
    names = F.transform(F.array_sort(F.collect_set(F.struct("pos", "name"))), lambda x: x["name"])
    return named.groupBy("doc_id", "sha").agg(names.alias("names"), copies.alias("copies"))


def name_documents(docs: DataFrame, block_chars: int = BLOCK_CHARS, hash_bits: int = 64) -> DataFrame:
    """doc_id, sha (binary), copies, level, name; one row per distinct (doc_id, text)."""
    text = docs.select("doc_id", text_of().alias("text"))
    named = _name_blocks(text.withColumn("sha", F.unhex(F.sha2("text", 256))), block_chars, hash_bits)
    level, found = 0, None
    now = cut(_gather(named, F.sum(F.when(F.col("pos") == 0, 1).otherwise(0))))
    while True:
        done = now.filter(F.size("names") == 1).select("doc_id", "sha", "copies", F.lit(level).alias("level"), F.col("names")[0].alias("name"))
        found = done if found is None else found.unionByName(done)
        longest = now.agg(F.max(F.size("names"))).first()[0] or 0
        if longest <= 1:
            return found
        level += 1
        pair = lambda j: F.struct(F.get("names", 2 * j).alias("a"), F.coalesce(F.get("names", 2 * j + 1), F.lit(-1)).alias("b"))
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")), pair)
        occ = now.filter(F.size("names") > 1).select("doc_id", "sha", "copies", F.posexplode(pairs).alias("pos", "p")).select("doc_id", "sha", "copies", "pos", "p.a", "p.b")
        distinct = occ.select("a", "b").distinct().withColumn("bucket", bucket_of(F.col("a"), F.col("b"), buckets=BUCKETS))
        place = F.row_number().over(W.partitionBy("bucket").orderBy("a", "b")) - 1
        names = distinct.select("a", "b", (place.cast("long") * BUCKETS + F.col("bucket")).alias("name"))
        now = cut(_gather(occ.join(names, ["a", "b"]), F.max("copies")))


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    named = cut(name_documents(docs, block_chars, hash_bits))
    groups = named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    rows = named.join(groups, ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, all columns."""
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__sha"))
    own = as_row(docs, __key=F.col("doc_id"), __own=F.unhex(F.sha2(text_of(), 256)))
    joined = own.join(kept, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")))
    return joined.dropDuplicates(["__id", "__sha"]).select("__row.*")
