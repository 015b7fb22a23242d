"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are laid end to end in a hashed order, pass after pass, and cut into blocks of equal
words. The mix is a sequence of slots: slot t gets the golden-ratio point frac((t + 1) / phi), which a search in
the cumulative target shares maps to a source, and the r-th slot of a source carries its r-th block. So what a
source gives is what the schedule calls for: as many blocks as it has slots, a few more or less than its target
(the sequence's discrepancy), and never more than MOST_PASSES times its words. Blocks are BLOCK_TOKENS words, or
fewer in a small table, where the targets would otherwise hold few blocks.

Offsets and slot ranks are two-level prefix sums over hash or slot ranges, so a source with a third of all
rows is spread over many tasks; the slots themselves are made by the executors. One row per source goes to the
driver; more than MAX_SOURCES is an error.

Defined cases: null text has size 0, and documents of size 0 are never taken. A null source is a source,
sorted last. Repeated rows are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, as_row, cut

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_PASSES = 2.0
BLOCK_TOKENS, LEAST_BLOCK, WANTED_BLOCKS = 1024, 8, 1 << 18
RANGES = 4096
SLOTS_PER_RANGE = 16384
MAX_SOURCES = 1_000_000
#: Up to this many sources their table is sent to every executor.
BROADCAST_SOURCES = 10_000
#: The golden ratio's inverse as a fraction of 2^64.
GOLDEN = 0x9E3779B97F4A7C15


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, most: float = MOST_PASSES) -> np.ndarray:
    """Targets by weight, none above most times its source's size, the excess shared again until none is above."""
    caps, total = most * sizes, share * sizes.sum()
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool)
    while free.any():
        left = max(0.0, total - caps[~free].sum())
        out = np.where(free, left * weights / weights[free].sum(), caps)
        over = free & (out > caps)
        if not over.any():
            break
        free &= ~over
    return np.minimum(out, caps)


def _schedule(cumulative: np.ndarray):
    """Slots to sources: the place of each slot's golden-ratio point in the cumulative shares."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slot = batch["id"].to_numpy()
            point = ((slot.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)).astype(np.float64) / 2.0**64
            found = np.minimum(np.searchsorted(cumulative, point * cumulative[-1], side="right"), len(cumulative) - 1)
            yield pd.DataFrame({"slot": slot, "source_no": found.astype(np.int32)})

    return run


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> pd.DataFrame:
    """source, source_no, source_size, target; sources by code point, null last."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, [*map(ord, r["source"] or "")]))
    size = np.array([r["source_size"] for r in rows], dtype=np.float64)
    weight = np.array([weights[i % len(weights)] for i in range(len(rows))])
    return pd.DataFrame({"source": [r["source"] for r in rows], "source_no": np.arange(len(rows), dtype=np.int32), "source_size": size.astype(np.int64), "target": targets(size, weight, share, most)})


def _slots(spark: SparkSession, target: np.ndarray, block: int) -> DataFrame:
    """slot, source_no, block: the rank of the slot among those of its source."""
    total = int(np.ceil(target.sum() / block))
    if not total:
        return spark.createDataFrame([], "slot long, source_no int, block long")
    drawn = spark.range(total).mapInPandas(_schedule(np.cumsum(target / target.sum())), "slot long, source_no int").withColumn("range", F.floor(F.col("slot") / SLOTS_PER_RANGE))
    sums = drawn.groupBy("source_no", "range").agg(F.count("*").alias("n"))
    before = sums.select("source_no", "range", (F.sum("n").over(W.partitionBy("source_no").orderBy("range")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("range", "source_no").orderBy("slot")) - 1
    return drawn.withColumn("within", rank).join(before, ["source_no", "range"]).select("slot", "source_no", (F.col("before") + F.col("within")).alias("block"))


def _lay(sized: DataFrame, info: DataFrame, seed: int) -> DataFrame:
    """sized beside info's columns and at, the words of the source before each document."""
    docs = sized.join(info.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "source")
    docs = docs.withColumn("order", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "h", F.lit(seed)))
    docs = docs.withColumn("range", F.pmod(F.shiftright("order", 52), F.lit(RANGES)))
    sums = docs.groupBy("source_no", "range").agg(F.sum("size").alias("n"))
    before = sums.select("source_no", "range", (F.sum("n").over(W.partitionBy("source_no").orderBy("range")) - F.col("n")).alias("before"))
    inner = W.partitionBy("source_no", "range").orderBy("order", "doc_id", "h", "uid")
    laid = docs.withColumn("within", F.sum("size").over(inner) - F.col("size")).join(before, ["source_no", "range"])
    return laid.withColumn("at", F.col("before") + F.col("within")).drop("range", "before", "within", "order")


def plan_mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES, block_tokens: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """From rows of (uid, doc_id, source, size, h), uid unique: the documents with source_no, source_size, target,
    at and taken; and the slots of the mix (slot, source_no, block, begin, end), where begin and end count the
    source's words, pass after pass.
    """
    spark = sized.sparkSession
    table = source_targets(sized, weights, share, most)
    target = table["target"].to_numpy()
    block = block_tokens or int(np.clip(target.sum() // WANTED_BLOCKS, LEAST_BLOCK, BLOCK_TOKENS))
    slots = cut(_slots(spark, target, block))
    info = spark.createDataFrame([(s, int(n), int(z), float(t)) for s, n, z, t in table.itertuples(index=False)], "source string, source_no int, source_size long, target double")
    limit = F.floor(F.col("source_size") * most).cast("long")
    given = slots.groupBy("source_no").agg(F.count("*").alias("blocks"))
    info = info.join(given, "source_no", "left").withColumn("end", F.least(F.coalesce("blocks", F.lit(0)) * block, limit)).drop("blocks")
    info = F.broadcast(info) if len(table) <= BROADCAST_SOURCES else info
    laid = _lay(sized, info, seed)
    passes = int(np.ceil(most))
    inside = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("end") - F.col("at") - p * F.col("source_size"))) for p in range(passes)]
    laid = cut(laid.withColumn("taken", sum(inside[1:], inside[0])))
    stretch = slots.join(info.select("source_no", F.col("end").alias("last")), "source_no").withColumns({"begin": F.col("block") * block, "end": F.least((F.col("block") + 1) * block, F.col("last"))})
    return laid, stretch.filter("begin < end").select("slot", "source_no", "block", "begin", "end").withColumn("words", F.lit(block))


def mix_parts(laid: DataFrame, stretches: DataFrame) -> DataFrame:
    """slot, uid, pass, part_start, part_length: the documents' words inside each slot's block, cut at block borders."""
    passes = F.when(F.col("source_size") > 0, F.ceil(F.col("end") / F.col("source_size"))).otherwise(0).cast("int")
    rows = laid.filter("taken > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    lo = F.col("at") + F.col("pass") * F.col("source_size")
    rows = rows.select("uid", "source_no", "pass", lo.alias("lo"), F.least(lo + F.col("size"), F.col("end")).alias("hi")).filter("lo < hi")
    words = stretches.select("words").limit(1)
    rows = rows.join(F.broadcast(words), F.lit(True))  # one row
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / F.col("words")), F.floor((F.col("hi") - 1) / F.col("words"))))).drop("words")
    both = rows.join(stretches.drop("words"), ["source_no", "block"])
    a, b = F.greatest("lo", "begin"), F.least("hi", F.col("end"))
    return both.select("slot", "uid", "pass", (a - F.col("lo")).alias("part_start"), (b - a).alias("part_length"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    sized = cut(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", _size().alias("size"), F.xxhash64("text").alias("h")))
    return plan_mix(sized, **how)[0].select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix has them: each row as many times as the rounded passes over it, all columns.

    Rows lie in the order of the slots where their words begin: each output file is a share of the mix, dealt by
    a hash of the rows, in slot order.
    """
    own = cut(as_row(docs, uid=F.monotonically_increasing_id(), doc_id=F.col("doc_id"), source=F.col("source"), size=_size(), h=F.xxhash64("text")))
    laid, stretches = plan_mix(own.drop("__row"), **how)
    begun = mix_parts(laid, stretches).filter("part_start = 0").select("uid", "pass", "slot")
    times = laid.filter("taken > 0").select("uid", F.round(F.col("taken") / F.col("size")).cast("int").alias("times"))
    copies = begun.join(times, "uid").filter(F.col("pass") < F.col("times")).select("uid", "slot")
    return own.select("uid", "__row").join(copies, "uid").sortWithinPartitions("slot").select("__row.*")
