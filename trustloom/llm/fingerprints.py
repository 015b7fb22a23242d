"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A paragraph (a run between line breaks or sentence ends; empty ones don't count) is hashed to a vector of
LEVELS x LANES sparse lanes, of which it touches one, and DENSE lanes, all of which it touches. Its level is
the number of trailing zeros of a hash, so level k samples one paragraph in 2^(k+1). A sparse lane holds a sum
of hashes modulo 2^HASH_BITS and a count modulo 2^COUNT_BITS. A document's fingerprint is the sum of its
paragraphs' vectors, lane by lane. So order doesn't matter, equal texts have equal fingerprints, and a
paragraph is inserted or deleted by adding or subtracting its vector. Vectors are sparse: an array of the
lanes that aren't zero, each with its number in its upper bits, by number.

The likeness of two fingerprints is the multiset likeness (shared paragraphs of all, with repeats) of the
paragraphs at the finest level that is not full and all levels above it: a lane whose sums are multiples of the
same hash shares the lesser count, another lane shares nothing. So a long text isn't less like its edit than
a short one.

The next document in falling order of doc_id is found inside ranges of 2^RANGE_BITS ids with a window; the
last document of a range takes the first of the next lower range that has any, found on range numbers in
the same way, level by level. So no task sorts all documents, and the text is shuffled once: everything up to
the result is computed in the partitions of that shuffle.

Defined cases: null text counts as empty, its fingerprint is zero, and two zero fingerprints have likeness 1.
Rows that repeat a doc_id follow each other by falling text. A null doc_id comes after all others. The only
document of a table is its own next. An empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, text_of

LEVELS, LANES, DENSE = 16, 1024, 8
HASH_BITS, COUNT_BITS = 28, 20
#: A level with more lanes in use is full: of its paragraphs too many would share a lane.
FULL = LANES // 8
RANGE_BITS = 10
LEVEL_BITS = 12
LANE_BITS = HASH_BITS + COUNT_BITS
PARAGRAPH = r"\n+|(?<=[.!?])\s+"
NULL_ID = -(1 << 63)


def _units(text: Column) -> Column:
    return F.filter(F.split(text, PARAGRAPH), lambda u: u != "")


def _trailing_zeros(x: Column) -> Column:
    return F.bit_count(x.bitwiseAND(-x) - 1)


def _lane(number: Column, hashes: Column, count: Column) -> Column:
    """A lane of a vector: its number, the sum of hashes and the count."""
    upper = F.shiftleft(number.cast("long"), LANE_BITS) + F.shiftleft(hashes.bitwiseAND((1 << HASH_BITS) - 1), COUNT_BITS)
    return upper + count.bitwiseAND((1 << COUNT_BITS) - 1)


def fingerprint_units(rows: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """keys and lanes (array<long>), from one row per paragraph; a null paragraph keeps its keys without lanes."""
    h, known = F.xxhash64(unit), F.col(unit).isNotNull()
    level = _trailing_zeros(F.shiftrightunsigned(h, HASH_BITS + 10).bitwiseOR(1 << (LEVELS - 1)))
    place = F.when(known, level * LANES + F.shiftrightunsigned(h, HASH_BITS).bitwiseAND(LANES - 1))
    dense = {f"__d{k}": F.xxhash64(unit, F.lit(k + 1)) for k in range(DENSE // 2)}
    mask = (1 << HASH_BITS) - 1
    hashed = rows.withColumns({"__place": place, "__value": h.bitwiseAND(mask), **dense})
    wide = [x for k in range(DENSE // 2) for x in (F.col(f"__d{k}").bitwiseAND(mask), F.shiftrightunsigned(F.col(f"__d{k}"), 64 - HASH_BITS))]
    sums = {"__value": F.col("__value"), **{f"__w{k}": x for k, x in enumerate(wide)}}
    by_lane = hashed.groupBy(*keys, "__place").agg(F.count(unit).alias("__n"), *[F.sum(x).bitwiseAND(mask).alias(c) for c, x in sums.items()])
    sparse = F.array_sort(F.collect_list(F.when(F.col("__place").isNotNull(), _lane(F.col("__place"), F.col("__value"), F.col("__n")))))
    summed = by_lane.groupBy(*keys).agg(sparse.alias("__sparse"), F.sum("__n").alias("__units"), *[F.sum(f"__w{k}").alias(f"__w{k}") for k in range(DENSE)])
    last = F.array(*[_lane(F.lit(LEVELS * LANES + k), F.col(f"__w{k}"), F.col("__units")) for k in range(DENSE)])
    return summed.select(*keys, F.when(F.col("__units") == 0, F.col("__sparse")).otherwise(F.concat("__sparse", last)).alias("lanes"))


def fingerprint_hex(lanes: Column) -> Column:
    """16 digits a lane: its number, hashes and count."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _by_number(lanes: Column) -> Column:
    """A map from a lane's number to what it holds."""
    return F.map_from_arrays(F.transform(lanes, lambda x: F.shiftright(x, LANE_BITS)), F.transform(lanes, lambda x: x.bitwiseAND((1 << LANE_BITS) - 1)))


def _count(x: Column) -> Column:
    return x.bitwiseAND((1 << COUNT_BITS) - 1)


def _hashes(x: Column) -> Column:
    return F.shiftright(x, COUNT_BITS)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the multiset sum (sign 1: insertion) or difference (sign -1: deletion)."""
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    both = F.map_zip_with(_by_number(a), _by_number(b), lambda k, x, y: _lane(k, _hashes(zero(x)) + sign * _hashes(zero(y)), _count(zero(x)) + sign * _count(zero(y))))
    return F.array_sort(F.filter(F.map_values(both), lambda x: x.bitwiseAND((1 << LANE_BITS) - 1) != 0))


def _add_lane(seen: Column, entry: Column) -> Column:
    """Adds a lane to the shares; a level that turns out to be full takes back all that was counted so far."""
    level = F.shiftright(entry["key"], LANES.bit_length() - 1)
    nth = F.when(level == seen["level"], seen["nth"] + 1).otherwise(1)
    full = (nth > FULL) & (level < LEVELS - 1)
    add = lambda name: F.when(full, F.lit(0).cast("long")).otherwise(seen[name] + entry["value"][name]).alias(name)
    return F.struct(level.alias("level"), nth.cast("int").alias("nth"), add("shared"), add("all"))


def likeness(a: Column, b: Column) -> Column:
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))

    def share(k: Column, x: Column, y: Column) -> Column:
        m, n = _count(zero(x)), _count(zero(y))
        same = x.isNotNull() & y.isNotNull() & (((_hashes(x) * n) - (_hashes(y) * m)).bitwiseAND((1 << HASH_BITS) - 1) == 0)
        return F.struct(F.when(same, F.least(m, n)).otherwise(F.lit(0).cast("long")).alias("shared"), F.when(same, F.greatest(m, n)).otherwise(m + n).alias("all"))

    sparse = lambda v: _by_number(F.filter(v, lambda x: F.shiftright(x, LANE_BITS) < LEVELS * LANES))
    entries = F.array_sort(F.map_entries(F.map_zip_with(sparse(a), sparse(b), share)))
    none = F.struct(F.lit(-1).cast("long").alias("level"), F.lit(0).alias("nth"), F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("all"))
    ratio = lambda s: F.try_divide(s["shared"].cast("double"), s["all"])
    return F.coalesce(F.aggregate(entries, none, _add_lane, ratio), (a == b).cast("double"))


def fingerprints(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and lanes of whole texts; keys identify a row."""
    units = docs.select(*keys, F.explode_outer(_units(text_of())).alias("__unit"))
    return fingerprint_units(units, keys, "__unit")


def next_lower(ids: DataFrame, bits: int = LEVEL_BITS) -> DataFrame:
    """id, next_id of distinct ids: the largest smaller one; of the least, the largest."""
    lo, hi = ids.agg(F.min("id"), F.max("id")).first()
    if lo is None or hi - lo < 1 << bits:
        w = W.partitionBy(F.lit(0)).orderBy(F.desc("id"))
        return ids.select("id", F.coalesce(F.lead("id").over(w), F.lit(hi)).alias("next_id"))
    ranged = ids.withColumn("range", F.shiftright("id", bits))
    first = cut(ranged.groupBy("range").agg(F.max("id").alias("first")))
    after = next_lower(first.select(F.col("range").alias("id")), bits).join(first.withColumnRenamed("range", "next_id"), "next_id")
    after = after.select(F.col("id").alias("range"), F.col("first").alias("after"))
    inner = F.lead("id").over(W.partitionBy("range").orderBy(F.desc("id")))
    return ranged.withColumn("__lead", inner).join(after, "range").select("id", F.coalesce("__lead", "after").alias("next_id"))


def edited_fingerprints(docs: DataFrame, range_bits: int = RANGE_BITS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    key = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    rows = docs.select("doc_id", key.alias("__id"), F.shiftright(key, range_bits).alias("__range"), text_of().alias("text"))
    first = cut(rows.groupBy("__range").agg(F.max(F.struct("__id", "text")).alias("first")).select("__range", F.col("first.text").alias("text")))
    after = next_lower(first.select(F.col("__range").alias("id"))).join(fingerprints(first, ["__range", "text"]).withColumnRenamed("__range", "next_id"), "next_id")
    after = cut(after.select(F.col("id").alias("__range"), F.col("text").alias("__after"), F.col("lanes").alias("__after_lanes")))

    w = W.partitionBy("__range").orderBy(F.desc("__id"), F.desc("text"))
    rows = rows.withColumns({"__nth": F.row_number().over(w), "__lead": F.lead("text").over(w)}).join(after.select("__range", "__after"), "__range", "left")
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring(F.coalesce("__lead", "__after"), F.lit(1), half))
    keys = ["__range", "__nth", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.withColumns({"n_chars": n.cast("long"), "__edited": edited}).withColumn("edited_sha256", F.sha2("__edited", 256))
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("__edited").alias("t")))).alias("__v"))
    units = both.select(*keys, F.col("__v.kind").alias("__kind"), F.explode_outer(_units(F.col("__v.t"))).alias("__unit"))
    lanes = fingerprint_units(units, [*keys, "__kind"], "__unit")
    of = lambda kind: F.max(F.when(F.col("__kind") == kind, F.col("lanes")))
    pair = lanes.groupBy(*keys).agg(of(0).alias("__own"), of(1).alias("__new"))
    pair = pair.withColumn("__next", F.lead("__own").over(W.partitionBy("__range").orderBy("__nth"))).join(after.select("__range", "__after_lanes"), "__range", "left")
    next_lanes = F.coalesce("__next", "__after_lanes")
    return pair.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_hex(F.col("__own")).alias("fingerprint"), fingerprint_hex(F.col("__new")).alias("edited_fingerprint"),
        likeness(F.col("__own"), F.col("__new")).alias("near_edited"), likeness(F.col("__own"), next_lanes).alias("near_next"),
    )
