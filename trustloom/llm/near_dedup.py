"""MinHash near-dedup with DartMinHash signatures and banded joining.

Each document is its set of five-word shingles (lower case, words between ASCII white space; fewer than
four words make one shingle), or with weighting="count" the multiset. Hashed darts are thrown into every
element's region: a Poisson process of unit intensity over weight x rank, drawn strip by strip from hashes
of (element, weight cell, strip). Each dart has a coordinate; the earliest dart of a coordinate that lies
inside the element's weight is the signature there, and two documents agree in a coordinate with
probability equal to their weighted Jaccard similarity.

Bands of the signature give candidate classes, joined in two steps whose rows grow with the documents and not
with the square of a class. First each member meets the one pivot of its class, the member that shares most
bands with others; links are verified exactly on the whole sets and their components labelled. Then the members
of classes that still hold several components meet each other if they share an element of their prefixes: all
elements are ordered from rare to common, and two sets of the wanted overlap must share one in the places where
that overlap is still to come, so no link is lost. Elements of one document alone meet nothing, and elements
whose holders are of one component are dropped; of the others, those outside the element's largest component
meet all holders. A pair's places bound its overlap, and what passes is verified exactly too.
Documents with equal shingle sets are one node from the start. Components come from minimum labels with
pointer jumping.

Defined cases: null or wordless text has no shingles, and each such row is a class of its own; repeated rows
and equal texts share a class; a null doc_id is a member like any other. A document is a (doc_id, text): rows
that share a doc_id but not the text are told apart, also where the doc_id is null. class_id is the largest
doc_id of the class, null if it has none; as classes can share it, class_key (a hash of the class's least
node, null for a wordless row) tells them apart. Of each class exactly one row is kept: of its largest doc_id
the text with the greatest hash. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, as_row, beside, cut, text_of

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 24, 4
SEED = 0x9E3779B97F4A7C15
#: Holders of one element that a task compares with those outside its largest component.
SALT_ROWS = 4096
#: Strip edges of the rank axis up to 1; unit strips follow.
EDGES = (0.0, 1 / 64, 1 / 16, 1 / 4, 1.0)

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * 2.0**-53


def _poisson_cdf(mean: float) -> np.ndarray:
    terms = [math.exp(-mean)]
    while terms[-1] > 1e-18 or len(terms) < 3:
        terms.append(terms[-1] * mean / len(terms))
    return np.cumsum(terms)


_CDF = {width: _poisson_cdf(width) for width in {b - a for a, b in zip(EDGES, EDGES[1:], strict=False)} | {1.0}}


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all word shingles, in order, repeats included."""
    from xxhash import xxh3_64_intdigest

    parts = text.lower().encode("utf-8", "surrogatepass").split()
    if not parts:
        return np.empty(0, dtype=U)
    w = np.fromiter(map(xxh3_64_intdigest, parts), dtype=U, count=len(parts))
    n = max(1, len(w) - words + 1)
    out = np.zeros(n, dtype=U)
    for i in range(min(words, len(w))):
        out = mix(out * U(0x9DDFEA08EB382D69) + w[i : i + n])
    return out


def darts(elements: np.ndarray, weights: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """The k ids of the earliest darts; elements distinct and not empty, weights positive."""
    cells = np.ceil(weights).astype(np.int64)
    e = np.repeat(elements, cells)
    cell = np.arange(len(e)) - np.repeat(np.cumsum(cells) - cells, cells)
    most = np.repeat(weights, cells) - cell  # of the unit cell, what lies inside the element
    base = mix(e * U(0xC2B2AE3D27D4EB4F) + cell.astype(U) * U(0x165667B19E3779F9) + U(seed))
    ids = np.zeros(k, dtype=U)
    best = np.full(k, np.inf)
    block = max(1, -(-256 // len(e)))
    strip = 0
    while np.isinf(best).any():
        count = 1 if strip < len(EDGES) - 1 else block
        if strip < len(EDGES) - 1:
            lows, width = np.array([EDGES[strip]]), EDGES[strip + 1] - EDGES[strip]
        else:
            lows, width = 1.0 + (strip - len(EDGES) + 1) + np.arange(count), 1.0
        seeds = mix((base[:, None] + np.arange(strip + 1, strip + 1 + count).astype(U)[None, :] * U(0xD6E8FEB86659FD93)).ravel())
        thrown = np.searchsorted(_CDF[width], _unit(seeds), side="right")
        at = np.flatnonzero(thrown)
        many = np.repeat(at, thrown[at])
        nth = np.arange(len(many)) - np.repeat(np.cumsum(thrown[at]) - thrown[at], thrown[at])
        dart = mix(seeds[many] + (nth.astype(U) + U(1)) * U(0xA0761D6478BD642F))
        inside = _unit(mix(dart ^ U(0xE7037ED1A0B428DB))) < most[many // count]
        dart, many = dart[inside], many[inside]
        rank = lows[many % count] + width * _unit(dart)
        where = (mix(dart ^ U(0x8EBC6AF09C88C6E3)) % U(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        fresh, fresh_id = np.full(k, np.inf), np.zeros(k, dtype=U)
        fresh[where[order]], fresh_id[where[order]] = rank[order], dart[order]
        better = fresh < best
        best[better], ids[better] = fresh[better], fresh_id[better]
        strip += count
    return ids


def set_elements(elements: np.ndarray, counts: np.ndarray, weighting: str) -> np.ndarray:
    """Distinct shingles; with counts, the n-th occurrence is an element of its own, so that set overlap is weighted overlap."""
    if weighting != "count":
        return elements
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(elements, counts) + nth.astype(U) * U(0xD6E8FEB86659FD93))


def signature(text: str, k: int, weighting: str = "set") -> tuple[bytes, np.ndarray, np.ndarray] | None:
    """Node (a 128-bit hash of the weighted set), elements of the set and signature; None without words."""
    from xxhash import xxh3_128_digest

    elements, counts = np.unique(shingles(text), return_counts=True)
    if not len(elements):
        return None
    weights = counts if weighting == "count" else np.ones(len(elements))
    node = xxh3_128_digest(elements.tobytes() + (counts.tobytes() if weighting == "count" else b""))
    return node, set_elements(elements, counts, weighting), darts(elements, weights.astype(np.float64), k)


def _sign(bands: int, rows: int, weighting: str):
    def work(texts: list[str]) -> dict[str, pa.Array]:
        nodes, keys, sizes = [], [], []
        for text in texts:
            found = signature(text, bands * rows, weighting)
            if found is None:
                nodes.append(None)
                keys.append(np.empty(0, dtype=np.int64))
                sizes.append(0)
                continue
            key = np.arange(1, bands + 1).astype(U)
            for part in found[2].reshape(bands, rows).T:
                key = mix(key * U(0x9DDFEA08EB382D69) + part)
            nodes.append(found[0])
            keys.append(key.view(np.int64))
            sizes.append(len(found[1]))
        return {"node": pa.array(nodes, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64())), "size": pa.array(sizes, pa.int32())}

    return work


def _shingle_sets(weighting: str):
    """Nodes with the elements of their sets."""

    def work(texts: list[str]) -> dict[str, pa.Array]:
        from xxhash import xxh3_128_digest

        nodes, sets = [], []
        for text in texts:
            elements, counts = np.unique(shingles(text), return_counts=True)
            nodes.append(xxh3_128_digest(elements.tobytes() + (counts.tobytes() if weighting == "count" else b"")) if len(elements) else None)
            sets.append(set_elements(elements, counts, weighting).view(np.int64))
        return {"node": pa.array(nodes, pa.binary()), "elements": pa.array(sets, pa.list_(pa.int64()))}

    return work


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of the component) for all nodes of edges (a, b)."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")))
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    turn = 0
    while True:
        sent = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("binary").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        new = sent.unionByName(own).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        if turn >= 2:  # stars are done by now; long chains halve from here on
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
            new = new.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("root", "label")).alias("label"))
        new = cut(new)
        if new.filter("label != old").isEmpty():
            return new.select("node", "label")
        labels, turn = new.select("node", "label"), turn + 1


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The rows of pairs whose nodes a and b have an exact similarity of at least threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    small, large = F.least(F.size("ea"), F.size("eb")), F.greatest(F.size("ea"), F.size("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    joined = pairs.join(left, "a").join(right, "b").filter(small >= threshold * large)
    return joined.filter(both >= threshold * (F.size("ea") + F.size("eb") - both) - 1e-9).drop("ea", "eb")


def _identity() -> Column:
    """A digest of doc_id and text, which identifies a document."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_of()), 256))


def _classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = BAND_ROWS, weighting: str = "set") -> tuple[DataFrame, DataFrame]:
    """Documents with words: doc_id, sha, copies, label, class_size, stays (the largest doc_id and sha of the class); and the doc_ids of wordless rows."""
    rows = docs.select("doc_id", _identity().alias("sha"), text_of().alias("text"))
    signed = cut(beside(rows, ["doc_id", "sha"], _sign(bands, band_rows, weighting), "doc_id long, sha binary, node binary, bands array<long>, size int"))
    labels = _link(rows, signed, threshold, weighting)
    distinct = signed.filter("node is not null").groupBy("doc_id", "sha", "node").agg(F.count("*").alias("copies"))
    named = distinct.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).drop("node")
    classes = named.groupBy("label").agg(F.max(F.struct("doc_id", "sha")).alias("stays"), F.sum("copies").alias("class_size"))
    return named.join(classes, "label"), signed.filter("node is null").select("doc_id")


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept, class_key. how: threshold, bands, band_rows, weighting."""
    named, wordless = _classes(docs, **how)
    rows = named.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = (F.col("sha") == F.col("stays.sha")) & (F.col("copy") == 1)
    out = rows.select("doc_id", F.col("stays.doc_id").alias("class_id"), "class_size", kept.alias("kept"), F.lower(F.hex("label")).alias("class_key"))
    return out.unionByName(wordless.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), F.lit(None).cast("string").alias("class_key")))


def _members(signed: DataFrame) -> DataFrame:
    """key, node, c of the classes with more than one node; c counts, with repeats, the nodes that share bands with a node."""
    each = signed.filter("node is not null").select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("key"))
    sizes = each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(each.join(sizes, "key"))
    return cut(shared.join(shared.groupBy("node").agg(F.sum("n").alias("c")), "node").select("key", "node", "c"))


def _link(rows: DataFrame, signed: DataFrame, threshold: float, weighting: str) -> DataFrame:
    """node and label of the nodes that share a band with another."""
    members = _members(signed)
    wanted = members.select("node").distinct()
    chosen = signed.join(wanted, "node", "left_semi").groupBy("node").agg(F.max("sha").alias("sha")).select("sha")
    texts = rows.join(chosen, "sha", "left_semi").select("text")
    sets = cut(beside(texts, [], _shingle_sets(weighting), "node binary, elements array<long>").dropDuplicates(["node"]))

    pivots = members.groupBy("key").agg(F.max(F.struct("c", "node"))["node"].alias("pivot"))
    stars = members.join(pivots, "key").filter("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    labels = _merge(wanted.select("node", F.col("node").alias("label")), cut(_verify(stars, sets, threshold)))

    named = members.select("key", "node").join(labels, "node")
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("key")
    unresolved = cut(named.join(mixed, "key", "left_semi").select("node", "label").distinct())
    found = cut(_verify(_prefix_pairs(_prefixes(unresolved, sets, threshold), threshold), sets, threshold))
    return _merge(labels, found.select(F.col("la").alias("a"), F.col("lb").alias("b")))


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after links (a, b) between labels."""
    if links.isEmpty():
        return labels
    merged = connected_components(links.distinct()).select(F.col("node").alias("label"), F.col("label").alias("merged"))
    return cut(labels.join(merged, "label", "left").select("node", F.coalesce("merged", "label").alias("label")))


def _prefixes(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """element, node, label, size, place of the elements that are no node's alone, up to the last place where a pair may first meet."""
    held = nodes.join(sets, "node").select("node", "label", F.size("elements").alias("size"), "elements")
    each = held.select("node", "label", "size", F.explode("elements").alias("element"))
    shared = each.groupBy("element").agg(F.count("*").alias("n")).filter("n > 1")
    ordered = each.join(shared, "element").groupBy("node", "label", "size").agg(F.array_sort(F.collect_list(F.struct("n", "element"))).alias("common"))
    alone = F.col("size") - F.size("common")
    last = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    near = ordered.withColumn("alone", alone).withColumn("common", F.slice("common", F.lit(1), F.greatest(last - alone, F.lit(0)).cast("int")))
    return near.select("node", "label", "size", "alone", F.posexplode("common").alias("i", "e")).select(F.col("e.element").alias("element"), "node", "label", "size", (F.col("alone") + F.col("i") + 1).alias("place"))


def _prefix_pairs(prefixes: DataFrame, threshold: float) -> DataFrame:
    """a, b, la, lb: nodes of different labels that share an element where their overlap can still reach the threshold."""
    prefixes = cut(prefixes)
    by_label = prefixes.groupBy("element", "label").agg(F.count("*").alias("n"))
    mixed = by_label.groupBy("element").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("holders"), F.count("*").alias("labels")).filter("labels > 1")
    parts = F.floor(F.col("holders") / SALT_ROWS) + 1
    right = cut(prefixes.join(mixed.select("element", "main", parts.alias("parts")), "element"))
    left = right.filter("label != main").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    left = left.select("element", "part", *[F.col(c).alias(f"_{c}") for c in ("node", "label", "size", "place")])
    right = right.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("main", "parts")
    needed = (F.col("size") + F.col("_size")) * (threshold / (1 + threshold)) - 1e-9
    reach = 1 + F.least(F.col("size") - F.col("place"), F.col("_size") - F.col("_place"))
    pairs = left.join(right, ["element", "part"]).filter("label != _label").filter((reach >= needed) & (F.least("size", "_size") >= needed))
    mine, other = F.struct("node", "label"), F.struct(F.col("_node").alias("node"), F.col("_label").alias("label"))
    pairs = pairs.select(F.least(mine, other).alias("x"), F.greatest(mine, other).alias("y")).distinct()
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb"))


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that near_dedup keeps, all columns; every wordless row is among them."""
    stays = _classes(docs, **how)[0].select(F.col("stays.sha").alias("__own")).distinct()
    own = as_row(docs, __own=_identity(), __words=text_of().rlike(WORD))
    kept = own.join(stays, "__own", "left_semi").dropDuplicates(["__own"])
    return kept.select("__row.*").unionByName(own.filter("not __words").select("__row.*"))
