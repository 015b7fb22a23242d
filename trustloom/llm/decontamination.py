"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

The automaton holds every run of words of every item. A document's words are streamed through it, which gives at each word the longest run
ending there that some item has too. A window is WINDOW consecutive words of an item, or a whole item of fewer: where the
longest run has at least WINDOW words, or ends with a short item, the words of that window are hit, and the automaton's state
names the items that hold it.

Items are dealt into shards of at most SHARD_WORDS words, long ones in parts that overlap by a window less one word, so that an automaton's size
is bounded whatever the benchmark's. One shard is shipped at a time, for one pass over the documents; the passes of a larger
benchmark are joined by text.

Words are runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII. Defined cases: null, empty and
wordless texts have no words, no hits and no items; an item without words has no windows. Items that share an id count once, and
an item without an id marks hits but is no item. Every row of documents has its own result, also where doc_id repeats or is null.
No documents, no rows; no items, no hits. Of documents only doc_id and text are read, of items item_id and text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import as_row, beside, cut, text_of

WINDOW = 10
SHARD_WORDS = 200_000
PART_WORDS = 2_000
MAX_COVERAGE = 0.5

_SPACED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of texts in either case
_WORD = re.compile(rb"[^ ]+")


def spaced(text: str) -> bytes:
    """The text's words in lower case, each other byte a space; in UTF-8 every byte of a character beyond ASCII is 128 or more."""
    return text.encode().translate(_SPACED)


class Automaton:
    """Generalised suffix automaton over words, for items given as (ids, words)."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        ends = []
        for name, words in items:
            state = 0
            for word in words:
                state = self._extend(state, word)
                ends.append((state, name))
            if 0 < len(words) < window:
                ends.append((-state, name))  # a short item is one window, all of it
        self._name_windows(ends)

    def _state(self, length: int, link: int, after: dict[bytes, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of the longest run of p with word behind it, taken out of q."""
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:  # another item has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def _name_windows(self, ends: list[tuple[int, object]]) -> None:
        """Each state's window state (the one whose runs include the last window words), its short items, and windows' items."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.at = [0] * len(self.next)
        self.short = [0] * len(self.next)  # the nearest state up the links that ends a whole short item
        whole = {-state for state, _ in ends if state < 0}
        for s in order:
            above = self.link[s]
            if self.length[s] >= self.window:
                self.at[s] = self.at[above] or s
            self.short[s] = s if s in whole else self.short[above]
        self.items: dict[int, set] = {}
        for state, name in ends:
            where = -state if state < 0 else self.at[state]
            if where:
                names = self.items.setdefault(where, set())
                if name is not None:
                    names.add(name)

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest run of the items that ends at each word, where it may end a window."""
        follow, link, lengths, window, short = self.next, self.link, self.length, self.window, self.short
        root = follow[0]
        state = length = 0
        for i, word in enumerate(words):
            if not state:
                state = root.get(word, 0)
                if not state:
                    continue
                length = 1
            else:
                to = follow[state].get(word)
                if to is None:
                    state = link[state]
                    while state >= 0 and word not in follow[state]:
                        state = link[state]
                    if state < 0:
                        state = length = 0
                        continue
                    length, to = lengths[state], follow[state][word]
                state = to
                length += 1
            if length >= window or short[state]:
                yield i, state, length

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Hit stretches [from, to) in words, apart and rising, and the items whose windows occur."""
        hits: list[list[int]] = []
        seen: set[int] = set()
        for i, state, length in self.matches(words):
            reach = 0
            if length >= self.window:
                reach = self.window
                seen.add(self.at[state])
            s = self.short[state]
            if s == state and length < self.length[s]:  # the document lacks its first words
                s = self.short[self.link[s]]
            if s:
                reach = reach or self.length[s]
                while s and s not in seen:
                    seen.add(s)
                    s = self.short[self.link[s]]
            if reach:
                begin = i + 1 - reach
                while hits and hits[-1][1] >= begin:
                    begin = min(begin, hits.pop()[0])
                hits.append([begin, i + 1])
        return hits, set().union(*map(self.items.__getitem__, seen))


def _parts(window: int, part_words: int):
    """Items' words, long items in parts that share a window less one word, so that each window is in a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, text, n = [], [], []
            for k, item in enumerate(batch.column("text").to_pylist()):
                words = spaced(item).split()
                for at in range(0, max(len(words) - window, 0) + 1, part_words):
                    part = words[at : at + part_words + window - 1]
                    if part:
                        row.append(k)
                        text.append(b" ".join(part))
                        n.append(len(part))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row, pa.int64())), pa.array(text, pa.binary()), pa.array(n, pa.int64())], names=["item_id", "words", "n"])

    return run


def shards_of(items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, part_words: int = PART_WORDS) -> tuple[DataFrame, list[int]]:
    """Parts of items (item_id, words, n, shard), and the numbers of the shards, each of at most shard_words words."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), text_of().alias("text"))
    parts = cut(rows.mapInArrow(_parts(window, part_words), "item_id string, words binary, n long").distinct())
    n = max(1, -(-(parts.agg(F.sum("n")).first()[0] or 0) // shard_words))
    while True:
        dealt = parts.withColumn("shard", F.pmod(F.xxhash64("item_id", "words"), F.lit(n)).cast("int"))
        sizes = {r.shard: r.words for r in dealt.groupBy("shard").agg(F.sum("n").alias("words")).collect()}
        if max(sizes.values(), default=0) <= max(shard_words, part_words + window):
            return dealt, sorted(sizes)
        n *= 2


_workers: dict[str, Automaton] = {}


def _scanner(parts: DataFrame, shard: int, window: int):
    """Work for beside(): words, hits and items of each text against one shard, which every worker builds once."""
    rows = [(r.item_id, bytes(r.words)) for r in parts.filter(F.col("shard") == shard).select("item_id", "words").collect()]  # at most a shard's words
    name, shipped = uuid4().hex, parts.sparkSession.sparkContext.broadcast(rows)

    def work(texts: list[str]) -> dict[str, pa.Array]:
        if name not in _workers:
            _workers.clear()
            _workers[name] = Automaton([(item, words.split()) for item, words in shipped.value], window)
        scan, n_words, hits, items = _workers[name].scan, [], [], []
        for text in texts:
            words = spaced(text).split()
            found = scan(words)
            n_words.append(len(words))
            hits.append(found[0])
            items.append(sorted(found[1]))
        return {"n_words": pa.array(n_words, pa.int64()), "hits": pa.array(hits, pa.list_(pa.list_(pa.int64()))), "items": pa.array(items, pa.list_(pa.string()))}

    return work


FOUND = StructType().add("n_words", "long").add("hits", ArrayType(ArrayType(LongType()))).add("items", ArrayType(StringType()))


def find_matches(rows: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """rows (text and any other columns) with n_words, hits ([from, to) in words, apart, rising) and items (ids, rising)."""
    parts, shards = shards_of(items, window, shard_words)
    rows = rows.withColumn("text", text_of())
    keep = rows.columns
    schema = StructType([*rows.schema.fields, *FOUND.fields])
    if len(shards) <= 1:
        return beside(rows, keep, _scanner(parts, shards[0] if shards else 0, window), schema)
    key = F.sha2("text", 256).alias("key")
    texts = rows.select(key, "text")
    found = []
    for shard in shards:
        seen = beside(texts, ["key"], _scanner(parts, shard, window), StructType([texts.schema["key"], *FOUND.fields]))
        found.append(cut(seen.filter(F.size("hits") > 0).withColumn("shard", F.lit(shard)).dropDuplicates(["key", "shard"])))
    found = reduce(DataFrame.unionAll, found).groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row a shard at most
    n_words = F.size(F.regexp_extract_all("text", F.lit(f"({WORDS})"))).cast("long").alias("n_words")
    none = F.array().cast
    return rows.select("*", key, n_words).join(found, "key", "left").select(
        *keep, "n_words", F.coalesce(_joined(F.col("hits")), none("array<array<long>>")).alias("hits"), F.coalesce("items", none("array<string>")).alias("items")
    )


def _joined(hits: Column) -> Column:
    """Stretches of several shards, joined where they touch."""

    def add(done: Column, hit: Column) -> Column:
        last = F.element_at(done, -1)
        touches = (F.size(done) > 0) & (F.try_element_at(F.try_element_at(done, F.lit(-1)), F.lit(2)) >= hit[0])
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], hit[1]))))
        return F.when(touches, grown).otherwise(F.concat(done, F.array(hit)))

    return F.aggregate(F.array_sort(hits), F.array().cast("array<array<long>>"), add)


def contamination_report(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, window, shard_words)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, hit: n + hit[1] - hit[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def _without_hits(min_words: int):
    def clean(text: str, hits: list[list[int]]) -> str:
        hits = [h for h in hits if h[1] - h[0] >= min_words]
        if not hits:
            return text
        raw, at, out = text.encode(), 0, []
        places = [m.span() for m in _WORD.finditer(spaced(text))]
        for begin, end in hits:
            out.append(raw[at : places[begin][0]])
            at = places[end - 1][1]
        return b"".join([*out, raw[at:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean(t, h) if h else t for t, h in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.string())], names=["__row", "text"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_words: int = 1, max_coverage: float = MAX_COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs, all columns, with hit stretches of at least min_words words cut from their texts; documents of which such
    stretches cover more than max_coverage of the words are left out. Texts without such stretches stay as they are, nulls too."""
    found = find_matches(as_row(docs, text=F.col("text")), items, window, shard_words)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, hit: n + F.when(hit[1] - hit[0] >= min_words, hit[1] - hit[0]).otherwise(0))
    kept = found.filter(n_hit <= F.lit(max_coverage) * F.col("n_words")).select("__row", "text", "hits")
    clean = kept.mapInArrow(_without_hits(min_words), StructType([kept.schema["__row"], kept.schema["text"]]))
    text = F.when(F.col("__row.text").isNull(), None).otherwise(F.col("text"))
    return clean.select(*[text.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
