"""Cross-tokenizer alignment: token groups that two tokenizers cut alike, the links inside them, and how usual each link is.

Both tokenizers encode each whole text, as if after a space. An anchor is a place where a token of either side ends and both
sides' next tokens are marked by a space; anchors cut a document into windows of token ids. Windows repeat as words do, so a
worker remembers the alignment of those it has met, by their ids. A document counts only if both sides' bytes, window by
window, are those of its text. Links are counted over all documents; the table of counts has a row for each
pair of token ids that ever meets, so it is broadcast up to MAX_BROADCAST pairs and joined by shuffle beyond.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece BPE that marks spaces by U+2581; the files are checked when
they are loaded. Where all of B's pieces hold the mark in front only, no token of either side reaches over a space that
follows a letter, so texts are encoded in words that a worker remembers, and joined; else B encodes whole texts.

Defined cases: null and empty texts, and those whose tokens' bytes differ from space and text (texts with U+2581 in them),
have no tokens: zeros and an empty groups_sha256. Special tokens' strings in a text are plain text. Every row has its own
result, also where doc_id repeats or is null. An empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .packing import Encoder, byte_letters, plain_byte_bpe

MARK = "▁"
MAX_BROADCAST = 1 << 21
CACHE_ENTRIES = 400_000
CACHE_CHARS = 64
BATCH_LINKS = 1 << 20
_WORD_STARTS = re.compile(r"(?<=\S)(?= )")
_SPACE_PAIR = re.compile(r"\s ")

Ids = tuple[bytes, bytes]
Window = tuple[bytes, str, bytes]
_workers: dict[tuple[str, str], "Aligner"] = {}


def _bytes_a(enc: Encoder) -> list[bytes]:
    letters = byte_letters()
    found = [b""] * enc.tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in enc.tokenizer.get_vocab(with_added_tokens=False).items():
        found[i] = bytes(map(letters.__getitem__, token)) if all(ch in letters for ch in token) else token.encode()
    return found


def _bytes_b(pieces) -> list[bytes]:
    return [bytes([int(p[3:-1], 16)]) if pieces.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, pieces.id_to_piece(i)) for i in range(pieces.vocab_size()))]


class Side:
    """Bytes and byte length of each token, whether a space marks it, and its id as text before each sign that may follow."""

    def __init__(self, tokens: list[bytes], closing: str):
        self.tokens = np.array(tokens, dtype=object)
        self.length = np.array([*map(len, tokens)], dtype=np.int64)
        self.marked = np.array([t.startswith(b" ") for t in tokens])
        self.text = np.array([f"{i}{sign}" for sign in ("," + closing) for i in range(len(tokens))], dtype=object)

    def written(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.text[ids + len(self.tokens) * last]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        enc = Encoder(path_a)
        if not plain_byte_bpe(enc.tokenizer.to_str()):
            raise ValueError(f"{path_a} is not a byte-level BPE")
        self.merge_a, self.pieces = enc.merge, SentencePieceProcessor(model_file=path_b)
        self.a, self.b = Side(_bytes_a(enc), "|"), Side(_bytes_b(self.pieces), ";")
        self.by_word = not any(MARK in self.pieces.id_to_piece(i).lstrip(MARK) for i in range(self.pieces.vocab_size()))
        self.words: dict[str, Ids] = {}
        self.windows: dict[Ids, Window] = {}

    def _encode(self, text: str) -> Ids:
        b = self.pieces.encode(text, num_threads=1) if text else [self.pieces.piece_to_id(MARK)]  # a lone space
        return array("I", self.merge_a(" " + text)).tobytes(), array("I", b).tobytes()

    def _meet(self, words: list[str]) -> None:
        """Encode words in one text and remember each; no token reaches over a space that follows a letter."""
        ids_a, ids_b = self._encode(" ".join(words))
        ends = np.cumsum([len(w.encode()) for w in words]) + np.arange(1, len(words) + 1)
        cuts = [(4 * (side.length[np.frombuffer(x, "<u4")].cumsum().searchsorted(ends) + 1)).tolist() for side, x in ((self.a, ids_a), (self.b, ids_b))]
        i = j = 0
        known = self.words
        for word, to_i, to_j in zip(words, *cuts, strict=True):
            known[word] = ids_a[i:to_i], ids_b[j:to_j]
            i, j = to_i, to_j

    def encode(self, text: str) -> list[Ids]:
        """Ids of both sides for space and text, as little-endian unsigned 32-bit numbers, in parts that begin with a space."""
        if not self.by_word:
            return [self._encode(text)]
        words = text.split(" ") if not text.startswith(" ") and not _SPACE_PAIR.search(text) else [w[1:] for w in _WORD_STARTS.split(" " + text)]
        known = self.words
        parts = [*map(known.get, words)]
        if None in parts:
            new = [*dict.fromkeys(w for w, p in zip(words, parts, strict=True) if p is None)]
            if spaces := [w for w in new if not w or w[0] == " "]:  # leading and lone spaces
                known.update((w, self._encode(w)) for w in spaces)
            if plain := [w for w in new if w and w[0] != " "]:
                self._meet(plain)
            parts = [*map(known.__getitem__, words)]
            for w in new if len(known) > CACHE_ENTRIES else [w for w in new if len(w) > CACHE_CHARS]:
                del known[w]
        return parts

    def _align(self, keys: list[Ids]) -> list[Window]:
        """Bytes, groups as text, and links of each window; no bytes where the sides differ."""
        a, b = (np.frombuffer(b"".join([k[side] for k in keys]), "<u4").astype(np.int64) for side in (0, 1))
        end_a, end_b = self.a.length[a].cumsum(), self.b.length[b].cumsum()
        to_a, to_b = (np.cumsum([len(k[side]) for k in keys]) // 4 for side in (0, 1))
        to_byte = end_a[to_a - 1]
        raw = b"".join(self.a.tokens[a].tolist())
        if (to_byte != end_b[to_b - 1]).any() or raw != b"".join(self.b.tokens[b].tolist()):
            return [(b"", "", b"")] * len(keys)
        ends = np.concatenate([end_a, end_b])
        ends.sort(kind="stable")  # two rising runs
        twice = ends[1:] == ends[:-1]
        shared = ends[1:][twice]
        ends = ends[np.append(~twice, True)]  # between two of them lies what one token of each side shares
        links = (a[end_a.searchsorted(ends)] << 32 | b[end_b.searchsorted(ends)]).tobytes()
        group_a, group_b = shared.searchsorted(end_a), shared.searchsorted(end_b)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        closed_a, closed_b = np.flatnonzero(last_a) + 1, np.append(0, np.flatnonzero(last_b) + 1)
        text = np.empty(len(a) + len(b), dtype=object)  # each group: A's tokens, then B's
        text[np.arange(len(a)) + closed_b[group_a]] = self.a.written(a, last_a)
        text[np.arange(len(b)) + closed_a[group_b]] = self.b.written(b, last_b)
        text, found, from_byte, from_text, from_link = text.tolist(), [], 0, 0, 0
        for to_raw, to_text, to_link in zip(to_byte.tolist(), (to_a + to_b).tolist(), (8 * ends.searchsorted(to_byte) + 8).tolist(), strict=True):
            found.append((raw[from_byte:to_raw], "".join(text[from_text:to_text])[:-1], links[from_link:to_link]))
            from_byte, from_text, from_link = to_raw, to_text, to_link
        return found

    def _windows(self, parts: list[Ids], ids: Ids) -> list[Window] | None:
        """Windows between the anchors of a whole document; None where the sides' lengths differ."""
        a, b = np.frombuffer(ids[0], "<u4"), np.frombuffer(ids[1], "<u4")
        wide_a, wide_b = self.a.length[a], self.b.length[b]
        at_a, at_b = wide_a.cumsum() - wide_a, wide_b.cumsum() - wide_b
        if at_a[-1] + wide_a[-1] != at_b[-1] + wide_b[-1]:
            return None
        anchors = np.intersect1d(at_a[self.a.marked[a]], at_b[self.b.marked[b]], assume_unique=True)
        keys = parts
        if len(anchors) != len(parts):  # else the parts are the windows
            cut_a, cut_b = (4 * at_a.searchsorted(anchors)).tolist(), (4 * at_b.searchsorted(anchors)).tolist()
            keys = [(ids[0][i:to_i], ids[1][j:to_j]) for i, to_i, j, to_j in zip(cut_a, [*cut_a[1:], len(ids[0])], cut_b, [*cut_b[1:], len(ids[1])], strict=True)]
        found = [*map(self.windows.get, keys)]
        if None in found:
            new = [k for k, w in zip(keys, found, strict=True) if w is None]
            made = self._align(new)
            if len(self.windows) < CACHE_ENTRIES:
                self.windows.update((k, w) for k, w in zip(new, made, strict=True) if len(w[0]) <= CACHE_CHARS)
            made = iter(made)
            found = [w or next(made) for w in found]
        return found

    def __call__(self, text: str) -> tuple[int, int, str, np.ndarray] | None:
        """Numbers of tokens, groups as text, and all links; None if the text has no tokens."""
        if not text or MARK in text:
            return None
        parts = self.encode(text)
        ids = b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])
        windows = self._windows(parts, ids)
        if windows is None or b"".join([w[0] for w in windows]) != b" " + text.encode():
            return None
        return len(ids[0]) // 4, len(ids[1]) // 4, ";".join([w[1] for w in windows]), np.frombuffer(b"".join([w[2] for w in windows]), "<i8")


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _workers:
        _workers[path_a, path_b] = Aligner(path_a, path_b)
    return _workers[path_a, path_b]


LINK = pa.struct([("pair", pa.int64()), ("times", pa.int32())])


def _rows(path_a: str, path_b: str, with_groups: bool):
    def batch_of(keep: pa.RecordBatch, found: list) -> pa.RecordBatch:
        none = np.empty(0, dtype=np.int64)
        links = [np.unique(x[3], return_counts=True) if x else (none, none) for x in found]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p, _ in links])]).astype(np.int32)
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([p for p, _ in links])), pa.array(np.concatenate([n for _, n in links]).astype(np.int32))], fields=[*LINK])
        made = {
            "n_a": pa.array([x[0] if x else 0 for x in found], pa.int64()), "n_b": pa.array([x[1] if x else 0 for x in found], pa.int64()),
            "n_groups": pa.array([x[2].count(";") + 1 if x else 0 for x in found], pa.int64()), "n_links": pa.array([len(x[3]) if x else 0 for x in found], pa.int64()),
            "groups_sha256": pa.array([sha256(x[2].encode()).hexdigest() if x else "" for x in found]), "links": pa.ListArray.from_arrays(pa.array(offsets), flat),
        }
        if with_groups:
            made["groups"] = pa.array([x[2] if x else "" for x in found])
        return pa.RecordBatch.from_arrays([keep.column("row"), keep.column("doc_id"), *made.values()], names=["row", "doc_id", *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the remembered words and windows are many, and nothing here is cyclic
        align = aligner(path_a, path_b)
        for batch in batches:
            found, start, links = [], 0, 0
            for text in batch.column("text").to_pylist():
                found.append(align(text))
                links += len(found[-1][3]) if found[-1] else 0
                if links >= BATCH_LINKS:
                    yield batch_of(batch.slice(start, len(found)), found)
                    found, start, links = [], start + len(found), 0
            if found:
                yield batch_of(batch.slice(start, len(found)), found)

    return run


def align_documents(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """One row per document: row (its key), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links (pair, times),
    and the groups as text on request. A pair holds A's id in its upper, B's in its lower 32 bits. Written to a table.
    """
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, times: int>>" + ", groups string" * with_groups
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows(path_a, path_b, with_groups), schema))


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_docs (documents that hold it linked), best (no other partner of its A id is in more documents)."""
    counts = aligned.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = counts.withColumn("a_id", F.shiftright("pair", 32))
    most = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a_id").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def partner_table(counts: DataFrame) -> DataFrame:
    """a_id, b_id, n_docs: the most usual partners of each A id, ties included."""
    return counts.filter("best").select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), "n_docs")


def alignment_report(docs: DataFrame, path_a: str, path_b: str, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = align_documents(docs, path_a, path_b)
    counts = cut(link_counts(aligned))
    if counts.count() <= max_broadcast:
        counts = F.broadcast(counts)
    times = F.col("times").cast("long")
    sums = (
        aligned.select("row", F.inline("links")).join(counts, "pair").groupBy("row")
        .agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n_docs")).alias("count_sum"))
    )
    zero = F.lit(0).cast("long")
    return aligned.drop("links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
