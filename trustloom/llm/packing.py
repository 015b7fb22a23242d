"""Best-fit packing of documents into sequences under vector capacities.

A piece needs (tokens, one document, attention cost = tokens squared) of a bin's three capacities. Pieces
are taken in falling order of tokens; each goes to the open bin with the best score of those that meet
every constraint: the smallest weighted norm of what would remain ("norm"), or the largest weighted dot
product of need and remainder ("dot"). Pieces as long as the capacity fill a sequence alone. The others
are dealt by a hash of their key into groups of about GROUP_PIECES, which are packed in parallel; a group
wastes at most a little of its last bins, and no task sees more than its groups.

Defined cases: null text counts as empty, and every document ends with the end id, so each has a piece.
Only documents longer than the capacity are cut; their first piece takes what the full ones leave. A piece that
alone exceeds another capacity has a sequence of its own.
Rows that repeat a doc_id are packed separately (same doc_id and text: told apart by copy number).
An empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut

CAPACITY = 1024
END_ID = 2
GROUP_PIECES = 2048
CACHE_WORDS = 200_000
#: Between these the pre-tokenizer always cuts: no token holds a space after another character.
_INNER_SPACE = re.compile(r"(?<=\S)(?= )")
# Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE_PAIR = re.compile(r"\s ")

_workers: dict[str, "Encoder"] = {}


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_byte_bpe(spec: str) -> bool:
    """Whether a tokenizers file is byte-level BPE whose ids are its merge ranks, cut by PRE_TOKENS and nothing else."""
    found = json.loads(spec)
    model, pre = found["model"], found.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or found.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return False
    vocab = model["vocab"]
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return None not in made and all(a < b for a, b in zip(made, made[1:], strict=False))


class Encoder:
    """Ids of a byte-level BPE as little-endian uint32 bytes, remembering the first CACHE_WORDS words.

    Byte-level BPE never merges across pre-tokens, so a text may be cut before any space that follows
    a character other than white space, and the parts' ids be joined. Words that aren't remembered are
    merged by tiktoken with the ranks of the tokenizers file, which is several times faster than
    tokenizers word by word; texts with a special token go to tokenizers whole. Where the file is not such a
    BPE, all words go to tokenizers.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}  # words after a space, without it
        if not plain_byte_bpe(self.tokenizer.to_str()):
            self.merge = lambda part: self.tokenizer.encode(part, add_special_tokens=False).ids
            return
        letters = byte_letters()
        ranks = {bytes(letters[ch] for ch in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.merge = tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._encode(text)
        spaced = _SPACE_PAIR.search(text) is None  # each space follows a word: all are cuts
        parts = text.split(" ") if spaced else _INNER_SPACE.split(text)
        inner, merge = self.inner if spaced else self.words, self.merge
        lead, out = " " if spaced else "", []
        for p in parts:
            ids = inner.get(p)
            if ids is None:
                ids = array("I", merge(lead + p)).tobytes()
                if len(inner) < CACHE_WORDS and len(p) <= 64:
                    inner[p] = ids
            out.append(ids)
        if spaced:
            out[0] = array("I", merge(parts[0])).tobytes()
        return b"".join(out)


def encoder(path: str) -> Encoder:
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = enc(text) + end
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                at = 0
                for piece, to in enumerate(range(first, n + 1, capacity)):
                    part = ids[4 * at : 4 * to]
                    rows.append((row, piece, at, to - at, zlib.crc32(part), np.frombuffer(part, "<u4").astype("i4") if with_ids else None))
                    at = to
            if rows:
                row, piece, start, length, crc, ids_ = zip(*rows, strict=True)
                doc_id = batch.column("doc_id").take(pa.array(row, pa.int64()))  # stays in Arrow: exact beside nulls
                made = {"doc_id": doc_id, "copy": pa.array(np.zeros(len(row), dtype=np.int64)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    made["ids"] = pa.array(ids_, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*made.values()], names=[*made])

    return run


def best_fit(need: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and token offset of each piece; need and capacity have the columns tokens, documents, attention cost.

    One piece per bin always fits if it fits an empty bin. Ties go to the bin opened first, so that runs agree.
    """
    n = len(need)
    scaled, unit = need / capacity, weights / weights.sum()
    left = np.empty((n, need.shape[1]))
    used, bins, offsets, at = 0, np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    open_bins = np.empty(0, dtype=np.int64)
    least = scaled.min(axis=0) if n else None
    for i in np.lexsort((np.arange(n), -need[:, 0])):
        rest = left[open_bins]
        fits = np.flatnonzero((rest >= scaled[i] - 1e-12).all(axis=1))
        if len(fits):
            room = rest[fits]
            score = ((room - scaled[i]) ** 2) @ unit if rule == "norm" else -(room * scaled[i]) @ unit
            k = fits[np.argmin(score)]
            b = open_bins[k]
        else:
            b, used = used, used + 1
            left[b] = 1.0
            k = len(open_bins)
            open_bins = np.append(open_bins, b)
        bins[i], offsets[i] = b, at[b]
        at[b] += int(need[i, 0])
        left[b] -= scaled[i]
        if (left[b] < least - 1e-12).any():  # nothing fits any more
            open_bins = np.delete(open_bins, k)
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, max_documents: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.25), rule: str = "norm", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (doc_id, copy, piece, length, ...) with sequence_id and offset.

    The default document and attention capacities are those that a full sequence of one-token documents
    and a single full document reach, so they never cost a sequence; smaller ones bind.
    """
    max_documents, max_attention = max_documents or capacity, max_attention or capacity**2
    groups = max(1, -(-pieces.filter(F.col("length") < capacity).count() // group_pieces))
    key = [F.col(c) for c in ("doc_id", "copy", "piece")]
    full = pieces.filter(F.col("length") >= capacity).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(4096)))
    part = pieces.filter(F.col("length") < capacity).withColumn("group", F.pmod(F.xxhash64(*key), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("copy", "ascending"), ("piece", "ascending")]))
        tokens = rows["length"].to_numpy().astype(np.float64)
        need = np.stack([tokens, np.ones_like(tokens), tokens**2], axis=1)
        bins, offsets = best_fit(need, np.array([capacity, max_documents, max_attention], dtype=np.float64), np.array(weights), rule)
        sequence = bins * groups + rows["group"].to_numpy()
        return rows.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    schema = StructType([f for f in part.schema if f.name != "group"]).add("sequence_id", "long").add("offset", "long")
    packed = part.groupBy("group").applyInArrow(run, schema)
    # those that fill a sequence alone have negative numbers: a place in a hash bucket each
    place = F.row_number().over(W.partitionBy("bucket").orderBy("doc_id", "copy", "piece")).cast("long")
    full = full.withColumns({"sequence_id": -(place * 4096 + F.col("bucket")), "offset": F.lit(0).cast("long")}).drop("bucket")
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, **limits) -> DataFrame:
    """One row per piece: doc_id, copy, piece, start, length, ids_crc32, sequence_id, offset, and the ids on request."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    schema = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = rows.mapInArrow(_pieces(tokenizer_path, capacity, with_ids), schema)
    pieces = cut(pieces)
    repeated = pieces.filter("piece = 0").groupBy("doc_id").count().filter("count > 1")
    if not repeated.isEmpty():
        pieces = cut(_tell_copies_apart(pieces, with_ids))
    return pack_pieces(pieces, capacity, **limits)


def _tell_copies_apart(pieces: DataFrame, with_ids: bool) -> DataFrame:
    """A copy number for each row of a repeated piece, by place in a fixed order of what the piece holds."""
    w = W.partitionBy("doc_id", "piece").orderBy("start", "length", "ids_crc32")
    return pieces.withColumn("copy", F.row_number().over(w).cast("long") - 1)
