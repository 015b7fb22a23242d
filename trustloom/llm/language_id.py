"""Language identification with hyperdimensional profiles.

Every letter (and the space between words) has a random vector of +1 and -1, drawn from its code point.
A trigram binds the vectors of its letters, permuted by place (rotated by two, one and none), by
elementwise product; a document or a language bundles, that is adds, the vectors of its trigrams. The
language whose prototype has the largest cosine with the document is predicted.

Prototypes bundle all training rows, not a sample: sums of integers, so partitions and order don't matter.
The driver gets one vector per language, at most MAX_LANGUAGES x DIMENSIONS numbers.

Defined cases: null text and text without a letter give `und` with score 0, as does a table without
training rows. Rows with a null lang or text are not learned from. A null doc_id is not held out.
Ties go to the language first in code-point order. Text is never cut: all of it counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import as_row, beside, text_of

DIMENSIONS = 1024
SEED = 11
MAX_LANGUAGES = 2000
BATCH = 128
SLICE = 4096


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=65536)
def _vector(code: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS).astype(np.int8) * np.int8(2) - np.int8(1)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the trigrams of lower-case letters, with one space for all between; none without letters."""
    u = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    u = np.where(_letters()[u], u, 32)
    if not (u != 32).any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    u = np.concatenate([[32], u, [32]]).astype(np.int64)
    u = u[np.concatenate([[True], (u[1:] != 32) | (u[:-1] != 32)])]
    return np.unique((u[:-2] << 42) | (u[1:-1] << 21) | u[2:], return_counts=True)


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram codes, one row each."""
    used, where = np.unique(np.concatenate([codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF]), return_inverse=True)
    base = np.stack([_vector(int(c)) for c in used])
    a, b, c = where.reshape(3, -1)
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


def bundle(grams: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, n: int) -> np.ndarray:
    """n sums of trigram vectors; document i adds to row rows[i]."""
    out = np.zeros((n, DIMENSIONS))
    if not sum(len(g) for g, _ in grams):
        return out
    codes, at = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True)
    row = np.repeat(rows, [len(g) for g, _ in grams])
    counts = np.concatenate([c for _, c in grams])
    order = np.argsort(at, kind="stable")
    at, row, counts = at[order], row[order], counts[order]
    for lo in range(0, len(codes), SLICE):
        i, j = np.searchsorted(at, [lo, lo + SLICE])
        block = np.zeros((n, min(SLICE, len(codes) - lo)))
        np.add.at(block, (row[i:j], at[i:j] - lo), counts[i:j])
        out += block.astype(np.float32) @ gram_vectors(codes[lo : lo + SLICE]).astype(np.float32)
    return out


def _chunks(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for lo in range(0, len(batch), BATCH):
        yield batch.iloc[lo : lo + BATCH]


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in _chunks(batch):
            names, rows = np.unique(part["lang"].to_numpy(dtype=str), return_inverse=True)
            for name, total in zip(names, bundle([trigrams(t) for t in part["text"]], rows, len(names)), strict=True):
                sums[name] = sums.get(name, 0) + np.rint(total).astype(np.int64)
    if sums:
        yield pd.DataFrame({"lang": [*sums], "total": [*sums.values()]})


def learn_prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their bundled vectors, from all rows of (text, lang) without nulls."""
    rows = labelled.select("text", "lang").filter("text is not null and lang is not null")
    sums = rows.mapInPandas(_learn, "lang string, total array<long>")
    sums = sums.select("lang", F.posexplode("total").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))
    found = sorted(sums.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = [r for r in found if any(r["total"])]
    return [r["lang"] for r in found], np.array([r["total"] for r in found], dtype=np.float64).reshape(len(found), DIMENSIONS)


def _predict(langs: list[str], prototypes: np.ndarray):
    unit = (prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True)).T if langs else None

    def work(texts: list[str]) -> dict[str, pa.Array]:
        names, scores = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        for lo in range(0, len(texts), BATCH):
            grams = [trigrams(t) for t in texts[lo : lo + BATCH]]
            vectors = bundle(grams, np.arange(len(grams)), len(grams))
            norm = np.linalg.norm(vectors, axis=1)
            known = np.flatnonzero((norm > 0) & np.array([len(g) > 0 for g, _ in grams], dtype=bool) & bool(langs))
            if len(known):
                cosine = vectors[known] @ unit / norm[known, None]
                best = cosine.argmax(axis=1)
                names[lo + known] = np.array(langs, dtype=object)[best]
                scores[lo + known] = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    return work


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    rows = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    return beside(rows, ["doc_id", "held_out"], _predict(langs, prototypes), "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows that aren't held out, then predict every row."""
    return identify(docs, *learn_prototypes(docs.filter(~held_out()).select("text", "lang")))


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """docs without the rows that are `und`, all columns: those have no letter, or nothing was learned."""
    langs, prototypes = learn_prototypes(docs.filter(~held_out()).select("text", "lang"))
    schema = StructType().add("__row", docs.schema).add("lang_pred", "string").add("score", "double")
    return beside(as_row(docs, text=text_of()), ["__row"], _predict(langs, prototypes), schema).filter("lang_pred != 'und'").select("__row.*")
