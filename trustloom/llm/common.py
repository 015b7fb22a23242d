"""What the operators share: cut points in shared storage, null-safe column picks and passes over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trustloom.sources.tables import cut, drop_cuts, shared_dir

__all__ = ["WORD", "as_row", "beside", "bucket_of", "cut", "drop_cuts", "shared_dir", "text_of"]

WORD = r"[^\x20\x09-\x0D]+"


def beside(rows: DataFrame, keep: list[str], work: Callable[[list[str]], dict[str, pa.Array]], schema: str | StructType) -> DataFrame:
    """The columns keep, then those that work makes of each Arrow batch's texts, one entry a row.

    The kept columns stay in Arrow, so that a 64-bit id beside a null is never made a float. schema is of the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = work(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*map(batch.column, keep), *made.values()], names=[*keep, *made])

    return rows.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def text_of(name: str = "text") -> Column:
    """Text with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def bucket_of(*keys: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


def as_row(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one struct column __row beside more, so that no name of its columns can clash; back by select("__row.*")."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *[v.alias(k) for k, v in more.items()])
