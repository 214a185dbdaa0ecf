"""Helpers shared by the operators: row keys and Arrow maps over narrow projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["_k1", "_k2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_columns(*columns: str | Column) -> list[Column]:
    """Two never-null hashes that stand for a row's id and content (128 bits).

    They come out the same on every scan, so a text can be read again instead of being carried
    through shuffles; rows that repeat an id with the same content share them, rows that repeat an
    id with other content don't.
    """
    return [F.xxhash64(F.lit(1), *columns).alias("_k1"), F.xxhash64(F.lit(2), *columns).alias("_k2")]


def arrow_map(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: str, keep: list[str] | None = None
) -> DataFrame:
    """One output row per input row: the columns `keep` and those that `fn` makes of a batch."""
    kept = keep or []
    full = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(kept).schema), schema] if kept else [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in made.values()]
            yield pa.RecordBatch.from_arrays([*columns, *arrays], names=[*kept, *made])

    return df.mapInArrow(run, full)


def arrow_flat(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Any number of output rows per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)
