"""Partitioned writers for curated spectra, rejects, registry and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators.classify import CLASSES, CUBE_SCHEMA
from ionloom.schema import Params
from ionloom.sinks.formats import csv_columns, json_columns, msp_record

REGISTRY_SCHEMA = "splash string, batch_id bigint"


def write_csv(df: DataFrame, path: str, mode: str = "append", folders: tuple[str, ...] = tuple(CLASSES)) -> None:
    """Tab-separated part files with header, one folder per class."""
    df.select(*csv_columns(df), *folders).write.mode(mode).partitionBy(*folders).option("sep", "\t").option(
        "header", True
    ).option("quote", '"').option("escape", '"').csv(path)


def write_msp(df: DataFrame, path: str, mode: str = "append", folders: tuple[str, ...] = tuple(CLASSES)) -> None:
    """MSP part files, records followed by a blank line."""
    df.select(msp_record(df).alias("value"), *folders).write.mode(mode).partitionBy(*folders).option(
        "lineSep", "\n\n"
    ).text(path)


def write_json(df: DataFrame, path: str, mode: str = "append", folders: tuple[str, ...] = tuple(CLASSES)) -> None:
    """JSON Lines part files, readable by the JSON source."""
    df.select(*json_columns(df), *folders).write.mode(mode).partitionBy(*folders).json(path)


def write_spectra(df: DataFrame, out: str, params: Params = Params(), batch_id: int = 0) -> None:
    """All formats that are switched on; a batch has its own folder, which a repeated run overwrites.

    ``params.reset`` replaces the folders of all batches.
    """
    numbered = df.withColumn("batch_id", F.lit(batch_id))
    for name, on, write in (
        ("CSV", params.csv, write_csv), ("MSP", params.msp, write_msp), ("JSON", params.json, write_json)
    ):
        if on and params.reset:
            write(numbered, f"{out}/{name}", "overwrite", ("batch_id", *CLASSES))
        elif on:
            write(df, f"{out}/{name}/batch_id={batch_id}", "overwrite")


def write_rejects(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rejected spectra, one folder per reason code."""
    df.select(*csv_columns(df), "deletion_reason").write.mode(mode).partitionBy("deletion_reason").option(
        "sep", "\t"
    ).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_cube(cube: DataFrame, path: str, batch_id: int, reset: bool = False) -> None:
    """Counts and sketches of a batch, in a folder of its own that a repeated run overwrites; with ``reset`` the only one."""
    if reset:
        cube.withColumn("batch_id", F.lit(batch_id)).coalesce(1).write.mode("overwrite").partitionBy("batch_id").parquet(path)
    else:
        cube.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_cubes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{CUBE_SCHEMA}, batch_id bigint").parquet(path)


def open_registry(spark: SparkSession, path: str, reset: bool = False) -> DataFrame:
    """Registry of seen SPLASH keys; created when missing, emptied on reset."""
    spark.createDataFrame([], REGISTRY_SCHEMA).write.mode("overwrite" if reset else "append").parquet(path)
    return spark.read.schema(REGISTRY_SCHEMA).parquet(path)


def append_registry(rows: DataFrame, path: str) -> None:
    rows.select("splash", F.col("batch_id").cast("bigint")).write.mode("append").parquet(path)


def replace_registry(rows: DataFrame, path: str) -> None:
    rows.select("splash", F.col("batch_id").cast("bigint")).write.mode("overwrite").parquet(path)
