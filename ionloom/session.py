"""Shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local session may do without it and then gets a temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a shared folder")
    if not spark.conf.get("spark.ionloom.scratch", None):
        spark.conf.set("spark.ionloom.scratch", tempfile.mkdtemp(prefix="ionloom-"))
    return spark.conf.get("spark.ionloom.scratch")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table to shared storage and continue from it: short lineage, stable ids, columnar."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """Small constant table. Arrow input becomes a local relation with a known size, so the
    optimizer can decide on broadcasting it."""
    return spark.createDataFrame(pa.table({c: list(v) for c, v in zip(columns, zip(*rows))}))
