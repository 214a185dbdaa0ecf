"""Lookup joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_LIMIT = 1000
HOT_ROWS = 200_000
SALTS = 64


def hot_keys(df: DataFrame, key: str, at_least: int = HOT_ROWS) -> DataFrame:
    """The most frequent keys, at most ``HOT_LIMIT`` rows.

    Counts are combined map-side; NULL counts as 0. A key outside this list holds less than 1/HOT_LIMIT of the
    rows, so it cannot dominate a partition.
    """
    return (
        df.groupBy(key)
        .agg(F.count(key).alias("_n"))
        .filter(F.col("_n") >= at_least)
        .orderBy(F.desc("_n"), key)
        .limit(HOT_LIMIT)
        .select(F.col(key).alias("_hot"))
    )


def null_apart(key: str, spread: str) -> Column:
    """The text key, or for NULL a text that no key has and that differs from row to row."""
    return F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.xxhash64(spread).cast("string")))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    spread: str = "record_id",
    at_least: int | None = None,
) -> DataFrame:
    """Join ``left`` with a lookup that has one row per ``key`` (``left``, ``left_anti``, ``left_semi``).

    NULL keys never match, so each goes to a partition of its own choice instead of meeting in one.
    A partition with a hot key is split by the adaptive skew join, for which one side with
    unique keys is the easy case; whether the lookup is broadcast is left to the size statistics.
    ``left`` is used once. With ``at_least`` hot keys are counted and salted instead: for sessions
    without adaptive execution, at the price of computing ``left`` three times.
    """
    if at_least is not None:
        return salted_join(left, right, key, how, spread, at_least)
    if left.schema[key].dataType.simpleString() != "string":
        return left.join(right, key, how)
    keyed = left.withColumn("_join", null_apart(key, spread))
    lookup = right.filter(F.col(key).isNotNull()).withColumnRenamed(key, "_join")
    return keyed.join(lookup, "_join", how).drop("_join")


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str, spread: str, at_least: int) -> DataFrame:
    """Rows of hot keys are spread over ``SALTS`` salts and only the hot lookup rows are copied. The
    hot list is bounded, hence the broadcast."""
    hot = F.broadcast(hot_keys(left, key, at_least))
    scatter = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    salted = (
        left.join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left")
        .withColumn(
            "_salt",
            F.when(F.col(key).isNull(), -1 - F.pmod(F.xxhash64(spread), F.lit(1 << 30)).cast("int"))
            .when(F.col("_hot").isNotNull(), scatter)
            .otherwise(F.lit(0)),
        )
        .drop("_hot")
    )
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    lookup = (
        right.filter(F.col(key).isNotNull())
        .join(hot, F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.explode(copies))
        .drop("_hot")
    )
    return salted.join(lookup, [key, "_salt"], how).drop("_salt")
