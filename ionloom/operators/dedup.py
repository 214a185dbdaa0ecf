"""Union, projection, duplicate removal and the registry of seen spectra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions import peaks as pk
from ionloom.functions.splash import splash
from ionloom.operators.joins import lookup_join
from ionloom.schema import COLUMNS, PEAKS_TYPE, TEXT_COLUMNS


def project_canonical(df: DataFrame, *extra: str) -> DataFrame:
    """``record_id``, the canonical columns in order (metadata as text, absent ones NULL), extras."""

    def column(name: str) -> Column:
        kind = PEAKS_TYPE if name == "peaks" else "string"
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)

    return df.select("record_id", *[column(c) for c in COLUMNS], *extra)


def union_sources(*parts: DataFrame) -> DataFrame:
    """Bag union by name, in the given order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_splash(df: DataFrame) -> DataFrame:
    return df.withColumn("splash", splash(F.col("peaks")))


def row_richness(df: DataFrame) -> Column:
    """Number of characters over all fields, peaks as canonical text."""
    texts = [F.length(F.coalesce(F.col(c), F.lit(""))) for c in TEXT_COLUMNS if c in df.columns]
    return reduce(lambda a, b: a + b, texts) + F.length(F.coalesce(pk.to_text(F.col("peaks")), F.lit("")))


def has_inchikey() -> Column:
    return F.coalesce(F.trim("inchikey") != "", F.lit(False))


def richest_ids(df: DataFrame) -> DataFrame:
    """``record_id`` of the richest row per (SPLASH, InChIKey); ties go to the lowest id.

    Only narrow key rows enter the grouping, with a partial maximum on the map side, so a key
    with very many copies stays cheap.
    """
    rank = F.struct(row_richness(df).alias("size"), (-F.col("record_id")).alias("id"))
    return (
        df.filter(has_inchikey())
        .select("splash", "inchikey", rank.alias("rank"))
        .groupBy("splash", "inchikey")
        .agg(F.max("rank").alias("rank"))
        .select((-F.col("rank.id")).alias("record_id"))
    )


def duplicate_ids(df: DataFrame) -> DataFrame:
    """``record_id`` of every row that has a richer copy; rows without InChIKey never do."""
    return df.filter(has_inchikey()).select("record_id").join(richest_ids(df), "record_id", "left_anti")


def flag_duplicates(df: DataFrame) -> DataFrame:
    """Add ``is_duplicate``; whole rows are matched by their unique id."""
    marked = duplicate_ids(df).withColumn("is_duplicate", F.lit(True))
    return df.join(marked, "record_id", "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))


def dedup_keep_richest(df: DataFrame) -> DataFrame:
    return flag_duplicates(df).filter(~F.col("is_duplicate")).drop("is_duplicate")


def dedup_rejects(df: DataFrame) -> DataFrame:
    return (
        flag_duplicates(df)
        .filter("is_duplicate")
        .drop("is_duplicate")
        .withColumn("deletion_reason", F.lit("duplicate"))
    )


def _seen(registry: DataFrame) -> DataFrame:
    return registry.select("splash")


def unseen(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Spectra whose SPLASH is not registered yet."""
    return lookup_join(df, _seen(registry), "splash", "left_anti")


def already_seen(df: DataFrame, registry: DataFrame) -> DataFrame:
    return lookup_join(df, _seen(registry), "splash", "left_semi").withColumn(
        "deletion_reason", F.lit("already_seen")
    )


def new_registry_rows(df: DataFrame, registry: DataFrame, batch_id: int) -> DataFrame:
    """Registry rows to append for a batch: its distinct unregistered SPLASH keys."""
    fresh = df.select("splash").filter(F.col("splash").isNotNull()).distinct()
    return fresh.join(_seen(registry), "splash", "left_anti").withColumn(
        "batch_id", F.lit(batch_id).cast("bigint")
    )
