"""Three-way classification, counts and the run report."""

from __future__ import annotations

from dataclasses import asdict
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.functions.exprs import matches
from ionloom.schema import REASONS, Params
from ionloom.session import local_table

POLARITIES = ["positive", "negative"]
CHROMATOGRAPHIES = ["LC", "GC"]
ORIGINS = ["experimental", "in_silico"]
CLASSES = ["polarity", "chromatography", "origin"]


def split_polarity(df: DataFrame) -> DataFrame:
    """``polarity`` from the ion mode; NULL for any other ion mode."""
    return df.withColumn("polarity", F.when(F.col("ionmode").isin(POLARITIES), F.col("ionmode")))


def split_chromatography(df: DataFrame) -> DataFrame:
    gc = matches(F.col("instrumenttype"), "(?i)GC|EI")
    return df.withColumn("chromatography", F.when(gc, F.lit("GC")).otherwise(F.lit("LC")))


def split_origin(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "origin", F.when(F.col("predicted"), F.lit("in_silico")).otherwise(F.lit("experimental"))
    )


def classify(df: DataFrame) -> DataFrame:
    return split_origin(split_chromatography(split_polarity(df)))


def class_grid(df: DataFrame) -> DataFrame:
    """The eight classes as a table, so that empty classes show up as zero."""
    return local_table(df.sparkSession, list(product(POLARITIES, CHROMATOGRAPHIES, ORIGINS)), CLASSES)


def count_classes(df: DataFrame) -> DataFrame:
    counts = df.groupBy(*CLASSES).agg(F.count(F.lit(1)).alias("spectra"))
    return class_grid(df).join(counts, CLASSES, "left").withColumn("spectra", F.coalesce("spectra", F.lit(0)))


def report_counts(df: DataFrame) -> DataFrame:
    """Spectra per class (zero classes included) and their total."""
    per_class = count_classes(df)
    total = per_class.agg(F.sum("spectra").alias("spectra")).select(
        *[F.lit("TOTAL").alias(c) for c in CLASSES], "spectra"
    )
    return per_class.unionByName(total)


def report_unique_compounds(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct InChIKeys per class; the total also covers spectra of unknown polarity."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    known = df.filter(F.col("polarity").isNotNull())
    counts = known.groupBy(*CLASSES).agg(distinct(F.col("inchikey")).alias("compounds"))
    per_class = class_grid(df).join(counts, CLASSES, "left").withColumn(
        "compounds", F.coalesce("compounds", F.lit(0))
    )
    total = df.agg(distinct(F.col("inchikey")).alias("compounds")).select(
        *[F.lit("TOTAL").alias(c) for c in CLASSES], "compounds"
    )
    return per_class.unionByName(total)


#: Registers of the sketches: 2^14, a relative error of about 0.8 percent.
SKETCH_LG_K = 14
CUBE_SCHEMA = "polarity string, chromatography string, origin string, spectra bigint, compounds binary"


def class_cube(df: DataFrame) -> DataFrame:
    """Spectra and a mergeable sketch of the distinct InChIKeys for every class, every side of the classes and all of them.

    NULL in a class column stands for all its values; spectra of unknown polarity count in the totals only.
    """
    named = df.select(F.coalesce("polarity", F.lit("unknown")).alias("polarity"), "chromatography", "origin", "inchikey")
    cube = named.cube(*CLASSES).agg(F.count(F.lit(1)).alias("spectra"), F.hll_sketch_agg("inchikey", SKETCH_LG_K).alias("compounds"))
    return cube.filter(F.coalesce(F.col("polarity") != "unknown", F.lit(True)))


def merged_cubes(cubes: DataFrame) -> DataFrame:
    """The cubes of several batches as one: spectra are added, sketches united, no batch is read again.

    ``compounds`` is an estimate (standard error 1.04 / 2^(SKETCH_LG_K / 2)); a compound of two batches counts once.
    """
    merged = cubes.groupBy(*CLASSES).agg(F.sum("spectra").alias("spectra"), F.hll_union_agg("compounds").alias("s"))
    return merged.select(*CLASSES, "spectra", F.hll_sketch_estimate("s").alias("compounds"))


def report_rejections(rejects: DataFrame) -> DataFrame:
    """Rejected spectra per reason code, unused codes with zero."""
    counts = rejects.groupBy("deletion_reason").agg(F.count(F.lit(1)).alias("spectra"))
    codes = local_table(rejects.sparkSession, [(r,) for r in REASONS], ["deletion_reason"])
    return codes.join(counts, "deletion_reason", "left").withColumn("spectra", F.coalesce("spectra", F.lit(0)))


def report_total_rejections(rejects: DataFrame) -> DataFrame:
    return rejects.agg(F.count(F.lit(1)).alias("rejected"))


def run_report(kept: DataFrame, rejects: DataFrame, params: Params = Params()) -> DataFrame:
    """``section, metric, value`` rows: parameters, class counts, compounds, rejections."""

    def class_rows(df: DataFrame, section: str, value: str) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"),
            F.concat_ws("/", *CLASSES).alias("metric"),
            F.col(value).cast("string").alias("value"),
        )

    settings = local_table(
        kept.sparkSession,
        [("parameters", k, str(v)) for k, v in asdict(params).items()],
        ["section", "metric", "value"],
    )
    rejected = report_rejections(rejects)
    total = rejected.agg(F.sum("spectra").alias("spectra")).withColumn("deletion_reason", F.lit("TOTAL"))
    return (
        settings.unionByName(class_rows(report_counts(kept), "spectra", "spectra"))
        .unionByName(class_rows(report_unique_compounds(kept), "compounds", "compounds"))
        .unionByName(
            rejected.unionByName(total).select(
                F.lit("filtered_out").alias("section"),
                F.col("deletion_reason").alias("metric"),
                F.col("spectra").cast("string").alias("value"),
            )
        )
    )
