"""Peak-list cleaning and spectrum acceptance; one narrow stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions import peaks as pk
from ionloom.functions.exprs import first_number, matches
from ionloom.functions.text import is_gc_type
from ionloom.schema import Params


def is_gc() -> Column:
    """GC spectra need no precursor: ``_GC`` in the file name or the word GC in the type."""
    return matches(F.col("filename"), "_GC") | is_gc_type(F.col("instrumenttype"))


def lacks_peaks(peaks: Column) -> Column:
    return F.coalesce(F.size(peaks) <= 0, F.lit(True))


def reject(df: DataFrame, reason: str, test: Column) -> DataFrame:
    """Set ``deletion_reason`` where it is still NULL and the test holds."""
    return df.withColumn(
        "deletion_reason",
        F.coalesce("deletion_reason", F.when(test, F.lit(reason))),
    )


def require_peaks(df: DataFrame) -> DataFrame:
    return reject(df, "no_peaks", lacks_peaks(F.col("peaks")))


def precursor_reason(precursor: Column, gc: Column) -> Column:
    value = first_number(precursor)
    return (
        F.when(gc, F.lit(None).cast("string"))
        .when(value.isNull(), F.lit("precursor_invalid"))
        .when(value <= 0, F.lit("precursor_le_zero"))
    )


def require_precursor(df: DataFrame) -> DataFrame:
    """Type ``precursormz`` as DOUBLE; non-GC spectra without a positive value are rejected."""
    gc = is_gc()
    return df.withColumns(
        {
            "deletion_reason": F.coalesce("deletion_reason", precursor_reason(F.col("precursormz"), gc)),
            "precursormz": first_number(F.col("precursormz")),
            "is_gc": gc,
        }
    )


def clean_peaks(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Sort and filter the peaks of spectra that still have no ``deletion_reason``.

    Needs ``precursormz`` DOUBLE and ``is_gc``. Adds ``entropy`` and ``num_peaks``; rejected
    spectra keep the peaks they had when they failed.
    """
    peaks = F.col("peaks")

    def step(frame: DataFrame, value: Column) -> DataFrame:
        return frame.withColumn("peaks", F.when(F.col("deletion_reason").isNull(), value).otherwise(peaks))

    out = step(df, pk.positive_only(pk.sort_by_mz(peaks)))
    if params.min_peaks is not None:
        out = reject(out, "min_peaks", F.size(peaks) < int(params.min_peaks))
    out = reject(out, "no_peaks", F.size(peaks) == 0)
    if params.precursor_window is not None:
        limit = F.when(~F.col("is_gc"), F.col("precursormz"))
        out = step(out, pk.below_precursor(peaks, limit, params.precursor_window))
        out = reject(out, "all_above_precursor", F.size(peaks) == 0)
    if params.max_peaks is not None:
        out = step(out, pk.most_intense(peaks, int(params.max_peaks)))
    if params.normalize_intensity:
        out = step(out, pk.scale_to_base_peak(peaks))
    if params.mz_from is not None and params.mz_to is not None:
        out = step(out, pk.within_mz(peaks, params.mz_from, params.mz_to))
        out = reject(out, "mz_range", F.size(peaks) == 0)
    if params.high_peak_percent is not None:
        out = reject(out, "min_high_peaks", pk.count_high(peaks, params.high_peak_percent) < params.high_peak_count)
    out = out.withColumn("entropy", F.when(F.col("deletion_reason").isNull(), pk.entropy(peaks)))
    if params.min_entropy is not None:
        out = reject(out, "low_entropy", F.col("entropy") < params.min_entropy)
    return out.withColumn("num_peaks", F.when(F.col("deletion_reason").isNull(), F.size(peaks)))


def accept_spectra(df: DataFrame, params: Params = Params()) -> DataFrame:
    return clean_peaks(require_precursor(df), params).drop("is_gc")
