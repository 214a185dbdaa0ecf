"""Peak-list expressions on ``ARRAY<STRUCT<mz, intensity>>``; all narrow, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.functions.exprs import let


def peak(mz: Column, intensity: Column) -> Column:
    return F.struct(mz.alias("mz"), intensity.alias("intensity"))


def no_peaks(peaks: Column) -> Column:
    return F.slice(peaks, 1, 0)


def base_peak(peaks: Column) -> Column:
    return F.array_max(F.transform(peaks, lambda p: p["intensity"]))


def sort_by_mz(peaks: Column) -> Column:
    return F.array_sort(peaks)


def positive_only(peaks: Column) -> Column:
    return F.filter(peaks, lambda p: p["intensity"] > 0)


def below_precursor(peaks: Column, precursor: Column, window: float = 5.0) -> Column:
    """Keep m/z strictly below precursor + window; a NULL precursor keeps everything."""
    return F.when(precursor.isNull(), peaks).otherwise(
        F.filter(peaks, lambda p: p["mz"] < precursor + F.lit(window))
    )


def most_intense(peaks: Column, k: int) -> Column:
    """The k most intense peaks (ties: larger m/z), back in m/z order."""
    ranked = F.sort_array(F.transform(peaks, lambda p: F.struct(p["intensity"], p["mz"])), asc=False)
    best = F.transform(F.slice(ranked, 1, k), lambda p: peak(p["mz"], p["intensity"]))
    return F.when(F.size(peaks) > k, F.array_sort(best)).otherwise(peaks)


def scale_to_base_peak(peaks: Column) -> Column:
    return let(
        base_peak(peaks),
        lambda top: F.when(
            top > 0, F.transform(peaks, lambda p: peak(p["mz"], p["intensity"] / top))
        ).otherwise(no_peaks(peaks)),
    )


def within_mz(peaks: Column, lo: float, hi: float) -> Column:
    """Inclusive m/z window; the bounds are truncated to whole numbers."""
    return F.filter(peaks, lambda p: p["mz"].between(float(int(lo)), float(int(hi))))


def count_high(peaks: Column, percent: float) -> Column:
    return let(
        base_peak(peaks),
        lambda top: F.size(F.filter(peaks, lambda p: p["intensity"] / top * 100 >= percent)),
    )


def entropy(peaks: Column) -> Column:
    """Shannon entropy (bits) of the intensities; 0 when they sum to 0."""
    total = F.aggregate(peaks, F.lit(0.0), lambda acc, p: acc + p["intensity"])

    def bits(sum_: Column) -> Column:
        shares = F.transform(F.filter(peaks, lambda p: p["intensity"] > 0), lambda p: p["intensity"] / sum_)
        return F.aggregate(shares, F.lit(0.0), lambda acc, x: acc - x * F.log2(x))

    return let(total, lambda s: F.when(s > 0, bits(s)).otherwise(F.lit(0.0)))


def fixed_text(number: Column) -> Column:
    """``%.8f`` of a number. Decimals write the same digits as the formatter at a fraction of its price,
    in the range where they are neither rounded away nor written with an exponent."""
    plain = number.between(1e-6, 1e9)
    return F.when(plain, number.cast("decimal(18,8)").cast("string")).otherwise(F.format_string("%.8f", number))


def pair_text(p: Column, separator: str = " ") -> Column:
    return F.concat(fixed_text(p["mz"]), F.lit(separator), fixed_text(p["intensity"]))


def to_text(peaks: Column, separator: str = "\n") -> Column:
    return F.array_join(F.transform(peaks, lambda p: pair_text(p)), separator)
