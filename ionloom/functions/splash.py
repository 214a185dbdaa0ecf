"""SPLASH spectrum identifier as one column expression.

Follows the published definition (Wohlgemuth et al., Nature Biotechnology 2016): version block,
prefilter histogram, similarity histogram, truncated SHA-256 of the ion list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.functions.exprs import let
from ionloom.functions.peaks import base_peak, peak

# Fixed values of the identifier definition.
EPS = 1.0e-7
MZ_FACTOR = 1000000
HASH_LENGTH = 20
PREFILTER = (3, 10, 5)
SIMILARITY = (10, 10, 100)
TOP_IONS = 10
BASE_PEAK_SHARE = 0.1
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def relative(peaks: Column) -> Column:
    """Intensities as percent of the base peak; NULL when the base peak is 0 or missing."""

    def scaled(ions: Column) -> Column:
        return let(
            base_peak(ions),
            lambda top: F.when(top != 0, F.transform(ions, lambda p: peak(p["mz"], p["intensity"] / top * 100.0))),
        )

    return let(peaks, scaled)


def top_ions(rel: Column) -> Column:
    """Ions of at least 10 % of the base peak, the ten most intense, scaled again."""

    def strongest(top: Column) -> Column:
        ions = F.filter(rel, lambda p: p["intensity"] + EPS >= F.lit(BASE_PEAK_SHARE) * top)
        ranked = F.sort_array(F.transform(ions, lambda p: F.struct((-p["intensity"]).alias("o"), p["mz"])))
        return F.transform(F.slice(ranked, 1, TOP_IONS), lambda p: peak(p["mz"], -p["o"]))

    return relative(let(base_peak(rel), strongest))


def _levels(ions: Column, base: int, length: int, width: int) -> Column:
    """Per-bin intensity scaled to ``0 .. base-1`` as integers; NULL when the top bin is 0."""
    binned = F.transform(
        ions,
        lambda p: F.struct(
            F.pmod((p["mz"] / width).try_cast("bigint"), F.lit(length)).alias("bin"), p["intensity"]
        ),
    )

    def sums(xs: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(length - 1)),
            lambda b: F.aggregate(
                F.filter(xs, lambda x: x["bin"] == b), F.lit(0.0), lambda acc, x: acc + x["intensity"]
            ),
        )

    def scaled(h: Column) -> Column:
        return let(
            F.array_max(h),
            lambda top: F.when(
                top != 0,
                F.transform(h, lambda x: (F.lit(EPS) + F.lit(float(base - 1)) * x / top).try_cast("bigint")),
            ),
        )

    return let(let(binned, sums), scaled)


def histogram(ions: Column, base: int, length: int, width: int) -> Column:
    """Wrapped histogram as digit text; a digit outside the alphabet gives NULL."""
    size = len(DIGITS)

    def digits(levels: Column) -> Column:
        known = F.forall(levels, lambda d: d.between(-size, size - 1))
        text = F.array_join(
            F.transform(levels, lambda d: F.substr(F.lit(DIGITS), F.pmod(d, F.lit(size)).cast("int") + 1, F.lit(1))),
            "",
        )
        return F.when(known, text)

    return let(_levels(ions, base, length, width), digits)


def translate_base3(digits: Column) -> Column:
    """Base-3 digit text as base 36, padded to four characters."""
    return let(digits, lambda d: F.when(d.rlike("^[012]+$"), F.lpad(F.lower(F.conv(d, 3, 36)), 4, "0")))


def ion_hash(rel: Column) -> Column:
    """First 20 hex digits of the SHA-256 over the sorted integer ion list."""
    ions = F.array_sort(
        F.transform(
            rel,
            lambda p: F.struct(
                ((p["mz"] + EPS) * MZ_FACTOR).try_cast("bigint").alias("m"),
                (-((p["intensity"] + EPS).try_cast("bigint"))).alias("i"),
            ),
        )
    )
    text = F.array_join(F.transform(ions, lambda x: F.concat_ws(":", x["m"], -x["i"])), " ")
    return F.when(rel.isNotNull(), F.substr(F.sha2(text, 256), F.lit(1), F.lit(HASH_LENGTH)))


def splash(peaks: Column) -> Column:
    def assemble(rel: Column) -> Column:
        return F.concat(
            F.lit("splash10-"),
            translate_base3(histogram(top_ions(rel), *PREFILTER)),
            F.lit("-"),
            histogram(rel, *SIMILARITY),
            F.lit("-"),
            ion_hash(rel),
        )

    return let(relative(peaks), assemble)
