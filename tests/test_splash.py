"""SPLASH and peak filters against slow, independent Python versions."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from ionloom.functions import peaks as pk
from ionloom.functions.splash import splash
from ionloom.schema import PEAKS_TYPE

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"


def py_histogram(ions, base, length, width):
    bins = [0.0] * length
    for mz, i in ions:
        bins[int(mz / width) % length] += i
    top = max(bins)
    return "".join(ALPHABET[int(1e-7 + (base - 1) * x / top)] for x in bins)


def py_scale(ions):
    top = max(i for _, i in ions)
    return [(mz, i / top * 100.0) for mz, i in ions]


def py_splash(ions):
    rel = py_scale(ions)
    top = max(i for _, i in rel)
    strong = [(mz, i) for mz, i in rel if i + 1e-7 >= 0.1 * top]
    strong = py_scale(sorted(strong, key=lambda p: (-p[1], p[0]))[:10])
    n, block = int(py_histogram(strong, 3, 10, 5), 3), ""
    while n:
        n, digit = divmod(n, 36)
        block = ALPHABET[digit] + block
    pairs = sorted(((int((mz + 1e-7) * 1e6), int(i + 1e-7)) for mz, i in rel), key=lambda p: (p[0], -p[1]))
    digest = hashlib.sha256(" ".join(f"{a}:{b}" for a, b in pairs).encode()).hexdigest()[:20]
    return f"splash10-{block.zfill(4)}-{py_histogram(rel, 10, 10, 100)}-{digest}"


def frame(spark, spectra):
    rows = [(k, [tuple(map(float, p)) for p in s]) for k, s in enumerate(spectra)]
    return spark.createDataFrame(rows, f"record_id bigint, peaks {PEAKS_TYPE}")


def random_spectra(n=200):
    rng = random.Random(7)
    return [
        [(round(rng.uniform(20, 1500), 4), round(rng.uniform(0.5, 1000), 3)) for _ in range(rng.randint(1, 40))]
        for _ in range(n)
    ]


def column(df, expr):
    return [r[0] for r in df.orderBy("record_id").select(expr).collect()]


def test_splash_equals_python(spark):
    spectra = random_spectra()
    assert column(frame(spark, spectra), splash(F.col("peaks"))) == [py_splash(s) for s in spectra]


def test_splash_edge_cases(spark):
    spectra = [[(100.0, 5.0)], [(100.0, 0.0), (120.0, 0.0)], [], [(100.0, 10.0), (200.0, -3.0)]]
    values = column(frame(spark, spectra), splash(F.col("peaks")))
    assert values[0] == py_splash(spectra[0])
    assert values[1] is None and values[2] is None


def test_splash_ignores_order_and_scale(spark):
    # Powers of two keep the sums exact in any order.
    spectrum = [(50.0 + 7 * k, float(2 ** (k % 5))) for k in range(12)]
    variants = [spectrum, spectrum[::-1], [(m, i * 8) for m, i in spectrum]]
    assert len(set(column(frame(spark, variants), splash(F.col("peaks"))))) == 1


def test_entropy(spark):
    spectra = random_spectra(50)

    def py_entropy(s):
        total = sum(i for _, i in s)
        return -sum(i / total * math.log2(i / total) for _, i in s)

    values = column(frame(spark, spectra), pk.entropy(F.col("peaks")))
    for value, spectrum in zip(values, spectra):
        assert value == pytest.approx(py_entropy(spectrum), abs=1e-9)
        assert value <= math.log2(len(spectrum)) + 1e-9


def test_peak_filter_edges(spark):
    df = frame(spark, [[(50.0, 1.0), (49.999, 1.0), (2000.0, 2.0), (2000.001, 2.0)]])
    assert column(df, F.transform(pk.within_mz(F.col("peaks"), 50.9, 2000.9), lambda p: p["mz"])) == [[50.0, 2000.0]]
    cut = pk.below_precursor(F.col("peaks"), F.lit(1995.0))
    assert column(df, F.transform(cut, lambda p: p["mz"])) == [[50.0, 49.999]]
    ties = pk.most_intense(F.col("peaks"), 3)
    assert column(df, F.transform(ties, lambda p: p["mz"])) == [[50.0, 2000.0, 2000.001]]
    assert column(frame(spark, [[(60.0, 0.0)]]), F.size(pk.scale_to_base_peak(F.col("peaks")))) == [0]
