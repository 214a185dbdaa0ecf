"""Queries for fragment formula annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators import denovo as dn
from ionloom.plans import fixture as fx
from ionloom.plans import oracle as orc

QUERIES = {}
ORACLES = {}
COUNTS = [f"n_{s}" for s in orc.MASSES]


def _add(name: str, fn, ctes: list[str], final: str) -> None:
    QUERIES[name] = fn
    ORACLES[name] = orc.query(ctes, final)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.denovo_spectra(spark, sf_dir)
    return dn.subformula_candidates(dn.parse_formula(df), dn.largest_targets(df))


def parse_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dn.parse_formula(fx.denovo_spectra(spark, sf_dir)).select(
        "formula", "is_simple", *[f"max_{s}" for s in orc.MASSES]
    )


def subformula_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("formula", *COUNTS, F.round("mass", 6).alias("mass"))


def bounded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compositions of the formulas of heavy-peaked spectra, between their lightest and heaviest window."""
    df = fx.denovo_spectra(spark, sf_dir).withColumn("peaks", F.filter("peaks", lambda p: p["mz"] >= 90))
    limits = dn.largest_targets(df.filter(F.size("peaks") > 0))
    found = dn.bounded_candidates(dn.parse_formula(df), limits)
    return found.select("formula", *COUNTS, F.round("mass", 6).alias("mass"))


def plausible_chnops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).filter("is_simple").filter(dn.plausible_chnops()).select("formula", *COUNTS)


def plausible_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).filter("not is_simple").filter(dn.plausible_general()).select("formula", *COUNTS)


def hill_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("formula", *COUNTS, dn.hill_formula().alias("hill"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.denovo_spectra(spark, sf_dir)
    heavy = dn.heavy_compositions(dn.parse_formula(df), dn.largest_targets(df))
    return dn.match_hydrogens(dn.peak_targets(df), heavy)


def annotate_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("formula", "mz", *COUNTS, "error_ppm")


def best_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dn.best_annotation(_hits(spark, sf_dir))


def annotated_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dn.annotate_peaks(fx.denovo_spectra(spark, sf_dir))
    return out.select("record_id", dn.annotated_text(F.col("annotated_peaks"), ";").alias("peaks_text"))


BASE = orc.denovo()
_N = ", ".join(COUNTS)
_add("parse_formula", parse_formula, [*BASE, orc.formulas()],
     f"SELECT formula, is_simple, {', '.join('max_' + s for s in orc.MASSES)} FROM frm")
_CAN = [*BASE, *orc.candidates()]
_add("subformula_candidates", subformula_candidates, _CAN, f"SELECT formula, {_N}, round(mass, 6) AS mass FROM can")
_add("bounded_candidates", bounded_candidates, [*BASE, *orc.candidates(90)], f"SELECT formula, {_N}, round(mass, 6) AS mass FROM can")
_add("plausible_chnops", plausible_chnops, _CAN, f"SELECT formula, {_N} FROM can WHERE is_simple AND {orc.PLAUSIBLE_SIMPLE}")
_add("plausible_general", plausible_general, _CAN, f"SELECT formula, {_N} FROM can WHERE NOT is_simple AND {orc.PLAUSIBLE_GENERAL}")
_add("hill_formula", hill_formula, _CAN, f"SELECT formula, {_N}, {orc.HILL} AS hill FROM can")
_add("annotate_range_join", annotate_range_join, [*BASE, *orc.hits()], f"SELECT formula, mz, {_N}, error_ppm FROM hit")
_add("best_annotation", best_annotation, [*BASE, *orc.best()],
     "SELECT formula, mz, fragment, error_ppm, fragment_mass FROM bst")
_add("annotated_peaks", annotated_peaks,
     [*BASE, *orc.best(),
      "pks AS (SELECT record_id, formula, unnest(peaks) AS p, generate_subscripts(peaks, 1) AS i FROM dn)"],
     "SELECT record_id, string_agg(concat(printf('%.8f %.8f', p.mz, p.intensity), CASE WHEN fragment IS NOT NULL THEN "
     "concat(' ', fragment, '/', printf('%.2f', error_ppm)) ELSE '' END), ';' ORDER BY i) AS peaks_text FROM pks "
     "LEFT JOIN bst ON bst.formula = pks.formula AND bst.mz = p.mz GROUP BY record_id")
