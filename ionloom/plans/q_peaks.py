"""Queries on peak lists: cleaning, acceptance and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import peaks as pk
from ionloom.functions import splash as sp
from ionloom.functions.exprs import first_number
from ionloom.operators import clean as cn
from ionloom.operators.dedup import with_splash
from ionloom.plans import fixture as fx
from ionloom.plans import oracle as orc
from ionloom.schema import Params

QUERIES = {}
ORACLES = {}
PRECURSOR = fx.HEADER["precursormz"]
TOP3 = 3


def _add(name: str, fn, sql: str) -> None:
    QUERIES[name] = fn
    ORACLES[name] = sql


def _text(value: Column) -> Column:
    return pk.to_text(value, ";")


def _peak_query(name: str, value, sql_value: str, columns: tuple[str, ...] = ()) -> None:
    """``record_id, peaks_text`` of one peak-list expression."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fx.spectra_raw(spark, sf_dir, list(columns))
        return df.select("record_id", _text(value(F.col("peaks"))).alias("peaks_text"))

    sql = orc.query(
        [*orc.raw(), f"v AS (SELECT *, {orc.first_number('precursormz')} AS precursor FROM raw)",
         f"x AS (SELECT record_id, {sql_value} AS peaks FROM v)"],
        f"SELECT record_id, {orc.peak_text()} AS peaks_text FROM x",
    )
    _add(name, run, sql)


_peak_query("sort_peaks", pk.sort_by_mz, orc.SORTED)
_peak_query("drop_nonpositive", pk.positive_only, orc.POSITIVE)
_peak_query(
    "cut_above_precursor",
    lambda p: pk.below_precursor(p, first_number(F.col("precursormz"))),
    orc.cut("precursor"),
    ("precursormz",),
)
_peak_query("top_k_peaks", lambda p: pk.most_intense(p, TOP3), orc.top_k(TOP3))
_peak_query("normalize_intensity", pk.scale_to_base_peak, orc.SCALED)
_peak_query("mz_range", lambda p: pk.within_mz(p, 50, 2000), orc.RANGE)
_peak_query("peaks_to_text", lambda p: p, "peaks")


def _scalar(name: str, value, sql_value: str, column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fx.spectra_raw(spark, sf_dir, [])
        positive = df.withColumn("peaks", pk.positive_only(F.col("peaks")))
        return positive.select("record_id", value(F.col("peaks")).alias(column))

    sql = orc.query(
        [*orc.raw(), f"v AS (SELECT * REPLACE ({orc.POSITIVE} AS peaks) FROM raw)"],
        f"SELECT record_id, {sql_value} AS {column} FROM v",
    )
    _add(name, run, sql)


_scalar("spectral_entropy", lambda p: F.round(pk.entropy(p), 6), orc.r6(orc.ENTROPY), "entropy")
_scalar("count_peaks", F.size, "len(peaks)::INT", "num_peaks")
_scalar("count_high_peaks", lambda p: pk.count_high(p, 5.0), f"{orc.N_HIGH}::INT", "high_peaks")


def _rejected(name: str, test, sql_test: str, reason: str, columns: tuple[str, ...] = ()) -> None:
    """``record_id, deletion_reason`` of one acceptance check on positive peaks."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fx.spectra_raw(spark, sf_dir, list(columns)).withColumn("deletion_reason", F.lit(None).cast("string"))
        if name != "require_peaks":
            df = df.withColumn("peaks", pk.positive_only(F.col("peaks")))
        return cn.reject(df, reason, test()).filter("deletion_reason is not null").select("record_id", "deletion_reason")

    prep = "raw" if name == "require_peaks" else f"(SELECT * REPLACE ({orc.POSITIVE} AS peaks) FROM raw)"
    sql = orc.query(orc.raw(), f"SELECT record_id, '{reason}' AS deletion_reason FROM {prep} WHERE {sql_test}")
    _add(name, run, sql)


P = Params()
_rejected("require_peaks", lambda: cn.lacks_peaks(F.col("peaks")), "len(peaks) = 0", "no_peaks")
_rejected("min_peaks", lambda: F.size("peaks") < P.min_peaks, "len(peaks) < 3", "min_peaks")
_rejected(
    "min_high_peaks",
    lambda: F.coalesce(pk.count_high(F.col("peaks"), P.high_peak_percent), F.lit(0)) < P.high_peak_count,
    f"{orc.N_HIGH} < 2",
    "min_high_peaks",
)
_rejected("min_entropy", lambda: pk.entropy(F.col("peaks")) < P.min_entropy, f"{orc.ENTROPY} < 0.5", "low_entropy")


def gc_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.spectra_raw(spark, sf_dir, ["filename", "instrumenttype"])
    return df.select("record_id", cn.is_gc().alias("is_gc"))


def require_precursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.headers(spark, sf_dir, ["filename", "instrumenttype", "precursormz"])
    checked = cn.require_precursor(df.withColumn("deletion_reason", F.lit(None).cast("string")))
    return checked.select("record_id", F.round("precursormz", 6).alias("precursormz"), "deletion_reason")


_add("gc_branch", gc_branch, orc.query(orc.raw(), f"SELECT record_id, {orc.IS_GC} AS is_gc FROM raw"))
_add(
    "require_precursor",
    require_precursor,
    orc.query(
        orc.raw(),
        f"SELECT record_id, round({orc.first_number('precursormz')}, 6) AS precursormz, CASE WHEN {orc.IS_GC} THEN NULL "
        f"WHEN {orc.first_number('precursormz')} IS NULL THEN 'precursor_invalid' "
        f"WHEN {orc.first_number('precursormz')} <= 0 THEN 'precursor_le_zero' END AS deletion_reason FROM raw",
    ),
)


def clean_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All peak filters in order on raw spectra, with the first failing check."""
    df = fx.spectra_raw(spark, sf_dir, ["filename", "instrumenttype", "precursormz"])
    out = cn.accept_spectra(cn.require_peaks(df.withColumn("deletion_reason", F.lit(None).cast("string"))))
    kept = F.col("deletion_reason").isNull()
    return out.select(
        "record_id",
        "deletion_reason",
        "num_peaks",
        F.round("entropy", 6).alias("entropy"),
        F.when(kept, _text(F.col("peaks"))).alias("peaks_text"),
    )


_add(
    "clean_peaks",
    clean_peaks,
    orc.query(
        [
            *orc.raw(),
            f"src AS (SELECT *, {orc.first_number('precursormz')} AS precursor, {orc.IS_GC} AS is_gc FROM raw)",
            "pre AS (SELECT *, coalesce(CASE WHEN len(peaks) = 0 THEN 'no_peaks' END, CASE WHEN is_gc THEN NULL "
            "WHEN precursor IS NULL THEN 'precursor_invalid' WHEN precursor <= 0 THEN 'precursor_le_zero' END) AS reason FROM src)",
            *orc.accepted("pre"),
        ],
        "SELECT record_id, reason AS deletion_reason, CASE WHEN reason IS NULL THEN len(peaks)::INT END AS num_peaks, "
        f"round(entropy, 6) AS entropy, CASE WHEN reason IS NULL THEN {orc.peak_text()} END AS peaks_text FROM acc",
    ),
)


# --- fingerprints ---------------------------------------------------------------------------


def _relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.spectra_raw(spark, sf_dir, []).withColumn("peaks", sp.relative(F.col("peaks")))


def relative_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relative(spark, sf_dir).select("record_id", _text(F.col("peaks")).alias("peaks_text"))


def top_ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relative(spark, sf_dir).select("record_id", _text(sp.top_ions(F.col("peaks"))).alias("peaks_text"))


def mz_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.col("peaks")
    prefilter = sp.histogram(sp.top_ions(rel), *sp.PREFILTER)
    return _relative(spark, sf_dir).select(
        "record_id", prefilter.alias("prefilter"), sp.histogram(rel, *sp.SIMILARITY).alias("similarity")
    )


def base_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.col("peaks")
    digits = _relative(spark, sf_dir).select("record_id", sp.histogram(sp.top_ions(rel), *sp.PREFILTER).alias("digits"))
    return digits.select("record_id", sp.translate_base3(F.col("digits")).alias("block"))


def spectrum_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relative(spark, sf_dir).select("record_id", sp.ion_hash(F.col("peaks")).alias("block"))


def splash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_splash(fx.spectra_raw(spark, sf_dir, [])).select("record_id", "splash")


_REL = [*orc.raw(), orc.relative("raw")]
_add("relative_intensity", relative_intensity, orc.query(_REL, f"SELECT record_id, {orc.peak_text()} AS peaks_text FROM rel"))
_add(
    "top_ions",
    top_ions,
    orc.query([*_REL, *orc.top_ions("rel")], f"SELECT record_id, {orc.peak_text()} AS peaks_text FROM top"),
)
_HIST = [*_REL, *orc.top_ions("rel"), *orc.histogram("top", *sp.PREFILTER, "pre"), *orc.histogram("rel", *sp.SIMILARITY, "sim")]
_add(
    "mz_histogram",
    mz_histogram,
    orc.query(
        _HIST,
        "SELECT raw.record_id, pre.digits AS prefilter, sim.digits AS similarity FROM raw LEFT JOIN pre USING (record_id) "
        "LEFT JOIN sim USING (record_id)",
    ),
)
_add(
    "base_translation",
    base_translation,
    orc.query(_HIST, f"SELECT raw.record_id, {orc.base36('pre.digits')} AS block FROM raw LEFT JOIN pre USING (record_id)"),
)
_add(
    "spectrum_hash",
    spectrum_hash,
    orc.query([*_REL, orc.ion_hash("rel")], "SELECT raw.record_id, block FROM raw LEFT JOIN hsh USING (record_id)"),
)
_add("splash", splash, orc.query([*orc.raw(), *orc.splash("raw")], "SELECT record_id, splash FROM spl"))
