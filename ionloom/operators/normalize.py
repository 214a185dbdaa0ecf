"""Metadata normalisation in its fixed order, with a reason for every rejected spectrum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions import text as tx
from ionloom.functions.elements import formula_mass
from ionloom.functions.exprs import first_number, matches
from ionloom.functions.inchi import structure_mass
from ionloom.operators.instruments import InstrumentRule, normalize_instruments
from ionloom.schema import MISSING, TEXT_COLUMNS


def normalize_empties(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = [c for c in (columns or TEXT_COLUMNS) if c in df.columns]
    return df.withColumns({c: tx.normalize_empty(F.col(c)) for c in names})


def repair_descriptors(df: DataFrame) -> DataFrame:
    """Descriptors in their own columns; every pattern is tested once per value."""
    names = ["smiles", "inchi", "inchikey"]
    tests = {f"_{c}_{kind}": test for c in names for kind, test in tx.descriptor_kinds(F.col(c)).items()}
    kinds = {c: {kind: F.col(f"_{c}_{kind}") for kind in names} for c in names}
    moved = tx.move_descriptors(*[F.col(c) for c in names], kinds)
    return df.withColumns(tests).withColumns(moved).drop(*tests)


def normalize_adduct(df: DataFrame, adducts: DataFrame) -> DataFrame:
    """Canonical adduct by table lookup; GC spectra and unknown adducts keep their text."""
    table = adducts.select(F.col("known_adduct").alias("_known"), F.col("canonical").alias("_canonical"))
    return (
        df.withColumn("_known", tx.strip_adduct(F.col("precursortype")))
        .join(table, "_known", "left")
        .withColumn(
            "precursortype",
            F.when(matches(F.col("instrumenttype"), r"(?i)\bGC\b"), F.col("precursortype")).otherwise(
                F.coalesce("_canonical", "precursortype")
            ),
        )
        .drop("_known", "_canonical")
    )


def with_adduct_facts(df: DataFrame, adducts: DataFrame) -> DataFrame:
    """Add ``massdiff``, ``adduct_in_pos`` and ``adduct_in_neg`` of the canonical adduct."""
    facts = adducts.groupBy(F.col("canonical").alias("precursortype")).agg(
        F.max_by("massdiff", F.when(F.col("ionmode") == "positive", 1).otherwise(0)).alias("massdiff"),
        F.bool_or(F.col("ionmode") == "positive").alias("adduct_in_pos"),
        F.bool_or(F.col("ionmode") == "negative").alias("adduct_in_neg"),
    )
    return df.join(facts, "precursortype", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("adduct_in_pos", "adduct_in_neg")}
    )


def precursor_needs_recompute(precursor: Column) -> Column:
    """True without a number, or with a first number that is not above zero."""
    return F.coalesce(first_number(precursor) <= 0, F.lit(True))


def neutral_mass() -> Column:
    """Exact mass of the structure: that of the InChI with its layers, else of the formula field."""
    return F.coalesce(structure_mass(F.col("inchi")), formula_mass(F.col("formula")))


def recompute_precursor(df: DataFrame) -> DataFrame:
    """Fill a missing precursor m/z with neutral mass + adduct mass shift (needs ``massdiff``)."""
    computed = (neutral_mass() + F.col("massdiff")).cast("string")
    return df.withColumn(
        "precursormz",
        F.when(precursor_needs_recompute(F.col("precursormz")), F.coalesce(computed, "precursormz")).otherwise(
            F.col("precursormz")
        ),
    )


def adduct_reason(adduct: Column, ionmode: Column, instrumenttype: Column, in_pos: Column, in_neg: Column) -> Column:
    """Reason code of an adduct that is unusable or contradicts the ion mode, else NULL."""
    empty = F.coalesce(adduct == "", F.lit(True))
    return (
        F.when(tx.is_gc_type(instrumenttype) & empty, F.lit(None).cast("string"))
        .when(~matches(adduct, tx.ADDUCT_LIKE), F.lit("bad_adduct"))
        .when((ionmode == "positive") & in_neg, F.lit("neg_in_pos"))
        .when((ionmode == "negative") & in_pos, F.lit("pos_in_neg"))
    )


def check_adduct(df: DataFrame, adducts: DataFrame) -> DataFrame:
    """Complete default and bare adducts, then add ``adduct_reason``."""
    completed = df.drop("massdiff", "adduct_in_pos", "adduct_in_neg").withColumn(
        "precursortype", tx.default_adduct(F.col("precursortype"), F.col("predicted"), F.col("ionmode"))
    )
    completed = completed.withColumn("precursortype", tx.complete_bare_m(F.col("precursortype"), F.col("ionmode")))
    reason = adduct_reason(
        F.col("precursortype"), F.col("ionmode"), F.col("instrumenttype"), F.col("adduct_in_pos"), F.col("adduct_in_neg")
    )
    return (
        with_adduct_facts(completed, adducts)
        .withColumn("adduct_reason", reason)
        .drop("massdiff", "adduct_in_pos", "adduct_in_neg")
    )


def normalize_values(df: DataFrame, adducts: DataFrame, rules: list[InstrumentRule]) -> DataFrame:
    """All metadata steps in order; adds ``deletion_reason`` where it is still NULL.

    ``predicted`` becomes BOOLEAN and ``rt`` DOUBLE (minutes).
    """
    out = df if "deletion_reason" in df.columns else df.withColumn("deletion_reason", F.lit(None).cast("string"))
    out = repair_descriptors(normalize_empties(out))
    out = out.withColumns(
        {
            "deletion_reason": F.coalesce(
                "deletion_reason",
                F.when(~tx.has_structure(F.col("smiles"), F.col("inchi"), F.col("inchikey")), F.lit("no_structure")),
            ),
            "ionization": tx.normalize_ionization(F.col("ionization"), F.col("instrumenttype")),
        }
    )
    out = normalize_adduct(normalize_instruments(out, rules), adducts)
    out = recompute_precursor(with_adduct_facts(out, adducts)).withColumns(
        {
            "ionmode": tx.normalize_ionmode(F.col("ionmode")),
            "predicted": tx.flag_predicted(F.col("predicted"), F.col("comment"), F.col("filename"), F.col("name")),
        }
    )
    out = check_adduct(out, adducts)
    return out.withColumns(
        {
            "deletion_reason": F.coalesce("deletion_reason", "adduct_reason"),
            "mslevel": tx.normalize_ms_level(F.col("mslevel")),
            "rt": tx.normalize_rt(F.col("rt")),
        }
    ).drop("adduct_reason")


def fill_not_found(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing text as ``NOT FOUND``; only sinks need this."""
    names = [c for c, t in df.dtypes if t == "string" and (columns is None or c in columns)]
    return df.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(MISSING)) for c in names})
