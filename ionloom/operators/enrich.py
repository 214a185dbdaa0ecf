"""Structure resolution, compound and ontology enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions.elements import AVERAGE, MONOISOTOPIC, formula_mass
from ionloom.functions.inchi import formula_layer, structure_mass
from ionloom.functions.text import strip_smiles_extension, valid_inchikey
from ionloom.operators.joins import lookup_join
from ionloom.schema import COMPOUND_COLUMNS, MISSING, ONTOLOGY_COLUMNS
from ionloom.session import stage

DERIVED = ["inchi", "inchikey", "smiles", "formula", "exactmass", "averagemass"]
DERIVED_SCHEMA = (
    "structure string, inchi string, inchikey string, smiles string, formula string, "
    "exactmass double, averagemass double"
)


def distinct_structures(df: DataFrame) -> DataFrame:
    """Every InChI and SMILES text once, so that work on structures is done once per value."""
    both = df.select(F.col("inchi").alias("structure")).union(df.select("smiles"))
    return both.filter(F.col("structure") != "").distinct()


def one_per_key(lookup: DataFrame, key: str) -> DataFrame:
    """One lookup row per key: the smallest one, so repeated keys cannot multiply spectra."""
    rest = [c for c in lookup.columns if c != key]
    return (
        lookup.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(F.struct(*rest)).alias("_row"))
        .select(key, "_row.*")
    )


def structure_table(compounds: DataFrame) -> DataFrame:
    """Compound table keyed by structure text: each row once under its InChI, once under its SMILES.

    Written out, like all lookups: a join can split a hot key's partition only where its other side is
    read as it lies, not where it is aggregated by the same key in the same stage.
    """
    facts = F.struct(*[F.col(c) for c in DERIVED]).alias("facts")
    texts = F.array_distinct(F.array("inchi", "smiles"))
    rows = compounds.select(F.explode(texts).alias("structure"), facts)
    return stage(one_per_key(rows.filter(F.col("structure") != ""), "structure"), "structures")


def derive_structures(
    structures: DataFrame, structure_fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
) -> DataFrame:
    """Optional hook: a chemistry toolkit applied with ``mapInPandas`` to distinct structures."""
    derived = structures.mapInPandas(structure_fn, DERIVED_SCHEMA)
    return derived.select("structure", F.struct(*DERIVED).alias("facts"))


def resolve_structures(df: DataFrame, table: DataFrame) -> DataFrame:
    """Replace identifiers and masses by those of the InChI, else of the SMILES; else keep them.

    ``table`` has ``structure`` and a ``facts`` struct. Masses still missing come from the
    InChI with its proton and isotope layers or the formula.
    """
    keyed = df.withColumns(
        {"_inchi": F.nullif("inchi", F.lit("")), "_smiles": F.nullif(strip_smiles_extension(F.col("smiles")), F.lit(""))}
    )
    by_inchi = table.select(F.col("structure").alias("_inchi"), F.col("facts").alias("_a"))
    by_smiles = table.select(F.col("structure").alias("_smiles"), F.col("facts").alias("_b"))
    joined = lookup_join(lookup_join(keyed, by_inchi, "_inchi"), by_smiles, "_smiles")
    facts = F.coalesce("_a", "_b")

    def resolved(name: str) -> Column:
        own = F.col(name).cast("double") if name.endswith("mass") else F.col(name)
        return F.when(facts.isNotNull(), facts[name]).otherwise(own)

    out = joined.withColumns({c: resolved(c) for c in DERIVED}).drop("_a", "_b", "_inchi", "_smiles")
    return fill_masses(out)


def fill_masses(df: DataFrame) -> DataFrame:
    named = formula_layer(F.col("inchi")).isNotNull()

    def mass(weights: dict[str, float]) -> Column:
        return F.when(named, structure_mass(F.col("inchi"), weights)).otherwise(formula_mass(F.nullif("formula", F.lit("")), weights))

    return df.withColumns({"exactmass": F.coalesce("exactmass", mass(MONOISOTOPIC)), "averagemass": F.coalesce("averagemass", mass(AVERAGE))})


def structure_reason(require_all: bool = False) -> Column:
    """Reason code for an invalid InChIKey or, in strict mode, a missing identifier or mass."""
    bad_key = F.when(~valid_inchikey(F.col("inchikey")), F.lit("bad_inchikey"))
    if not require_all:
        return bad_key
    missing = F.lit(False)
    for name in ("exactmass", "averagemass", "smiles", "inchi", "inchikey"):
        missing = missing | F.col(name).isNull()
    return F.coalesce(bad_key, F.when(missing, F.lit("no_structure_after_derivation")))


def enrich_compounds(df: DataFrame, compounds: DataFrame) -> DataFrame:
    """Left join on InChIKey; a lookup value wins when it is not NULL."""
    names = {c: f"_{c}" for c in COMPOUND_COLUMNS}
    lookup = stage(one_per_key(compounds.select("inchikey", *COMPOUND_COLUMNS), "inchikey"), "compounds").withColumnsRenamed(names)
    joined = lookup_join(df, lookup, "inchikey")
    return joined.withColumns({c: F.coalesce(names[c], c) for c in COMPOUND_COLUMNS}).drop(*names.values())


def enrich_ontology(df: DataFrame, ontologies: DataFrame) -> DataFrame:
    """Six class columns from the lookup, ``NOT FOUND`` otherwise."""
    lookup = stage(one_per_key(ontologies.select("inchikey", *ONTOLOGY_COLUMNS), "inchikey"), "ontologies")
    joined = lookup_join(df.drop(*ONTOLOGY_COLUMNS), lookup, "inchikey")
    return joined.withColumns({c: F.coalesce(c, F.lit(MISSING)) for c in ONTOLOGY_COLUMNS})
