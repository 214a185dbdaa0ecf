"""The complete curation run, batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators import classify as cl
from ionloom.operators import dedup as dd
from ionloom.operators import enrich as en
from ionloom.operators.clean import accept_spectra, require_peaks
from ionloom.operators.denovo import annotate_peaks
from ionloom.operators.instruments import InstrumentRule
from ionloom.operators.joins import lookup_join
from ionloom.operators.normalize import normalize_values
from ionloom.schema import Params
from ionloom.session import stage
from ionloom.sinks import writers as wr
from ionloom.sources.lookups import DEFAULT_INSTRUMENTS, adduct_table, complete_adducts
from ionloom.sources.readers import ingest


class Lookups(NamedTuple):
    """Lookup tables of a run; ``compounds`` and ``ontologies`` are optional user tables.

    ``structure_fn`` is the hook of a chemistry toolkit (see ``derive_structures``); its facts
    then replace those of the compound table. With ``adduct_grammar`` names that the adduct table
    lacks are read by the grammar.
    """

    adducts: DataFrame
    instruments: list[InstrumentRule] = DEFAULT_INSTRUMENTS
    compounds: DataFrame | None = None
    ontologies: DataFrame | None = None
    structure_fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None
    adduct_grammar: bool = True


class Curated(NamedTuple):
    kept: DataFrame
    rejects: DataFrame


def fingerprint(raw: DataFrame) -> DataFrame:
    """Canonical text columns, SPLASH of the raw peaks and ``deletion_reason``."""
    if "deletion_reason" not in raw.columns:
        raw = raw.withColumn("deletion_reason", F.lit(None).cast("string"))
    return dd.with_splash(dd.project_canonical(raw, "deletion_reason"))


def screen_verdicts(parsed: DataFrame, registry: DataFrame | None) -> DataFrame:
    """``record_id, verdict`` of the duplicates and of the spectra that an earlier run registered.

    Both searches work on ids and keys only.
    """
    live = parsed.filter(F.col("deletion_reason").isNull())
    verdicts = dd.duplicate_ids(live).withColumn("verdict", F.lit("duplicate"))
    if registry is not None:
        seen = lookup_join(live.select("record_id", "splash"), registry.select("splash"), "splash", "left_semi")
        verdicts = verdicts.unionByName(seen.select("record_id", F.lit("already_seen").alias("verdict")))
        # The union order is not the check order: "duplicate" wins as the larger text.
        verdicts = verdicts.groupBy("record_id").agg(F.max("verdict").alias("verdict"))
    return verdicts


def passing(parsed: DataFrame, verdicts: DataFrame) -> DataFrame:
    return parsed.filter(F.col("deletion_reason").isNull()).join(verdicts, "record_id", "left_anti")


def screened_out(parsed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Unparsable records and those with a verdict, with their reason."""
    judged = parsed.filter(F.col("deletion_reason").isNull()).join(verdicts, "record_id")
    judged = judged.withColumn("deletion_reason", F.col("verdict")).drop("verdict")
    return parsed.filter(F.col("deletion_reason").isNotNull()).unionByName(judged)


def clean(screened: DataFrame, lookups: Lookups, params: Params) -> DataFrame:
    """Metadata normalisation and peak cleaning of the spectra that are still in."""
    checked = require_peaks(screened)
    return accept_spectra(normalize_values(checked, lookups.adducts, lookups.instruments), params)


DESCRIPTORS = ["inchi", "smiles", "inchikey", "formula", "name", "exactmass", "averagemass"]


def structure_facts(facts: DataFrame, lookups: Lookups) -> DataFrame | None:
    """Facts by structure text: from the toolkit hook, else from the compound table."""
    if lookups.structure_fn is not None:
        return stage(en.derive_structures(en.distinct_structures(facts), lookups.structure_fn), "structures")
    return None if lookups.compounds is None else en.structure_table(lookups.compounds)


def describe(cleaned: DataFrame, lookups: Lookups, params: Params = Params()) -> DataFrame:
    """Resolved structures, masses, compound facts and ontologies of every spectrum.

    All lookups run on the distinct descriptor rows; the spectra with their peaks are shuffled
    once, to pick up the result.
    """
    own = F.struct(*DESCRIPTORS)
    keyed = cleaned.withColumn("_own", own)
    facts = cleaned.select(*DESCRIPTORS).distinct().withColumn("_own", own).withColumn("record_id", F.xxhash64("_own"))
    structures = structure_facts(facts, lookups)
    if structures is not None:
        facts = en.resolve_structures(facts, structures)
    else:
        masses = {c: F.col(c).try_cast("double") for c in ("exactmass", "averagemass")}
        facts = en.fill_masses(facts.withColumns(masses))
    facts = facts.withColumn("_reason", en.structure_reason(params.require_structure))
    if lookups.compounds is not None:
        facts = en.enrich_compounds(facts, lookups.compounds)
    if lookups.ontologies is not None:
        facts = en.enrich_ontology(facts, lookups.ontologies)
    found = [c for c in facts.columns if c not in ("record_id", "_own")]
    replaced = [c for c in found if c in cleaned.columns]
    joined = lookup_join(keyed.drop(*replaced), facts.drop("record_id"), "_own")
    return joined.withColumn("deletion_reason", F.coalesce("deletion_reason", "_reason")).drop("_own", "_reason")


def complete(cleaned: DataFrame, lookups: Lookups, params: Params) -> DataFrame:
    """Descriptors, classes and optional fragment annotation."""
    out = cl.classify(describe(cleaned, lookups, params))
    unknown = F.when(F.col("polarity").isNull(), F.lit("unknown_ionmode"))
    out = out.withColumn("deletion_reason", F.coalesce("deletion_reason", unknown))
    return annotate_peaks(out, params) if params.de_novo else out


def curate(
    raw: DataFrame, lookups: Lookups, params: Params = Params(), registry: DataFrame | None = None
) -> tuple[Curated, DataFrame]:
    """Kept and rejected spectra plus the screened table (for the registry).

    Stage tables in shared storage: the parsed one fixes ``record_id`` (it is read twice by the
    duplicate search), the verdicts are narrow and serve the kept and the rejected side, the
    cleaned one feeds the enrichment joins and the reject sink, the completed one, laid out by
    class, feeds all sinks and the report.
    """
    parsed = stage(fingerprint(raw), "parsed")
    verdicts = stage(screen_verdicts(parsed, registry), "verdicts")
    if lookups.adduct_grammar:
        lookups = lookups._replace(adducts=complete_adducts(parsed, lookups.adducts))
    cleaned = stage(clean(passing(parsed, verdicts), lookups, params), "cleaned")
    live = cleaned.filter(F.col("deletion_reason").isNull())
    # A class in one file as far as its size allows, split where it is large: few files per sink.
    completed = stage(complete(live, lookups, params).hint("rebalance", *cl.CLASSES), "completed")
    kept = completed.filter(F.col("deletion_reason").isNull())
    late = completed.filter(F.col("deletion_reason").isNotNull())
    early = screened_out(parsed, verdicts)
    dropped = cleaned.filter(F.col("deletion_reason").isNotNull())
    rejects = dd.union_sources(*[dd.project_canonical(d, "deletion_reason") for d in (early, dropped, late)])
    return Curated(kept, rejects), cleaned


def library_totals(spark: SparkSession, out: str) -> DataFrame:
    """Spectra and distinct compounds of the library over all batches, by class and in all, from the batches' totals."""
    return cl.merged_cubes(wr.read_cubes(spark, f"{out}/TOTALS"))


def next_batch(registry: DataFrame) -> int:
    last = registry.agg(F.max("batch_id").alias("last")).first()["last"]
    return 0 if last is None else last + 1


def run(
    spark: SparkSession,
    paths: list[str],
    out: str,
    lookups: Lookups | None = None,
    params: Params = Params(),
    batch_id: int | None = None,
) -> DataFrame:
    """Files in, curated library, rejects, registry and report out; returns the report.

    A run is a batch: its spectra, rejects and report go to folders of its own, which a repeated
    run overwrites, and the registry takes its keys last. A run that broke off therefore left
    nothing registered, gets the same number again and replaces what it wrote. With ``params.reset``
    the outputs are replaced too, and the registry only once they are written.
    """
    lookups = lookups or Lookups(adduct_table(spark))
    registry = wr.open_registry(spark, f"{out}/REGISTRY")
    known = registry.limit(0) if params.reset else registry
    if batch_id is None:
        batch_id = next_batch(known)
    earlier = known.filter(F.col("batch_id") != batch_id)
    result, cleaned = curate(ingest(spark, paths, multiline=params.multiline), lookups, params, earlier)
    wr.write_spectra(result.kept, out, params, batch_id)
    wr.write_rejects(result.rejects, f"{out}/REJECTS/batch_id={batch_id}")
    registered = cleaned if params.register == "all" else result.kept
    fresh = dd.new_registry_rows(registered, known, batch_id)
    if params.reset:
        wr.replace_registry(fresh, f"{out}/REGISTRY")
    else:
        wr.append_registry(fresh, f"{out}/REGISTRY")
    wr.write_cube(cl.class_cube(result.kept), f"{out}/TOTALS", batch_id, params.reset)
    report = cl.run_report(result.kept, result.rejects, params)
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/REPORT/batch_id={batch_id}")
    return report
