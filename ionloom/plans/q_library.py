"""Queries for union, duplicates, registry, enrichment, classes, reports and the whole run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import text as tx
from ionloom.functions.elements import AVERAGE, MONOISOTOPIC, formula_mass, inchi_formula
from ionloom.functions.peaks import to_text
from ionloom.operators import classify as cl
from ionloom.operators import dedup as dd
from ionloom.operators import enrich as en
from ionloom.operators.normalize import repair_descriptors
from ionloom.plans import fixture as fx
from ionloom.plans import oracle as orc
from ionloom.plans.pipeline import Curated, Lookups, curate
from ionloom.schema import REASONS, Params
from ionloom.session import new_path, stage
from ionloom.sinks import writers as wr
from ionloom.sources.lookups import adduct_table

QUERIES = {}
ORACLES = {}
RAW = orc.raw()
COPIES = [*orc.copies(), *orc.with_splash("cp")]


def _add(name: str, fn, ctes: list[str], final: str) -> None:
    QUERIES[name] = fn
    ORACLES[name] = orc.query(ctes, final)


# --- union, duplicates, registry ------------------------------------------------------------


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources with different columns, put together by name."""
    raw = fx.spectra_raw(spark, sf_dir, ["source", "name", "comment"])
    parts = [raw.filter(F.col("source") == s) for s in ("MSP", "CSV", "JSON", "MGF")]
    parts[1] = parts[1].drop("comment")
    return dd.union_sources(*parts).select("record_id", "source", "name", "comment", F.size("peaks").alias("n"))


_add("union_sources", union_sources, RAW,
     "SELECT record_id, source, name, CASE WHEN source <> 'CSV' THEN comment END AS comment, len(peaks)::INT AS n FROM raw")


def project_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dd.project_canonical(fx.spectra_raw(spark, sf_dir))
    return out.withColumn("peaks", to_text(F.col("peaks"), ";"))


def _canonical_sql(col: str) -> str:
    if col == "peaks":
        return f"{orc.peak_text()} AS peaks"
    return f"{col if col in orc.TEXTS else 'NULL::VARCHAR'} AS {col}"


_add("project_canonical", project_canonical, RAW,
     f"SELECT record_id, {', '.join(_canonical_sql(c) for c in dd.COLUMNS)} FROM raw")


def _fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged like in a full run: the duplicate search reads the table twice."""
    return stage(dd.with_splash(fx.spectra_with_copies(spark, sf_dir).drop("source")), "fingerprinted")


def row_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _fingerprinted(spark, sf_dir)
    return df.select("record_id", dd.row_richness(df).cast("bigint").alias("row_size"))


def dedup_keep_richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.dedup_keep_richest(_fingerprinted(spark, sf_dir)).select("record_id", "splash", "inchikey", "comment")


def dedup_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.dedup_rejects(_fingerprinted(spark, sf_dir)).select("record_id", "splash", "deletion_reason")


_add("row_richness", row_richness, COPIES, f"SELECT record_id, ({orc.RICHNESS})::BIGINT AS row_size FROM fin")
_DUP = [*COPIES, orc.deduplicated("fin")]
_add("dedup_keep_richest", dedup_keep_richest, _DUP,
     "SELECT record_id, splash, inchikey, comment FROM dup WHERE NOT coalesce(is_duplicate, false)")
_add("dedup_rejects", dedup_rejects, _DUP,
     "SELECT record_id, splash, 'duplicate' AS deletion_reason FROM dup WHERE coalesce(is_duplicate, false)")


def _batch_and_registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All spectra as a batch, and the keys of the even ones as the registry of an earlier run."""
    batch = stage(dd.with_splash(fx.spectra_raw(spark, sf_dir, [])), "batch")
    even = batch.filter("record_id % 2 = 0 and splash is not null")
    return batch, even.select("splash", F.lit(0).cast("bigint").alias("batch_id")).distinct()


def incremental_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.unseen(*_batch_and_registry(spark, sf_dir)).select("record_id", "splash")


def incremental_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.already_seen(*_batch_and_registry(spark, sf_dir)).select("record_id", "splash", "deletion_reason")


def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, registry = _batch_and_registry(spark, sf_dir)
    return registry.unionByName(dd.new_registry_rows(batch, registry, 1))


_REG = [*RAW, *orc.splash("raw"), "reg AS (SELECT DISTINCT splash FROM spl WHERE record_id % 2 = 0 AND splash IS NOT NULL)"]
_SEEN = "EXISTS (SELECT 1 FROM reg WHERE reg.splash = spl.splash)"
_add("incremental_new", incremental_new, _REG, f"SELECT record_id, splash FROM spl WHERE NOT {_SEEN}")
_add("incremental_seen", incremental_seen, _REG,
     f"SELECT record_id, splash, 'already_seen' AS deletion_reason FROM spl WHERE {_SEEN}")
_add("registry_merge", registry_merge, _REG,
     "SELECT splash, 0::BIGINT AS batch_id FROM reg UNION ALL SELECT DISTINCT splash, 1::BIGINT FROM spl "
     f"WHERE splash IS NOT NULL AND NOT {_SEEN}")


# --- structures and enrichment --------------------------------------------------------------


def distinct_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.distinct_structures(fx.headers(spark, sf_dir, ["inchi", "smiles"]))


_add("distinct_structures", distinct_structures, RAW,
     "SELECT inchi AS structure FROM raw WHERE inchi <> '' UNION SELECT smiles FROM raw WHERE smiles <> ''")


def _toolkit(frames):
    """Stands in for a chemistry toolkit: facts that follow from the text of a structure."""
    for frame in frames:
        text = frame["structure"]
        yield frame.assign(
            inchi="InChI=" + text, inchikey=text.str.len().astype(str) + "-KEY", smiles=text.str.upper(), formula="C" + text.str.len().astype(str),
            exactmass=text.str.len() + 0.5, averagemass=text.str.count("C") * 12.0,
        )


def derive_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that the toolkit hook gives for every distinct structure, back on the spectra that name it."""
    df = fx.headers(spark, sf_dir, ["inchi", "smiles", "inchikey", "formula"])
    blank = F.lit(None).cast("double")
    facts = stage(en.derive_structures(en.distinct_structures(df), _toolkit), "structures")
    out = en.resolve_structures(df.withColumns({"exactmass": blank, "averagemass": blank, "smiles": F.lit("")}), facts)
    return out.filter("inchi <> ''").select("record_id", "inchi", "inchikey", "smiles", "formula", "exactmass", "averagemass")


_add("derive_structures", derive_structures, RAW,
     "SELECT record_id, 'InChI=' || inchi AS inchi, length(inchi) || '-KEY' AS inchikey, upper(inchi) AS smiles, 'C' || length(inchi) AS formula, "
     "length(inchi) + 0.5e0 AS exactmass, 12.0e0 * (length(inchi) - length(replace(inchi, 'C', ''))) AS averagemass FROM raw WHERE inchi <> ''")


def formula_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.headers(spark, sf_dir, ["inchi", "formula"])
    formula = F.coalesce(inchi_formula(F.col("inchi")), F.col("formula"))
    return df.select(
        "record_id",
        formula.alias("formula"),
        F.round(formula_mass(formula, MONOISOTOPIC), 6).alias("exactmass"),
        F.round(formula_mass(formula, AVERAGE), 6).alias("averagemass"),
    )


_add("formula_mass", formula_masses, [*RAW, f"f AS (SELECT record_id, coalesce({orc.INCHI_FORMULA}, formula) AS formula FROM raw)"],
     f"SELECT record_id, formula, round({orc.chno_mass('formula')}, 6) AS exactmass, "
     f"round({orc.chno_mass('formula', (12.011, 1.008, 14.007, 15.999))}, 6) AS averagemass FROM f")


def strip_smiles_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.headers(spark, sf_dir, ["smiles"])
    tagged = F.when(F.col("record_id") % 3 == 0, F.concat("smiles", F.lit(" |c:1,2|"))).otherwise(F.col("smiles"))
    return df.select("record_id", tx.strip_smiles_extension(tagged).alias("smiles"))


_add("strip_smiles_ext", strip_smiles_ext, RAW,
     "SELECT record_id, CASE WHEN contains(t, 'InChI=') THEN t ELSE split_part(t, '|', 1) END AS smiles FROM "
     "(SELECT record_id, CASE WHEN record_id % 3 = 0 THEN smiles || ' |c:1,2|' ELSE smiles END AS t FROM raw)")
_STRUCT = ["smiles", "inchi", "inchikey", "formula", "name"]


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.headers(spark, sf_dir, _STRUCT).repartition("record_id")
    return repair_descriptors(df).withColumns({c: F.lit(None).cast("double") for c in ("exactmass", "averagemass")})


_MASSLESS = "mss AS (SELECT *, NULL::DOUBLE AS exactmass, NULL::DOUBLE AS averagemass FROM rep)"
_PRE = [*RAW, orc.repair("raw"), _MASSLESS]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("exactmass", "averagemass")})


def resolve_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = en.structure_table(fx.compounds(spark, sf_dir))
    return _rounded(en.resolve_structures(_structured(spark, sf_dir), table)).select("record_id", *en.DERIVED)


_R = "round(exactmass, 6) AS exactmass, round(averagemass, 6) AS averagemass"
_add("resolve_structures", resolve_structures, [*_PRE, *orc.resolved("mss")],
     f"SELECT record_id, inchi, inchikey, smiles, formula, {_R} FROM res")


def valid_inchikey(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.headers(spark, sf_dir, ["inchikey"])
    return df.select("record_id", tx.valid_inchikey(F.col("inchikey")).alias("is_valid"))


def require_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = en.fill_masses(_structured(spark, sf_dir).withColumn("formula", F.expr("case when record_id % 6 = 0 then '' else formula end")))
    return df.select("record_id", en.structure_reason(require_all=True).alias("deletion_reason"))


_add("valid_inchikey", valid_inchikey, RAW, f"SELECT record_id, {orc.VALID_KEY} AS is_valid FROM raw")
_add("require_masses", require_masses, [*RAW, orc.repair("raw")],
     f"SELECT record_id, CASE WHEN NOT {orc.VALID_KEY} THEN 'bad_inchikey' WHEN smiles IS NULL OR inchi IS NULL OR inchikey IS NULL "
     f"OR ({orc.INCHI_FORMULA} IS NULL AND (record_id % 6 = 0 OR formula = '')) THEN 'no_structure_after_derivation' END AS deletion_reason FROM rep")


def enrich_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = en.enrich_compounds(_structured(spark, sf_dir), fx.compounds(spark, sf_dir))
    return _rounded(out).select("record_id", "inchikey", *en.COMPOUND_COLUMNS)


def enrich_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.enrich_ontology(fx.headers(spark, sf_dir, ["inchikey"]), fx.ontologies(spark, sf_dir))


def enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound facts and ontologies in a row."""
    out = en.enrich_compounds(_structured(spark, sf_dir), fx.compounds(spark, sf_dir))
    out = en.enrich_ontology(out, fx.ontologies(spark, sf_dir))
    return _rounded(out).select("record_id", "inchikey", "name", "exactmass", "averagemass", *en.ONTOLOGY_COLUMNS)


_add("enrich_compounds", enrich_compounds, [*_PRE, *orc.enriched("mss")],
     f"SELECT record_id, inchikey, inchi, smiles, formula, name, {_R} FROM enr")
_add("enrich_ontology", enrich_ontology, [*RAW, *orc.classed("raw")],
     f"SELECT record_id, inchikey, {', '.join(orc.CLASS_FIELDS)} FROM ont")
_add("enrich", enrich, [*_PRE, *orc.enriched("mss"), *orc.classed("enr")],
     f"SELECT record_id, inchikey, name, {_R}, {', '.join(orc.CLASS_FIELDS)} FROM ont")


# --- classes and reports --------------------------------------------------------------------
_CLASS_INPUT = ["ionmode", "instrumenttype", "inchikey", "predicted", "comment", "filename", "name"]


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.headers(spark, sf_dir, _CLASS_INPUT)
    return df.withColumns(
        {
            "ionmode": tx.normalize_ionmode(F.col("ionmode")),
            "predicted": tx.flag_predicted(F.col("predicted"), F.col("comment"), F.col("filename"), F.col("name")),
        }
    )


def split_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.split_polarity(_typed(spark, sf_dir)).select("record_id", "polarity")


def split_chromatography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.split_chromatography(_typed(spark, sf_dir)).select("record_id", "chromatography")


def split_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.split_origin(_typed(spark, sf_dir)).select("record_id", "origin")


def classify_8way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.classify(_typed(spark, sf_dir)).select("record_id", *cl.CLASSES)


_CLS = [*RAW, orc.modes("raw"), orc.classes("mod")]
for _name, _fn, _cols in (
    ("split_polarity", split_polarity, "polarity"),
    ("split_chromatography", split_chromatography, "chromatography"),
    ("split_origin", split_origin, "origin"),
    ("classify_8way", classify_8way, "polarity, chromatography, origin"),
):
    _add(_name, _fn, _CLS, f"SELECT record_id, {_cols} FROM cls")


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.report_counts(cl.classify(_typed(spark, sf_dir)).filter("polarity is not null"))


def report_unique_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.report_unique_compounds(cl.classify(_typed(spark, sf_dir)))


_GRID_COUNT = (
    "SELECT g.*, coalesce(n, 0)::BIGINT AS {0} FROM grid g LEFT JOIN (SELECT polarity, chromatography, origin, {1} AS n "
    "FROM cls WHERE polarity IS NOT NULL GROUP BY ALL) c USING (polarity, chromatography, origin) UNION ALL "
    "SELECT 'TOTAL', 'TOTAL', 'TOTAL', (SELECT {1} FROM cls {2})::BIGINT"
)
_add("report_counts", report_counts, [*_CLS, orc.GRID], _GRID_COUNT.format("spectra", "count(*)", "WHERE polarity IS NOT NULL"))
_add("report_unique_compounds", report_unique_compounds, [*_CLS, orc.GRID],
     _GRID_COUNT.format("compounds", "count(DISTINCT inchikey)", ""))


def merged_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of four batches, merged from their counts and sketches; the estimated compounds within 4 percent of the exact ones."""
    classed = cl.classify(_typed(spark, sf_dir))
    path = new_path(spark, "totals")
    for batch in range(4):
        wr.write_cube(cl.class_cube(classed.filter(F.col("record_id") % 4 == batch)), path, batch)
    merged = cl.merged_cubes(wr.read_cubes(spark, path))
    named = F.coalesce("polarity", F.lit("unknown"))
    exact = classed.withColumn("polarity", named).cube(*cl.CLASSES).agg(F.count_distinct("inchikey").alias("exact"))
    same = reduce(lambda a, b: a & b, [merged[c].eqNullSafe(exact[c]) for c in cl.CLASSES])
    near = F.abs(F.col("compounds") - F.col("exact")) <= 0.04 * F.col("exact") + 1
    shown = [F.coalesce(merged[c], F.lit("ALL")).alias(c) for c in cl.CLASSES]
    return merged.join(exact, same).select(*shown, "spectra", F.col("exact").alias("compounds"), near.alias("near"))


_add("merged_totals", merged_totals, [*_CLS],
     "SELECT * FROM (SELECT CASE WHEN grouping(p) = 1 THEN 'ALL' ELSE p END AS polarity, CASE WHEN grouping(chromatography) = 1 THEN 'ALL' ELSE chromatography END AS chromatography, "
     "CASE WHEN grouping(origin) = 1 THEN 'ALL' ELSE origin END AS origin, count(*) AS spectra, count(DISTINCT inchikey) AS compounds, true AS near "
     "FROM (SELECT *, coalesce(polarity, 'unknown') AS p FROM cls) GROUP BY CUBE (p, chromatography, origin)) WHERE polarity <> 'unknown'")


# --- whole run ------------------------------------------------------------------------------


def _curated(spark: SparkSession, sf_dir: str, params: Params = Params()) -> Curated:
    lookups = Lookups(
        adduct_table(spark), compounds=fx.compounds(spark, sf_dir), ontologies=fx.ontologies(spark, sf_dir)
    )
    result, _ = curate(fx.spectra_with_copies(spark, sf_dir).drop("source"), lookups, params)
    return result


def full_curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _curated(spark, sf_dir).kept
    return kept.select(
        "record_id", "splash", "inchikey", "name", F.round("precursormz", 5).alias("precursormz"), "precursortype",
        F.round("entropy", 6).alias("entropy"), "num_peaks", to_text(F.col("peaks"), ";").alias("peaks_text"),
        F.round("exactmass", 6).alias("exactmass"), "classyfire_superclass", *cl.CLASSES,
    )


def rejects_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curated(spark, sf_dir).rejects.select("record_id", "deletion_reason")


def report_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.report_rejections(_curated(spark, sf_dir).rejects)


def report_total_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.report_total_rejections(_curated(spark, sf_dir).rejects)


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _curated(spark, sf_dir)
    return cl.run_report(result.kept, result.rejects).filter("section <> 'parameters'")


_CUR = orc.curated()
_add("full_curation", full_curation, _CUR,
     "SELECT record_id, splash, inchikey, name, round(precursor, 5) AS precursormz, precursortype, round(entropy, 6) AS entropy, "
     f"len(peaks)::INT AS num_peaks, {orc.peak_text()} AS peaks_text, round(exactmass, 6) AS exactmass, classyfire_superclass, "
     "polarity, chromatography, origin FROM kept")
_add("rejects_by_reason", rejects_by_reason, _CUR, "SELECT record_id, reason AS deletion_reason FROM rejected")
_CODES = "codes(deletion_reason) AS (VALUES " + ", ".join(f"('{r}')" for r in REASONS) + ")"
_COUNTS = (
    "cnt AS (SELECT deletion_reason, coalesce(n, 0)::BIGINT AS spectra FROM codes LEFT JOIN (SELECT reason, count(*) AS n "
    "FROM rejected GROUP BY 1) ON reason = deletion_reason)"
)
_add("report_rejections", report_rejections, [*_CUR, _CODES, _COUNTS], "SELECT deletion_reason, spectra FROM cnt")
_add("report_total_rejections", report_total_rejections, _CUR, "SELECT count(*) AS rejected FROM rejected")
_PATH = "polarity || '/' || chromatography || '/' || origin"


def _report_part(section: str, measure: str) -> str:
    return (
        f"SELECT '{section}' AS section, g.polarity || '/' || g.chromatography || '/' || g.origin AS metric, "
        f"coalesce(n, 0)::VARCHAR AS value FROM grid g LEFT JOIN (SELECT polarity, chromatography, origin, {measure} AS n FROM kept "
        f"GROUP BY ALL) c USING (polarity, chromatography, origin) UNION ALL SELECT '{section}', 'TOTAL/TOTAL/TOTAL', "
        f"(SELECT {measure} FROM kept)::VARCHAR"
    )


_add("run_report", run_report, [*_CUR, orc.GRID, _CODES, _COUNTS],
     _report_part("spectra", "count(*)") + " UNION ALL " + _report_part("compounds", "count(DISTINCT inchikey)")
     + " UNION ALL SELECT 'filtered_out', deletion_reason, spectra::VARCHAR FROM cnt UNION ALL "
     "SELECT 'filtered_out', 'TOTAL', (SELECT sum(spectra) FROM cnt)::BIGINT::VARCHAR")
