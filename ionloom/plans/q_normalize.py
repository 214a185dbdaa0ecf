"""Queries for value normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import inchi as ic
from ionloom.functions import text as tx
from ionloom.functions.adducts import read_adduct
from ionloom.functions.elements import AVERAGE
from ionloom.functions.exprs import computed_once, first_number
from ionloom.operators import instruments as ins
from ionloom.operators import normalize as nm
from ionloom.plans import fixture as fx
from ionloom.plans import oracle as orc
from ionloom.sources.lookups import DEFAULT_INSTRUMENTS, adduct_table, complete_adducts

QUERIES = {}
ORACLES = {}
RAW = orc.raw()


def _add(name: str, fn, ctes: list[str], final: str) -> None:
    QUERIES[name] = fn
    ORACLES[name] = orc.query(ctes, final)


def _column(name: str, columns: list[str], value, sql: str, out: str) -> None:
    """``record_id`` and one normalised column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fx.headers(spark, sf_dir, columns).select("record_id", value().alias(out))

    _add(name, run, RAW, f"SELECT record_id, {sql} AS {out} FROM raw")


def normalize_empties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nm.normalize_empties(fx.headers(spark, sf_dir)).drop("source")


_add(
    "normalize_empties",
    normalize_empties,
    [*RAW, orc.empties("raw")],
    f"SELECT record_id, {', '.join(orc.TEXTS)} FROM emp",
)
STRUCTURE = ["smiles", "inchi", "inchikey"]
_column("repair_inchi", ["inchi"], lambda: tx.repair_inchi(F.col("inchi")),
        "'InChI=' || regexp_replace(nullif(inchi, ''), '(?i)^inchi=', '')", "inchi")


def repair_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nm.repair_descriptors(fx.headers(spark, sf_dir, STRUCTURE))


_add("repair_descriptors", repair_descriptors, [*RAW, orc.repair("raw")],
     "SELECT record_id, smiles, inchi, inchikey FROM rep")
_column("require_structure", STRUCTURE, lambda: tx.has_structure(*[F.col(c) for c in STRUCTURE]),
        f"NOT ({orc.NO_STRUCTURE})", "has_structure")
_column("normalize_ionization", ["ionization", "instrumenttype"],
        lambda: tx.normalize_ionization(F.col("ionization"), F.col("instrumenttype")), orc.ionization_expr(), "ionization")
INSTRUMENT = ["instrument", "instrumenttype", "comment"]
_column("clean_instrument_text", INSTRUMENT, lambda: tx.clean_instrument_text(*[F.col(c) for c in INSTRUMENT]),
        orc.instrument_text_expr(), "instrument_text")


def match_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = ins.match_instrument(fx.headers(spark, sf_dir, INSTRUMENT), DEFAULT_INSTRUMENTS)
    return matched.select("record_id", "instrument_text", *ins.LEVELS)


def assign_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.headers(spark, sf_dir, [*INSTRUMENT, "resolution", "ionization"])
    out = ins.normalize_instruments(df, DEFAULT_INSTRUMENTS)
    return out.select("record_id", "instrument", "instrumenttype", "resolution", "ionization")


def match_instrument_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same match by the inverted index that large rule sets use."""
    matched = ins.match_instrument(fx.headers(spark, sf_dir, INSTRUMENT), DEFAULT_INSTRUMENTS, by_index=True)
    return matched.select("record_id", "instrument_text", *ins.LEVELS)


_add("match_instrument_index", match_instrument_index, [*RAW, *orc.instruments("raw", keep_path=True)],
     f"SELECT record_id, instrument_text, {', '.join(ins.LEVELS)} FROM ins")
_add("match_instrument", match_instrument, [*RAW, *orc.instruments("raw", keep_path=True)],
     f"SELECT record_id, instrument_text, {', '.join(ins.LEVELS)} FROM ins")
_add("assign_resolution", assign_resolution, [*RAW, *orc.instruments("raw")],
     "SELECT record_id, instrument, instrumenttype, resolution, ionization FROM ins")
_column("strip_adduct", ["precursortype"], lambda: tx.strip_adduct(F.col("precursortype")), orc.strip_adduct_expr(), "adduct")


def normalize_adduct(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.headers(spark, sf_dir, ["precursortype", "instrumenttype"])
    return nm.normalize_adduct(df, adduct_table(spark)).select("record_id", "precursortype")


_add("normalize_adduct", normalize_adduct, [*RAW, *orc.adduct("raw")], "SELECT record_id, precursortype FROM adu")


def adduct_mass_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    adducts = adduct_table(spark)
    df = nm.normalize_adduct(fx.headers(spark, sf_dir, ["precursortype", "instrumenttype"]), adducts)
    return nm.with_adduct_facts(df, adducts).select("record_id", "precursortype", F.round("massdiff", 6).alias("massdiff"))


_add("adduct_mass_shift", adduct_mass_shift, [*RAW, *orc.adduct("raw"), orc.facts()],
     "SELECT record_id, precursortype, round(massdiff, 6) AS massdiff FROM adu LEFT JOIN facts ON canonical = precursortype")
_column("precursor_needs_recompute", ["precursormz"], lambda: nm.precursor_needs_recompute(F.col("precursormz")), orc.NEEDS, "needed")


def recompute_precursor_mz(spark: SparkSession, sf_dir: str) -> DataFrame:
    adducts = adduct_table(spark)
    df = fx.headers(spark, sf_dir, ["precursormz", "precursortype", "instrumenttype", "inchi", "formula"])
    out = nm.recompute_precursor(nm.with_adduct_facts(nm.normalize_adduct(df, adducts), adducts))
    return out.select("record_id", F.round(first_number(F.col("precursormz")), 5).alias("precursormz"))


_add("recompute_precursor_mz", recompute_precursor_mz, [*RAW, *orc.adduct("raw"), *orc.recompute("adu")],
     "SELECT record_id, round(precursor, 5) AS precursormz FROM rec")
_column("normalize_ionmode", ["ionmode"], lambda: tx.normalize_ionmode(F.col("ionmode")), orc.IONMODE, "ionmode")
PREDICTED = ["predicted", "comment", "filename", "name"]
_column("flag_predicted", PREDICTED, lambda: tx.flag_predicted(*[F.col(c) for c in PREDICTED]), orc.PREDICTED, "predicted")


def _moded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.headers(spark, sf_dir, [*PREDICTED, "ionmode", "precursortype", "instrumenttype"])
    return df.withColumns(
        {
            "ionmode": tx.normalize_ionmode(F.col("ionmode")),
            "predicted": tx.flag_predicted(*[F.col(c) for c in PREDICTED]),
        }
    )


def default_adduct(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = tx.default_adduct(F.col("precursortype"), F.col("predicted"), F.col("ionmode"))
    return _moded(spark, sf_dir).select("record_id", value.alias("precursortype"))


def complete_bare_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = tx.complete_bare_m(F.col("precursortype"), F.col("ionmode"))
    return _moded(spark, sf_dir).select("record_id", value.alias("precursortype"))


def check_adduct_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    adducts = adduct_table(spark)
    out = nm.check_adduct(nm.normalize_adduct(_moded(spark, sf_dir), adducts), adducts)
    return out.select("record_id", "precursortype", "adduct_reason")


_add("default_adduct", default_adduct, [*RAW, orc.modes("raw")], f"SELECT record_id, {orc.DEFAULT_ADDUCT} AS precursortype FROM mod")
_add("complete_bare_m", complete_bare_m, [*RAW, orc.modes("raw")], f"SELECT record_id, {orc.BARE_M} AS precursortype FROM mod")
_add("check_adduct_polarity", check_adduct_polarity, [*RAW, orc.modes("raw"), *orc.adduct("mod"), *orc.check_adduct("adu")],
     "SELECT record_id, precursortype, adduct_reason FROM chk")
_column("normalize_ms_level", ["mslevel"], lambda: tx.normalize_ms_level(F.col("mslevel")), orc.MS_LEVEL, "mslevel")
_column("normalize_rt", ["rt"], lambda: F.round(tx.normalize_rt(F.col("rt")), 6), f"round({orc.RT}, 6)", "rt")


def fill_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nm.fill_not_found(nm.normalize_empties(fx.headers(spark, sf_dir)).drop("source"))


_add("fill_not_found", fill_not_found, [*RAW, orc.empties("raw")],
     "SELECT record_id, " + ", ".join(f"coalesce(nullif({c}, ''), 'NOT FOUND') AS {c}" for c in orc.TEXTS) + " FROM emp")


def normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metadata step in its order, with the first failing check."""
    out = nm.normalize_values(fx.headers(spark, sf_dir), adduct_table(spark), DEFAULT_INSTRUMENTS)
    return out.select(
        "record_id", "smiles", "inchi", "inchikey", "ionization", "instrument", "instrumenttype", "resolution",
        "precursortype", F.round(first_number(F.col("precursormz")), 5).alias("precursormz"), "ionmode", "predicted",
        "mslevel", F.round("rt", 6).alias("rt"), "deletion_reason",
    )


_add("normalize_values", normalize_values, [*RAW, *orc.normalized("raw")],
     "SELECT record_id, smiles, inchi, inchikey, ionization, instrument, instrumenttype, resolution, precursortype, "
     "round(precursor, 5) AS precursormz, ionmode, predicted, mslevel, round(rt, 6) AS rt, "
     f"coalesce(CASE WHEN {orc.NO_STRUCTURE} THEN 'no_structure' END, adduct_reason) AS deletion_reason FROM nrm")


# Adducts put together from an order's key: molecules, lost protons, a cation, a neutral molecule and the ion.
_ADDUCT_PARTS = {
    "molecules": "o_orderkey % 3", "lost": "o_orderkey % 4", "times": "1 + o_orderkey % 2", "cation": "(o_orderkey // 4) % 3",
    "neutral": "(o_orderkey // 12) % 4", "ion": "(o_orderkey // 48) % 4", "heavy": "(o_orderkey // 192) % 2",
}


def _adduct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = {c: F.expr(e.replace("//", "div")) for c, e in _ADDUCT_PARTS.items()}

    def pick(values: list[str], c: str):
        return F.element_at(F.array(*map(F.lit, values)), part[c].cast("int") + 1)

    name = F.concat(
        pick(["", "2", "3"], "molecules"), F.lit("M"), pick(["", "-H", "-2H", "-3H"], "lost"), F.lit("+"),
        F.when(part["times"] == 2, "2").otherwise(""), pick(["Na", "K", "Ca"], "cation"), pick(["+H2O", "+CH3OH", "+NaCl", "-NH3"], "neutral"),
        pick(["+H", "+Na", "+NH4", "+Cl"], "ion"),
        F.when((part["heavy"] == 1) & (part["ion"] == 3), "_37Cl1").otherwise(""),
    )
    return fx.table(spark, sf_dir, "orders").select(name.alias("name")).distinct()


def adduct_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical text, charge, ion mode and mass shift of adduct names; NULL where the terms are no ion."""
    read = _adduct_names(spark, sf_dir).select("name", F.inline(F.array(read_adduct(F.col("name")))))
    return read.withColumn("massdiff", F.round("massdiff", 4))


def complete_adduct_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra by the polarity of their adduct, where the default table lacks the name and the grammar reads it."""
    names = _adduct_names(spark, sf_dir).withColumn("precursortype", F.concat(F.lit("["), "name", F.lit("]")))
    full = complete_adducts(names, adduct_table(spark))
    out = nm.with_adduct_facts(nm.normalize_adduct(names.withColumn("instrumenttype", F.lit("LC")), full), full)
    return out.select("name", "precursortype", "adduct_in_pos", "adduct_in_neg", F.round("massdiff", 4).alias("massdiff"))


_ADDUCTS = f"""parts AS (SELECT DISTINCT {", ".join(f"{e} AS {c}" for c, e in _ADDUCT_PARTS.items())} FROM orders),
texts AS (SELECT *, ['', '2', '3'][molecules + 1] || 'M' || ['', '-H', '-2H', '-3H'][lost + 1] || '+' || CASE WHEN times = 2 THEN '2' ELSE '' END
   || ['Na', 'K', 'Ca'][cation + 1] || ['+H2O', '+CH3OH', '+NaCl', '-NH3'][neutral + 1] AS head,
   ['+H', '+Na', '+NH4', '+Cl'][ion + 1] AS tail, CASE WHEN heavy = 1 AND ion = 3 THEN '_37Cl1' ELSE '' END AS isotope,
   times * [1, 1, 2][cation + 1] - lost AS z0,
   times * [22.98976928e0, 38.96370649e0, 39.9625909e0][cation + 1] - lost * 1.0078250322e0 + [18.0105646834e0, 32.0262147478e0, 57.95862198e0, -17.0265491006e0][neutral + 1]
   + [1.0078250322e0, 22.98976928e0, 18.0343741328e0, 34.9688527e0][ion + 1] AS mass FROM parts),
ions AS (SELECT head || tail || isotope AS name, z0 + [1, 1, 1, -1][ion + 1] AS z,
   CASE WHEN z0 = 0 THEN '(' || head || ')' ELSE head END || tail AS body, isotope, mass + CASE WHEN isotope <> '' THEN 1.9970499e0 ELSE 0e0 END AS mass FROM texts),
adducts_read AS (SELECT DISTINCT name, CASE WHEN z <> 0 THEN '[' || body || ']' || CASE WHEN abs(z) > 1 THEN abs(z)::VARCHAR ELSE '' END
   || CASE WHEN z > 0 THEN '+' ELSE '-' END || isotope END AS canonical, nullif(z, 0)::INT AS charge,
   CASE WHEN z > 0 THEN 'positive' WHEN z < 0 THEN 'negative' END AS ionmode, CASE WHEN z <> 0 THEN round(mass - z * 0.000548579909e0, 4) END AS massdiff FROM ions)"""

_add("adduct_grammar", adduct_grammar, [_ADDUCTS], "SELECT * FROM adducts_read")
_add("complete_adduct_table", complete_adduct_table, [_ADDUCTS],
     "SELECT name, coalesce(canonical, '[' || name || ']') AS precursortype, coalesce(charge > 0, false) AS adduct_in_pos, "
     "coalesce(charge < 0, false) AS adduct_in_neg, massdiff FROM adducts_read")


def inchi_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charge, protons and masses of InChIs with proton, charge, isotope and counted component layers."""
    key = "o_orderkey"
    text = F.expr(
        f"concat('InChI=1S/', case when {key} % 2 = 0 then '2' else '' end, 'C', 2 + {key} % 9, 'H', 4 + {key} % 7, 'ClNO.Na/c;/h;/q', "
        f"case when {key} % 2 = 0 then '2*-1;+1' else ';+1' end, case when {key} % 5 = 0 then '' else concat('/p', case when {key} % 5 > 2 then '+' else '-' end, {key} % 3) end, "
        f"case when {key} % 4 = 0 then '' else concat('/i', case when {key} % 2 = 0 then '2*' else '' end, '1+1,2D', {key} % 4, ',', 3 + {key} % 9, '+2;') end)"
    )
    inchi = F.col("inchi")
    rows = fx.table(spark, sf_dir, "orders").select(F.col(key).alias("record_id"), text.alias("inchi"))
    # Narrow rows that are heavy in CPU: their bytes, by which scans and adaptive execution cut tasks, would give few.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = computed_once(rows.repartition(tasks, "record_id"), own=ic.facts(inchi))
    own = F.col("own")
    return read.select(
        "record_id", *[own[c].alias(c) for c in ("formula", "charge", "protons")],
        F.round(ic.facts_mass(own), 4).alias("exactmass"), F.round(ic.facts_mass(own, AVERAGE), 3).alias("averagemass"),
    )


def _sql_inchi_mass(c: float, h: float, n: float, o: float, cl: float, na: float) -> str:
    labels = f"(13.00335483507e0 - {c}) + d * (2.01410177812e0 - {h}) + 36.965902602e0 - {cl}"
    return (
        f"times * (c * {c} + h * {h} + {cl} + {n} + {o}) + {na} + p * {h} + CASE WHEN d > 0 THEN times * ({labels}) ELSE 0e0 END"
    )


_EXACT = _sql_inchi_mass(12.0, 1.0078250322, 14.003074004, 15.994914619, 34.9688527, 22.98976928)
_MEAN = _sql_inchi_mass(12.011, 1.008, 14.007, 15.999, 35.45, 22.98976928)
_add("inchi_layers", inchi_layers,
     ["k AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS times, 2 + o_orderkey % 9 AS c, 4 + o_orderkey % 7 AS h, "
      "CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 5 > 2 THEN o_orderkey % 3 ELSE -(o_orderkey % 3) END AS p, o_orderkey % 4 AS d FROM orders)"],
     "SELECT id AS record_id, CASE WHEN times = 2 THEN '2' ELSE '' END || 'C' || c || 'H' || h || 'ClNO.Na' AS formula, "
     "(CASE WHEN times = 2 THEN -1 ELSE 1 END + p)::INT AS charge, p::INT AS protons, "
     f"round({_EXACT}, 4) AS exactmass, round({_MEAN}, 3) AS averagemass FROM k")
