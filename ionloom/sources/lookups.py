"""Lookup tables: small computed defaults and readers for user-supplied files."""

from __future__ import annotations

import json
import re
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions.adducts import CHARGES, HEAVY, MASSES, NAMED, SOLVENTS, group_mass, read_adduct
from ionloom.functions.elements import ELECTRON
from ionloom.functions.text import strip_adduct
from ionloom.operators.enrich import one_per_key
from ionloom.operators.instruments import InstrumentRule
from ionloom.schema import COMPOUND_COLUMNS, ONTOLOGY_COLUMNS
from ionloom.session import local_table, stage

# The lower-case field names that fill each canonical column.
FIELD_NAMES = {
    "filename": ["comment:filename", "filename"],
    "filehash": ["filehash"],
    "predicted": ["predicted"],
    "splash": ["pk$splash", "splash"],
    "spectrumid": [
        "accession", "compound id", "database-id", "db", "db#", "dbid", "spectrum_id", "spectrumid", "unpd_id",
    ],
    "resolution": ["resolution"],
    "synon": ["synon"],
    "ionization": ["ac$mass_spectrometry:ionization", "ion_source", "ionimethod", "ionization"],
    "mslevel": ["ac$mass_spectrometry:ms_type", "ms level", "ms_level", "mslevel", "spectrum_type"],
    "fragmentationmode": [
        "ac$mass_spectrometry:fragmentation_mode", "fragmenation_method", "fragmentationmode", "special_fragmentation",
    ],
    "name": ["ch$name", "compound_name", "compoundname", "name", "submittecomputed_mass_erroname"],
    "precursormz": [
        "ms$focused_ion:precursor_m/z", "pepmass", "precursor", "precursor m/z", "precursor_mass", "precursor_mz",
        "precursormass", "precursormz",
    ],
    "exactmass": ["exact_mass", "exactmass"],
    "averagemass": ["averagemass"],
    "precursortype": [
        "adduct", "ms$focused_ion:precursor_type", "precursor type", "precursor_type", "precursortype",
    ],
    "instrumenttype": [
        "ac$instrument_type", "instrument type", "instrument_type", "instrument-type", "instrumenttype",
        "source_instrument",
    ],
    "instrument": ["ac$instrument", "instrument"],
    "smiles": ["ch$smiles", "computed_smiles", "smiles"],
    "inchi": ["ch$iupac", "computed_inchi", "inchi", "stdinchi"],
    "inchikey": ["ch$link:inchikey", "computed_inchikey", "inchi_aux", "inchikey"],
    "collisionenergy": [
        "ac$mass_spectrometry:collision_energy", "colenergy", "collision energy", "collision_energy",
        "collision-energy-level", "collision-energy-voltage", "collisionenergy",
    ],
    "formula": ["ch$formula", "formula"],
    "rt": [
        "ac$chromatography:retention_time", "retention-time", "retentiontime", "rettime", "rt", "rt_query",
        "rtinseconds",
    ],
    "ionmode": [
        "ac$mass_spectrometry:ion_mode", "ion_mode", "ionization mode", "ionization-mode", "ionmode", "ionpol",
        "ionpolarity", "polarity",
    ],
    "comment": ["comment", "comments"],
    "entropy": ["entropy"],
    "classyfire_superclass": ["classyfire_superclass"],
    "classyfire_class": ["classyfire_class"],
    "classyfire_subclass": ["classyfire_subclass"],
    "npclass_pathway": ["npclass_pathway"],
    "npclass_superclass": ["npclass_superclass"],
    "npclass_class": ["npclass_class"],
    "num_peaks": ["num peaks", "num_peaks", "numpeaks"],
}

#: Cations and anions of the clusters.
CATIONS = {ion: CHARGES[ion] for ion in ("H", "Na", "K", "NH4", "Li", "Ca", "Fe")}
ANIONS = ["Cl", "37Cl", "Br", "I", "F", "HCOO", "CH3COO", "NO3"]
# Names in use whose canonical text does not follow from their terms, and the name that they stand for.
READINGS = {
    "M+FA": ("[M+FA]-", "M+FA-H"),
    "M-C2H3O": ("[M-C2H3O]-", "M-C2H3O"),
    "M-C3H7O2": ("[M-C3H7O2]-", "M-C3H7O2"),
    "M-CH3": ("[M-CH3]-", "M-CH3"),
    "M-H2O": ("[M-H2O]+", "M-H2O"),
    "M-HCN-HCN": ("[(M-HCN)-HCN]-", "M-HCN-H"),
    "M-CH3-H.": ("[M-CH4]+.", "M-CH4"),
    "M-Ac-H-": ("[M-Ac-H]-", "M-HAc+H"),
    "M+CH3COOH-H": ("[M+CH3COOH-H]-", "M+CH3COOH-H"),
    "2M+Hac-H": ("[2M+HAc-H]-", "2M+HAc-H"),
    "3M+Cl_37Cl2": ("[3M+Cl]2-_37Cl2", "3M+2Cl_37Cl2"),
    "M-2H+Ca+CH3OH+CH3COOH+Cl_Cl1": ("[(M-2H+Ca+CH3OH+CH3COOH)+Cl]-37_Cl1", "M-2H+Ca+CH3OH+CH3COOH+Cl_37Cl1"),
    "2M-H+Na": ("[2M-H+Na]+", "2M-H+Na"),
    "2M-3H+2Ca": ("[(2M-3H+2Ca)]+", "2M-3H+2Ca"),
    "2M-K+K+2K": ("[(2M-K+K)+2K]2+", "2M-H+K+2K"),
    "M+Ca-H": ("[(M+Ca)-H]+", "M+Ca-H"),
    "M-H+Ca": ("[(M-H)+Ca]+", "M-H+Ca"),
    "M-3H+2Na+Ca": ("[(M-3H+2Na)+Ca]+", "M-3H+2Na+Ca"),
    "M+Na+CH3CO2Ca-H": ("[(M+Na+CH3CO2Ca-H]+", "M+Na+CH3CO2Ca-H"),
    "M-H+2CH3O+Ca+Ca": ("[(M-H+2CH3O+Ca)+Ca]+", "M-H+2CH3O+Ca+Ca"),
    "M-H+2OH+Ca+Ca": ("[(M-H+2OH+Ca)+Ca]+", "M-H+2OH+Ca+Ca"),
    "M-H+CH3O+CH3COO+Ca+Ca": ("[(M-H+CH3O+CH3COO+Ca)+Ca]+", "M-H+CH3O+CH3COO+Ca+Ca"),
    "M-H+OH+CH3O+Ca+Ca": ("[(M-H+OH+CH3O+Ca)+Ca]+", "M-H+OH+CH3O+Ca+Ca"),
    "M+Ca-H+CH3OCa": ("[M+Ca-H+CH3OCa]+", "M+Ca-2H+CH3OCa"),
    "M+H+CH3OCa": ("[M+H+CH3OCa]+", "M+CH3OCa"),
    "M+K+CH3OCa": ("[M+K+CH3OCa]+", "M+K-H+CH3OCa"),
    "M-3H2O+H": ("[M-3H2O+H]+", "M-3H2O+H"),
    "M-C3H8O+H": ("[M-C3H8O+H]+", "M-C3H8O+H"),
    "M-C6H10O5+H": ("[M-C6H10O5+H]+", "M-C6H10O5+H"),
}
MAX_MOLECULES, MAX_IONS, MAX_CHARGE = 3, 3, 3
NEUTRAL_LOSSES = [
    "H2O", "2H2O", "NH3", "CO", "CO2", "HCN", "CH2O", "CH3OH", "C2H4", "C4H8", "CH2CO", "CH3CHO", "CH3CHNH",
    "CH3CH2NH2", "CH3CO2H", "H3PO4", "HPO3", "SO3", "C5H8O3", "C5H8O4", "H2O-CO", "H2O-CO2", "H2O-NH3", "NH3-CO",
]
NEUTRAL_GAINS = ["H2O", "NH3", "CH3OH", "CH3CO2H", "2CH3CO2H", "CH3COOH", "2CH3COOH", "NaCl", "2NaCl", "3NaCl"]
POSITIVE_IONS = {
    1: [
        "M+", "M+H", "M+Na", "M+K", "M+Li", "M+NH4", "M+ACN+H", "M+ACN+Na", "M+MeOH+H", "M+DMSO+H", "M+IsoProp+H",
        "M+H-H2O", "M+H-2H2O", "M+H-3H2O", "M+H-NH3", "M+H-CH3", "M-H2O", "M-3H2O+H", "M-H+2Na", "M-H+2K",
        "2M+H", "2M+Na", "2M+K", "2M+NH4", "2M+ACN+H", "2M+ACN+Na", "2M-H+2Na", "3M+H", "3M+Na", "3M+K",
    ],
    2: [
        "M+2H", "M+2Na", "M+2K", "M+Ca", "M+H+Na", "M+H+K", "M+H+NH4", "M+ACN+2H", "M+2ACN+2H", "2M+2H", "2M+2Na",
        "2M+2K", "2M+Ca", "2M+H+Na", "2M+H+K", "3M+2H", "3M+2Na", "3M+2K", "3M+Ca", "3M+H+K", "3M+H+Na",
    ],
    3: ["M+3H", "M+3Na", "M+2H+Na", "M+H+2Na", "2M+3H", "3M+3H"],
}
NEGATIVE_IONS = {
    1: [
        "M-", "M-H", "M+Cl", "M+Br", "M+I", "M+F", "M+NO3", "M+HSO4", "M+HCOO", "M+CH3COO", "M+CH3CO2", "M+acetate",
        "M+FA-H", "M+HAc-H", "M+MeOH-H", "M+TFA-H", "M+CH3COOH-H", "M+Na-2H", "M+K-2H", "M-CH3", "M-C2H3O",
        "M-H-H2O", "M-H-CO2", "2M-H", "2M+Cl", "2M+FA-H", "2M+HAc-H", "2M+Hac-H", "2M+Na-2H", "2M+K-2H", "3M-H",
        "3M+Cl",
    ],
    2: ["M-2H", "2M-2H", "2M+2Cl", "2M-H+Cl", "3M-2H", "3M+2Cl", "3M-H+Cl"],
    3: ["M-3H", "2M-3H", "3M-3H"],
}


def default_synonyms() -> dict[str, list[str]]:
    """Canonical column -> lower-case field names."""
    return {column: list(names) for column, names in FIELD_NAMES.items()}


def terms(name: str) -> list[tuple[int, str, str]]:
    """``(times, group, token)`` of the terms of a name without brackets; an isotope's mass number belongs to its group."""
    out = []
    for token in re.findall(r"[+-]?\w+", name):
        sign, times, group = re.fullmatch(rf"([+-]?)(\d??)({'|'.join(HEAVY)})|([+-]?)(\d*)(\w+)", token).group(1, 2, 3)
        if group is None:
            sign, times, group = re.fullmatch(r"([+-]?)(\d*)(\w+)", token).groups()
        out.append(((-1 if sign == "-" else 1) * int(times or 1), group, token))
    return out


def adduct_shift(known: str, charge: int) -> float:
    """Mass shift of an adduct: added minus lost groups, less the electrons of its charge.

    A suffix like ``_37Cl1`` makes so many of the named atoms the heavy isotope.
    """
    body, _, isotope = known.partition("_")
    shift = sum(n * (0.0 if g == "M" else NAMED.get(g) or group_mass(g)) for n, g, _ in terms(body))
    if isotope:
        number, element, count = re.fullmatch(r"(\d+)([A-Z][a-z]?)(\d+)", isotope).groups()
        shift += int(count) * (HEAVY[number + element] - MASSES[element])
    return shift - charge * ELECTRON


def canonical_body(name: str) -> str:
    """The name with its longest neutral start in parentheses, unless that is molecules only or holds a solvent."""
    own, charge, cut = terms(name), 0, 0
    for i, (n, group, _) in enumerate(own[:-1]):
        if group in SOLVENTS:
            break
        charge += 0 if group == "M" else n * CHARGES.get(re.sub(r"^\d+", "", group), 0)
        cut = i + 1 if i and not charge else cut
    tokens = [t for *_, t in own]
    return f"({''.join(tokens[:cut])}){''.join(tokens[cut:])}" if cut else name


def _ion(known: str, body: str, charge: int) -> tuple[str, str, float, str]:
    sign = "+" if charge > 0 else "-"
    size = "" if abs(charge) == 1 else str(abs(charge))
    mode = "positive" if charge > 0 else "negative"
    return known, f"[{canonical_body(body)}]{size}{sign}", round(adduct_shift(known.rstrip("+-"), charge), 6), mode


def _reading(known: str) -> tuple[str, str, float, str]:
    canonical, name = READINGS[known]
    size, sign = re.search(r"\](\d?)([+-])", canonical).groups()
    charge = int(size or 1) * (1 if sign == "+" else -1)
    return known, canonical, round(adduct_shift(name, charge), 6), "positive" if charge > 0 else "negative"


def _times(n: int, group: str) -> str:
    return f"{n if n > 1 else ''}{group}"


def cluster_ions() -> list[tuple[str, str, float, str]]:
    """Clusters of up to three molecules with up to three cations, or two anions, less up to three protons.

    A name lists the ions and the protons in either order; ions of two kinds in either order too.
    """
    gains: list[tuple[list[str], int]] = []
    for a, b in combinations_with_replacement(CATIONS, 2):
        for i in range(1, MAX_IONS + 1):
            for j in range(0 if a == b else 1, 1 if a == b else MAX_IONS + 1 - i):
                parts = [_times(i, a), *([_times(j, b)] if j else [])]
                gains.append((parts, i * CATIONS[a] + j * CATIONS[b]))
    gains += [([_times(n, a)], -n) for a in ANIONS for n in ((1,) if a[0].isdigit() else (1, 2))]
    gains.append(([], 0))
    rows = []
    for molecules in range(1, MAX_MOLECULES + 1):
        for parts, charge in gains:
            for lost in range(4):
                z = charge - lost
                if not 1 <= abs(z) <= MAX_CHARGE or (lost and any(re.fullmatch(r"\d?H", p) for p in parts)):
                    continue
                core, minus = _times(molecules, "M"), f"-{_times(lost, 'H')}" if lost else ""
                for order in ([parts, parts[::-1]] if len(parts) > 1 else [parts]):
                    plus = "".join(f"+{p}" for p in order)
                    rows += [_ion(name, name, z) for name in dict.fromkeys((core + plus + minus, core + minus + plus))]
    return rows


def default_adducts() -> list[tuple[str, str, float, str]]:
    """``(known_adduct, canonical, massdiff, ionmode)`` rows computed from the lists above."""
    rows = []
    for sign, ions in ((1, POSITIVE_IONS), (-1, NEGATIVE_IONS)):
        for z, names in ions.items():
            rows += [_ion(n, n.rstrip("+-"), sign * z) for n in names]
    for loss in NEUTRAL_LOSSES:
        core = f"M-{loss}"
        rows += [_ion(f"{core}+{h}", f"{core}+{h}", z) for z, h in ((1, "H"), (2, "2H"), (3, "3H"))]
        rows.append(_ion(f"{core}-H", f"{core}-H", -1))
    for gain in NEUTRAL_GAINS:
        core = f"M+{gain}"
        rows += [_ion(f"{core}+{c}", f"{core}+{c}", 1) for c in ("H", "Na", "K")]
        rows += [_ion(f"{core}+Cl", f"{core}+Cl", -1), _ion(f"{core}-H", f"{core}-H", -1)]
    rows += cluster_ions()
    rows = [_reading(known) for known in READINGS] + rows
    return list({r[0]: r for r in reversed(rows)}.values())


DEFAULT_INSTRUMENTS = [
    InstrumentRule("thermo", "qexactive", "not found", "itft", "esi", "high", "Q Exactive, LC-ESI-ITFT, high"),
    InstrumentRule("thermo", "qexactive", "not found", "not found", "esi", "high", "Q Exactive, LC-ESI-QFT, high"),
    InstrumentRule("thermo", "qexactive", "not found", "not found", "not found", "high", "Q Exactive, QFT, high"),
    InstrumentRule("thermo", "ltq", "not found", "it", "esi", "low", "LTQ, LC-ESI-IT, low"),
    InstrumentRule("sciex", "qqq", "not found", "qtof", "esi", "high", "TripleTOF, LC-ESI-QTOF, high"),
    InstrumentRule("sciex", "qqq", "not found", "qtof", "ei", "high", "TripleTOF, GC-EI-QTOF, high"),
    InstrumentRule("sciex", "qqq", "not found", "not found", "esi", "low", "Triple Quad, LC-ESI-QQQ, low"),
    InstrumentRule("agilent", "(?:6530|6550)", "not found", "qtof", "esi", "high", "Agilent Q-TOF, LC-ESI-QTOF, high"),
    InstrumentRule("agilent", "(?:6530|6550)", "not found", "qtof", "esi", "unknown", "Agilent Q-TOF, LC-ESI-QTOF, unknown"),
    InstrumentRule("agilent", "not found", "gc", "qtof", "ei", "high", "Agilent GC, GC-EI-QTOF, high"),
    InstrumentRule("waters", "xevo", "not found", "qtof", "esi", "high", "Xevo, LC-ESI-QTOF, high"),
    InstrumentRule("waters", "not found", "gc", "qtof", "ei", "unknown", "Waters GC, GC-EI-QTOF, unknown"),
    InstrumentRule("not found", "not found", "gc", "qtof", "ei", "unknown", "not found, GC-EI-QTOF, unknown"),
]

ADDUCT_COLUMNS = ["known_adduct", "canonical", "massdiff", "ionmode"]


def adduct_table(spark: SparkSession) -> DataFrame:
    return local_table(spark, default_adducts(), ADDUCT_COLUMNS)


def complete_adducts(df: DataFrame, adducts: DataFrame) -> DataFrame:
    """The adduct table with a row for every other name in ``precursortype`` that the grammar can read.

    Names are few against spectra: they are made distinct before anything is read or joined.
    """
    names = df.select(strip_adduct(F.col("precursortype")).alias("known_adduct")).filter("known_adduct <> ''").distinct()
    unknown = names.join(adducts, "known_adduct", "left_anti")
    # A generator reads each name once; its fields are not put into later expressions.
    read = stage(unknown.select("known_adduct", F.inline(F.array(read_adduct(F.col("known_adduct"))))), "adducts")
    return adducts.select(*ADDUCT_COLUMNS).unionByName(read.filter("canonical is not null").select(*ADDUCT_COLUMNS))


def _small_file(spark: SparkSession, path: str) -> str:
    """A lookup file as one text, from any storage that Spark reads; several parts follow each other."""
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def _read_parts(spark: SparkSession, path: str) -> DataFrame:
    """All ``;``-separated parts under a path, header in lower case."""
    df = spark.read.option("header", True).option("sep", ";").option("quote", '"').option("escape", '"').csv(path)
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_adducts(spark: SparkSession, path: str) -> DataFrame:
    """User adduct file: known name, canonical name, mass shift, ion mode (by position)."""
    df = _read_parts(spark, path)
    named = df.toDF(*ADDUCT_COLUMNS, *df.columns[4:])
    rows = named.select("known_adduct", "canonical", F.col("massdiff").cast("double"), "ionmode")
    return one_per_key(rows, "known_adduct")


def read_compounds(spark: SparkSession, path: str) -> DataFrame:
    df = _read_parts(spark, path).select("inchikey", *COMPOUND_COLUMNS)
    return df.withColumns({c: F.col(c).cast("double") for c in ("exactmass", "averagemass")})


def read_ontologies(spark: SparkSession, path: str) -> DataFrame:
    return _read_parts(spark, path).select("inchikey", *ONTOLOGY_COLUMNS)


def read_synonyms(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """User synonym file (``known;canonical`` with a header) as column -> names; the last line of a name wins."""
    known = {}
    for line in _small_file(spark, path).splitlines()[1:]:
        name, _, canonical = line.partition(";")
        if canonical.strip():
            known[name.strip().lower()] = canonical.strip().lower().replace(" ", "_")
    out: dict[str, list[str]] = {}
    for name, canonical in known.items():
        column = "peaks" if canonical == "peaks_list" else canonical
        if column in FIELD_NAMES or column == "peaks":
            out.setdefault(column, []).append(name)
    return out


def read_instruments(spark: SparkSession, path: str) -> list[InstrumentRule]:
    """User instrument tree: five nested levels, then resolution -> {"SOLUTION": text}."""

    def walk(node: dict, trail: tuple):
        if len(trail) == 6:
            yield InstrumentRule(*trail, node["SOLUTION"])
            return
        for key, child in node.items():
            yield from walk(child, (*trail, key))

    return list(walk(json.loads(_small_file(spark, path)), ()))
