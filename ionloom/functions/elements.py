"""Element tables and formula expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.functions.exprs import group_or_null

# Monoisotopic masses of the atoms used for fragment formulas.
MONOISOTOPIC = {
    "H": 1.0078250322,
    "C": 12.000000,
    "N": 14.003074004,
    "O": 15.994914619,
    "F": 18.998403162,
    "Na": 22.98976928,
    "Mg": 23.98504170,
    "P": 30.973761998,
    "S": 31.972071174,
    "Cl": 34.9688527,
    "K": 38.96370649,
    "Ca": 39.9625909,
    "Mn": 54.938043,
    "Fe": 55.934936,
    "Co": 58.933194,
    "Cu": 62.929597,
    "Zn": 63.929142,
    "Br": 78.918338,
    "Se": 79.916522,
    "I": 126.90447,
}
# Standard atomic weights (IUPAC, abridged) of the same atoms.
AVERAGE = {
    "H": 1.008,
    "C": 12.011,
    "N": 14.007,
    "O": 15.999,
    "F": 18.998403163,
    "Na": 22.98976928,
    "Mg": 24.305,
    "P": 30.973761998,
    "S": 32.06,
    "Cl": 35.45,
    "K": 39.0983,
    "Ca": 40.078,
    "Mn": 54.938043,
    "Fe": 55.845,
    "Co": 58.933194,
    "Cu": 63.546,
    "Zn": 65.38,
    "Br": 79.904,
    "Se": 78.971,
    "I": 126.90447,
}
# Valences for the unsaturation rule, every other atom counts as 2.
VALENCES = {"C": 4, "N": 3, "P": 3, "H": 1, "F": 1, "Cl": 1, "Br": 1, "I": 1, "Na": 1, "K": 1}
DEFAULT_VALENCE = 2
ELECTRON = 0.000548579909

# Search order of the composition enumeration: heaviest atom first.
HEAVIEST_FIRST = sorted(MONOISOTOPIC, key=MONOISOTOPIC.get, reverse=True)
TOKEN = r"([A-Z][a-z]*)(\d*)"


def literal_map(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def _count(text: Column, pattern: str, group: int = 1) -> Column:
    """Number in a text, 1 without one. An empty text isn't cast: that fails by an exception, a hundred times dearer."""
    return F.coalesce(group_or_null(text, pattern, group).try_cast("int"), F.lit(1))


def atom_counts(formula: Column) -> Column:
    """``array<struct<symbol, n>>`` in formula order."""
    return F.transform(
        F.regexp_extract_all(formula, F.lit(TOKEN), 0),
        lambda t: F.struct(
            F.regexp_extract(t, TOKEN, 1).alias("symbol"),
            _count(t, TOKEN, 2).alias("n"),
        ),
    )


def max_count(atoms: Column, symbol: str) -> Column:
    """Count of one atom; the last mention wins, 0 when absent."""
    hits = F.filter(atoms, lambda a: a["symbol"] == symbol)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["n"]).otherwise(F.lit(0))


def formula_parts(formula: Column) -> Column:
    """``array<struct<times, atoms>>``: the parts that ``.`` separates, with their leading multiplier.

    NULL for an empty formula or any other notation.
    """

    def part(text: Column) -> Column:
        return F.struct(_count(text, r"^(\d+)").alias("times"), atom_counts(text).alias("atoms"))

    parts = F.transform(F.split(F.regexp_replace(formula, r"[+-]\d*$", ""), r"\."), part)
    return F.when(formula.rlike(r"^(\d*([A-Z][a-z]?\d*)+)(\.\d*([A-Z][a-z]?\d*)+)*([+-]\d*)?$"), parts)


def parts_mass(parts: Column, table: dict[str, float] = MONOISOTOPIC) -> Column:
    """Mass of `formula_parts`; NULL with an unknown atom."""
    masses = literal_map(table)

    def mass(atoms: Column) -> Column:
        return F.aggregate(atoms, F.lit(0.0), lambda acc, a: acc + F.try_element_at(masses, a["symbol"]) * a["n"])

    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["times"] * mass(p["atoms"]))


def formula_mass(formula: Column, table: dict[str, float] = MONOISOTOPIC) -> Column:
    """Mass of a formula; ``.`` separates parts that may carry a leading multiplier.

    NULL for an empty formula, an unknown atom or any other notation.
    """
    return parts_mass(formula_parts(formula), table)


def inchi_formula(inchi: Column) -> Column:
    """Formula layer of an InChI."""
    return group_or_null(inchi, r"(?i)^InChI=1S?/([A-Za-z0-9.]+)")
