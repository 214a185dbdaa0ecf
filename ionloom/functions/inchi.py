"""Layers of an InChI as column functions: charge, protons, isotopes and the fixed-hydrogen formula.

The formula layer alone leaves out the protons of `/p`, the labels of `/i`, and what `/f` says of a
fixed tautomer. Components are separated by `.` in formulas and by `;` in layers, with a leading
count for equal ones (`2C2H6.ClH`, `/q2*-1;+2`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.functions.elements import MONOISOTOPIC, atom_counts, formula_mass, formula_parts, literal_map, parts_mass
from ionloom.functions.exprs import group_or_null, let

HYDROGEN = "H"
# Masses of labelled hydrogens.
LABELS = {"D": 2.01410177812, "T": 3.0160492779, "H": 1.0078250322}
# Isotope masses by element and offset. The offset counts from the rounded standard weight.
ISOTOPES = {
    "C+1": 13.00335483507, "C+2": 14.0032419884, "N+1": 15.0001088989, "O+1": 16.9991317565, "O+2": 17.9991596129,
    "F-1": 18.000938, "P+1": 32.971725, "P+2": 33.971726, "S+1": 32.9714589098, "S+2": 33.967867004, "S+3": 34.969032,
    "S+4": 35.96708071, "Cl+0": 34.9688527, "Cl+1": 35.968306809, "Cl+2": 36.965902602, "Br-1": 78.918338, "Br+1": 80.9162906,
    "I-2": 124.904629, "I+4": 130.906124, "Na+1": 23.990963, "K+1": 39.96399817, "K+2": 40.9618252579,
    "Se-3": 75.919213704, "Se+1": 79.916522, "Se+3": 81.9166995,
}
COUNTED = r"^(\d+)\*(.*)$"


def layers(inchi: Column) -> Column:
    """Texts of the layers that move charge and mass, as one struct; each pattern is tested once per InChI.

    ``p``, ``q``, ``i``: the first layer of that name, NULL without one; layers of the fixed-hydrogen part don't count.
    ``fixed_q``: the charge of that part. ``formula``: that behind `/f` if it names one, else the first layer.
    ``mobile``: labels of mobile hydrogens (`/i.../h`).
    """

    def of(own: Column) -> Column:
        texts = {name: group_or_null(own["main"], rf"/{name}([^/]*)") for name in "pqi"}
        fixed = F.when(own["fixed"] != "", group_or_null(own["fixed"], "/q([^/]*)"))
        behind = F.when(F.contains(inchi, F.lit("/f")) | F.contains(inchi, F.lit("/F")), group_or_null(inchi, r"(?i)^InChI=1/.*?/f([A-Z][A-Za-z0-9.]*)"))
        formula = F.coalesce(behind, group_or_null(inchi, r"(?i)^InChI=1S?/(\d*[A-Z][A-Za-z0-9.]*)"))
        mobile = group_or_null(F.regexp_extract(inchi, r"/i[^/]*/h([DTH0-9,]+)", 0), r"/h([DTH0-9,]+)")
        parts = {**texts, "fixed_q": fixed, "formula": formula, "mobile": F.when(F.contains(inchi, F.lit("/i")), mobile)}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    main = F.regexp_extract(inchi, r"(?i)^(InChI=1S?/.*?)(?:/f.*)?$", 1)
    fixed = F.regexp_extract(inchi, r"(?i)^InChI=1/.*?/f(.*)$", 1)
    return let(F.struct(main.alias("main"), fixed.alias("fixed")), of)


def formula_layer(inchi: Column) -> Column:
    """The formula: that behind `/f` if it names one, else the first layer."""
    fixed = group_or_null(inchi, r"(?i)^InChI=1/.*?/f([A-Z][A-Za-z0-9.]*)")
    return F.coalesce(fixed, group_or_null(inchi, r"(?i)^InChI=1S?/(\d*[A-Z][A-Za-z0-9.]*)"))


def _components(text: Column) -> Column:
    """Texts of the components of a layer, equal ones repeated."""

    def repeated(part: Column) -> Column:
        n = F.coalesce(F.regexp_extract(part, COUNTED, 1).try_cast("int"), F.lit(1))
        own = F.array_repeat(F.when(part.rlike(COUNTED), F.regexp_extract(part, COUNTED, 2)).otherwise(part), n)
        return F.when(F.contains(part, F.lit("*")), own).otherwise(F.array(part))

    return F.flatten(F.transform(F.split(text, ";"), repeated))


def _formulas(formula: Column) -> Column:
    """Formulas of the components, equal ones repeated."""

    def repeated(part: Column) -> Column:
        n = F.coalesce(group_or_null(part, r"^(\d+)").try_cast("int"), F.lit(1))
        return F.array_repeat(F.regexp_replace(part, r"^\d+", ""), n)

    return F.flatten(F.transform(F.split(formula, r"\."), repeated))


def _signed_sum(text: Column) -> Column:
    numbers = F.transform(_components(text), lambda c: F.coalesce(F.when(c != "", F.regexp_replace(c, r"^\+", "").try_cast("int")), F.lit(0)))
    return F.coalesce(F.aggregate(numbers, F.lit(0), lambda acc, n: acc + n), F.lit(0))


def protons(inchi: Column) -> Column:
    """Protons that `/p` adds or removes."""
    return facts(inchi)["protons"]


def charge(inchi: Column) -> Column:
    """Net charge: that of `/q`, or of the fixed-hydrogen part where it has one, and of the protons."""
    return facts(inchi)["charge"]


def _skeleton(formula: Column) -> Column:
    """Symbols of the numbered atoms of a component, in the order of their numbers: carbons first, no hydrogens."""
    heavy = F.filter(atom_counts(formula), lambda a: a["symbol"] != HYDROGEN)
    return F.flatten(F.transform(heavy, lambda a: F.array_repeat(a["symbol"], a["n"])))


def _label(entry: Column, atoms: Column) -> Column:
    """One entry of `/i`, as `3+1` or `2D3`, read: the offset and the element of a numbered atom, and labelled hydrogens."""

    def hydrogen(text: Column) -> Column:
        n = F.coalesce(group_or_null(text, r"(\d+)").try_cast("int"), F.lit(1))
        return F.struct(F.substr(text, F.lit(1), F.lit(1)).alias("label"), n.alias("n"))

    hydrogens = F.regexp_extract_all(F.regexp_replace(entry, r"^\d*([+-]\d+)?", ""), F.lit(r"[DTH]\d*"), 0)
    return F.struct(
        entry.rlike(r"^\d*([+-]\d+)?([DTH]\d*)*$").alias("readable"),
        group_or_null(entry, r"^\d+([+-]\d+)").alias("offset"),
        F.try_element_at(atoms, group_or_null(entry, r"^(\d+)").try_cast("int")).alias("symbol"),
        F.transform(hydrogens, hydrogen).alias("hydrogens"),
    )


def _labels(text: Column, mobile: Column, formula: Column) -> Column:
    """All entries of `/i`, component by component, and of the mobile hydrogens."""
    none = F.array().cast("array<string>")

    def entries(part: Column, atoms: Column) -> Column:
        return F.transform(F.filter(F.split(part, ","), lambda e: e != ""), lambda e: _label(e, atoms))

    def own(formulas: Column) -> Column:
        def part(c: Column, i: Column) -> Column:
            atoms = F.coalesce(F.when(c != "", _skeleton(F.try_element_at(formulas, i + 1))), none)
            return let(atoms, lambda a: entries(c, a))

        return F.flatten(F.transform(_components(text), part))

    labelled = let(F.coalesce(_formulas(formula), none), own)
    return F.concat(F.when(text != "", labelled).otherwise(entries(F.lit(""), none)), entries(F.coalesce(mobile, F.lit("")), none))


def facts(inchi: Column) -> Column:
    """What the layers say, read once for all that is asked of it: ``formula``, its ``parts``, ``protons``, ``charge``, the
    protons ``moved`` that the formula leaves out, and ``labels``."""

    def read(own: Column) -> Column:
        def assemble(n: Column) -> Column:
            charged = F.when(own["fixed_q"].isNotNull(), _signed_sum(own["fixed_q"])).otherwise(_signed_sum(own["q"]) + n)
            return F.struct(
                own["formula"].alias("formula"), formula_parts(own["formula"]).alias("parts"), n.alias("protons"),
                F.when(own["formula"].isNotNull(), charged).alias("charge"),
                F.when(own["fixed_q"].isNull(), n).otherwise(F.lit(0)).alias("moved"),
                _labels(F.coalesce(own["i"], F.lit("")), own["mobile"], own["formula"]).alias("labels"),
            )

        return let(_signed_sum(own["p"]), assemble)

    return let(layers(inchi), read)


def _label_shift(label: Column, weights: dict[str, float]) -> Column:
    """Mass that a label adds to the unlabelled atoms; NULL if it can't be read."""
    symbol, offset = label["symbol"], label["offset"]
    heavier = F.try_element_at(literal_map(ISOTOPES), F.concat(symbol, offset)) - F.try_element_at(literal_map(weights), symbol)

    def added(acc: Column, x: Column) -> Column:
        return acc + (F.try_element_at(literal_map(LABELS), x["label"]) - F.lit(weights[HYDROGEN])) * x["n"]

    moved = F.when(offset.isNull(), F.lit(0.0)).otherwise(heavier)
    return F.when(label["readable"], moved + F.aggregate(label["hydrogens"], F.lit(0.0), added))


def facts_mass(own: Column, weights: dict[str, float] = MONOISOTOPIC) -> Column:
    """`inchi_mass` of `facts`."""
    labels = F.aggregate(own["labels"], F.lit(0.0), lambda acc, e: acc + _label_shift(e, weights))
    return parts_mass(own["parts"], weights) + own["moved"] * F.lit(weights[HYDROGEN]) + labels


def isotope_shift(inchi: Column, weights: dict[str, float] = MONOISOTOPIC) -> Column:
    """Mass that the labels of `/i` and of mobile hydrogens (`/i.../h`) add; NULL for a label that is not known."""
    return F.aggregate(facts(inchi)["labels"], F.lit(0.0), lambda acc, e: acc + _label_shift(e, weights))


def inchi_mass(inchi: Column, weights: dict[str, float] = MONOISOTOPIC) -> Column:
    """Mass of all atoms that the InChI names, with protons and labels; electrons are not weighed.

    NULL where the formula or a label can't be read.
    """
    return let(facts(inchi), lambda own: facts_mass(own, weights))


def structure_mass(inchi: Column, weights: dict[str, float] = MONOISOTOPIC) -> Column:
    """`inchi_mass`; where no layer can move it, the formula's, which is cheaper."""
    return F.when(inchi.rlike("/[pif]"), inchi_mass(inchi, weights)).otherwise(formula_mass(formula_layer(inchi), weights))
