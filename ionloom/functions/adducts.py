"""Adduct names read by a grammar of column functions.

    name    = [molecules] "M" {term} [isotope]
    term    = ("+" | "-") [times] (group | "(" name ")")
    isotope = "_" mass-number element times, e.g. `_37Cl1`: so many of the named atoms are the heavy isotope

A fold over the tokens with a stack of multipliers gives the mass shift and the charge. Ions bring their charge;
molecules and radicals bring none. A name whose charge the terms don't tell (`M-CH3`) has that of the
sign behind its bracket.

The canonical text puts the longest neutral start in parentheses, as in `[(M-H+Na)+Na]+`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.functions.elements import ELECTRON, MONOISOTOPIC, formula_mass, literal_map
from ionloom.functions.exprs import group_or_null, let

# Group names that are not plain formulas.
GROUPS = {
    "ACN": "C2H3N", "FA": "CH2O2", "Hac": "C2H4O2", "HAc": "C2H4O2", "MeOH": "CH4O", "TFA": "C2HF3O2",
    "acetate": "C2H3O2", "Ac": "C2H2O", "DMSO": "C2H6OS", "IsoProp": "C3H8O", "R": "C5H8O4", "dR": "C5H8O3",
    "GlcA": "C6H8O6", "GlcAc": "C6H8O6",
}
#: Groups that stay beside the ion, without parentheses, in canonical texts.
SOLVENTS = ["ACN", "FA", "Hac", "HAc", "MeOH", "TFA", "DMSO", "IsoProp", "acetate", "Ac"]
# Charges that groups bring.
CHARGES = {
    "H": 1, "Na": 1, "K": 1, "Li": 1, "NH4": 1, "Ca": 2, "Fe": 2, "CH3OCa": 1, "CH3CO2Ca": 1, "CH3COOCa": 1, "Cl": -1, "Br": -1,
    "I": -1, "F": -1, "HCOO": -1, "CH3COO": -1, "CH3CO2": -1, "acetate": -1, "NO3": -1, "HSO4": -1, "OH": -1, "CH3O": -1,
}
# Masses of isotopes that names spell out, and of lithium.
HEAVY = {"37Cl": 36.96590260, "81Br": 80.9162906, "13C": 13.00335483507, "15N": 15.0001088989, "6Li": 6.0151228874}
MASSES = MONOISOTOPIC | {"Li": 7.016003}
TOKEN = r"[+-]?\d*\(|\)|[+-]?\d*[A-Za-z][A-Za-z0-9]*"
NAME = rf"^(?:{TOKEN})+$"
ISOTOPE = r"_(\d*)([A-Z][a-z]?)(\d+)$"


def group_mass(formula: str) -> float:
    """Mass of a formula, on the driver."""
    return sum(MASSES[s] * int(n or 1) for s, n in re.findall(r"([A-Z][a-z]?)(\d*)", formula))


#: Mass by group name, for those that the formula parser can't read.
NAMED = {g: group_mass(f) for g, f in GROUPS.items()} | HEAVY


def _sign(token: Column) -> Column:
    times = F.coalesce(F.regexp_extract(token, r"^[+-]?(\d+)", 1).try_cast("int"), F.lit(1))
    return F.when(F.startswith(token, F.lit("-")), -times).otherwise(times)


def _term(token: Column) -> Column:
    """``(times, group)`` of a token that is no bracket; an isotope's mass number belongs to its group."""
    heavy = r"^([+-]?)(\d??)(" + "|".join(HEAVY) + r")$"
    isotope = group_or_null(token, heavy, 3)
    spelled = F.regexp_replace(token, heavy, "$1$2")
    count = F.coalesce(F.regexp_extract(spelled, r"^[+-]?(\d+)", 1).try_cast("int"), F.lit(1))
    marked = F.when(F.startswith(token, F.lit("-")), -count).otherwise(count)
    plain = F.regexp_extract(token, r"^[+-]?\d*(.*)$", 1)
    return F.struct(
        F.when(isotope.isNotNull(), marked).otherwise(_sign(token)).alias("times"), F.coalesce(isotope, plain).alias("group")
    )


def _mass(group: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(NAMED), group), formula_mass(group, MASSES))


def _charge(group: Column) -> Column:
    charges = CHARGES | {k: CHARGES.get(re.sub(r"\d", "", k), 0) for k in HEAVY}
    return F.coalesce(F.try_element_at(literal_map(charges), group), F.lit(0))


def _fold(tokens: Column) -> Column:
    """``(mass, charge, molecules, known)`` over the tokens; the top of `stack` multiplies what follows."""
    start = F.struct(
        F.array(F.lit(1)).alias("stack"), F.lit(0.0).alias("mass"), F.lit(0).alias("charge"), F.lit(0).alias("molecules"),
        F.lit(True).alias("known"),
    )

    def state(acc: Column, **new: Column) -> Column:
        return F.struct(*[new.get(c, acc[c]).alias(c) for c in ("stack", "mass", "charge", "molecules", "known")])

    def step(acc: Column, token: Column) -> Column:
        top = F.element_at(acc["stack"], -1)
        term = _term(token)
        times, is_m = top * term["times"], term["group"] == "M"
        mass = _mass(term["group"])
        opened = state(acc, stack=F.concat(acc["stack"], F.array(top * _sign(token))))
        deep = F.size(acc["stack"]) > 1
        closed = state(
            acc, stack=F.when(deep, F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(1)))).otherwise(acc["stack"]),
            known=acc["known"] & deep,
        )
        added = state(
            acc, mass=acc["mass"] + F.when(is_m, F.lit(0.0)).otherwise(F.coalesce(mass, F.lit(0.0)) * times),
            charge=acc["charge"] + F.when(is_m, F.lit(0)).otherwise(_charge(term["group"]) * times),
            molecules=acc["molecules"] + F.when(is_m, times).otherwise(F.lit(0)), known=acc["known"] & (is_m | mass.isNotNull()),
        )
        return F.when(F.endswith(token, F.lit("(")), opened).when(token == ")", closed).otherwise(added)

    return F.aggregate(tokens, start, step)


def _neutral_start(tokens: Column) -> Column:
    """Number of tokens of the longest neutral start that is more than molecules and not all; 0 without one."""
    terms = F.transform(tokens, _term)
    reach = F.sequence(F.lit(1), F.size(tokens))

    def charge_to(i: Column) -> Column:
        part = F.slice(terms, 1, i)
        total = F.aggregate(part, F.lit(0), lambda acc, t: acc + F.when(t["group"] == "M", F.lit(0)).otherwise(_charge(t["group"]) * t["times"]))
        return F.when(F.exists(part, lambda t: t["group"].isin(SOLVENTS)), F.lit(1)).otherwise(total)

    neutral = F.filter(reach, lambda i: (i > 1) & (i < F.size(tokens)) & (charge_to(i) == 0))
    return F.coalesce(F.array_max(neutral), F.lit(0))


def _signed(charge: Column) -> Column:
    size = F.when(F.abs(charge) == 1, F.lit("")).otherwise(F.abs(charge).cast("string"))
    return F.concat(size, F.when(charge > 0, "+").otherwise("-"))


def read_adduct(text: Column) -> Column:
    """``struct<canonical, charge, massdiff, ionmode>`` of an adduct, bare or in brackets; NULL where the grammar ends.

    ``massdiff`` is what the ion adds to the molecules, less the electrons of its charge.
    """
    bare = F.regexp_replace(text, r"^\s+|\s+$|[*.]", "")
    inner = group_or_null(bare, r"^\[(.*)\]")
    written = group_or_null(bare, r"\]_?(\d*[+-])")
    size = F.coalesce(F.regexp_extract(written, r"^(\d+)", 1).try_cast("int"), F.lit(1))
    given = F.when(F.endswith(written, F.lit("-")), -size).when(written.isNotNull(), size)
    trailing = F.regexp_extract(F.regexp_replace(bare, ISOTOPE, ""), r"([+-])$", 1)
    given = F.coalesce(given, F.when(trailing == "+", 1).when(trailing == "-", -1))
    tail = F.regexp_extract(bare, ISOTOPE, 0)
    body = F.regexp_replace(F.regexp_replace(F.coalesce(inner, bare), ISOTOPE, ""), r"[+-]$", "")
    light, heavy = F.regexp_extract(tail, ISOTOPE, 2), F.concat(F.regexp_extract(tail, ISOTOPE, 1), F.regexp_extract(tail, ISOTOPE, 2))
    swap = F.try_element_at(literal_map(HEAVY), heavy) - F.try_element_at(literal_map(MASSES), light)
    swapped = F.when(tail == "", F.lit(0.0)).otherwise(swap * F.regexp_extract(tail, ISOTOPE, 3).try_cast("int"))

    def shaped(tokens: Column) -> Column:
        def built(found: Column) -> Column:
            charge = F.when(found["charge"] != 0, found["charge"]).otherwise(F.coalesce(given, F.lit(0)))
            n = _neutral_start(tokens)
            flat = ~F.exists(tokens, lambda t: F.endswith(t, F.lit("(")))
            head = F.concat(F.lit("("), F.array_join(F.slice(tokens, 1, F.greatest(n, F.lit(1))), ""), F.lit(")"))
            rest = F.array_join(F.slice(tokens, n + 1, F.size(tokens)), "")
            inside = F.when(flat & (n > 0), F.concat(head, rest)).otherwise(F.array_join(tokens, ""))
            mass = F.round(found["mass"] + swapped - charge * ELECTRON, 6)
            mode = F.when(charge > 0, "positive").otherwise("negative")
            out = F.struct(
                F.concat(F.lit("["), inside, F.lit("]"), _signed(charge), tail).alias("canonical"), charge.alias("charge"),
                mass.alias("massdiff"), mode.alias("ionmode"),
            )
            return F.when(found["known"] & (found["molecules"] > 0) & (F.size(found["stack"]) == 1) & (charge != 0) & mass.isNotNull(), out)

        return let(_fold(tokens), built)

    # Parentheses that only group, as in canonical texts, are read without them.
    plain = F.regexp_replace(body, r"^\(([^()]*)\)", "$1")
    return F.when(plain.rlike(NAME), let(F.regexp_extract_all(plain, F.lit(TOKEN), 0), shaped))
