"""Fragment formula annotation as relational work on distinct values.

Compositions are enumerated once per distinct formula, peaks are reduced to distinct
(formula, m/z) pairs, and both meet in an equi join on (formula, mass bin) plus the exact window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions.elements import (
    DEFAULT_VALENCE,
    HEAVIEST_FIRST,
    MONOISOTOPIC,
    VALENCES,
    atom_counts,
    max_count,
)
from ionloom.operators.joins import lookup_join
from ionloom.schema import Params

SIMPLE_ATOMS = ["C", "H", "N", "O", "P", "S"]
ORGANIC_ATOMS = ["C", "H", "N", "O", "P", "S", "F", "Cl", "Br", "I"]
# Element ratio bounds relative to carbon.
HC_MIN, HC_MAX = 0.2, 3.0
RATIO_MAX = {"O": 1.2, "N": 1.3, "P": 0.3, "S": 0.8}
BIN_WIDTH = 0.01
H_MASS = MONOISOTOPIC["H"]
RESIDUES = 100
RESIDUE_WIDTH = H_MASS / RESIDUES
RESIDUE_SLACK = 1e-6


def count_of(symbol: str) -> Column:
    return F.col(f"n_{symbol}")


def parse_formula(df: DataFrame) -> DataFrame:
    """Distinct formulas with the largest count per atom and the kind of plausibility rules."""
    atoms = df.filter(F.col("formula") != "").select("formula").distinct()
    atoms = atoms.withColumn("_atoms", atom_counts(F.col("formula")))
    simple = F.forall("_atoms", lambda a: a["symbol"].isin(SIMPLE_ATOMS))
    return atoms.select(
        "formula",
        simple.alias("is_simple"),
        *[max_count(F.col("_atoms"), s).alias(f"max_{s}") for s in HEAVIEST_FIRST],
    )


def largest_targets(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Per formula the upper and lower mass bound of its peaks (partial extremes before the shuffle)."""
    mz = F.transform("peaks", lambda p: p["mz"])
    span = df.filter(F.col("formula") != "").groupBy("formula").agg(F.max(F.array_max(mz)).alias("_top"), F.min(F.array_min(mz)).alias("_low"))
    tolerance = params.ppm_tolerance / 1e6
    return span.select(
        "formula", ((F.col("_top") - H_MASS) * (1 + tolerance)).alias("mass_limit"),
        ((F.col("_low") - H_MASS) * (1 - tolerance) - RESIDUE_SLACK).alias("mass_floor"),
    )


def compositions(formulas: DataFrame, limits: DataFrame, symbols: list[str], two_sided: bool = False) -> DataFrame:
    """Every composition of the given atoms up to the formula's counts and the mass limit.

    One explode per atom, heaviest first, each bounded by the remaining mass. With ``two_sided`` a count is
    also bounded from below: all that the later atoms and the hydrogens can still add must reach
    the floor. Before the carbon level the rows are spread, so a formula with very many compositions does
    not stay in one task.
    """
    out = formulas.join(limits, "formula").withColumn("mass", F.lit(0.0))
    rest = sum((F.col(f"max_{s}") * F.lit(MONOISOTOPIC[s]) for s in dict.fromkeys([*symbols, "H"])), F.lit(0.0))
    shuffle_width = int(formulas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for symbol in symbols:
        if symbol == "C":
            out = out.repartition(shuffle_width, "formula", *[f"n_{s}" for s in ("N", "O", "S", "P")])
        mass = MONOISOTOPIC[symbol]
        room = F.floor((F.col("mass_limit") - F.col("mass")) / mass).cast("int")
        top = F.least(F.col(f"max_{symbol}"), room)
        rest = rest - F.col(f"max_{symbol}") * F.lit(mass)
        need = F.ceil((F.col("mass_floor") - F.col("mass") - rest) / mass).cast("int") if two_sided else F.lit(0)
        low = F.greatest(F.lit(0), need)
        out = out.withColumn(
            f"n_{symbol}", F.explode(F.when(top >= low, F.sequence(low, top)).otherwise(F.array().cast("array<int>")))
        ).withColumn("mass", F.col("mass") + count_of(symbol) * F.lit(mass))
    return out


def subformula_candidates(formulas: DataFrame, limits: DataFrame) -> DataFrame:
    """The whole lattice, hydrogens included; the annotation itself solves for the hydrogens."""
    out = compositions(formulas, limits, HEAVIEST_FIRST)
    return out.select("formula", "is_simple", "max_C", "mass", *[f"n_{s}" for s in HEAVIEST_FIRST])


def bounded_candidates(formulas: DataFrame, limits: DataFrame) -> DataFrame:
    """The lattice between the lightest and the heaviest window, hydrogens included."""
    out = compositions(formulas, limits, HEAVIEST_FIRST, two_sided=True).filter(F.col("mass") >= F.col("mass_floor"))
    return out.select("formula", "is_simple", "max_C", "mass", *[f"n_{s}" for s in HEAVIEST_FIRST])


def heavy_compositions(formulas: DataFrame, limits: DataFrame) -> DataFrame:
    """Compositions without their hydrogens: the part of the lattice that has to be enumerated."""
    symbols = [s for s in HEAVIEST_FIRST if s != "H"]
    return compositions(formulas, limits, symbols, two_sided=True).select(
        "formula", "is_simple", "max_C", "max_H", "mass", *[f"n_{s}" for s in symbols]
    )


def hydrogen_ratio_ok() -> Column:
    return (count_of("H") / count_of("C")).between(HC_MIN, HC_MAX)


def plausible_chnops() -> Column:
    """Carbon present, unsaturation a whole number from 0, H/C within bounds."""
    dbe = count_of("C") - count_of("H") / 2 + count_of("N") / 2 + count_of("P") / 2 + 1
    return F.when(count_of("C") > 0, (dbe >= 0) & (dbe == F.floor(dbe)) & hydrogen_ratio_ok()).otherwise(F.lit(False))


def plausible_general() -> Column:
    """Nitrogen rule, unsaturation from valences and ratios to carbon."""
    special = F.lit(False)
    unsaturation = F.lit(0)
    for symbol in HEAVIEST_FIRST:
        if symbol not in ORGANIC_ATOMS:
            special = special | (count_of(symbol) > 0)
        unsaturation = unsaturation + count_of(symbol) * (VALENCES.get(symbol, DEFAULT_VALENCE) - 2)
    nitrogen_rule = special | (F.rint("mass").cast("bigint") % 2 == (count_of("N") + count_of("P")) % 2)
    dbe = 1 + unsaturation / 2
    ratios = hydrogen_ratio_ok()
    for symbol, top in RATIO_MAX.items():
        ratios = ratios & (count_of(symbol) / count_of("C") <= top)
    carbon = F.when(count_of("C") > 0, ratios).otherwise(F.col("max_C") == 0)
    return nitrogen_rule & (dbe >= 0) & (dbe == F.floor(dbe)) & carbon


def plausible() -> Column:
    return F.when(F.col("is_simple"), plausible_chnops()).otherwise(plausible_general())


def hill_formula() -> Column:
    """Hill order with one more hydrogen and the charge sign."""

    def part(symbol: str, n: Column) -> Column:
        return F.when(n > 1, F.concat(F.lit(symbol), n.cast("string"))).when(n == 1, F.lit(symbol)).otherwise("")

    rest = [part(s, count_of(s)) for s in sorted(HEAVIEST_FIRST) if s not in ("C", "H")]
    return F.concat(part("C", count_of("C")), part("H", count_of("H") + 1), *rest, F.lit("+"))


def peak_targets(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Distinct (formula, m/z) with the neutral target mass and its ppm window."""
    pairs = (
        df.filter(F.col("formula") != "")
        .select("formula", F.explode(F.array_distinct(F.transform("peaks", lambda p: p["mz"]))).alias("mz"))
        .distinct()
    )
    share = params.ppm_tolerance / 1_000_000
    return (
        pairs.withColumn("target", F.col("mz") - H_MASS)
        .filter("target > 0")
        .withColumns({"lo": F.col("target") * (1 - share), "hi": F.col("target") * (1 + share)})
    )


def mass_bin(mass: Column) -> Column:
    return F.floor(mass / BIN_WIDTH)


def annotate_range_join(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose mass lies in a target window, with the ppm error."""
    binned = targets.withColumn("bin", F.explode(F.sequence(mass_bin(F.col("lo")), mass_bin(F.col("hi")))))
    return (
        binned.join(candidates.withColumn("bin", mass_bin(F.col("mass"))), ["formula", "bin"])
        .filter((F.col("mass") >= F.col("lo")) & (F.col("mass") <= F.col("hi")))
        .withColumn("error_ppm", F.round((F.col("mass") - F.col("target")) / F.col("target") * 1_000_000, 2))
        .drop("bin")
    )


def residue_bins(low: Column, high: Column) -> Column:
    """Bins of the masses between two bounds modulo the mass of hydrogen; edges count for both sides."""
    first, last = F.floor(low / RESIDUE_WIDTH - RESIDUE_SLACK), F.floor(high / RESIDUE_WIDTH + RESIDUE_SLACK)
    spread = F.sequence(first, F.least(last, first + RESIDUES - 1))
    return F.array_distinct(F.transform(spread, lambda b: F.pmod(b, F.lit(RESIDUES))))


def match_hydrogens(targets: DataFrame, heavy: DataFrame) -> DataFrame:
    """Plausible compositions in a target window, with the ppm error.

    A composition of heavy atoms meets only targets from which it differs by whole hydrogens: both
    sides join on the formula and the mass modulo the mass of hydrogen. The hydrogens then follow
    from the window, within the bounds of the formula and of the plausibility rules.
    """
    binned = targets.withColumn("bin", F.explode(residue_bins(F.col("lo"), F.col("hi"))))
    own = F.pmod(F.floor(F.col("mass") / RESIDUE_WIDTH), F.lit(RESIDUES))
    joined = binned.join(heavy.withColumn("bin", own), ["formula", "bin"]).withColumnRenamed("mass", "_heavy")
    fewest = F.greatest(F.floor((F.col("lo") - F.col("_heavy")) / H_MASS), F.lit(0))
    most = F.least(F.ceil((F.col("hi") - F.col("_heavy")) / H_MASS), F.col("max_H"))
    counts = F.when(fewest <= most, F.sequence(fewest.cast("int"), most.cast("int")))
    solved = joined.withColumn("n_H", F.explode(counts)).withColumn("mass", F.col("_heavy") + count_of("H") * F.lit(H_MASS))
    return (
        solved.filter((F.col("mass") >= F.col("lo")) & (F.col("mass") <= F.col("hi")))
        .filter(plausible())
        .withColumn("error_ppm", F.round((F.col("mass") - F.col("target")) / F.col("target") * 1_000_000, 2))
        .drop("bin", "_heavy", "max_H")
    )


def best_annotation(hits: DataFrame, pick: str = "first") -> DataFrame:
    """One formula per (formula, m/z): first in search order, or the closest mass."""
    counts = F.array(*[count_of(s) for s in HEAVIEST_FIRST])
    order = counts if pick == "first" else F.struct(F.abs("error_ppm"), counts)
    found = F.struct(hill_formula().alias("fragment"), F.col("error_ppm"), F.round("mass", 6).alias("fragment_mass"))
    return (
        hits.groupBy("formula", "mz")
        .agg(F.min_by(found, order).alias("_hit"))
        .select("formula", "mz", "_hit.fragment", "_hit.error_ppm", "_hit.fragment_mass")
    )


def annotations(df: DataFrame, params: Params = Params()) -> DataFrame:
    heavy = heavy_compositions(parse_formula(df), largest_targets(df, params))
    return best_annotation(match_hydrogens(peak_targets(df, params), heavy), params.annotation_pick)


def annotate_peaks(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Add ``annotated_peaks``: peaks with fragment formula and ppm error (NULL without a hit).

    Only peaks with a hit travel back to their spectrum.
    """
    hits = annotations(df, params).select(
        F.struct("formula", "mz").alias("_pair"), F.struct("mz", "fragment", "error_ppm").alias("_hit")
    )
    peaks = df.filter(F.col("formula") != "").select(
        "record_id",
        F.explode(
            F.transform(
                F.array_distinct(F.transform("peaks", lambda p: p["mz"])),
                lambda mz: F.struct(F.col("formula").alias("formula"), mz.alias("mz")),
            )
        ).alias("_pair"),
    )
    per_spectrum = (
        lookup_join(peaks, hits, "_pair", spread="record_id")
        .filter(F.col("_hit").isNotNull())
        .groupBy("record_id")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct(F.col("_hit.mz"), F.struct("_hit.fragment", "_hit.error_ppm")))
            ).alias("_hits")
        )
    )

    def annotated(p: Column) -> Column:
        hit = F.try_element_at(F.col("_hits"), p["mz"])
        return F.struct(
            p["mz"].alias("mz"), p["intensity"].alias("intensity"),
            hit["fragment"].alias("formula"), hit["error_ppm"].alias("error_ppm"),
        )

    return df.join(per_spectrum, "record_id", "left").withColumn(
        "annotated_peaks", F.transform("peaks", annotated)
    ).drop("_hits")


def annotated_text(peaks: Column, separator: str = "\n") -> Column:
    """``mz intensity formula/ppm`` lines; peaks without a hit have no third part."""
    return F.array_join(
        F.transform(
            peaks,
            lambda p: F.concat_ws(
                " ",
                F.format_string("%.8f %.8f", p["mz"], p["intensity"]),
                F.when(p["formula"].isNotNull(), F.concat(p["formula"], F.lit("/"), F.format_string("%.2f", p["error_ppm"]))),
            ),
        ),
        separator,
    )
