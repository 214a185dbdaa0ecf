"""Value normalisation expressions (text, regular expressions, conditionals)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.functions.exprs import blank_to_null, group_or_null, matches, to_number

# Patterns and word lists the results depend on.
EMPTY_WORDS = [
    "CCS:", "$:00in-source", "0", "0.0", "na", "n/a", "nan", "unknown", "unknow", "none", "?", "unk", "x",
]
SMILES_LIKE = r"(?i)[^J][a-z0-9@+\-\[\]\(\)\\\/%=#$]{6,}"
INCHI_LIKE = r"(?i)InChI=.*|/[0-9A-Z]*/"
INCHIKEY_LIKE = r"(?i)([A-Z]{14}-[A-Z]{10}-[NO])|([A-Z]{14})"
INCHIKEY_EXACT = r"(?i)^(?:[A-Z]{14}-[A-Z]{10}-[NO]|[A-Z]{14})\z"
IN_SILICO = r"(?i)in.silico|insilico|predicted|theoretical|Annotation.level.3"
PUBLIC_LIBRARY = "MSMS_Public"
IONIZATION_WORDS = ["APCI", "ACPI", "APPI", "EI", "ESI", "FAB", "MALDI"]
ADDUCT_WRAPPING = r"\(|\)|(.*\[)|(\]([\d\+\-\*]*)?)"
ADDUCT_END_SIGN = r"(?<!M)(\-|\+)$"
ADDUCT_LIKE = r"(?i)m\]?(\-|\+)"
MINUTES = ["minutes", "minute", "min", "m"]
SECONDS = ["seconds", "second", "sec", "s"]
MILLISECONDS = ["milliseconds", "millisecond", "ms"]
# Ordered instrument text replacements, plain words first, then patterns.
INSTRUMENT_WORDS = [
    ("q exactive", " qexactive "),
    ("applied biosystems", " sciex "),
    (" ab ", " sciex "),
    ("sciex", " sciex "),
]
INSTRUMENT_PATTERNS = [
    ("triple(-| )?tof", " qqq "),
    ("triple(-| )?quad", " qqq "),
    ("... uplc ...", " "),
]
#: Such a word, alone or followed by a space and more on its line; the Kelvin sign is a k in lower case.
EMPTY_TEXT = r"\A(?:(?i:" + "|".join(re.escape(w.lower()).replace("k", r"[k\u212A]") for w in EMPTY_WORDS) + r")(?: [^\n]*)?)?\z"


def normalize_empty(col: Column) -> Column:
    """NULL for every spelling of "no value": such a word alone or followed by more on its line.

    One pattern: with several calls per column the projection over all columns is too long to be compiled.
    """
    return F.when(~col.rlike(EMPTY_TEXT), col)


def repair_inchi(inchi: Column) -> Column:
    """Exactly one ``InChI=`` prefix on a present value."""
    return F.concat(F.lit("InChI="), F.regexp_replace(blank_to_null(inchi), "(?i)^inchi=", ""))


def descriptor_kinds(col: Column) -> dict[str, Column]:
    """What a structure field looks like."""
    return {"smiles": matches(col, SMILES_LIKE), "inchi": matches(col, INCHI_LIKE), "inchikey": matches(col, INCHIKEY_LIKE)}


def move_descriptors(
    smiles: Column, inchi: Column, inchikey: Column, kinds: dict[str, dict[str, Column]]
) -> dict[str, Column]:
    """Move SMILES / InChI / InChIKey values that sit in the wrong column.

    ``kinds`` maps each column to what its original value looks like. Where several moves write
    one column, the move listed last in the definition wins, so it comes first in the chain.
    """
    s, i, k = kinds["smiles"], kinds["inchi"], kinds["inchikey"]
    tidy = s["smiles"] & i["inchi"] & k["inchikey"]

    def only_smiles(kind: dict[str, Column]) -> Column:
        return kind["smiles"] & ~kind["inchi"] & ~kind["inchikey"]

    none = F.lit(None).cast("string")
    new_smiles = (
        F.when(tidy, smiles)
        .when(s["inchikey"] | s["inchi"], none)
        .when(only_smiles(k), inchikey)
        .when(only_smiles(i), inchi)
        .otherwise(smiles)
    )
    new_inchi = (
        F.when(tidy, inchi)
        .when(i["inchikey"], none)
        .when(k["inchi"], inchikey)
        .when(s["inchi"], smiles)
        .when(only_smiles(i), none)
        .otherwise(inchi)
    )
    new_inchikey = (
        F.when(tidy, inchikey)
        .when(s["inchikey"], smiles)
        .when(i["inchikey"], inchi)
        .when(k["inchi"] | only_smiles(k), none)
        .otherwise(inchikey)
    )
    return {
        "smiles": blank_to_null(new_smiles),
        "inchi": repair_inchi(new_inchi),
        "inchikey": blank_to_null(new_inchikey),
    }


def has_structure(smiles: Column, inchi: Column, inchikey: Column) -> Column:
    return F.coalesce(blank_to_null(smiles), blank_to_null(inchi), blank_to_null(inchikey)).isNotNull()


def normalize_ionization(ionization: Column, instrumenttype: Column) -> Column:
    """Leftmost ionisation keyword of the ionisation, else of the instrument type."""
    words = "(?i)(" + "|".join(IONIZATION_WORDS) + ")"

    def keyword(col: Column) -> Column:
        word = F.upper(group_or_null(col, words))
        return F.when(word == "ACPI", F.lit("APCI")).otherwise(word)

    return F.coalesce(keyword(ionization), keyword(instrumenttype), ionization)


def _instrument_part(col: Column, split_hyphens: bool) -> Column:
    text = F.lower(F.coalesce(col, F.lit("")))
    rules = [("-tof", "tof"), ("q-", "q")]
    rules += [("-", " ")] if split_hyphens else []
    for word, replacement in rules + INSTRUMENT_WORDS:
        text = F.replace(text, F.lit(word), F.lit(replacement))
    for pattern, replacement in INSTRUMENT_PATTERNS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def clean_instrument_text(instrument: Column, instrumenttype: Column, comment: Column) -> Column:
    """One lower-case line of instrument words from three fields."""
    joined = F.concat_ws(
        " ",
        _instrument_part(instrument, split_hyphens=False),
        _instrument_part(instrumenttype, split_hyphens=True),
        _instrument_part(comment, split_hyphens=True),
    )
    words = F.regexp_replace(joined, r"(?U)[^-\w\s]", " ")
    return F.trim(F.regexp_replace(words, r"(?U)\s+", " "))


def strip_adduct(adduct: Column) -> Column:
    """Adduct without brackets, charge suffix and trailing sign."""
    return F.regexp_replace(F.regexp_replace(adduct, ADDUCT_WRAPPING, ""), ADDUCT_END_SIGN, "")


def is_gc_type(instrumenttype: Column) -> Column:
    return matches(instrumenttype, r"\bGC\b")


def normalize_ionmode(ionmode: Column) -> Column:
    return (
        F.when(ionmode.rlike(r"(?i)^(p|\+)"), F.lit("positive"))
        .when(ionmode.rlike(r"(?i)^(n|-)"), F.lit("negative"))
        .otherwise(ionmode)
    )


def flag_predicted(predicted: Column, comment: Column, filename: Column, name: Column) -> Column:
    source = F.concat_ws(" ", F.coalesce(filename, F.lit("")), F.coalesce(name, F.lit("")))
    public = F.coalesce(F.contains(filename, F.lit(PUBLIC_LIBRARY)), F.lit(False))
    said = F.coalesce(predicted, F.lit(""))
    return (said != "false") & (
        matches(comment, IN_SILICO) | (said == "true") | (~public & matches(source, IN_SILICO))
    )


def default_adduct(adduct: Column, predicted: Column, ionmode: Column) -> Column:
    """In-silico spectra without an adduct get the protonated / deprotonated form."""
    missing = predicted & F.coalesce(adduct == "", F.lit(True))
    return (
        F.when(missing & (ionmode == "positive"), F.lit("[M+H]+"))
        .when(missing & (ionmode == "negative"), F.lit("[M-H]-"))
        .otherwise(adduct)
    )


def complete_bare_m(adduct: Column, ionmode: Column) -> Column:
    return (
        F.when((adduct == "M") & (ionmode == "positive"), F.lit("[M]+"))
        .when((adduct == "M") & (ionmode == "negative"), F.lit("[M]-"))
        .otherwise(adduct)
    )


def normalize_ms_level(mslevel: Column) -> Column:
    digits = F.regexp_extract_all(F.coalesce(mslevel, F.lit("")), F.lit(r"(\d)"), 1)
    return F.when(F.size(digits) == 0, F.lit("2")).otherwise(F.array_join(F.slice(digits, 1, 2), "-"))


def normalize_rt(rt: Column) -> Column:
    """Retention time in minutes; a value without a unit is taken as it is."""
    units = "|".join(MILLISECONDS + MINUTES + SECONDS)
    pattern = rf"(?i)(-?\d+[.,]?\d*(?:E[+-]?\d+)?)\W?({units})"
    unit = F.lower(F.regexp_extract(rt, pattern, 2))
    value = to_number(group_or_null(rt, pattern))
    return (
        F.when(unit == "", to_number(F.trim(rt)))
        .when(unit.isin(MILLISECONDS), value / 60000)
        .when(unit.isin(SECONDS), value / 60)
        .otherwise(value)
    )


def strip_smiles_extension(smiles: Column) -> Column:
    """SMILES without the trailing ``|...|`` annotation; InChI text stays as it is."""
    return F.when(F.contains(smiles, F.lit("InChI=")), smiles).otherwise(
        F.regexp_replace(smiles, r"\|[\s\S]*", "")
    )


def valid_inchikey(inchikey: Column) -> Column:
    return matches(inchikey, INCHIKEY_EXACT)
