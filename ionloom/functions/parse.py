"""Record text -> parallel key / value arrays and peak arrays, as column expressions.

A parsed record is ``keys ARRAY<STRING>`` and ``vals ARRAY<STRING>`` in record order; where a
key occurs several times the last one counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.functions.exprs import let
from ionloom.functions.peaks import peak
from ionloom.schema import FIELDS, PEAKS_TYPE

# Record patterns.
_MZ = r"(-?\d+\.?\d*(?:[Ee][+-]?\d+)?)"
_INTENSITY = r"(-?\d+[.,]?\d*(?:[Ee][+-]?\d+)?)"
STRICT_PEAK = rf"^{_MZ}(?:\s+|:){_INTENSITY}"
LOOSE_PEAK = rf"{_MZ}(?:\s+|:|,|, ){_INTENSITY}"
KEY_EDGES = r"(?U)^[\W_]+|[\W_]+$"
#: Keys without such edges, told by a cheaper pattern.
BARE_KEY = r"(?s)\A[A-Za-z0-9](?:.*[A-Za-z0-9])?\z"
VALUE_QUOTES = r'^"|"$'
SUB_FIELD = (
    r'(\S+?)="([^"]*)"|"(\w+?)=([^"]*)"|"([^"]*?)=([^"]*)"|(\S+?)=(\d+(?:[.,]\d*)?)|(\S+?)=(.*?)(?:;|\n|$)'
)
NESTED_KEYS = ["compound", "id", "metaData", "spectrum"]
NESTED_METADATA = [
    "instrument", "instrument type", "ms level", "ionization", "retention time", "ionization mode",
    "precursor type", "collision energy", "precursor m/z",
]
NESTED_STRUCTURE = ["molecular formula", "smiles", "inchi", "inchikey"]
PEAK_KEYS = ["spectrum", "peaks_json", "peaks", "peaks_list", "PEAKS_LIST"]

NESTED_COMPOUND_TYPE = (
    "array<struct<names:array<struct<name:string>>,"
    "metaData:array<struct<name:string,value:string,computed:string>>>>"
)


def _trimmed(s: Column) -> Column:
    """Without outer white space; a line that begins and ends with visible ASCII needs no pattern."""
    bare = (s >= "!") & s.substr(-1, 1).between("!", "~")
    return F.when(bare, s).otherwise(F.regexp_replace(s, r"^\s+|\s+$", ""))


def lines(record: Column) -> Column:
    """Trimmed, non-empty lines."""
    parts = F.when(F.contains(record, F.lit("\r")), F.split(record, r"\r\n|\n|\r")).otherwise(F.split(record, "\n"))
    return F.filter(F.transform(parts, _trimmed), lambda s: s != "")


def _is_peak(s: Column) -> Column:
    """Lines that don't begin with a sign or digit are told without the pattern."""
    return (s >= "-") & (s < ":") & s.rlike(STRICT_PEAK)


def peak_lines(rows: Column) -> Column:
    return F.filter(rows, _is_peak)


def metadata_lines(rows: Column) -> Column:
    return F.filter(rows, lambda s: ~_is_peak(s))


def _peak(text: Column, pattern: str) -> Column:
    return peak(
        F.regexp_extract(text, pattern, 1).try_cast("double"),
        F.replace(F.regexp_extract(text, pattern, 2), F.lit(","), F.lit(".")).try_cast("double"),
    )


def parse_peaks_strict(rows: Column) -> Column:
    """Number pairs at line start; the rest of the line (annotation) is ignored."""
    return F.transform(rows, lambda s: _peak(s, STRICT_PEAK)).cast(PEAKS_TYPE)


def parse_peaks_loose(text: Column) -> Column:
    """Every number pair of a text: ``[[a,b],…]``, ``a b`` lines, ``a:b a:b`` and ``a b;a b``."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(LOOSE_PEAK), 0), lambda s: _peak(s, LOOSE_PEAK)
    ).cast(PEAKS_TYPE)


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def bare_key(key: Column) -> Column:
    return F.when(key.rlike(BARE_KEY), key).otherwise(F.regexp_replace(key, KEY_EDGES, ""))


def _unquoted(value: Column) -> Column:
    return F.when(F.contains(value, F.lit('"')), F.regexp_replace(value, VALUE_QUOTES, "")).otherwise(value)


def clean_entries(entries: Column) -> Column:
    """Field names without outer punctuation, lower case; values without outer quotes."""
    return F.transform(entries, lambda e: _entry(F.trim(F.lower(bare_key(e["key"]))), _unquoted(e["value"])))


def msp_entries(rows: Column) -> Column:
    """``key: value`` lines; a line without ``:`` is noise."""
    return F.transform(
        F.filter(rows, lambda s: F.contains(s, F.lit(":"))),
        lambda s: _entry(
            F.substring_index(s, ":", 1), F.regexp_extract(s, r"^[^:]*: ?(.*)$", 1)
        ),
    )


def mgf_entries(rows: Column) -> Column:
    """``key=value`` lines."""
    pattern = r"([^:=]*)=\s*(.*)$"
    return F.transform(
        F.filter(rows, lambda s: F.contains(s, F.lit("="))),
        lambda s: _entry(F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2)),
    )


def comment_subfields(comment: Column) -> Column:
    """``k=v`` pairs hidden in a comment, one pass of the five-layout pattern.

    Each hit is rewritten to ``<STX>key<ETX>value<EOT>`` and split again, so the tokens are
    consumed exactly as by a single left-to-right scan.
    """
    marked = F.regexp_replace(comment, SUB_FIELD, "\u0002$1$3$5$7$9\u0003$2$4$6$8$10\u0004")
    hits = F.filter(F.split(marked, "\u0004"), lambda s: F.contains(s, F.lit("\u0002")))
    pairs = F.transform(
        hits,
        lambda s: _entry(
            F.substring_index(F.substring_index(s, "\u0002", -1), "\u0003", 1), F.substring_index(s, "\u0003", -1)
        ),
    )
    return F.filter(pairs, lambda e: (e["key"] != "") & (e["value"] != ""))


def _is_minable(entry: Column) -> Column:
    return F.contains(entry["value"], F.lit("=")) & F.contains(F.lower(entry["key"]), F.lit("comment"))


def mine_comments(entries: Column) -> Column:
    """Put comment sub-fields behind their comment and drop ``computed`` fields.

    A comment with ``=`` in which no layout fits leaves the record as it was.
    """
    unreadable = F.exists(entries, lambda e: _is_minable(e) & ~e["value"].rlike(SUB_FIELD))
    mined = F.flatten(
        F.transform(
            entries,
            lambda e: F.when(_is_minable(e), F.concat(F.array(e), comment_subfields(e["value"]))).otherwise(
                F.array(e)
            ),
        )
    )
    mined = F.when(F.exists(entries, _is_minable), mined).otherwise(entries)
    kept = F.filter(mined, lambda e: ~F.contains(F.lower(e["key"]), F.lit("computed")))
    return F.when(unreadable, entries).otherwise(kept)


def entry_keys(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["key"])


def entry_values(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["value"])


def nested_entries(raw: Column) -> Column:
    """Entries of a nested JSON record given as ``MAP<STRING, STRING>`` of its top-level values."""
    compound = F.get(F.from_json(F.try_element_at(raw, F.lit("compound")), NESTED_COMPOUND_TYPE), F.lit(0))
    metadata = F.from_json(F.try_element_at(raw, F.lit("metaData")), "array<struct<name:string,value:string>>")
    tags = F.from_json(F.try_element_at(raw, F.lit("tags")), "array<struct<text:string>>")
    none = F.array().cast("array<struct<key:string,value:string>>")

    def structures(c: Column) -> Column:
        measured = F.filter(
            c["metaData"],
            lambda m: F.lower(m["name"]).isin(NESTED_STRUCTURE) & (F.coalesce(m["computed"], F.lit("false")) == "false"),
        )
        return F.concat(
            F.array(_entry(F.lit("compound_name"), F.coalesce(F.get(c["names"], F.lit(0))["name"], F.lit("")))),
            F.coalesce(F.transform(measured, lambda m: _entry(F.lower(m["name"]), m["value"])), none),
        )

    wanted = F.filter(metadata, lambda m: m["name"].isin(NESTED_METADATA))
    in_silico = F.coalesce(F.exists(tags, lambda t: t["text"] == "In-Silico"), F.lit(False))
    return F.concat(
        F.coalesce(let(compound, structures), none),
        F.array(_entry(F.lit("spectrum_id"), F.try_element_at(raw, F.lit("id")))),
        F.coalesce(F.transform(wanted, lambda m: _entry(F.lower(m["name"]), m["value"])), none),
        F.array(_entry(F.lit("predicted"), F.when(in_silico, F.lit("true")).otherwise(F.lit("false")))),
    )


def is_nested(raw: Column) -> Column:
    test = F.lit(True)
    for key in NESTED_KEYS:
        test = test & F.map_contains_key(raw, key)
    return test


def flat_entries(raw: Column) -> Column:
    return F.transform(F.map_entries(raw), lambda e: _entry(F.lower(e["key"]), e["value"]))


def json_peak_text(raw: Column) -> Column:
    """Text of the first peak field that is present."""
    return F.coalesce(*[F.try_element_at(raw, F.lit(k)) for k in PEAK_KEYS])


def canonical_key(key: Column, synonyms: dict[str, list[str]]) -> Column:
    """Canonical column of a field name; NULL when the field is not kept.

    The name is searched among those of its length only: a search goes through its whole list.
    """
    columns: dict[str, str] = {}
    for column, names in synonyms.items():
        for name in names:
            columns.setdefault(name, column)
    by_length: list[list[str]] = [[] for _ in range(max(map(len, columns), default=0) + 1)]
    for name in columns:
        by_length[len(name)].append(name)
    # A list of its own for every length; where there is no name, one that no key of the length can be.
    names = [own or ["x" * (n + 1)] for n, own in enumerate(by_length)]

    def found(k: Column) -> Column:
        at = F.array_position(F.get(F.lit(names), F.length(k)), k).cast("int")
        return F.get(F.get(F.lit([[columns.get(name, "") for name in own] for own in names]), F.length(k)), at - 1)

    return let(key, found)


#: Canonical columns in the order of `canonical_values`.
VALUE_COLUMNS = [c for c in FIELDS.values() if c != "peaks"]


def canonical_values(keys: Column, vals: Column) -> Column:
    """Last value of every canonical column, as an array; ``keys`` must be canonical names (NULL = drop).

    Put it in a column of its own: a search per output column makes a projection that is too long to be compiled.
    """

    def found(newest: Column) -> Column:
        return F.transform(
            F.lit(VALUE_COLUMNS), lambda c: F.get(newest["v"], F.array_position(newest["k"], c).cast("int") - 1)
        )

    return let(F.struct(F.reverse(keys).alias("k"), F.reverse(vals).alias("v")), found)


def canonical_fields(values: Column) -> dict[str, Column]:
    """The columns of an array of `canonical_values`."""
    return {column: F.get(values, F.lit(i)) for i, column in enumerate(VALUE_COLUMNS)}
