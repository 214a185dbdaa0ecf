"""Queries that write the tables as library files and read them back, sinks and streaming."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import parse as ps
from ionloom.functions.exprs import first_number
from ionloom.functions.peaks import pair_text, to_text
from ionloom.operators import classify as cl
from ionloom.operators.dedup import with_splash
from ionloom.operators.instruments import normalize_instruments
from ionloom.operators.normalize import normalize_adduct, with_adduct_facts
from ionloom.plans import fixture as fx
from ionloom.plans import oracle as orc
from ionloom.plans.pipeline import Lookups
from ionloom.schema import Params
from ionloom.session import new_path, stage
from ionloom.sinks import formats as fm
from ionloom.sinks import writers as wr
from ionloom.sources import lookups as lk
from ionloom.sources import readers as rd
from ionloom.streaming.incremental import first_copies, library_stream, start_curation
from ionloom.streaming.richest import CHANGES, current_richest, ranked, richest_changes

QUERIES = {}
ORACLES = {}
RAW = orc.raw()
HAS_PEAKS = "len(peaks) > 0"

# Field spellings used in the rendered files; they differ from the canonical names on purpose.
SPELLING = {
    "spectrumid": "DB#",
    "name": "Name",
    "precursormz": "PrecursorMZ",
    "precursortype": "Precursor_type",
    "ionmode": "Ion_mode",
    "instrumenttype": "Instrument_type",
    "inchikey": "InChIKey",
    "smiles": "SMILES",
    "formula": "Formula",
    "rt": "RETENTIONTIME",
    "mslevel": "MS_level",
}
COLUMNS = list(SPELLING)
#: For libraries that would fill a disk as plain text; a part file is read by one task then.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
_PARSED = f"SELECT record_id, {', '.join(COLUMNS)}, {orc.peak_text()} AS peaks_text FROM raw WHERE {HAS_PEAKS}"


def _add(name: str, fn, ctes: list[str], final: str) -> None:
    QUERIES[name] = fn
    ORACLES[name] = orc.query(ctes, final)


def _raw(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return fx.spectra_raw(spark, sf_dir, [*COLUMNS, *extra])


def _pairs(separator: str) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}{separator}"), F.col(c)) for c, k in SPELLING.items()])


def _write_msp(spark: SparkSession, sf_dir: str, extra: Column | None = None, **options: str) -> str:
    """Every spectrum as an MSP record; odd ones use ``mz:intensity`` and peak comments."""
    path = new_path(spark, "msp") + "/library.msp"
    peaks = F.transform(
        "peaks",
        lambda p: F.when(
            F.col("record_id") % 2 == 1, F.concat(pair_text(p, ":"), F.lit(' "C2H3 0.5ppm"'))
        ).otherwise(pair_text(p)),
    )
    lines = [_pairs(": ")] + ([extra] if extra is not None else [])
    record = F.concat_ws("\n", *lines, F.concat(F.lit("Num Peaks: "), F.size("peaks")), F.array_join(peaks, "\n"))
    _raw(spark, sf_dir, ("comment",)).select(record.alias("value")).write.options(lineSep="\n\n", **options).text(path)
    return path


def _write_mgf(spark: SparkSession, sf_dir: str, **options: str) -> str:
    path = new_path(spark, "mgf") + "/library.mgf"
    body = F.concat_ws("\n", F.lit("BEGIN IONS"), _pairs("="), to_text(F.col("peaks")), F.lit("END IONS"))
    _raw(spark, sf_dir).select(body.alias("value")).write.options(**options).text(path)
    return path


def _json_object() -> Column:
    return F.to_json(
        F.struct(*[F.col(c).alias(k) for c, k in SPELLING.items()],
                 F.transform("peaks", lambda p: F.array(p["mz"], p["intensity"])).alias("peaks"))
    )


def _write_jsonl(spark: SparkSession, sf_dir: str, **options: str) -> str:
    path = new_path(spark, "jsonl") + "/library.json"
    _raw(spark, sf_dir).select(_json_object().alias("value")).write.options(**options).text(path)
    return path


def _write_json_array(spark: SparkSession, sf_dir: str) -> str:
    """JSON array files of at most 500 consecutive orders each."""
    path = new_path(spark, "jsonarray") + "/library.json"
    rows = _raw(spark, sf_dir).select(F.floor(F.col("record_id") / 500).alias("part"), _json_object().alias("o"))
    arrays = rows.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("o"), ",\n"), F.lit("]")).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return path


def _write_csv(spark: SparkSession, sf_dir: str, separator: str = ";", **options: str) -> str:
    path = new_path(spark, "csv") + "/library.csv"
    columns = [F.col(c).alias(k) for c, k in SPELLING.items()]
    _raw(spark, sf_dir).select(*columns, to_text(F.col("peaks"), "\n").alias("peaks")).write.option("sep", separator).option(
        "header", True
    ).option("quote", '"').option("escape", '"').option("emptyValue", "").options(**options).csv(path)
    return path


def _parsed(df: DataFrame) -> DataFrame:
    """Columns to compare; rejected records are left out and missing text reads ''."""
    ids = F.substr(F.col("spectrumid"), F.lit(3)).cast("bigint")
    kept = df.filter(F.col("deletion_reason").isNull())
    return kept.select(
        ids.alias("record_id"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in COLUMNS],
        to_text(F.col("peaks"), ";").alias("peaks_text"),
    )


def read_msp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(rd.read_msp(spark, _write_msp(spark, sf_dir)))


def read_mgf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(rd.read_mgf(spark, _write_mgf(spark, sf_dir)))


def read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(rd.read_json(spark, _write_jsonl(spark, sf_dir)))


def read_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(rd.read_json(spark, _write_json_array(spark, sf_dir)))


def read_csv_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(rd.read_csv(spark, [_write_csv(spark, sf_dir)]))


_add("read_msp", read_msp, RAW, _PARSED)
_add("read_mgf", read_mgf, RAW, _PARSED)
_ALL = _PARSED.replace(f" WHERE {HAS_PEAKS}", "")
for _name, _fn in (("read_jsonl", read_jsonl), ("read_json_array", read_json_array), ("read_csv_spectra", read_csv_spectra)):
    _add(_name, _fn, RAW, _ALL)


def ingest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spectra in four formats, routed by suffix: rows per spectrum id."""
    paths = [write(spark, sf_dir, **PACKED) for write in (_write_msp, _write_mgf, _write_jsonl, _write_csv)]
    rows = rd.ingest(spark, paths).filter("deletion_reason is null")
    return rows.groupBy(F.col("spectrumid")).agg(F.count(F.lit(1)).alias("copies"), F.sum(F.size("peaks")).alias("peaks"))


_add("ingest_all", ingest_all, RAW,
     "SELECT spectrumid, CASE WHEN len(peaks) > 0 THEN 4 ELSE 2 END::BIGINT AS copies, (4 * len(peaks))::BIGINT AS peaks FROM raw")


def detect_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra in the files of a ``;`` and of a tab library, by the separator that is found for their file."""
    paths = [_write_csv(spark, sf_dir, ";"), _write_csv(spark, sf_dir, "\t")]
    found = rd.detect_separators(spark, paths)
    read = rd.read_csv(spark, paths).select("filename", F.size("peaks").alias("n")).join(found, "filename")
    mark = F.when(F.col("separator") == "\t", "tab").otherwise("semicolon")
    return read.groupBy(mark.alias("separator")).agg(F.count(F.lit(1)).alias("spectra"), F.sum("n").alias("peaks"))


def file_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen files of records whose sizes are known: the hash of each (SHA-256 of its decimal size)."""
    path = new_path(spark, "sized") + "/library.msp"
    record = F.concat(F.lit("Name: part"), F.col("part"), F.lit("\nPrecursorMZ: "), F.col("record_id"), F.lit("\nNum Peaks: 1\n100 1"))
    rows = fx.headers(spark, sf_dir, []).withColumn("part", (F.col("record_id") % 16).cast("string"))
    rows.repartition("part").select("part", record.alias("value")).write.partitionBy("part").option("lineSep", "\n\n").text(path)
    records = rd.read_msp(spark, path)
    return records.groupBy("name").agg(F.max("filehash").alias("filehash"), F.count(F.lit(1)).alias("records"))


_add("detect_separator", detect_separator, RAW,
     "SELECT unnest(['tab', 'semicolon']) AS separator, count(*) AS spectra, sum(len(peaks))::BIGINT AS peaks FROM raw")
QUERIES["file_provenance"] = file_provenance
ORACLES["file_provenance"] = (
    "SELECT name, sha256(sum(length(name) + length(id) + 41)::BIGINT::VARCHAR) AS filehash, count(*) AS records "
    "FROM (SELECT concat('part', o_orderkey % 16) AS name, o_orderkey::VARCHAR AS id FROM orders) GROUP BY name"
)

#: Every so many spectra one record can't be read.
ODD = "record_id % 50 = 7"


def _array_texts(spark: SparkSession, sf_dir: str, joint: str, pretty: bool) -> DataFrame:
    """``part, value``: arrays of at most 500 consecutive spectra, some of whose objects are malformed."""
    fields = [F.col(c).alias(k) for c, k in SPELLING.items()]
    whole = F.struct(*fields, F.transform("peaks", lambda p: F.array(p["mz"], p["intensity"])).alias("peaks"))
    text = F.to_json(whole, {"pretty": "true"}) if pretty else F.to_json(whole)
    own = F.when(F.expr(ODD), F.lit('{"DB#": oops}')).otherwise(text)
    rows = _raw(spark, sf_dir).select(F.floor(F.col("record_id") / 500).alias("part"), F.struct("record_id", own.alias("o")).alias("r"))
    parts = rows.groupBy("part").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    objects = F.array_join(F.transform("rs", lambda r: r["o"]), joint)
    return parts.select("part", F.concat(F.lit("["), objects, F.lit("]")).alias("value"))


def read_json_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spectra as arrays with an object a line, on one line, in a free layout, and cut off before their end."""
    base = new_path(spark, "layouts")
    texts = {
        "lines": _array_texts(spark, sf_dir, ",\n", False), "compact": _array_texts(spark, sf_dir, ",", False),
        "free": _array_texts(spark, sf_dir, "\n ,\t", True),
    }
    texts["cut"] = texts["compact"].withColumn("value", F.substr("value", F.lit(1), F.length("value") - 2))
    out = None
    for layout, df in texts.items():
        df.write.partitionBy("part").option("lineSep", "\n").text(f"{base}/{layout}.json")
        ids = F.substr(F.col("spectrumid"), F.lit(3)).cast("bigint")
        kept = F.col("deletion_reason").isNull()
        rows = rd.read_json(spark, f"{base}/{layout}.json").agg(
            F.lit(layout).alias("layout"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("rejected"),
            F.sum(F.when(kept, ids)).alias("ids"), F.sum(F.when(kept, F.size("peaks"))).alias("peaks"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


_add("read_json_layouts", read_json_layouts, RAW,
     "SELECT layout, count(*) FILTER (NOT odd) AS kept, count(*) FILTER (odd) AS rejected, sum(record_id) FILTER (NOT odd)::BIGINT AS ids, "
     "sum(len(peaks)) FILTER (NOT odd)::BIGINT AS peaks FROM (SELECT *, record_id % 50 = 7 OR layout = 'cut' AND record_id = max(record_id) "
     "OVER (PARTITION BY layout, record_id // 500) AS odd FROM raw, (VALUES ('lines'), ('compact'), ('free'), ('cut')) l(layout)) GROUP BY layout")


def read_msp_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records parted by lines with blanks, by lines of mixed ends, and by several of them."""
    body = F.concat_ws("\n", _pairs(": "), F.concat(F.lit("Num Peaks: "), F.size("peaks")), to_text(F.col("peaks"), "\n"))
    base = new_path(spark, "separators")
    marks = {"blanks": "\n \t \n", "mixed": "\n\r\n", "several": "\n\n  \n\r\n"}
    out = None
    for layout, mark in marks.items():
        _raw(spark, sf_dir).select(body.alias("value")).write.options(lineSep=mark, **PACKED).text(f"{base}/{layout}.msp")
        rows = _parsed(rd.read_msp(spark, f"{base}/{layout}.msp")).select(F.lit(layout).alias("layout"), "record_id", "name", "peaks_text")
        out = rows if out is None else out.unionByName(rows)
    return out


_add("read_msp_separators", read_msp_separators, RAW,
     f"SELECT layout, record_id, name, {orc.peak_text()} AS peaks_text FROM raw, (VALUES ('blanks'), ('mixed'), ('several')) l(layout) WHERE {HAS_PEAKS}")


def lookup_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound and ontology parts written as ``;`` files, read and joined."""
    out = new_path(spark, "lookups")
    options = {"sep": ";", "header": True, "quote": '"', "escape": '"'}
    fx.compounds(spark, sf_dir).write.options(**options).csv(f"{out}/compounds")
    fx.ontologies(spark, sf_dir).write.options(**options).csv(f"{out}/ontologies")
    compounds = lk.read_compounds(spark, f"{out}/compounds")
    return compounds.join(lk.read_ontologies(spark, f"{out}/ontologies"), "inchikey", "left").select(
        "inchikey", "formula", "name", F.round("exactmass", 6).alias("exactmass"), "classyfire_superclass", "npclass_superclass"
    )


_add("lookup_readers", lookup_readers, [orc.compounds(), orc.ontologies()],
     "SELECT c.inchikey, formula, name, round(exactmass, 6) AS exactmass, classyfire_superclass, npclass_superclass "
     "FROM compounds c LEFT JOIN ontologies o ON o.inchikey = c.inchikey")


def _write_lines(spark: SparkSession, name: str, lines: list[str]) -> str:
    path = new_path(spark, name)
    spark.createDataFrame([("\n".join(lines),)], "value string").write.text(path)
    return path


def read_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON Lines under field names of a user's own, read with the synonym file that names them."""
    path = new_path(spark, "own-names") + "/library.json"
    fields = [F.col(c).alias(f"own {c} !") for c in COLUMNS]
    peaks = F.transform("peaks", lambda p: F.array(p["mz"], p["intensity"])).alias("peaks")
    _raw(spark, sf_dir).select(F.to_json(F.struct(*fields, peaks)).alias("value")).write.text(path)
    lines = ["known_synonym;canonical", *(f"own {c} !;{c.upper()}" for c in COLUMNS), "own name !;nonsense", "own name !;NAME", "x;no_column"]
    return _parsed(rd.read_json(spark, path, lk.read_synonyms(spark, _write_lines(spark, "synonyms", lines))))


_add("read_synonyms", read_synonyms, RAW, _ALL)


def read_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments assigned by a rule tree that was written as JSON and read back."""
    tree: dict = {}
    for rule in lk.DEFAULT_INSTRUMENTS:
        node = tree
        for key in rule[:6]:
            node = node.setdefault(key, {})
        node["SOLUTION"] = rule.solution
    rules = lk.read_instruments(spark, _write_lines(spark, "instruments", json.dumps(tree, indent=1).split("\n")))
    df = fx.headers(spark, sf_dir, ["instrument", "instrumenttype", "comment", "resolution", "ionization"])
    return normalize_instruments(df, rules).select("record_id", "instrument", "instrumenttype", "resolution", "ionization")


_add("read_instruments", read_instruments, [*RAW, *orc.instruments("raw")],
     "SELECT record_id, instrument, instrumenttype, resolution, ionization FROM ins")


def read_adducts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adducts normalised, with their mass shift, by an adduct table that was written as a file, twice over, and read back."""
    path = new_path(spark, "adducts")
    for mode in ("overwrite", "append"):
        lk.adduct_table(spark).write.mode(mode).options(sep=";", header=True).csv(path)
    adducts = lk.read_adducts(spark, path)
    df = normalize_adduct(fx.headers(spark, sf_dir, ["precursortype", "instrumenttype"]), adducts)
    return with_adduct_facts(df, adducts).select("record_id", "precursortype", F.round("massdiff", 6).alias("massdiff"))


_add("read_adducts", read_adducts, [*RAW, *orc.adduct("raw"), orc.facts()],
     "SELECT record_id, precursortype, round(massdiff, 6) AS massdiff FROM adu LEFT JOIN facts ON canonical = precursortype")


def ingest_split_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV and JSON libraries routed together, the CSV files split by lines as no field has a line break."""
    path = new_path(spark, "flat") + "/library.csv"
    columns = [F.col(c).alias(k) for c, k in SPELLING.items()]
    table = _raw(spark, sf_dir).select(*columns, to_text(F.col("peaks"), " ").alias("peaks"))
    table.write.options(sep=";", header=True, quote='"', escape='"', emptyValue="").csv(path)
    rows = rd.ingest(spark, [path, _write_jsonl(spark, sf_dir)], multiline=False)
    return rows.groupBy("spectrumid").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("name", "inchikey").alias("kinds"))


_add("ingest_split_csv", ingest_split_csv, RAW, "SELECT spectrumid, 2::BIGINT AS copies, 1::BIGINT AS kinds FROM raw")


# --- record parsing steps -------------------------------------------------------------------


def _text_record(separator: str) -> Column:
    return F.concat_ws("\n", F.lit("odd line"), _pairs(separator), F.lit(""), to_text(F.col("peaks"), "\n"))


def _split(spark: SparkSession, sf_dir: str, separator: str = ": ") -> DataFrame:
    df = _raw(spark, sf_dir, ("comment",)).withColumn("value", _text_record(separator))
    return rd.split_record(df)


def split_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select(
        "record_id", F.size("metadata_rows").alias("metadata_lines"), F.size("peak_rows").alias("peak_lines")
    )


_add("split_record", split_record, RAW,
     f"SELECT record_id, {len(COLUMNS) + 1} AS metadata_lines, len(peaks)::INT AS peak_lines FROM raw")


def _entry_rows(df: DataFrame, entries: Column) -> DataFrame:
    return df.select("record_id", F.explode(ps.clean_entries(entries)).alias("e")).select("record_id", "e.key", "e.value")


def parse_msp_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entry_rows(_split(spark, sf_dir), ps.msp_entries(F.col("metadata_rows")))


def parse_mgf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entry_rows(_split(spark, sf_dir, "="), ps.mgf_entries(F.col("metadata_rows")))


_KEYS = {c: k.lower().strip("#") for c, k in SPELLING.items()}
_ENTRIES = " UNION ALL ".join(f"SELECT record_id, '{k}' AS key, {c} AS value FROM raw" for c, k in _KEYS.items())
_add("parse_msp_metadata", parse_msp_metadata, RAW, _ENTRIES)
_add("parse_mgf_metadata", parse_mgf_metadata, RAW, _ENTRIES)


def _commented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a comment that hides one pair in each of the five layouts."""
    comment = F.concat(
        F.lit('"author='), F.col("name"), F.lit('" rating="'), F.col("formula"), F.lit('" "computed mass='),
        F.col("mslevel"), F.lit('1" ev='), F.col("record_id"), F.lit(" ion="), F.col("ionmode"), F.lit("; tail"),
    )
    df = _raw(spark, sf_dir)
    entries = F.array(
        F.struct(F.lit("Name").alias("key"), F.col("name").alias("value")),
        F.struct(F.lit("Comments").alias("key"), comment.alias("value")),
        F.struct(F.lit("Computed SMILES").alias("key"), F.col("smiles").alias("value")),
    )
    return df.select("record_id", entries.alias("entries"))


def comment_subfields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _commented(spark, sf_dir)
    pairs = ps.comment_subfields(F.get("entries", F.lit(1))["value"])
    return df.select("record_id", F.explode(pairs).alias("e")).select("record_id", "e.key", "e.value")


def drop_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _commented(spark, sf_dir)
    return df.select("record_id", F.explode(ps.mine_comments(F.col("entries"))).alias("e")).select("record_id", "e.key")


_SUB = {
    "author": "name", "rating": "formula", "computed mass": "mslevel || '1'", "ev": "record_id::VARCHAR", "ion": "ionmode",
}
_add("comment_subfields", comment_subfields, RAW,
     " UNION ALL ".join(f"SELECT record_id, '{k}' AS key, {v} AS value FROM raw" for k, v in _SUB.items()))
_add("drop_computed", drop_computed, RAW,
     "SELECT record_id, unnest(['Name', 'Comments', 'author', 'rating', 'ev', 'ion']) AS key FROM raw")


def parse_peaks_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark, sf_dir)
    return rows.select("record_id", to_text(ps.parse_peaks_strict(F.col("peak_rows")), ";").alias("peaks_text"))


def parse_peaks_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three text layouts, chosen by record."""
    df = fx.spectra_raw(spark, sf_dir, [])

    def layout(pair: str, separator: str) -> Column:
        return F.array_join(F.transform("peaks", lambda p: F.format_string(pair, p["mz"], p["intensity"])), separator)

    text = (
        F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("["), layout("[%.8f, %.8f]", ", "), F.lit("]")))
        .when(F.col("record_id") % 3 == 1, layout("%.8f %.8f", "\n"))
        .otherwise(layout("%.8f:%.8f", " "))
    )
    return df.select("record_id", to_text(ps.parse_peaks_loose(text), ";").alias("peaks_text"))


_TEXT = f"SELECT record_id, {orc.peak_text()} AS peaks_text FROM raw"
_add("parse_peaks_strict", parse_peaks_strict, RAW, _TEXT)
_add("parse_peaks_loose", parse_peaks_loose, RAW, _TEXT)


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON records as raw maps, some flat ones and some without peaks."""
    df = fx.spectra_raw(spark, sf_dir, ["name", "inchikey", "formula", "instrument", "precursormz", "spectrumid"])

    def meta(name: str, value: Column, computed: bool | None = None) -> Column:
        parts = [F.lit(name).alias("name"), value.alias("value")]
        return F.struct(*parts, *([F.lit(computed).alias("computed")] if computed is not None else []))

    compound = F.array(
        F.struct(
            F.array(F.struct(F.col("name").alias("name"))).alias("names"),
            F.array(
                meta("InChIKey", F.col("inchikey"), False),
                meta("molecular formula", F.col("formula"), False),
                meta("SMILES", F.lit("computed one"), True),
            ).alias("metaData"),
        )
    )
    text = F.array_join(F.transform("peaks", lambda p: F.format_string("%.8f:%.8f", p["mz"], p["intensity"])), " ")
    nested = F.to_json(
        F.struct(
            compound.alias("compound"),
            F.col("spectrumid").alias("id"),
            F.array(
                meta("instrument", F.col("instrument")), meta("precursor m/z", F.col("precursormz")), meta("author", F.lit("nobody"))
            ).alias("metaData"),
            text.alias("spectrum"),
            F.when(F.col("record_id") % 4 == 0, F.array(F.struct(F.lit("In-Silico").alias("text")))).alias("tags"),
        )
    )
    flat = F.to_json(F.struct(F.col("spectrumid").alias("DB#"), F.col("name").alias("NAME"), text.alias("peaks_json")))
    bare = F.to_json(F.struct(F.col("spectrumid").alias("DB#"), F.col("name").alias("NAME")))
    value = F.when(F.col("record_id") % 5 == 0, flat).when(F.col("record_id") % 7 == 0, bare).otherwise(nested)
    return df.select(
        "record_id", F.from_json(value, rd.RAW_MAP).alias("raw"), F.lit("a.json").alias("filename"), F.lit("hash").alias("filehash")
    )


def flatten_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nested(spark, sf_dir).filter("record_id % 5 <> 0 and record_id % 7 <> 0")
    return df.select("record_id", F.explode(ps.nested_entries(F.col("raw"))).alias("e")).select(
        "record_id", "e.key", F.coalesce("e.value", F.lit("")).alias("value")
    )


def dispatch_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rd.parse_json(_nested(spark, sf_dir))
    return out.select(
        "spectrumid", "name", F.coalesce("predicted", F.lit("")).alias("predicted"), "deletion_reason",
        F.coalesce(F.size("peaks"), F.lit(-1)).alias("n"),
    )


_NEST = {
    "compound_name": "name", "inchikey": "inchikey", "molecular formula": "formula", "spectrum_id": "spectrumid",
    "instrument": "instrument", "precursor m/z": "precursormz",
    "predicted": "CASE WHEN record_id % 4 = 0 THEN 'true' ELSE 'false' END",
}
_add("flatten_nested_json", flatten_nested_json, RAW,
     " UNION ALL ".join(f"SELECT record_id, '{k}' AS key, {v} AS value FROM raw WHERE record_id % 5 <> 0 AND record_id % 7 <> 0"
                        for k, v in _NEST.items()))
_add("dispatch_json", dispatch_json, RAW,
     "SELECT spectrumid, name, CASE WHEN record_id % 5 = 0 OR record_id % 7 = 0 THEN '' WHEN record_id % 4 = 0 THEN 'true' ELSE 'false' END "
     "AS predicted, CASE WHEN record_id % 5 <> 0 AND record_id % 7 = 0 THEN 'unparsable' END AS deletion_reason, "
     "CASE WHEN record_id % 5 <> 0 AND record_id % 7 = 0 THEN -1 ELSE len(peaks) END::INT AS n FROM raw")


def canonicalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms to canonical columns; unknown fields vanish and the last synonym wins."""
    df = _raw(spark, sf_dir)
    names = F.array(*[F.lit(x) for x in ("compound_name", "Name", "pepmass", "unknown_field", "polarity", "RTINSECONDS")])
    vals = F.array(*[F.col(c) for c in ("smiles", "name", "precursormz", "formula", "ionmode", "rt")])
    keys = F.transform(names, lambda k: ps.canonical_key(F.lower(k), lk.default_synonyms()))
    fields = ps.canonical_fields(F.col("_f"))
    rows = df.select("record_id", keys.alias("_k"), vals.alias("_v"))
    return rows.select("record_id", ps.canonical_values(F.col("_k"), F.col("_v")).alias("_f")).select(
        "record_id", *[fields[c].alias(c) for c in ("name", "precursormz", "ionmode", "rt", "formula")]
    )


_add("canonicalize_keys", canonicalize_keys, RAW,
     "SELECT record_id, name, precursormz, ionmode, rt, NULL::VARCHAR AS formula FROM raw")


def reject_unparsable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rd.read_msp(spark, _write_msp(spark, sf_dir))
    return rows.filter("deletion_reason is not null").select("spectrumid", "deletion_reason")


_add("reject_unparsable", reject_unparsable, RAW,
     "SELECT spectrumid, 'unparsable' AS deletion_reason FROM raw WHERE len(peaks) = 0")


# --- sinks ----------------------------------------------------------------------------------


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw spectra with the classes of their untouched fields, numbers typed."""
    df = fx.spectra_raw(spark, sf_dir).drop("source")
    typed = df.withColumns(
        {
            "precursormz": first_number(F.col("precursormz")),
            "num_peaks": F.size("peaks"),
            "predicted": F.col("predicted") == "true",
            "ionmode": F.when(F.col("record_id") % 2 == 0, F.lit("positive")).otherwise(F.lit("negative")),
        }
    )
    return cl.classify(typed)


_TYPED = [
    *RAW,
    "typ AS (SELECT * REPLACE ("
    f"{orc.first_number('precursormz')} AS precursormz, predicted = 'true' AS predicted, "
    "CASE WHEN record_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS ionmode), len(peaks)::INT AS num_peaks FROM raw)",
    orc.classes("typ"),
]


def _sql_shown(field: str) -> str:
    name = fm.FIELDS[field]
    if name == "precursormz":
        return f"coalesce({orc.number_text(name)}, 'NOT FOUND')"
    if name in ("predicted", "num_peaks"):
        return f"{name}::VARCHAR"
    return f"coalesce(nullif({name}, ''), 'NOT FOUND')" if name in orc.TEXTS else "'NOT FOUND'"


def _sql_msp() -> str:
    lines = [f"'{f}: ' || {_sql_shown(f)}" for f in fm.MSP_FIELDS]
    pairs = [f"'{f}=' || {_sql_shown(f)}" for f in fm.COMMENT_FIELDS]
    classes = [f"'{f}{'=' if i == 0 else ' = '}' || {_sql_shown(f)}" for i, f in enumerate(fm.ONTOLOGY_FIELDS)]
    block = "'ONTOLOGIES = \"' || concat_ws(', ', " + ", ".join(classes) + ") || '\"'"
    lines.append("'COMMENT: ' || concat_ws('; ', " + ", ".join([*pairs, block]) + ")")
    lines.append(f"'NUM PEAKS: ' || {_sql_shown('NUM PEAKS')}")
    return "concat_ws(chr(10), " + ", ".join(lines) + ", " + orc.peak_text(sep="\n") + ")"


def format_msp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _classed(spark, sf_dir)
    record = fm.msp_record(df)
    return df.select("record_id", F.length(record).cast("bigint").alias("n"), F.md5(record).alias("digest"))


def format_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _classed(spark, sf_dir)
    row = fm.csv_row(df)
    return df.select("record_id", F.length(row).cast("bigint").alias("n"), F.md5(row).alias("digest"))


def _sql_csv() -> str:
    cells = [orc.peak_text() if c == "peaks" else _sql_shown(f) for f, c in fm.FIELDS.items()]
    return "concat_ws(chr(9), " + ", ".join(cells) + ")"


def format_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _classed(spark, sf_dir)
    row = df.select("record_id", fm.json_row(df).alias("j"))
    fields = F.json_tuple("j", "NAME", "MSLEVEL", "NUM PEAKS", "INCHIKEY", "SPLASH").alias("name", "mslevel", "num_peaks", "inchikey", "splash")
    parsed = row.select("record_id", "j", fields)
    n = F.json_array_length(F.get_json_object("j", "$.PEAKS_LIST"))
    return parsed.select("record_id", "name", "mslevel", "num_peaks", "inchikey", "splash", n.alias("n"))


for _name, _fn, _sql in (("format_msp", format_msp, _sql_msp()), ("format_csv_rows", format_csv_rows, _sql_csv())):
    _add(_name, _fn, [*_TYPED, f"txt AS (SELECT record_id, {_sql} AS t FROM cls)"],
         "SELECT record_id, length(t) AS n, md5(t) AS digest FROM txt")
_add("format_json_rows", format_json_rows, _TYPED,
     "SELECT record_id, name, coalesce(nullif(mslevel, ''), 'NOT FOUND') AS mslevel, num_peaks::VARCHAR AS num_peaks, "
     "coalesce(nullif(inchikey, ''), 'NOT FOUND') AS inchikey, 'NOT FOUND' AS splash, len(peaks)::INT AS n FROM cls")


def _round_trip(df: DataFrame) -> DataFrame:
    return df.filter("deletion_reason is null").select(
        F.substr(F.col("spectrumid"), F.lit(3)).cast("bigint").alias("record_id"), "name", "precursortype", "ionmode",
        to_text(F.col("peaks"), ";").alias("peaks_text"),
    )


def write_msp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "out-msp")
    wr.write_msp(_classed(spark, sf_dir), path)
    return _round_trip(rd.read_msp(spark, path))


def write_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "out-csv")
    wr.write_csv(_classed(spark, sf_dir), path)
    return _round_trip(rd.read_csv(spark, path))


def write_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "out-json")
    wr.write_json(_classed(spark, sf_dir), path)
    return _round_trip(rd.read_json(spark, path))


_BACK = (
    f"SELECT record_id, name, coalesce(nullif(precursortype, ''), 'NOT FOUND') AS precursortype, ionmode, {orc.peak_text()} AS peaks_text FROM cls"
)
_add("write_msp_roundtrip", write_msp_roundtrip, _TYPED, _BACK + " WHERE len(peaks) > 0")
_add("write_csv_roundtrip", write_csv_roundtrip, _TYPED, _BACK)
_add("write_json_roundtrip", write_json_roundtrip, _TYPED, _BACK)


def _record_number() -> Column:
    return F.substr(F.col("SPECTRUMID"), F.lit(3)).cast("bigint").alias("record_id")


def write_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append, an overwrite that leaves nothing of it, and an append; every row with its class folder."""
    path = new_path(spark, "out-modes")
    df = _classed(spark, sf_dir)
    wr.write_csv(df, path, "append")
    wr.write_csv(df.filter("record_id % 2 = 0"), path, "overwrite")
    wr.write_csv(df.filter("record_id % 2 = 1"), path, "append")
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.select(_record_number(), F.col("NAME").alias("name"), "polarity", "chromatography", "origin")


def reject_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "out-rejects")
    df = _classed(spark, sf_dir).withColumn(
        "deletion_reason", F.when(F.size("peaks") == 0, "no_peaks").when(F.size("peaks") < 3, "min_peaks")
    )
    wr.write_rejects(df.filter("deletion_reason is not null"), path)
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.select(_record_number(), F.col("NAME").alias("name"), "deletion_reason")


_add("write_modes", write_modes, _TYPED,
     "SELECT record_id, coalesce(nullif(name, ''), 'NOT FOUND') AS name, polarity, chromatography, origin FROM cls")
_add("reject_sink", reject_sink, RAW,
     "SELECT record_id, coalesce(nullif(name, ''), 'NOT FOUND') AS name, CASE WHEN len(peaks) = 0 THEN 'no_peaks' ELSE 'min_peaks' END "
     "AS deletion_reason FROM raw WHERE len(peaks) < 3")


# --- streaming ------------------------------------------------------------------------------


def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even spectra arrive first, then all of them; the second micro-batch keeps only unseen ones, and
    every record of both is kept or among the rejects."""
    base = new_path(spark, "stream")
    record = F.concat_ws("\n", _pairs(": "), to_text(F.col("peaks")))
    spectra = _raw(spark, sf_dir).select("record_id", record.alias("value"))
    lookups, params = Lookups(lk.adduct_table(spark)), Params(csv=False, json=False)
    for name, rows in (("even", spectra.filter("record_id % 2 = 0")), ("all", spectra)):
        rows.select("value").write.option("lineSep", "\n\n").text(f"{base}/in/{name}.msp")
        start_curation(library_stream(spark, f"{base}/in"), f"{base}/out", f"{base}/checkpoint", lookups, params).awaitTermination()
    registered = spark.read.parquet(f"{base}/out/REGISTRY").groupBy("batch_id").agg(F.count_distinct("splash").alias("keys"))
    options = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "multiLine": True}
    rejects = spark.read.options(**options).csv(f"{base}/out/REJECTS").groupBy("batch_id", "deletion_reason").agg(F.count(F.lit(1)).alias("n"))
    audited = rejects.groupBy("batch_id").agg(
        F.sum(F.when(F.col("deletion_reason") == "unparsable", F.col("n"))).alias("unparsable"),
        F.sum(F.when(F.col("deletion_reason").isin("already_seen", "duplicate"), F.col("n"))).alias("known"),
    )
    return registered.join(audited, "batch_id").select(
        F.col("batch_id").cast("bigint").alias("batch_id"), "keys", F.coalesce("unparsable", F.lit(0)).alias("unparsable"),
        F.coalesce("known", F.lit(0)).alias("known"),
    )


_add("stream_incremental", stream_incremental, [*RAW, *orc.splash("raw")],
     "SELECT batch_id, count(DISTINCT splash) FILTER (fresh) AS keys, count(*) FILTER (n_peaks = 0) AS unparsable, "
     "count(*) FILTER (splash IS NOT NULL) - count(DISTINCT CASE WHEN fresh THEN coalesce(nullif(trim(inchikey), ''), record_id::VARCHAR) || splash END) AS known "
     "FROM (SELECT batch_id, s.*, first = batch_id AS fresh FROM (SELECT spl.splash, raw.record_id, raw.inchikey, len(raw.peaks) AS n_peaks, min(raw.record_id % 2) OVER (PARTITION BY splash) AS first "
     "FROM raw LEFT JOIN spl USING (record_id)) s, (VALUES (0), (1)) b(batch_id) WHERE batch_id = 1 OR record_id % 2 = 0) GROUP BY batch_id")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First copy per key, as a stream: every key stays, with one row."""
    base = new_path(spark, "stream-dedup")
    copies = with_splash(fx.spectra_with_copies(spark, sf_dir, ["inchikey", "comment"])).select("splash", "inchikey")
    copies.write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(copies.schema).parquet(f"{base}/in")
    sink = first_copies(arriving).writeStream.format("parquet").option("path", f"{base}/out")
    sink.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(copies.schema).parquet(f"{base}/out")
    return kept.groupBy("splash", "inchikey").agg(F.count(F.lit(1)).alias("n"))


_add("stream_dedup", stream_dedup, [*orc.copies(), *orc.splash("cp")],
     "SELECT spl.splash, inchikey, CASE WHEN trim(inchikey) <> '' THEN 1 ELSE count(*) END::BIGINT AS n FROM cp JOIN spl USING (record_id) GROUP BY 1, 2")


def stream_richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that arrive in three parts, a micro-batch each: the richest copy per key by the log of changes."""
    base = new_path(spark, "stream-richest")
    copies = stage(ranked(with_splash(fx.spectra_with_copies(spark, sf_dir))), "ranked")
    for part in range(3):
        copies.filter(F.col("record_id") % 3 == part).write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(copies.schema).parquet(f"{base}/in")
        sink = richest_changes(arriving).writeStream.format("parquet").option("path", f"{base}/log")
        sink.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return current_richest(spark.read.schema(CHANGES).parquet(f"{base}/log")).select("record_id", "splash", "inchikey")


_add("stream_richest", stream_richest, [*orc.copies(), *orc.splash("cp"), "fin AS (SELECT cp.*, splash FROM cp JOIN spl USING (record_id))", orc.deduplicated("fin")],
     "SELECT record_id, splash, inchikey FROM dup WHERE NOT coalesce(is_duplicate, false) AND trim(inchikey) <> ''")
