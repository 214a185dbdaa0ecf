"""Readers for MSP, MGF, JSON and CSV libraries -> raw ``spectra`` rows.

Every reader yields ``record_id``, the canonical columns as text, ``peaks`` and
``deletion_reason`` (``unparsable`` for records without metadata or peaks).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import parse as ps
from ionloom.functions.exprs import computed_once
from ionloom.schema import COLUMNS, PEAKS_TYPE
from ionloom.session import local_table, stage
from ionloom.sources.lookups import default_synonyms
from ionloom.sources.ranges import blank_line_records, json_array_elements, pieces, salvaged

SOURCES = ["msp", "csv", "json", "mgf"]
SOURCE_STRIDE = 1 << 60
BLANK_LINE = r"\r?\n[ \t\r]*\n"
RAW_MAP = "map<string,string>"
#: Bytes of a file's start that its format is told by; a longer first line is read on to its end.
HEAD_BYTES = 1 << 16
#: Bytes that tell the first character, unless they are all blank.
FIRST_BYTES = 1 << 10
#: Of more files than these a scan tells the kinds: the driver's calls per file add up.
DRIVER_FILES = 64
#: Start of an array, in the piece before the first `}` of a file.
ARRAY_START = r"(?U)^\ufeff?\s*\["


def provenance() -> list[Column]:
    """File name and file hash (SHA-256 of the decimal file size)."""
    return [
        F.col("_metadata.file_name").alias("filename"),
        F.sha2(F.col("_metadata.file_size").cast("string"), 256).alias("filehash"),
    ]


def record_id(source: str) -> Column:
    """Id that is unique over all sources and follows the source order.

    It depends on the scan's partitions, so a pipeline writes the parsed table once and
    goes on from there.
    """
    return F.lit(SOURCES.index(source) * SOURCE_STRIDE) + F.monotonically_increasing_id()


class Heads(NamedTuple):
    """What the first bytes of a file say, per file: its first line and character, and whether plain blank lines part its records."""

    path: str
    header: str
    first_char: str
    plain: bool


def head_bytes(spark: SparkSession, file: str, conf, codecs, limit: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file of any file system that Spark reads, unpacked, at least to the end of the first line."""
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
    codec = codecs.getCodec(path)
    stream = path.getFileSystem(conf).open(path)
    try:
        if codec is not None:
            stream = codec.createInputStream(stream)
        head = bytes(stream.readNBytes(limit))
        while head and len(head) % limit == 0 and b"\n" not in head and head.lstrip(b"\xef\xbb\xbf \t\r")[:1] != b"[":
            more = bytes(stream.readNBytes(len(head)))
            head += more
            if not more:
                break
        return head
    finally:
        stream.close()


def head_of(path: str, head: bytes) -> Heads:
    text = head.decode("utf-8-sig", errors="replace")
    header = text.partition("\n")[0]
    between = {blank for blank in re.findall(r"\n([ \t\r]*)(?=\n)", text)}
    usual = "\r" if header.endswith("\r") else ""
    # No blank line in all of a full head says nothing about those that follow.
    plain = between <= {usual} and (bool(between) or len(head) < HEAD_BYTES)
    return Heads(path, header, text.lstrip()[:1], plain)


def path_of(spark: SparkSession, uri: str) -> str:
    """The path that a file's URI, as scans report it, stands for."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)).toString()


def file_heads(spark: SparkSession, paths: str | list[str], first_char_only: bool = False) -> list[Heads]:
    """The heads of every file under the paths, side by side and without a scan. The list is as long as
    the scan's own file listing, and no more than a head is read of a file.

    With ``first_char_only`` the first lines, which in JSON may be whole files, are neither read on nor kept.
    """
    files = spark.read.text(paths).inputFiles()
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def head(file: str) -> Heads:
        if first_char_only:
            start = head_bytes(spark, file, conf, codecs, FIRST_BYTES)
            if start.removeprefix(b"\xef\xbb\xbf").strip():
                return head_of(path_of(spark, file), start)._replace(header="")
        return head_of(path_of(spark, file), head_bytes(spark, file, conf, codecs))

    with ThreadPoolExecutor(16) as pool:
        return sorted(pool.map(head, files))


def _grouped(heads: list[Heads], kind) -> dict:
    groups: dict = {}
    for head in heads:
        groups.setdefault(kind(head), []).append(head.path)
    return groups


def msp_records(text: DataFrame) -> DataFrame:
    """Split the chunks of a text scan at whitespace-only lines; drop empty records."""
    chunks = text.select(F.explode(F.split("value", BLANK_LINE)).alias("value"), *provenance())
    return chunks.filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")


def scan_msp(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per record. Files whose records plain blank lines part are cut there by the scan itself;
    those with blanks in them or of mixed line ends are read line by line, by ranges."""
    groups = _grouped(file_heads(spark, paths), lambda h: (h.plain, h.header.endswith("\r")))
    scans = []
    for (plain, crlf), group in groups.items():
        if plain:
            scans.append(msp_records(spark.read.option("lineSep", "\r\n\r\n" if crlf else "\n\n").text(group)))
        else:
            scans.append(blank_line_records(spark, group))
    return _together(spark, scans, "value string, filename string, filehash string")


def _together(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def scan_mgf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per block that a line ``BEGIN IONS`` starts, with ``closed``; text before the first is skipped.

    A block without a line ``END IONS`` is not closed: the next block, or the file, ended first.
    """
    chunks = spark.read.option("lineSep", "\nBEGIN IONS").text(paths).select("value", *provenance())
    own = F.regexp_replace("value", r"^\ufeff?BEGIN IONS", "")
    parts = F.split(own, r"\r?\n[ \t]*END IONS", 2)
    blocks = chunks.select(parts[0].alias("value"), "filename", "filehash", (F.size(parts) > 1).alias("closed"))
    return blocks.filter(F.col("closed") | F.col("value").rlike(r"(?m)^[^#;!/\n]*=|^\s*[0-9]"))


def split_record(records: DataFrame) -> DataFrame:
    """Metadata lines and peak lines of a text record."""
    return (
        records.withColumn("_rows", ps.lines(F.col("value")))
        .withColumns({"metadata_rows": ps.metadata_lines(F.col("_rows")), "peak_rows": ps.peak_lines(F.col("_rows"))})
        .drop("_rows", "value")
    )


def _entry(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def _finish(df: DataFrame, source: str, synonyms: dict[str, list[str]] | None) -> DataFrame:
    """Canonical columns from ``entries`` (last synonym wins) and ``peaks``."""
    names = synonyms or default_synonyms()
    keys = F.transform("entries", lambda e: ps.canonical_key(F.lower(e["key"]), names))
    fields = df.withColumns({"_keys": keys, "_vals": ps.entry_values(F.col("entries"))})
    fields = fields.withColumn("_fields", ps.canonical_values(F.col("_keys"), F.col("_vals")))
    values = ps.canonical_fields(F.col("_fields"))
    return fields.select(
        record_id(source).alias("record_id"),
        *[(F.col("peaks").cast(PEAKS_TYPE) if c == "peaks" else values[c]).alias(c) for c in COLUMNS],
        "deletion_reason",
    )


def _own_fields() -> Column:
    return F.array(_entry("filename", F.col("filename")), _entry("filehash", F.col("filehash")))


def _text_entries(df: DataFrame, raw: Column, mine: bool) -> DataFrame:
    named = F.filter(raw, lambda e: ~(F.contains(F.lower(e["key"]), F.lit("filename")) & (F.lower(ps.bare_key(e["key"])) == "filename")))
    found = ps.mine_comments(F.col("_raw")) if mine else F.col("_raw")
    return computed_once(
        df.withColumn("_raw", named).withColumn("_found", found),
        entries=F.concat(_own_fields(), ps.clean_entries(F.col("_found"))),
        peaks=ps.parse_peaks_strict(F.col("peak_rows")),
        deletion_reason=F.when((F.size("_found") == 0) | (F.size("peak_rows") == 0), F.lit("unparsable")),
    )


def parse_msp(records: DataFrame, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    rows = split_record(records)
    return _finish(_text_entries(rows, ps.msp_entries(F.col("metadata_rows")), mine=True), "msp", synonyms)


def parse_mgf(records: DataFrame, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    rows = _text_entries(split_record(records), ps.mgf_entries(F.col("metadata_rows")), mine=False)
    if "closed" in records.columns:
        rows = rows.withColumn("deletion_reason", F.when(F.col("closed"), F.col("deletion_reason")).otherwise("unparsable"))
    return _finish(rows, "mgf", synonyms)


def scan_json_lines(spark: SparkSession, paths: str | list[str], only: DataFrame | None = None) -> DataFrame:
    """One object per line as a map of top-level values; splittable. ``only``: the ``path`` of the files to read."""
    lines = among(spark.read.text(paths), only).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", RAW_MAP).alias("raw"), "filename", "filehash")


def scan_json_array(spark: SparkSession, paths: str | list[str], text: DataFrame | None = None) -> DataFrame:
    """Objects of top-level arrays in any layout, by ranges; an element that can't be read is a NULL row.

    Files whose brackets or quotes don't close can't be cut by ranges: each is one task, which
    goes on at the next object after what can't be read. ``text``: the `pieces` to read, if they are there already.
    """
    objects, broken = json_array_elements(spark, paths, text)
    if broken:
        objects = objects.unionByName(salvaged_elements(spark, paths, broken))
    return objects.select(F.from_json("value", RAW_MAP).alias("raw"), "filename", "filehash")


def among(files: DataFrame, only: DataFrame | None) -> DataFrame:
    """(value, filename, filehash) of a scan, of the files whose ``path`` is in a table."""
    own = files.select("value", *provenance(), F.col("_metadata.file_path").alias("path"))
    return (own if only is None else own.join(F.broadcast(only), "path", "left_semi")).select("value", "filename", "filehash")


def whole_files(spark: SparkSession, paths: str | list[str], uris: list[str]) -> DataFrame:
    """(value, filename, filehash) of the files under the paths that have these URIs.

    Files of up to a range are picked from a scan, however many they are; larger ones, which can't be many, by path.
    """
    limit = F.col("_metadata.file_size") > spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    listed = spark.read.format("binaryFile").load(paths).filter(limit).select("_metadata.file_path").collect()
    large = sorted({r["file_path"] for r in listed} & set(uris))
    own = local_table(spark, [(u,) for u in uris], ["path"])
    texts = [among(spark.read.text(paths, wholetext=True).filter(~limit), own)]
    if large:
        texts.append(among(spark.read.text([path_of(spark, u) for u in large], wholetext=True), None))
    return reduce(DataFrame.union, texts)


def salvaged_elements(spark: SparkSession, paths: str | list[str], uris: list[str]) -> DataFrame:
    files = whole_files(spark, paths, uris)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, *origin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                objects = list(salvaged(text.partition("[")[2]))
                columns = [objects, *([o] * len(objects) for o in origin)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["value", "filename", "filehash"])

    return files.mapInArrow(run, "value string, filename string, filehash string")


def json_kinds(text: DataFrame) -> DataFrame:
    """``path, array`` of every file that is not empty: whether its first piece begins an array."""
    return text.filter("at = 0").groupBy("path").agg(F.first(F.col("value").rlike(ARRAY_START)).alias("array"))


def scan_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Array or line reader per file, by its first non-blank character.

    Many files are listed once for all that is read of them, except for lines and for arrays that are not sound.
    """
    text = pieces(spark, paths, "}")
    if len(text._jdf.inputFiles()) <= DRIVER_FILES:
        groups = _grouped(file_heads(spark, paths, first_char_only=True), lambda h: h.first_char == "[")
        scans = [(scan_json_array if array else scan_json_lines)(spark, group) for array, group in groups.items()]
    else:
        kinds = stage(json_kinds(text), "kinds")
        found = {r["array"] for r in kinds.select("array").distinct().collect()}
        arrays, others = kinds.filter("array").select("path"), kinds.filter("not array").select("path")
        scans = []
        if True in found:
            own = text.join(F.broadcast(arrays), "path", "left_semi").select(text.columns) if len(found) > 1 else text
            scans.append(scan_json_array(spark, paths, own))
        if False in found:
            scans.append(scan_json_lines(spark, paths, others if len(found) > 1 else None))
    return _together(spark, scans, f"raw {RAW_MAP}, filename string, filehash string")


def parse_json(records: DataFrame, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """Nested records are flattened, flat ones need a peak field; all others are unparsable."""
    raw = F.col("raw")
    shaped = records.withColumns(
        {"_nested": ps.is_nested(raw), "_peak_text": ps.json_peak_text(raw)}
    )
    shaped = shaped.withColumns(
        {
            "entries": F.concat(
                F.when(F.col("_nested"), ps.nested_entries(raw)).otherwise(ps.flat_entries(raw)), _own_fields()
            ),
            "peaks": ps.parse_peaks_loose(F.col("_peak_text")),
            "deletion_reason": F.when(
                F.coalesce(~F.col("_nested") & F.col("_peak_text").isNull(), F.lit(True)), F.lit("unparsable")
            ),
        }
    )
    return _finish(shaped, "json", synonyms)


def separator_of(line: Column) -> Column:
    """Tab when the header has strictly more tabs than semicolons, else semicolon."""

    def count(mark: str) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit(mark)))

    return F.when(count("\t") > count(";"), F.lit("\t")).otherwise(F.lit(";"))


def detect_separators(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``filename, separator`` per file, from the first line of each file."""
    heads = [(h.path.rpartition("/")[2], h.header) for h in file_heads(spark, paths)]
    table = spark.createDataFrame(heads, "filename string, header string")
    return table.select("filename", separator_of(F.col("header")).alias("separator"))


def scan_csv(spark: SparkSession, paths: str | list[str], multiline: bool = True) -> DataFrame:
    """All-text rows as entries, columns matched by lower-case name.

    Quoted line breaks need ``multiline`` (one task per file); without them set it to False and
    the files are split.
    """
    by_header = _grouped(file_heads(spark, paths), lambda h: h.header.rstrip("\r"))
    scans = []
    for header, group in by_header.items():
        table = (
            spark.read.option("header", True)
            .option("sep", "\t" if header.count("\t") > header.count(";") else ";")
            .option("quote", '"')
            .option("escape", '"')
            .option("multiLine", multiline)
            .csv(group)
        )
        named = {c.lower(): F.col(f"`{c}`") for c in table.columns}
        text = named.pop("peaks", None)
        other = named.pop("peaks_list", None)
        text = next((c for c in (text, other) if c is not None), F.lit(None).cast("string"))
        entries = F.array(*[_entry(name, col) for name, col in named.items()])
        scans.append(table.select(entries.alias("own"), text.alias("peak_text"), *provenance()))
    return _together(
        spark, scans, "own array<struct<key:string,value:string>>, peak_text string, filename string, filehash string"
    )


def parse_csv(records: DataFrame, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows without peaks are kept; the cleaning stage rejects them as ``no_peaks``."""
    shaped = records.withColumns(
        {
            "entries": F.concat(_own_fields(), F.filter("own", lambda e: e["value"].isNotNull())),
            "peaks": F.coalesce(ps.parse_peaks_loose(F.col("peak_text")), F.array().cast(PEAKS_TYPE)),
            "deletion_reason": F.lit(None).cast("string"),
        }
    )
    return _finish(shaped, "csv", synonyms)


def read_msp(spark: SparkSession, paths: str | list[str], synonyms=None) -> DataFrame:
    return parse_msp(scan_msp(spark, paths), synonyms)


def read_mgf(spark: SparkSession, paths: str | list[str], synonyms=None) -> DataFrame:
    return parse_mgf(scan_mgf(spark, paths), synonyms)


def read_json(spark: SparkSession, paths: str | list[str], synonyms=None) -> DataFrame:
    return parse_json(scan_json(spark, paths), synonyms)


def read_csv(spark: SparkSession, paths: str | list[str], synonyms=None, multiline: bool = True) -> DataFrame:
    return parse_csv(scan_csv(spark, paths, multiline), synonyms)


def library_files(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Paths by format: those with a known suffix as they are, others as folders, whose files are listed.

    A file of no known format is an error and not silently left out.
    """
    groups: dict[str, list[str]] = {s: [] for s in SOURCES}
    unknown = []

    def route(path: str) -> bool:
        # Part files of a folder that is named as a library are of its format.
        names = [part.rpartition(".")[2].lower() for part in path.rstrip("/").split("/") if "." in part]
        suffix = next((n for n in reversed(names) if n in groups), None)
        if suffix:
            groups[suffix].append(path)
        return suffix is not None

    for path in paths:
        if not route(path):
            listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect()
            unknown += [r["path"] for r in listed if not route(r["path"])] if listed else [path]
    if unknown or not any(groups.values()):
        raise ValueError(f"no library format: {', '.join(sorted(unknown)[:10]) or 'no paths'}")
    return groups


def ingest(spark: SparkSession, paths: list[str], synonyms=None, multiline: bool = True) -> DataFrame:
    """Route files by their suffix, folders file by file; union in the order MSP, CSV, JSON, MGF.

    Without ``multiline`` no CSV field has a line break, and big CSV files are split.
    """
    readers = {"msp": read_msp, "csv": partial(read_csv, multiline=multiline), "json": read_json, "mgf": read_mgf}
    parts = [readers[s](spark, group, synonyms) for s, group in library_files(spark, paths).items() if group]
    return reduce(lambda a, b: a.unionByName(b), parts)
