"""Output rows as text columns and typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions import peaks as pk
from ionloom.functions.exprs import number_text
from ionloom.operators.denovo import annotated_text
from ionloom.schema import FIELDS, MISSING, NUMERIC_TYPES

# Field order of an MSP record and of its comment line.
MSP_FIELDS = [
    "NAME", "PRECURSORMZ", "PRECURSORTYPE", "FORMULA", "INCHIKEY", "INCHI", "SMILES", "RT", "IONMODE",
    "INSTRUMENTTYPE", "INSTRUMENT", "COLLISIONENERGY", "EXACTMASS", "IONIZATION", "MSLEVEL",
]
COMMENT_FIELDS = [
    "FILENAME", "FILEHASH", "PREDICTED", "SPLASH", "SPECTRUMID", "RESOLUTION", "SYNON", "FRAGMENTATIONMODE",
    "AVERAGEMASS", "ENTROPY",
]
ONTOLOGY_FIELDS = [
    "CLASSYFIRE_SUPERCLASS", "CLASSYFIRE_CLASS", "CLASSYFIRE_SUBCLASS", "NPCLASS_PATHWAY", "NPCLASS_SUPERCLASS",
    "NPCLASS_CLASS",
]


def shown(df: DataFrame, field: str) -> Column:
    """A field as output text; missing values read ``NOT FOUND``."""
    name = FIELDS[field]
    if name not in df.columns:
        return F.lit(MISSING)
    col = F.col(name)
    if dict(df.dtypes)[name] == "double":
        col = number_text(col)
    return F.coalesce(F.nullif(col.cast("string"), F.lit("")), F.lit(MISSING))


def peak_text(df: DataFrame, separator: str) -> Column:
    if "annotated_peaks" in df.columns:
        return annotated_text(F.col("annotated_peaks"), separator)
    return pk.to_text(F.col("peaks"), separator)


def msp_comment(df: DataFrame) -> Column:
    pairs = [F.concat(F.lit(f"{f}="), shown(df, f)) for f in COMMENT_FIELDS]
    classes = [
        F.concat(F.lit(f"{f}=" if f == ONTOLOGY_FIELDS[0] else f"{f} = "), shown(df, f)) for f in ONTOLOGY_FIELDS
    ]
    block = F.concat(F.lit('ONTOLOGIES = "'), F.concat_ws(", ", *classes), F.lit('"'))
    return F.concat_ws("; ", *pairs, block)


def msp_record(df: DataFrame) -> Column:
    """One MSP record; the writer adds the blank line."""
    lines = [F.concat(F.lit(f"{f}: "), shown(df, f)) for f in MSP_FIELDS]
    lines.append(F.concat(F.lit("COMMENT: "), msp_comment(df)))
    lines.append(F.concat(F.lit("NUM PEAKS: "), shown(df, "NUM PEAKS")))
    return F.concat_ws("\n", *lines, peak_text(df, "\n"))


def csv_columns(df: DataFrame) -> list[Column]:
    """Canonical columns as text, peaks on one line."""
    return [
        (peak_text(df, ";") if c == "peaks" else shown(df, f)).alias(f) for f, c in FIELDS.items()
    ]


def csv_row(df: DataFrame) -> Column:
    return F.concat_ws("\t", *csv_columns(df))


def json_columns(df: DataFrame) -> list[Column]:
    """Typed numbers where the value is one, text elsewhere.

    Peaks are ``[mz, intensity]`` pairs; annotated peaks are objects, as they mix types.
    """

    def typed(field: str, name: str) -> Column:
        if name == "peaks":
            if "annotated_peaks" in df.columns:
                return F.col("annotated_peaks")
            return F.transform("peaks", lambda p: F.array(p["mz"], p["intensity"]))
        if name in NUMERIC_TYPES and name in df.columns and "mass" not in name:
            return F.col(name).try_cast(NUMERIC_TYPES[name])
        if name == "mslevel" and name in df.columns:
            return F.coalesce(F.col(name).try_cast("int").cast("string"), shown(df, field))
        return shown(df, field)

    return [typed(f, c).alias(f) for f, c in FIELDS.items()]


def json_row(df: DataFrame) -> Column:
    return F.to_json(F.struct(*json_columns(df)))
