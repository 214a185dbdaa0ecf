"""Canonical table layout, parameters and reason codes."""

from __future__ import annotations

from dataclasses import dataclass

# Canonical fields in output order -> DataFrame column names.
FIELDS = {
    "FILENAME": "filename",
    "FILEHASH": "filehash",
    "PREDICTED": "predicted",
    "SPLASH": "splash",
    "SPECTRUMID": "spectrumid",
    "RESOLUTION": "resolution",
    "SYNON": "synon",
    "IONIZATION": "ionization",
    "MSLEVEL": "mslevel",
    "FRAGMENTATIONMODE": "fragmentationmode",
    "NAME": "name",
    "PRECURSORMZ": "precursormz",
    "EXACTMASS": "exactmass",
    "AVERAGEMASS": "averagemass",
    "PRECURSORTYPE": "precursortype",
    "INSTRUMENTTYPE": "instrumenttype",
    "INSTRUMENT": "instrument",
    "SMILES": "smiles",
    "INCHI": "inchi",
    "INCHIKEY": "inchikey",
    "COLLISIONENERGY": "collisionenergy",
    "FORMULA": "formula",
    "RT": "rt",
    "IONMODE": "ionmode",
    "COMMENT": "comment",
    "ENTROPY": "entropy",
    "CLASSYFIRE_SUPERCLASS": "classyfire_superclass",
    "CLASSYFIRE_CLASS": "classyfire_class",
    "CLASSYFIRE_SUBCLASS": "classyfire_subclass",
    "NPCLASS_PATHWAY": "npclass_pathway",
    "NPCLASS_SUPERCLASS": "npclass_superclass",
    "NPCLASS_CLASS": "npclass_class",
    "NUM PEAKS": "num_peaks",
    "PEAKS_LIST": "peaks",
}
COLUMNS = list(FIELDS.values())
TEXT_COLUMNS = [c for c in COLUMNS if c != "peaks"]
ONTOLOGY_COLUMNS = COLUMNS[COLUMNS.index("classyfire_superclass"):COLUMNS.index("num_peaks")]
COMPOUND_COLUMNS = ["inchi", "smiles", "formula", "name", "exactmass", "averagemass"]
PEAKS_TYPE = "array<struct<mz:double,intensity:double>>"
NUMERIC_TYPES = {
    "precursormz": "double",
    "exactmass": "double",
    "averagemass": "double",
    "rt": "double",
    "entropy": "double",
    "num_peaks": "int",
}

MISSING = "NOT FOUND"

# Reason codes in the order the pipeline checks them (the first failing check wins).
REASONS = [
    "unparsable",
    "duplicate",
    "already_seen",
    "no_peaks",
    "no_structure",
    "bad_adduct",
    "neg_in_pos",
    "pos_in_neg",
    "precursor_le_zero",
    "precursor_invalid",
    "min_peaks",
    "all_above_precursor",
    "mz_range",
    "min_high_peaks",
    "low_entropy",
    "bad_inchikey",
    "no_structure_after_derivation",
    "unknown_ionmode",
]


@dataclass(frozen=True)
class Params:
    """Run parameters; every peak filter is on by default, de novo annotation is off."""

    min_peaks: int | None = 3
    precursor_window: float | None = 5.0
    max_peaks: int | None = 500
    normalize_intensity: bool = True
    mz_from: float | None = 50
    mz_to: float | None = 2000
    high_peak_percent: float | None = 5.0
    high_peak_count: int = 2
    min_entropy: float | None = 0.5
    de_novo: bool = False
    ppm_tolerance: float = 5.0
    annotation_pick: str = "first"
    require_structure: bool = False
    register: str = "all"
    csv: bool = True
    msp: bool = True
    json: bool = True
    reset: bool = False
    multiline: bool = True
