"""Quality rules by compression bands.

Repetitive text compresses too well, random or encoded text hardly at all. The ratio of compressed
to plain bytes (zstandard) is held against limits that depend on the length, because short texts
never compress far and long ones always do: once over the whole document and once for each chunk
of fixed size, so that a bad passage is found in a long good text. One narrow pass, no shuffle.

Defined cases: a null text is an empty one; a text without bytes has no ratio and no band verdict;
the last chunk is the last `CHUNK` bytes, whatever it shares with the one before. Repeated rows are judged
one by one. Input columns other than the id and the text are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm import kernels as kn
from ionloom.llm.common import arrow_map

LEVEL = 3
CHUNK = 2048
#: (bytes below, lowest ratio, highest ratio); prose keeps well inside on every row, encoded data (base64 packs to
#: about 0.76) is above the limit from 1024 bytes on.
BANDS = [
    (256, 0.40, 1.50),
    (512, 0.40, 0.90),
    (1024, 0.38, 0.85),
    (2048, 0.36, 0.74),
    (4096, 0.34, 0.74),
    (8192, 0.32, 0.72),
    (32768, 0.30, 0.70),
    (1 << 62, 0.26, 0.68),
]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WORDS = 3

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
CONTINUATION = (np.arange(256) & 0xC0) == 0x80

SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, ratio double, chunk_low double, chunk_high double, reason string"
)


@lru_cache(maxsize=4)
def compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set bytes of each row."""
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    newline = np.zeros(len(data) + 1, dtype=bool)
    newline[:-1] = data == 10
    begin = np.unique(np.r_[np.flatnonzero(newline) + 1, np.flatnonzero(edge)])
    begin = begin[begin < len(data)]
    stop = np.r_[begin[1:], len(data)]
    ends_in_newline = data[stop - 1] == 10 if len(stop) else np.zeros(0, bool)
    stop = stop - ends_in_newline
    word_at = np.searchsorted(starts, begin)
    has_word = word_at < len(starts)
    has_word[has_word] = starts[word_at[has_word]] < stop[has_word]
    begin, stop = begin[has_word], stop[has_word]
    rows = np.searchsorted(offsets, begin, side="right") - 1
    values = kn.slice_hashes(data, begin, stop)
    order = np.lexsort((values, rows))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (values[order][1:] == values[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    return np.bincount(rows[order][again], minlength=len(offsets) - 1)


def repeated_words(word_hash: np.ndarray, rows: np.ndarray, n_rows: int, size: int = REPEAT_WORDS) -> np.ndarray:
    """Words inside windows of `size` words that their row has twice or more."""
    count = len(word_hash) - size + 1
    if count <= 0:
        return np.zeros(n_rows, dtype=np.int64)
    at = np.flatnonzero(rows[:count] == rows[size - 1 :])
    values, of = kn.shingle_hashes(word_hash, rows, size)
    full = np.bincount(rows, minlength=n_rows)[of] >= size
    values, of = values[full], of[full]
    order = np.lexsort((values, of))
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = (values[order][1:] == values[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = at[order[same[:-1] | same[1:]]]
    hit = np.zeros(len(word_hash), dtype=bool)
    for k in range(size):
        hit[twice + k] = True
    return np.bincount(rows[hit], minlength=n_rows)


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for below, low, high in BANDS if n_bytes < below)


def compression(text: memoryview, chunk: int) -> tuple[float | None, float | None, float | None, str | None]:
    """(ratio, lowest and highest chunk ratio, reason); no reason is a good text."""
    if len(text) == 0:
        return None, None, None, None
    pack = compressor(LEVEL).compress
    ratio = len(pack(text)) / len(text)
    low, high = band(len(text))
    reason = "repetitive" if ratio < low else "incompressible" if ratio > high else None
    # The last chunk ends with the text and overlaps the one before, so every byte lies in a full chunk.
    begins = sorted({*range(0, len(text) - chunk, chunk), len(text) - chunk}) if len(text) > chunk else []
    ratios = [len(pack(text[i : i + chunk])) / chunk for i in begins]
    if ratios and reason is None:
        low, high = band(chunk - 1)
        reason = "repetitive chunk" if min(ratios) < low else "incompressible chunk" if max(ratios) > high else None
    return ratio, min(ratios, default=None), max(ratios, default=None), reason


def judge(column: pa.Array, chunk: int = CHUNK) -> dict[str, list]:
    out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
    for _, data, offsets in kn.blocks(column):
        n_rows = len(offsets) - 1
        starts, ends, rows = kn.words(data, offsets)
        n_words = np.bincount(rows, minlength=n_rows)
        repeat = repeated_words(kn.slice_hashes(data, starts, ends), rows, n_rows)
        failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
        view = memoryview(data)
        bands = [compression(view[offsets[i] : offsets[i + 1]], chunk) for i in range(n_rows)]
        ratio, low, high, reason = zip(*bands, strict=True)
        out["n_words"] += n_words.tolist()
        out["word_chars"] += per_row(~kn.BLANKS[data] & ~CONTINUATION[data], offsets).tolist()
        out["n_symbols"] += per_row(SYMBOLS[data], offsets).tolist()
        out["n_dup_lines"] += duplicate_lines(data, offsets, starts).tolist()
        out["n_repeat_words"] += repeat.tolist()
        out["base_failed"] += failed.tolist()
        out["kept"] += [not f and r is None for f, r in zip(failed.tolist(), reason, strict=True)]
        out["ratio"] += ratio
        out["chunk_low"] += low
        out["chunk_high"] += high
        out["reason"] += reason
    return out


def quality_rules(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK, keep: list[str] | None = None
) -> DataFrame:
    """Counts, ratios and verdict of every row; `keep` names the columns to carry along (the id)."""
    keep = keep if keep is not None else [id_column]
    types = dict(f.split() for f in SCHEMA.split(", "))
    arrow = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = judge(batch.column(batch.schema.get_field_index(text_column)), chunk)
        return {c: pa.array(v, arrow[types[c]]) for c, v in made.items()}

    columns = list(dict.fromkeys([*keep, text_column]))
    return arrow_map(docs.select(columns), fn, SCHEMA, keep)


def good_documents(docs: DataFrame, text_column: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The rows that pass, with all their columns; columns of the same names as the verdict's are safe."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = f"c{names.index(text_column)}"
    judged = quality_rules(plain, text_column=text, chunk=chunk, keep=plain.columns)
    return judged.filter(F.col("kept")).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
