"""Repeated byte strings by a sparse, distributed suffix array.

Which suffixes: a string of `LENGTH` bytes is represented by its anchor, the start of the smallest of
its `GRAM`-byte substrings (by hash, leftmost on ties). Equal strings have equal anchors at equal
distances, so only suffixes at anchors, about one in 140 bytes, take part. An anchor serves a run of
consecutive string starts; the bytes they span are its segment.

1. Anchors are counted by the hash of their gram, pre-aggregated. Unique grams start no repeat.
   Where all segments of a gram are equal, every string in them is repeated.
2. Other grams are mixed: one row per distinct segment goes on, its suffix (right of the anchor) and
   its reversed prefix. Sampled splitters range-partition these suffixes by their leading bytes, the
   gram, so equal grams share a bucket and no repeat crosses a boundary. Each bucket sorts
   suffixes and prefixes by multikey quicksort; the ranks that the common-prefix lengths of
   neighbours give at every depth decide, byte for byte, which strings occur twice.
3. A gram with more than `HOT` distinct segments would fill a bucket: its strings are compared by
   128-bit hash across buckets instead, in a count that is pre-aggregated and split by Spark.

Texts cross the network packed, once for the mixed segments and once for the result; nothing else
grows faster than the number of anchors.

Defined cases: null text is empty; texts shorter than `LENGTH` lose nothing; equal rows are separate
documents (each is repeated in the other); columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm import kernels as kn
from ionloom.llm.common import KEY, arrow_flat, arrow_map, key_columns
from ionloom.session import stage

LENGTH = 400
GRAM = 128
HOT = 16_384
BUCKET_ROWS = 20_000
POSITION = np.uint64(0xFFFFFFFF)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, in linear time."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    table = padded.reshape(-1, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, low, high, anchor, gram hash, segment hash) per anchor; positions are those of the block."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none, none
    first = kn.Rolling(data, 1)
    at = np.arange(len(data) - gram + 1)
    grams = first.slices(at, at + gram)
    best = window_minimum((grams & ~POSITION) | at.astype(np.uint64), length - gram + 1)
    starts = np.arange(len(best))
    row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(best)]
    inside = np.flatnonzero(starts + length <= row_end)
    if not len(inside):
        return none, none, none, none, none, none
    anchor = (best[inside] & POSITION).astype(np.int64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(inside) != 1)]
    low = inside[new]
    high = inside[np.r_[np.flatnonzero(new)[1:] - 1, len(inside) - 1]]
    anchor = anchor[new]
    segment = kn.mix(kn.slice_hashes(data, low, high + length) ^ kn.mix((anchor - low).astype(np.uint64), 8), 9)
    rows = np.searchsorted(offsets, low, side="right") - 1
    return rows, low, high, anchor, grams[anchor].view(np.int64), segment.view(np.int64)


def anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(keys, low, high, anchor, gram, segment); positions within the text."""
    schema = pa.schema([(c, pa.int64()) for c in (*KEY, "low", "high", "anchor", "gram", "segment")])

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in KEY]
        for row, data, offsets in kn.blocks(batch.column(batch.schema.get_field_index("text"))):
            rows, low, high, anchor, grams, segment = anchors(data, offsets, length, gram)
            base = offsets[rows]
            arrays = [*(k[row + rows] for k in keys), low - base, high - base, anchor - base, grams, segment]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], schema=schema)

    return arrow_flat(texts, fn, ", ".join(f"{c} bigint" for c in schema.names))


def packed(texts: DataFrame, keep: list[str]) -> DataFrame:
    """Texts as zstandard frames, to cross the network small."""

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        pack = zstandard.ZstdCompressor(level=3).compress
        column = batch.column(batch.schema.get_field_index("text"))
        return {"packed": pa.array([pack((t or "").encode()) for t in column.to_pylist()], pa.binary())}

    return arrow_map(texts, fn, "packed binary", keep)


def unpacked(column: pa.Array) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(p.as_py()) for p in column)


def segments(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(keys, anchor, single, lead, suffix, prefix) of the wanted (keys, low, high, anchor, single) rows."""
    by_text = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("low", "high", "anchor", "single")).alias("w"))
    joined = packed(texts, KEY).join(by_text.hint("merge"), KEY)
    spec = "_k1 bigint, _k2 bigint, anchor bigint, single boolean, lead binary, suffix binary, prefix binary"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in spec.split(", ")]

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        k1, k2, wants = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*KEY, "w"))
        rows = []
        for a, b, text, want in zip(k1, k2, unpacked(batch.column(batch.schema.get_field_index("packed"))), wants, strict=True):
            for w in want:
                at = w["anchor"]
                rows.append((a, b, at, w["single"], text[at : at + gram], text[at : w["high"] + length], text[w["low"] : at][::-1]))
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return arrow_flat(joined, fn, spec)


def as_words(strings: list[bytes], width: int) -> np.ndarray:
    """Zero-padded strings as rows of big-endian 8-byte characters."""
    width = -(-max(width, 1) // 8) * 8
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=">u8").reshape(len(strings), -1).astype(np.uint64)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows: only rows that still tie are partitioned by their next character."""
    n, depth = words.shape
    order = np.arange(n)
    group = np.zeros(n, dtype=np.int64)  # of the row at each place: the first place of its tied run
    active = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    for d in range(depth):
        if not len(active):
            break
        character = words[order[active], d]
        by = np.lexsort((character, group[active]))
        order[active] = order[active[by]]
        character, tied = character[by], group[active]
        new = np.r_[True, (tied[1:] != tied[:-1]) | (character[1:] != character[:-1])]
        begin = active[new]
        group[active] = np.repeat(begin, np.diff(np.r_[np.flatnonzero(new), len(active)]))
        run = np.repeat(np.diff(np.r_[np.flatnonzero(new), len(active)]), np.diff(np.r_[np.flatnonzero(new), len(active)]))
        active = active[run > 1]
    return order


def neighbour_prefixes(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common bytes of each row, in order, with the one before it (the first: 0)."""
    above, below = words[order[:-1]], words[order[1:]]
    differ = above ^ below
    column = (differ != 0).argmax(axis=1)
    value = differ[np.arange(len(differ)), column]
    leading = np.zeros(len(value), dtype=np.int64)
    for shift in (32, 16, 8):  # bytes of zero at the top
        empty = (value >> np.uint64(64 - shift)) == 0
        leading[empty] += shift // 8
        value = np.where(empty, value << np.uint64(shift), value)
    equal = ~(differ != 0).any(axis=1)
    return np.r_[0, np.where(equal, words.shape[1] * 8, column * 8 + leading)]


def repeated_strings(suffixes: list[bytes], prefixes: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, distance): every string of `length` bytes that starts `distance` bytes left of a row's
    anchor and occurs in another row at the same distance."""
    n = len(suffixes)
    far = np.array([len(p) for p in prefixes])
    near = length - np.array([len(s) for s in suffixes])
    ranks = []
    for strings in (suffixes, prefixes):
        words = as_words(strings, max(map(len, strings)))
        order = multikey_quicksort(words)
        ranks.append((order, neighbour_prefixes(words, order)))
    (right, right_lcp), (left, left_lcp) = ranks
    right_rank, left_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    rows, distances = [], []
    for distance in range(int(near.min()), int(far.max()) + 1):
        valid = np.flatnonzero((near <= distance) & (distance <= far))
        if len(valid) < 2:
            continue
        right_rank[right] = np.cumsum(right_lcp < length - distance)
        left_rank[left] = np.cumsum(left_lcp < distance)
        _, inverse, count = np.unique(right_rank[valid] * (n + 1) + left_rank[valid], return_inverse=True, return_counts=True)
        found = valid[count[inverse] > 1]
        rows.append(found)
        distances.append(np.full(len(found), distance))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(distances)


SPANS = pa.schema([(c, pa.int64()) for c in (*KEY, "begin", "end")])


def resolve_buckets(parts: DataFrame, length: int, buckets: int) -> DataFrame:
    """(keys, begin, end): the repeated strings of single segments, by suffix buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        suffixes, prefixes = rows.column("suffix").to_pylist(), rows.column("prefix").to_pylist()
        row, distance = repeated_strings(suffixes, prefixes, length)
        mine = rows.column("single").to_numpy()[row]
        row, distance = row[mine], distance[mine]
        by = np.lexsort((distance, row))
        row, distance = row[by], distance[by]
        new = np.r_[True, (row[1:] != row[:-1]) | (distance[1:] != distance[:-1] + 1)] if len(row) else np.zeros(0, bool)
        last = np.r_[np.flatnonzero(new)[1:] - 1, len(row) - 1] if len(row) else np.zeros(0, np.int64)
        anchor = rows.column("anchor").to_numpy()
        of = row[new]
        begin, end = anchor[of] - distance[last], anchor[of] - distance[new] + length
        keys = [rows.column(k).to_numpy()[of] for k in KEY]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys, begin, end)], schema=SPANS)

    ranged = parts.repartitionByRange(buckets, "lead").select(*KEY, "anchor", "single", "suffix", "prefix")
    return ranged.mapInArrow(run, "_k1 bigint, _k2 bigint, begin bigint, end bigint")


def resolve_hot(parts: DataFrame, length: int) -> DataFrame:
    """The same for grams with very many segments: string by string, compared by hash."""
    spec = "_k1 bigint, _k2 bigint, begin bigint, single boolean, h1 bigint, h2 bigint"

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*KEY, "anchor", "single", "suffix", "prefix")]
        for k1, k2, anchor, single, suffix, prefix in zip(*columns, strict=True):
            data = np.frombuffer(prefix[::-1] + suffix, dtype=np.uint8)
            at = np.arange(len(data) - length + 1)
            hashes = [kn.Rolling(data, s).slices(at, at + length).view(np.int64) for s in (3, 4)]
            n = len(at)
            arrays = [np.full(n, k1), np.full(n, k2), anchor - len(prefix) + at, np.full(n, single), *hashes]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[c.split()[0] for c in spec.split(", ")])

    strings = arrow_flat(parts, fn, spec)
    twice = stage(strings.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "twice")
    found = strings.filter("single").join(twice, ["h1", "h2"])
    return found.select(*KEY, "begin", (F.col("begin") + length).alias("end"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(keys, begin, end): spans of every text (keys, text) that repeated strings cover; they may overlap."""
    found = anchor_rows(texts, length, gram)
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("segment").alias("s1"), F.max("segment").alias("s2"))
    # Written out: the partition of a hot gram is split only against a side that is read as it lies.
    grams = stage(grams.filter("n > 1").select("gram", (F.col("s1") != F.col("s2")).alias("mixed")), "grams")
    flagged = stage(found.join(grams.hint("merge"), "gram"), "anchors")
    span = (*KEY, F.col("low").alias("begin"), (F.col("high") + length).alias("end"))
    sure = flagged.filter(~F.col("mixed")).select(*span)
    mixed = flagged.filter("mixed")
    classes = mixed.groupBy("gram", "segment").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "anchor", "low", "high")).alias("r"))
    classes = stage(classes.select("gram", "segment", (F.col("n") == 1).alias("single"), "r.*"), "classes")
    again = classes.filter(~F.col("single")).select("gram", "segment")
    repeated = mixed.join(again.hint("merge"), ["gram", "segment"]).select(*span)
    crowded = classes.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("gram")
    crowded = stage(crowded, "crowded")
    total = classes.count()
    usual = classes.join(crowded, "gram", "left_anti")
    parts = stage(segments(texts, usual, length, gram), "segments")
    spans = [sure, repeated, resolve_buckets(parts, length, max(1, total // BUCKET_ROWS + 1))]
    if not crowded.isEmpty():
        spans.append(resolve_hot(stage(segments(texts, classes.join(crowded, "gram", "left_semi"), length, gram), "crowd"), length))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_bytes: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and spans of every row (and `kept`: the remaining bytes)."""
    texts = docs.select(F.col(id_column), F.col(text_column).alias("text"), *key_columns(id_column, text_column))
    spans = repeated_spans(texts.drop(id_column), length, gram, hot)
    # Spans of a text meet in one row: bounded by its length. Pre-merge where many lie in one task.
    by_text = spans.groupBy(*KEY).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    joined = packed(texts, [id_column, *KEY]).join(by_text.hint("merge"), KEY, "left")
    spec = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<begin:bigint,end:bigint>>"
    removed = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows, kept_bytes = [], []
        for text, found in zip(unpacked(batch.column(batch.schema.get_field_index("packed"))), batch.column(batch.schema.get_field_index("spans")).to_pylist(), strict=True):
            cut = merged([(s["begin"], s["end"]) for s in found or []])
            edges = [0, *(x for span in cut for x in span), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), [{"begin": a, "end": b} for a, b in cut]))
            if with_bytes:
                kept_bytes.append(kept)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), removed]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        out = {c.split()[0]: pa.array(v, t) for c, v, t in zip(spec.replace("array<struct<begin:bigint,end:bigint>>", "a").split(", "), columns, types, strict=True)}
        return out | ({"kept": pa.array(kept_bytes, pa.binary())} if with_bytes else {})

    return arrow_map(joined, fn, spec + (", kept binary" if with_bytes else ""), [id_column])
