"""Records cut from byte ranges of text files, whatever the files' size.

Spark's text source splits a file into ranges and re-synchronises at a separator of one character: lines for
MSP, `}` for JSON. A task cuts the records that lie inside its range; what is left at a range's
ends are fragments, at most two a range, which are put together by a small aggregation:

- `head`: up to the range's first record boundary, `tail`: from its last boundary on, `middle`: a range without any.

For lines a boundary can be told on the spot. In a JSON array it depends on the state of the lexer at the range's
start, so a first pass summarises what every range does to that state (in a string or not, and the
depth that it adds in either case); the summaries, one row a range, are composed in file order.

The cut records are written to the shared folder once, so fragments don't need another scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.session import local_table, stage

ORIGIN = ["path", "filename", "filehash"]
CUT = "value string, path string, filename string, filehash string, at bigint, kind string"
NAMES = [c.split()[0] for c in CUT.split(", ")]
#: Order of the fragments of one range.
HEAD, MIDDLE, TAIL = "head", "middle", "tail"


def pieces(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """(value, path, filename, filehash, at) of every piece between separators; `at` is the start of its range."""
    text = spark.read.option("lineSep", separator).text(paths)
    return text.select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("filename"),
        F.sha2(F.col("_metadata.file_size").cast("string"), 256).alias("filehash"), F.col("_metadata.file_block_start").alias("at"),
    )


class Part(NamedTuple):
    """Pieces of a batch that come from one range."""

    value: pa.Array
    origin: tuple[str, str, str]
    at: int


def parts(batch: pa.RecordBatch) -> Iterator[Part]:
    """The batch by ranges; pieces of a range follow each other."""
    path, at = pc.run_end_encode(batch.column(1)), pc.run_end_encode(batch.column(4))
    begin = 0
    for end in np.union1d(path.run_ends.to_numpy(), at.run_ends.to_numpy()).tolist():
        origin = tuple(batch.column(c)[begin].as_py() for c in (1, 2, 3))
        yield Part(batch.column(0).slice(begin, end - begin), origin, batch.column(4)[begin].as_py())
        begin = end


class Cutter:
    """What a range has left open between batches. Subclasses find the boundaries in a part."""

    joint = ""

    def __init__(self, part: Part) -> None:
        self.origin, self.at = part.origin, part.at
        self.bounded = part.at == 0  # a file's start is a boundary
        self.cut = part.at == 0  # whether what is held began at a boundary
        self.held: list[str] = []

    def close(self) -> tuple[str, str | None]:
        """What is held, at a boundary: a whole record or the head of the range."""
        text, kind = self.joint.join(self.held), None if self.cut else HEAD
        self.held, self.bounded, self.cut = [], True, True
        return text, kind

    def rest(self) -> tuple[str, str]:
        return self.joint.join(self.held), TAIL if self.bounded else MIDDLE

    def records(self, part: Part) -> Iterator[tuple[pa.Array | list[str], str | None]]:
        raise NotImplementedError


def as_rows(values: pa.Array | list[str], kind: str | None, cutter: Cutter) -> pa.RecordBatch:
    n = len(values)
    arrays = [values if isinstance(values, pa.Array) else pa.array(values, pa.string()), *(pa.repeat(o, n) for o in cutter.origin)]
    return pa.RecordBatch.from_arrays([*arrays, pa.repeat(pa.scalar(cutter.at, pa.int64()), n), pa.array([kind] * n, pa.string())], names=NAMES)


def cut(batches: Iterator[pa.RecordBatch], cutter_of: Callable[[Part], Cutter]) -> Iterator[pa.RecordBatch]:
    cutter = None
    for batch in batches:
        for part in parts(batch):
            if cutter is None or (cutter.origin, cutter.at) != (part.origin, part.at):
                if cutter is not None:
                    yield as_rows([cutter.rest()[0]], cutter.rest()[1], cutter)
                cutter = cutter_of(part)
            for values, kind in cutter.records(part):
                if len(values):
                    yield as_rows(values, kind, cutter)
    if cutter is not None:
        yield as_rows([cutter.rest()[0]], cutter.rest()[1], cutter)


def stitched(found: DataFrame, joint: str) -> DataFrame:
    """(value, filename, filehash) of the records that ranges cut apart.

    A head or middle belongs to the last tail before it in its file. The window is over places only, two rows a range.
    """
    rank = F.when(F.col("kind") == TAIL, 1).otherwise(0)
    places = found.filter("kind is not null").select("path", "at", "kind", rank.alias("rank"))
    order = Window.partitionBy("path").orderBy("at", "rank")
    owner = F.last(F.when(F.col("kind") == TAIL, F.col("at")), ignorenulls=True).over(order)
    owned = places.withColumn("owner", F.coalesce(owner, F.lit(-1)))
    texts = found.filter("kind is not null").withColumn("rank", rank).join(owned, ["path", "at", "kind", "rank"])
    ordered = F.array_sort(F.collect_list(F.struct("at", "rank", "value")))
    joined = texts.groupBy(*ORIGIN, "owner").agg(ordered.alias("own"))
    return joined.select(F.array_join(F.transform("own", lambda f: f["value"]), joint).alias("value"), "filename", "filehash")


def whole_records(found: DataFrame) -> DataFrame:
    return found.filter("kind is null").select("value", "filename", "filehash")


# ---- records between blank lines --------------------------------------------------------------


class BlankLines(Cutter):
    """Records are runs of lines that are not all white space."""

    joint = "\n"

    def records(self, part: Part) -> Iterator[tuple[pa.Array | list[str], str | None]]:
        blank = pc.invert(pc.match_substring_regex(part.value, r"\S")).to_numpy(zero_copy_only=False)
        lines = part.value.filter(pa.array(~blank))
        record = np.cumsum(blank)[~blank]  # 0: goes on with what is held; the last: is held
        last = int(blank.sum())
        starts = np.flatnonzero(np.diff(record, prepend=-1))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[starts, len(lines)], pa.int32()), lines.cast(pa.string())), self.joint) if len(lines) else pa.array([], pa.string())
        numbers = record[starts] if len(lines) else np.zeros(0, np.int64)
        if len(numbers) and numbers[0] == 0:
            self.held.append(texts[0].as_py())
        if not last:
            return
        text, kind = self.close()
        yield [text], kind
        inside = np.flatnonzero((numbers > 0) & (numbers < last))
        if len(inside):
            yield texts.slice(int(inside[0]), len(inside)), None
        if len(numbers) and numbers[-1] == last:
            self.held.append(texts[-1].as_py())


def blank_line_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, filename, filehash) of the records between lines of white space, with any line ends."""
    lines = pieces(spark, paths, "\n")
    found = stage(lines.mapInArrow(lambda batches: cut(batches, BlankLines), CUT), "records", "zstd")
    return whole_records(found).unionByName(stitched(found, BlankLines.joint)).filter(F.col("value").rlike(r"\S"))


# ---- elements of JSON arrays ------------------------------------------------------------------

QUOTE, BACKSLASH = ord('"'), ord("\\")
STEP = np.zeros(256, dtype=np.int8)
STEP[[ord("{"), ord("[")]] = 1
STEP[[ord("}"), ord("]")]] = -1


class Lexed(NamedTuple):
    """Bytes of a part, each piece after the `}` that it was cut at, with the places of quotes and brackets."""

    data: np.ndarray
    quotes: np.ndarray
    brackets: np.ndarray

    def inside(self, in_string: bool) -> np.ndarray:
        """Which brackets lie in strings, if the part begins in one or not."""
        return (np.searchsorted(self.quotes, self.brackets) + in_string) % 2 == 1

    def steps(self, in_string: bool) -> np.ndarray:
        return np.where(self.inside(in_string), 0, STEP[self.data[self.brackets]])


def lexed(part: Part, first: bool) -> Lexed:
    """`first`: the part begins the file, so nothing was cut off before it."""
    texts = [t.encode() for t in part.value.to_pylist()]
    data = np.frombuffer((b"" if first else b"}") + b"}".join(texts), dtype=np.uint8)
    quotes = np.flatnonzero(data == QUOTE)
    if len(quotes):
        slashed = quotes[(quotes > 0) & (data[np.maximum(quotes - 1, 0)] == BACKSLASH)]
        if len(slashed):
            other = np.flatnonzero(data != BACKSLASH)
            near = np.searchsorted(other, slashed) - 1
            run = slashed - 1 - np.where(near >= 0, other[np.maximum(near, 0)], -1)
            quotes = np.setdiff1d(quotes, slashed[run % 2 == 1], assume_unique=True)
    return Lexed(data, quotes, np.flatnonzero(STEP[data]))


SUMMARY = "path string, at bigint, flips boolean, add0 bigint, low0 bigint, add1 bigint, low1 bigint"


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What every range does to the lexer's state: whether it ends in the other string state, and from either state
    the depth that it adds and the lowest that it reaches."""
    flips: dict[tuple[str, int], bool] = {}
    depths: dict[tuple[str, int], list[list[int]]] = {}
    for batch in batches:
        for part in parts(batch):
            key = (part.origin[0], part.at)
            found = lexed(part, part.at == 0 and key not in flips)
            flipped = flips.get(key, False)
            for start, state in enumerate(depths.setdefault(key, [[0, 0], [0, 0]])):
                depth = state[0] + np.cumsum(found.steps((start == 1) != flipped), dtype=np.int64)
                if len(depth):
                    state[:] = [int(depth[-1]), min(state[1], int(depth.min()))]
            flips[key] = flipped != (len(found.quotes) % 2 == 1)
    rows = [(*k, flips[k], *depths[k][0], *depths[k][1]) for k in flips]
    types = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
    arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SUMMARY.split(", ")])


class Entry(NamedTuple):
    """State of the lexer at the start of a range."""

    in_string: bool
    depth: int


def composed(rows: list[tuple]) -> tuple[dict[tuple[str, int], Entry], set[str]]:
    """State at the start of every range, and the files whose brackets and quotes don't close."""
    entries: dict[tuple[str, int], Entry] = {}
    ends: dict[str, Entry] = {}
    broken = set()
    for path, at, flips, add0, low0, add1, low1 in sorted(rows):
        state = ends.get(path, Entry(False, 0))
        entries[path, at] = state
        add, low = (add1, low1) if state.in_string else (add0, low0)
        if state.depth + low < 0:
            broken.add(path)
        ends[path] = Entry(state.in_string != flips, state.depth + add)
    return entries, broken | {p for p, e in ends.items() if e != Entry(False, 0)}


BLANKS = " \t\r\n"


def array_elements(text: str) -> list[str]:
    """The elements in a text from one boundary to the next: one object, unless something else stands there."""
    bare = text.strip(BLANKS + ",")
    return [bare] if bare.startswith("{") and bare.endswith("}") else list(salvaged(bare))


class Elements(Cutter):
    """Elements of the top-level array; a boundary is where a bracket closes to depth 1."""

    def __init__(self, part: Part, entry: Entry) -> None:
        super().__init__(part)
        self.in_string, self.depth, self.first = entry.in_string, entry.depth, part.at == 0

    def records(self, part: Part) -> Iterator[tuple[list[str], str | None]]:
        first, self.first = self.first, False
        found = lexed(part, first)
        steps = found.steps(self.in_string)
        depth = self.depth + np.cumsum(steps, dtype=np.int64)
        ends = found.brackets[(steps == -1) & (depth == 1)] + 1
        self.in_string ^= len(found.quotes) % 2 == 1
        self.depth = int(depth[-1]) if len(depth) else self.depth
        data, whole = found.data.tobytes(), []
        begin = data.find(b"[") + 1 if first else 0
        for end in ends.tolist():
            text = data[begin:end].decode(errors="replace")
            begin = end
            if self.held or not self.cut:
                self.held.append(text)
                text, kind = self.close()
                if kind:
                    yield [text], kind
                    continue
            whole += array_elements(text)
        if whole:
            yield whole, None
        self.held.append(data[begin:].decode(errors="replace"))


NEXT_OBJECT = re.compile(r",\s*(?=\{)")


def salvaged(text: str) -> Iterator[str]:
    """Elements one after the other, up to the closing bracket. What can't be read is an element of its own that
    ends where an object follows a comma."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and text[at] in BLANKS + ",":
            at += 1
        if at >= len(text) or not text[at:].strip(BLANKS + ",]"):
            return
        try:
            _, end = decoder.raw_decode(text, at)
        except ValueError as error:
            comma = text.rfind(",", at + 1, getattr(error, "pos", at) + 1)
            following = NEXT_OBJECT.search(text, comma if comma > 0 else at + 1)
            end = following.end() if following else len(text)
        yield text[at:end].rstrip(BLANKS + ",")
        at = max(end, at + 1)


def json_array_elements(spark: SparkSession, paths: str | list[str], text: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(value, filename, filehash) of the array elements of sound files, in any layout; and the files that are not sound.

    The states are broadcast: one row for every range that the scan has. ``text``: the pieces, if they are there already.
    """
    text = pieces(spark, paths, "}") if text is None else text
    rows = [tuple(r) for r in text.mapInArrow(summaries, SUMMARY).collect()]
    entries, broken = composed(rows)
    states = spark.sparkContext.broadcast({k: tuple(v) for k, v in entries.items()})

    def cutter_of(part: Part) -> Cutter:
        return Elements(part, Entry(*states.value[part.origin[0], part.at]))

    # A join and not a list of literals: as many files as there are may be broken.
    sound = text.join(F.broadcast(local_table(spark, [(p,) for p in sorted(broken)], ["path"])), "path", "left_anti").select(text.columns) if broken else text
    found = stage(sound.mapInArrow(lambda batches: cut(batches, cutter_of), CUT), "elements", "zstd")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, *origin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own := array_elements(text):
                    yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array([o] * len(own)) for o in origin)], names=["value", "filename", "filehash"])

    rest = stitched(found, Elements.joint).mapInArrow(elements, "value string, filename string, filehash string")
    return whole_records(found).unionByName(rest), sorted(broken)
