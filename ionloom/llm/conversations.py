"""Conversation repair by a rank-convergence parallel Viterbi.

A conversation should read `(s?(ua)+)?` in the initials of its roles. Each row is kept, given the other role, or
deleted, and rows without text are inserted; the repair is the cheapest such edit, written as
its letters (`Keep`, `Rerole`, `Delete`, `Insert`), the least in ASCII order among equals.

Order and chunks: rows are dealt by ranges of (conversation, turn, role, text), so a long conversation
spreads over many tasks; within a task a conversation is a chunk, cut at `CHUNK_ROWS` and `CHUNK_BYTES`. A
conversation that lies inside one task and one chunk is repaired there. The other chunks go on as one
letter a row (what the row costs in every state) and:

1. *Backward costs.* Every chunk but the last starts from a speculative vector: the cheapest way to the end is taken to
   cost nothing from any state. Chunk by chunk the vector at the left end is passed on. A fix-up pass reruns a
   chunk whose incoming vector is not the one it used plus a constant: products of such
   steps soon have rank one, so vectors of different origin differ by a constant and few passes remain.
2. *Stitching.* A constant changes no decision. The state in which the tracing enters each chunk is passed on
   from the left in the same way, by fix-up passes from a speculative state.
3. *Tracing.* Each chunk takes, row by row, the least letter that a cheapest way can take. Letters
   and texts of a conversation's chunks meet in order, streamed, as its one output row needs them together.

Whether a row repeats an earlier one is decided without a join: the first turn of every (conversation, role, text)
is a pre-aggregated row that the range order puts right before the row it stands for.

Defined cases: a null role, text, or id or turn in the damage key reads as one blank; a null conversation id is a
conversation. Rows of one turn go by role, then text. Roles count by their first letter. Conversations
that lost all rows have zeros, an empty audit and the hash of the empty string; an empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.session import stage

CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 22
RANGE_ROWS = 200_000
DAMAGE = 20
WORD = r"[^\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state that a kept row leads to, by (state, initial).
MOVES = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
#: The state after the row that a state still needs, kept, re-roled or inserted, and its role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Pairs of neighbouring initials that a sound conversation has.
LEGAL = {"su", "ua", "au"}


def with_inserts(after: list[int]) -> list[int]:
    """Costs before a row from those after the inserts in front of it: at most one insert pays, two from the system state."""
    user = min(after[USER], INSERT + after[ASSISTANT])
    assistant = min(after[ASSISTANT], INSERT + after[USER])
    return [min(after[START], INSERT + user), min(after[SYSTEM], INSERT + user), user, assistant]


#: Costs to the end of the conversation from its last row on. No way ends after a system or a user row.
NEVER = 1 << 40
END = with_inserts([0, NEVER, NEVER, 0])
SPECULATIVE = [0, 0, 0, 0]


class Row(NamedTuple):
    """What a row costs: its letter is the initial, `x` for others, upper case if truncated, `-` if it must go."""

    initial: str
    extra: int
    must_go: bool


def letter(role: str, must_go: bool, truncated: bool) -> str:
    if must_go:
        return "-"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if truncated else initial


LETTERS = {
    c: Row(c.lower(), TRUNCATED if c.isupper() else 0, c == "-") for c in "suaxSUAX-"
}


def row_costs(row: Row, after: list[int]) -> list[int]:
    """Costs right before a row, without inserts."""
    out = []
    for state in STATES:
        best = DELETE + after[state]
        if not row.must_go:
            kept = MOVES.get((state, row.initial))
            if kept is not None:
                best = min(best, KEEP + row.extra + after[kept])
            best = min(best, REROLE + row.extra + after[NEXT[state]])
        out.append(best)
    return out


def backward(letters: str, end: list[int]) -> list[list[int]]:
    """Cost to go in every state before each row (inserts in front of it included), the end last."""
    costs = [end]
    for c in reversed(letters):
        costs.append(with_inserts(row_costs(LETTERS[c], costs[-1])))
    return costs[::-1]


def rank(vector: list[int]) -> list[int]:
    """The vector less its minimum: two vectors with one rank differ by a constant."""
    least = min(vector)
    return [v - least for v in vector]


def trace(letters: str, end: list[int], state: int, last: bool) -> tuple[str, int, int, list[int | str]]:
    """(audit, cost, state at the end, and for each output row its place or, if inserted, its role).

    Output rows are places (>= 0, kept), ~place with the role next in line (re-roled), or a role name.
    """
    costs = backward(letters, end)
    audit, total, out = [], 0, []

    def insert() -> None:
        nonlocal state, total
        state = NEXT[state]
        audit.append("I")
        out.append(ROLE[state])
        total += INSERT

    for at, c in enumerate(letters):
        row, after = LETTERS[c], costs[at + 1]
        while True:
            go = costs[at][state]
            if DELETE + after[state] == go:
                audit.append("D")
                total += DELETE
                break
            if INSERT + costs[at][NEXT[state]] == go:
                insert()
                continue
            kept = MOVES.get((state, row.initial))
            total += row.extra
            if kept is not None and row.extra + after[kept] == go:
                audit.append("K")
                out.append(at)
                state = kept
            else:
                audit.append("R")
                total += REROLE
                state = NEXT[state]
                out += [~at, ROLE[state]]
            break
    if last:
        while state in (SYSTEM, USER):
            insert()
    return "".join(audit), total, state, out


def repaired(out: list[int | str], roles: list[str], texts: list[str]) -> list[str]:
    """`role:text` of every output row."""
    lines, places = [], iter(out)
    for x in places:
        if isinstance(x, str):
            lines.append(f"{x}:")
        elif x < 0:
            lines.append(f"{next(places)}:{texts[~x]}")
        else:
            lines.append(f"{roles[x]}:{texts[x]}")
    return lines


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) after the stated damage; dropped rows stay as `gone`, to name their conversation."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", (F.crc32(key.cast("binary")) % DAMAGE).alias("harm"))
    rows = rows.select(
        "conv_id", "turn",
        F.when(F.col("harm") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (F.col("harm") == 0).alias("gone"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.select("conv_id", *(F.when(~F.col("gone"), F.col(c)).alias(c) for c in ("turn", "role", "text")), "gone")


def in_order(rows: DataFrame, ranges: int) -> DataFrame:
    """(conv_id, turn, role, text, gone, mark) by ranges and sorted: a mark stands right before the first row of its role and text.

    A row and its mark have one range key, so no boundary parts them; `place` makes it unique, so copies of a row
    spread over ranges too.
    """
    key = F.when(~F.col("gone"), F.unhex(F.sha2("text", 256)))
    placed = stage(rows.select("*", key.alias("text_key"), F.monotonically_increasing_id().alias("place")), "damaged")
    # Unknown turns come first, in the order of structs as in that of the rows.
    at = F.struct("turn", "place")
    marks = placed.filter(~F.col("gone")).groupBy("conv_id", "role", "text_key").agg(F.min(at).alias("at"))
    nothing = F.lit(None).cast("string").alias("text")
    marks = marks.select("conv_id", "at.turn", "role", nothing, F.lit(False).alias("gone"), "text_key", "at.place", F.lit(True).alias("mark"))
    both = placed.withColumn("mark", F.lit(False)).unionByName(marks)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text_key", "place")]
    dealt = both.repartitionByRange(ranges, *order).sortWithinPartitions(*order, F.col("mark").desc())
    return dealt.select("conv_id", "turn", "role", "text", "gone", "mark")


class Chunk:
    """Rows of one conversation that follow each other, and what can be told of them alone."""

    def __init__(self) -> None:
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.letters: list[str] = []
        self.bytes = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low: int | None = None
        self.high: int | None = None

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        bare = text.strip(" \t\n\x0b\x0c\r")
        truncated = bool(bare) and first and bare[-1] not in ".!?"
        self.blank += not bare
        self.duplicate += bool(bare) and not first
        self.truncated += truncated
        if self.roles:
            self.illegal += self.roles[-1][:1] + role[:1] not in LEGAL
        self.letters.append(letter(role, not bare or not first, truncated))
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.roles) >= CHUNK_ROWS or self.bytes >= CHUNK_BYTES

    def facts(self) -> dict:
        ends = [self.roles[0][:1], self.roles[-1][:1]] if self.roles else [None, None]
        return {
            "low": self.low, "high": self.high, "turns": self.turns, "blank": self.blank, "duplicate": self.duplicate,
            "truncated": self.truncated, "illegal": self.illegal, "first": ends[0], "last": ends[1],
        }


#: What is summed or joined over the chunks of a conversation, and its result.
FACTS = {"low": "bigint", "high": "bigint", "turns": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "first": "string", "last": "string"}
OPEN = {"range": "int", "seq": "bigint", "letters": "string", "roles": "array<string>", "texts": "array<string>"}
RESULT = {"gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"}
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}


def spec(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def as_batch(ids: list, kind: pa.DataType, rows: list[dict], columns: dict[str, str]) -> pa.RecordBatch:
    arrays = [pa.array([r.get(c) for r in rows], ARROW[t]) for c, t in columns.items()]
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *arrays], names=["conv_id", *columns])


class Joined:
    """A conversation put together from its chunks in order."""

    def __init__(self) -> None:
        self.sums = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.low = self.high = self.last = None
        self.audits: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0

    def add(self, facts: dict, audit: str, cost: int, lines: list[str]) -> None:
        for c in self.sums:
            self.sums[c] += cost if c == "cost" else facts[c]
        if facts["high"] is not None:
            self.sums["turns"] -= self.high == facts["low"]
            self.low, self.high = facts["low"] if self.low is None else self.low, facts["high"]
        if facts["first"] is not None:
            self.sums["illegal"] += self.last is not None and self.last + facts["first"] not in LEGAL
            self.last = facts["last"]
        self.audits.append(audit)
        for line in lines:
            self.digest.update(("\n" if self.lines else "").encode() + line.encode())
            self.lines += 1

    def result(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["turns"]
        return self.sums | {"gaps": gaps, "audit": "".join(self.audits), "repaired_sha256": self.digest.hexdigest()}


def finished(chunk: Chunk) -> dict:
    """The result of a conversation that is one chunk."""
    letters = "".join(chunk.letters)
    audit, cost, _, out = trace(letters, END, START, True)
    whole = Joined()
    whole.add(chunk.facts(), audit, cost, repaired(out, chunk.roles, chunk.texts))
    return whole.result()


SCAN = {"open": "boolean"} | {c: t for c, t in (FACTS | RESULT | OPEN).items()}


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished conversations, and open chunks of those that may go on in another range or chunk."""
    from pyspark import TaskContext

    here = TaskContext.get().partitionId()
    ids, out, size, seq, kind = [], [], 0, 0, None
    none = object()
    current, chunk, started, first = none, Chunk(), False, False

    def close(whole: bool) -> None:
        nonlocal chunk, size, seq
        ids.append(current)
        if whole:
            out.append({"open": False} | finished(chunk))
        else:
            out.append({"open": True, "range": here, "seq": seq, "letters": "".join(chunk.letters), "roles": chunk.roles, "texts": chunk.texts} | chunk.facts())
            seq += 1
            size += chunk.bytes
        chunk = Chunk()

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, turn, role, text, gone, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current is none or conv != current:
                if current is not none:
                    close(started)
                    started = True  # those of a range's first conversation may have begun in the one before
                current, first = conv, False
            if gone:
                continue
            if mark:
                first = True
                continue
            if chunk.full():
                close(False)
                started = False  # nor is the rest of this one whole
            chunk.add(turn, role, text, first)
            first = False
        if size >= CHUNK_BYTES or len(out) >= 2000:
            yield as_batch(ids, kind, out, SCAN)
            ids, out, size = [], [], 0
    if current is not none:
        close(False)
        yield as_batch(ids, kind, out, SCAN)


def numbered(found: DataFrame) -> DataFrame:
    """Open chunks with their number in the order of all: a conversation's chunks are neighbours.

    The offsets are one number per range that has any.
    """
    counts = found.filter("open").groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect()
    offsets, total = [], 0
    for r in counts:
        offsets.append((r["range"], total))
        total += r["n"]
    table = found.sparkSession.createDataFrame(offsets, "range int, offset bigint")
    return found.filter("open").join(F.broadcast(table), "range").withColumn("number", F.col("offset") + F.col("seq"))


def neighbours(chunks: DataFrame, other: DataFrame, step: int) -> DataFrame:
    """`chunks` with the columns `near_*` of the chunk `step` places on, where it is one of the same conversation."""
    near = other.select((F.col("number") - step).alias("number"), *(F.col(c).alias(f"near_{c}") for c in other.columns if c != "number"))
    joined = chunks.join(near.withColumn("near", F.lit(True)), "number", "left")
    return joined.withColumn("near", F.coalesce("near", F.lit(False)) & F.col("near_conv_id").eqNullSafe(F.col("conv_id"))).drop("near_conv_id")


RUN = {"number": "bigint", "letters": "string", "last": "boolean", "used": "array<bigint>", "left": "array<bigint>", "rerun": "boolean"}


def rerun_backward(rows: DataFrame, kind: str) -> DataFrame:
    """Chunks whose incoming vector `come` has another rank than the one they used run again; others stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.to_pylist()
            for r in out:
                r["rerun"] = r["used"] is None or rank(r["used"]) != rank(r["come"])
                if r["rerun"]:
                    vector = r["come"]
                    for c in reversed(r["letters"]):
                        vector = with_inserts(row_costs(LETTERS[c], vector))
                    r["used"], r["left"] = r["come"], rank(vector)
            yield as_batch([r["conv_id"] for r in out], batch.schema.field("conv_id").type, out, RUN)

    return rows.mapInArrow(run, f"conv_id {kind}, {spec(RUN)}")


def backward_costs(chunks: DataFrame, kind: str) -> tuple[DataFrame, int]:
    """(chunks with the vector `used` at their right end, right up to a constant; number of fix-up passes)."""
    lasts = neighbours(chunks, chunks.select("number", "conv_id"), 1)
    vector = lambda values: F.array(*(F.lit(v).cast("bigint") for v in values))
    begun = lasts.select(
        "conv_id", "number", "letters", (~F.col("near")).alias("last"), F.lit(None).cast("array<bigint>").alias("used"),
        F.lit(None).cast("array<bigint>").alias("left"), F.when(F.col("near"), vector(SPECULATIVE)).otherwise(vector(END)).alias("come"),
    )
    current, passes = stage(rerun_backward(begun, kind), "backward"), 0
    while True:
        near = neighbours(current, current.select("number", "conv_id", "left"), 1)
        come = F.when(F.col("near"), F.col("near_left")).otherwise(vector(END))
        current = stage(rerun_backward(near.withColumn("come", come).drop("near", "near_left"), kind), "backward")
        if current.filter("rerun").isEmpty():
            return current, passes
        passes += 1


TRACE = {"number": "bigint", "letters": "string", "last": "boolean", "used": "array<bigint>", "enter": "bigint", "leave": "bigint", "rerun": "boolean"}


def retraced(rows: DataFrame, kind: str) -> DataFrame:
    """Chunks that are entered in another state `come` than the one they used are traced again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.to_pylist()
            for r in out:
                r["rerun"] = r["enter"] != r["come"]
                if r["rerun"]:
                    r["enter"], r["leave"] = r["come"], trace(r["letters"], r["used"], r["come"], r["last"])[2]
            yield as_batch([r["conv_id"] for r in out], batch.schema.field("conv_id").type, out, TRACE)

    return rows.mapInArrow(run, f"conv_id {kind}, {spec(TRACE)}")


def entered(chunks: DataFrame, kind: str) -> tuple[DataFrame, int]:
    """(chunks with the state `enter` of the tracing at their left end, number of fix-up passes)."""
    firsts = neighbours(chunks.drop("rerun", "left"), chunks.select("number", "conv_id"), -1)
    guess = F.when(F.col("near"), F.lit(ASSISTANT)).otherwise(F.lit(START)).cast("bigint")
    empty = F.lit(None).cast("bigint")
    begun = firsts.select("conv_id", "number", "letters", "last", "used", empty.alias("enter"), empty.alias("leave"), guess.alias("come"))
    current, passes = stage(retraced(begun, kind), "traced"), 0
    while True:
        near = neighbours(current, current.select("number", "conv_id", "leave"), -1)
        come = F.when(F.col("near"), F.col("near_leave")).otherwise(F.lit(START)).cast("bigint")
        current = stage(retraced(near.withColumn("come", come).drop("near", "near_leave"), kind), "traced")
        if current.filter("rerun").isEmpty():
            return current, passes
        passes += 1


def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose chunks come in order; no more than one batch of chunks is held."""
    none = object()
    current, whole, kind = none, Joined(), None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        ids, out = [], []
        for i in range(batch.num_rows):
            r = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
            if current is none or r["conv_id"] != current:
                if current is not none:
                    ids.append(current)
                    out.append(whole.result())
                current, whole = r["conv_id"], Joined()
            audit, cost, _, rows = trace(r["letters"], r["used"], r["enter"], r["is_last"])
            whole.add(r, audit, cost, repaired(rows, r["roles"], r["texts"]))
        if out:
            yield as_batch(ids, kind, out, RESULT)
    if current is not none:
        yield as_batch([current], kind, [whole.result()], RESULT)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, gone): its faults, the cheapest repair and the hash of what it gives."""
    spark = rows.sparkSession
    kind = rows.select("conv_id").schema[0].dataType.simpleString()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS + 1)
    found = stage(in_order(rows, ranges).mapInArrow(chunked, f"conv_id {kind}, {spec(SCAN)}"), "chunks")
    done = found.filter("not open").select("conv_id", *RESULT)
    if found.filter("open").isEmpty():
        return done
    chunks = numbered(found)
    narrow = stage(chunks.select("conv_id", "number", "letters"), "letters")
    traced, _ = entered(backward_costs(narrow, kind)[0], kind)
    ways = traced.select("number", "used", "enter", F.col("last").alias("is_last"))
    texts = chunks.select("conv_id", "number", "letters", "roles", "texts", *FACTS).join(ways, "number")
    ordered = texts.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "number")
    return done.unionByName(ordered.mapInArrow(put_together, f"conv_id {kind}, {spec(RESULT)}"))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """The stated damage to (conv_id, turn, role, text), repaired."""
    return repair(damaged(conversations))
