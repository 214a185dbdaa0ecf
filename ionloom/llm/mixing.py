"""Mixing sources to target weights.

The words of each source form a stream (documents in hash order) cut into blocks of `BLOCK` words.
Every source gets the number of slots that fills its target exactly; a keyed binary splitting draws
how many of them fall to each output shard, which is a multinomial draw that every task can do for
its own shards alone. The slots of a source are mapped to block indices by a pseudorandom
permutation per source and pass (a small Feistel network with cycle walking), so a pass takes every
block once and the last, partial pass a random set of blocks; its final slot is cut to the words
still due. Blocks are then joined by (source, index), keys that no source can make hot.

Targets: sources in code point order, null last, get the weights `WEIGHTS` in turn and share
`PERCENT` percent of all words; a target stops at `MAX_PASSES` times the source's words and the
excess is shared again by weight until none is above.

Nothing depends on the partitioning: stream offsets are prefix sums in two levels (buckets of about
`BUCKET_DOCS` documents of a source, then within a bucket), so a source with a third of all rows is
spread over many tasks, and equal seeds give equal mixes.

Defined cases: null or blank text has size 0 and is never taken; a source of such rows only has
target 0; equal rows are separate documents of the stream; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm import kernels as kn
from ionloom.llm.common import KEY, arrow_flat, key_columns
from ionloom.session import stage

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256
WEIGHTS = (5, 2, 1)
PERCENT = 150
MAX_PASSES = 2
BUCKET_DOCS = 1024
SHARD_SLOTS = 256
TASK_SHARDS = 64
SEED = 20
ROUNDS = 6


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: float = PERCENT, passes: int = MAX_PASSES) -> DataFrame:
    """(sid, source, source_size, n_docs, target): one row per source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1)
    ranked = sources.withColumn("sid", rank).withColumn("weight", weight)
    cap = F.col("source_size") * F.lit(float(passes))
    # Sources reach their cap in order of cap by weight: one pass over them in that order settles who does.
    by_ratio = Window.orderBy(cap / F.col("weight"), "sid")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * (percent / 100.0)
    spent = F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    settled = ranked.withColumn("total", total).withColumn("full", cap / F.col("weight") <= (F.col("total") - spent) / left)
    free = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    taken = F.coalesce(F.sum(F.when(F.col("full"), cap)).over(everything), F.lit(0.0))
    share = F.least(F.col("weight") * (F.col("total") - taken) / free, cap)
    return settled.select(
        F.col("sid").cast("long").alias("sid"), "source", "source_size", "n_docs",
        F.when(F.col("full"), cap).otherwise(share).alias("target"),
    )


def stream_offsets(sized: DataFrame, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """`sized` (source, size, keys, ...) with `offset`: the words of its source before each row."""
    rows = sized.groupBy().agg(F.count("*").alias("rows"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket_docs))
    spread = sized.crossJoin(F.broadcast(rows)).withColumn("bucket", F.pmod(F.xxhash64("_k1", "_k2"), buckets)).drop("rows")
    sums = spread.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("source", "bucket").orderBy("_k1", "_k2").rowsBetween(Window.unboundedPreceding, -1)
    inside = spread.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))
    return inside.join(starts, same).withColumn("offset", F.col("start") + F.col("inside")).drop("_s", "_b", "start", "inside", "bucket")


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Image of each index under a keyed permutation of range(n)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = np.asarray(index, dtype=np.uint64).copy()
    todo = np.ones(len(out), dtype=bool)
    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in rounds:
            if inverse:
                left, right = right ^ (kn.mix(left, key * ROUNDS + r) & mask), left
            else:
                left, right = right, left ^ (kn.mix(right, key * ROUNDS + r) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= n
    return out.astype(np.int64)


def key_of(*parts: int) -> int:
    value = np.array([SEED], dtype=np.uint64)
    for p in parts:
        value = kn.mix(value ^ np.uint64(p & 0xFFFFFFFFFFFFFFFF), 3)
    return int(value[0])


def slot_plan(sid: int, size: int, target: float, block: int) -> tuple[int, int, int]:
    """(slots, blocks, words of the final slot) that take round(target) words of a source."""
    blocks = -(-size // block)
    due = min(round(target), MAX_PASSES * size)
    if not due:
        return 0, blocks, 0
    full, rest = divmod(due, size)
    last_size = size - (blocks - 1) * block
    if not rest:
        final = int(permute(np.array([blocks - 1]), blocks, key_of(sid, full - 1))[0])
        return full * blocks, blocks, last_size if final == blocks - 1 else block
    odd = int(permute(np.array([blocks - 1]), blocks, key_of(sid, full), inverse=True)[0])
    slots = -(-rest // block)
    if slots > odd:  # the short last block comes up earlier
        slots = max(odd + 1, -(-(rest + block - last_size) // block))
    done = (slots - 1) * block - (block - last_size if slots - 1 > odd else 0)
    return full * blocks + slots, blocks, rest - done


def shard_counts(slots: int, shards: int, sid: int, first: int, last: int) -> tuple[int, np.ndarray]:
    """Slots before shard `first` and the slots of shards first..last-1, of a multinomial draw over all shards."""
    low, high, before, n = 0, shards, 0, slots
    while high - low > last - first:
        middle = low + max(1, (high - low) // TASK_SHARDS // 2) * TASK_SHARDS
        middle = min(middle, high - 1)
        left = int(np.random.default_rng([SEED, sid, low, high]).binomial(n, (middle - low) / (high - low)))
        if first < middle:
            high, n = middle, left
        else:
            low, before, n = middle, before + left, n - left
    counts = np.random.default_rng([SEED, sid, low, high]).multinomial(n, np.full(high - low, 1 / (high - low)))
    return before, counts


SLOTS = "sid bigint, shard bigint, place bigint, pass bigint, block bigint, words bigint"


def slots(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per slot: shard, place within it (by value), source, pass, block index and words taken."""
    due = F.sum(F.ceil(F.col("target") / block) + MAX_PASSES).over(Window.partitionBy())
    shards = F.greatest(F.lit(1), F.ceil(due / SHARD_SLOTS)).cast("long")
    tasks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("shards") - 1) / TASK_SHARDS))
    wanted = (
        sources.filter(F.col("target") > 0).withColumn("shards", shards)
        .select("sid", "source_size", "target", "shards", F.explode(tasks).alias("task"))
    )

    def generate(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            sid, size = row["sid"], row["source_size"]
            n, blocks, final = slot_plan(sid, size, row["target"], block)
            first = row["task"] * TASK_SHARDS
            before, counts = shard_counts(n, row["shards"], sid, first, min(first + TASK_SHARDS, row["shards"]))
            index = np.arange(before, before + counts.sum())
            turn, at = np.divmod(index, blocks)
            images = np.empty(len(index), dtype=np.int64)
            for p in np.unique(turn):
                images[turn == p] = permute(at[turn == p], blocks, key_of(sid, int(p)))
            taken = np.where(images == blocks - 1, size - (blocks - 1) * block, block)
            taken[index == n - 1] = final
            place = kn.mix(index.astype(np.uint64), key_of(sid, 99)).astype(np.int64)
            shard = first + np.repeat(np.arange(len(counts)), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(index), sid)), pa.array(shard), pa.array(place), pa.array(turn), pa.array(images), pa.array(taken)],
                names=["sid", "shard", "place", "pass", "block", "words"],
            )

    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_flat(wanted.repartition(tasks, "sid", "task"), generate, SLOTS)


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per document and block it reaches into; `low`, `high`: its words, counted within the block."""
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)
    spread = placed.filter(F.col("size") > 0).withColumn("block", F.explode(F.sequence(first, last)))
    start = F.col("block") * block
    low = F.greatest(F.col("offset") - start, F.lit(0))
    high = F.least(F.col("offset") + F.col("size") - start, F.lit(block))
    return spread.withColumns({"low": low, "high": high})


def row_keys(docs: DataFrame) -> list[Column]:
    """Keys of whole rows, so that only rows that agree in every column share them. What has no hash of its own
    (maps, variants) takes part as JSON text."""
    unhashed = [f.name for f in docs.schema if any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return key_columns(*(F.to_json(F.struct(F.col(f"`{c}`"))) if c in unhashed else F.col(f"`{c}`") for c in docs.columns))


def mix(docs: DataFrame, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> tuple[DataFrame, DataFrame]:
    """(placed, parts): every document with size, source_size, target, sid and offset; and every taken
    part of a document: its keys, sid and offset, shard, place, pass, and words `first` to `last` - 1."""
    sized = docs.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size"),
        *row_keys(docs),
    )
    sized = stage(sized, "sized")
    sources = stage(targets(sized), "sources")
    named = sources.select("sid", F.col("source").alias("_s"), "source_size", "target")
    joined = stream_offsets(sized).join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = stage(joined, "placed")  # fixes the order of equal rows
    # Slots grow with the data, which their few source rows hide from the size estimate: never broadcast them.
    parts = pieces(placed.select(*KEY, "sid", "offset", "size"), block).join(slots(sources, block).hint("merge"), ["sid", "block"])
    high = F.least(F.col("high"), F.col("words"))
    before = F.col("block") * block - F.col("offset")
    parts = parts.filter(F.col("low") < high).select(
        *KEY, "sid", "offset", "shard", "place", "pass", "block", (before + F.col("low")).alias("first"), (before + high).alias("last")
    )
    return placed, parts


def mixture(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: the words that the mix takes of each document."""
    placed, parts = mix(docs, block)
    taken = parts.groupBy("sid", "offset").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    some = placed.filter(F.col("size") > 0).join(taken, ["sid", "offset"], "left")
    none = placed.filter(F.col("size") == 0).withColumn("taken", F.lit(0).cast("long"))
    both = some.unionByName(none)
    words = F.coalesce(F.col("taken"), F.lit(0)).cast("long")
    return both.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", words.alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, text_column: str = "text") -> DataFrame:
    """A row per document and pass, cut to the words that the pass takes (whole rows keep their text as
    it is), with all columns of `docs`; `n_chars` follows the text where there is such a column."""
    names = docs.columns
    _, parts = mix(docs, block)
    taken = parts.groupBy(*KEY, "sid", "offset", "pass").agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_p"), F.sum(F.col("last") - F.col("first")).alias("_n")
    )
    keyed = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), *row_keys(docs)).dropDuplicates(KEY)
    text = f"c{names.index(text_column)}"
    joined = keyed.join(taken, KEY)
    split = F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")
    cut = F.array_join(F.flatten(F.transform("_p", lambda p: F.slice(split, (p["first"] + 1).cast("int"), (p["last"] - p["first"]).cast("int")))), " ")
    result = joined.withColumn("_t", F.when(F.col("_n") == word_count(F.col(text)), F.col(text)).otherwise(cut))
    columns = []
    for i, c in enumerate(names):
        value = F.col("_t") if c == text_column else F.length("_t").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"c{i}")
        columns.append(value.alias(c))
    return result.select(columns)


def mixed_blocks(docs: DataFrame, block: int = BLOCK, text_column: str = "text") -> DataFrame:
    """The mix itself: a row per shard and slot with its words joined by blanks, and their number."""
    _, parts = mix(docs, block)
    keyed = docs.select(F.col(text_column).alias("_t"), *row_keys(docs)).dropDuplicates(KEY)
    split = F.array_remove(F.split(F.col("_t"), r"[\x20\x09-\x0D]+"), "")
    piece = F.array_join(F.slice(split, (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int")), " ")
    cut = parts.join(keyed, KEY).select("shard", "place", "sid", "pass", "block", "offset", (F.col("last") - F.col("first")).alias("n"), piece.alias("piece"))
    ordered = F.sort_array(F.collect_list(F.struct("offset", "piece")))
    grouped = cut.groupBy("shard", "place", "sid", "pass", "block").agg(F.sum("n").alias("n_words"), ordered.alias("o"))
    return grouped.withColumn("text", F.array_join(F.col("o.piece"), " ")).drop("o")


