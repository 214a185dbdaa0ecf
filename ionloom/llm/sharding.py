"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size (offset and step
from its name, so a full permutation). Shards take turns claiming their next free slot, as often
per round as their weight says, until the table is full: slots per shard differ by a turn at most,
and a shard that leaves moves little besides its own slots. A row's key hashes to a slot, and a
broadcast of the table, whose size is a parameter and doesn't grow with the data, gives its shard.
DataFrame functions only, no shuffle of rows.

Defined cases: a null key is placed by the text's hash instead (null text: as an empty one), so rows
without ids don't meet in one shard; equal keys always share a shard; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple((f"shard-{i:03d}", 1) for i in range(64))
MAX_SLOTS = 4_000_003


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[tuple[str, int], ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Index of the shard that owns each slot."""
    if not is_prime(slots) or slots > MAX_SLOTS or slots < sum(w for _, w in shards):
        raise ValueError("slots: a prime, at least the sum of the weights and at most MAX_SLOTS")
    if len({name for name, _ in shards}) < len(shards) or not any(w > 0 for _, w in shards):
        raise ValueError("shards: distinct names and some positive weight")
    owner = [-1] * slots
    start = [_number("offset " + name) % slots for name, _ in shards]
    step = [_number("step " + name) % (slots - 1) + 1 for name, _ in shards]
    turn = [0] * len(shards)
    free = slots
    while True:
        for i, (_, weight) in enumerate(shards):
            for _ in range(weight):
                while owner[slot := (start[i] + turn[i] * step[i]) % slots] >= 0:
                    turn[i] += 1
                owner[slot] = i
                turn[i] += 1
                free -= 1
                if not free:
                    return owner


def table_frame(spark: SparkSession, owner: list[int], names: list[str]) -> DataFrame:
    """(slot, shard_id, shard): a row per slot, unfolded from one literal."""
    text = F.split(F.lit(",".join(map(str, owner))), ",")
    shard = F.split(F.lit("\n".join(names)), "\n")
    rows = spark.range(1, numPartitions=1).select(F.posexplode(text).alias("slot", "owner"))
    return rows.select(
        F.col("slot").cast("long"), F.col("owner").cast("int").alias("shard_id"),
        F.element_at(shard, F.col("owner").cast("int") + 1).alias("shard"),
    )


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """First 52 bits of the key's MD5, modulo the table size: the same in any engine."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") % slots


def shard_rows(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shards: tuple[tuple[str, int], ...] = SHARDS,
    slots: int = SLOTS,
) -> DataFrame:
    """The rows with `slot`, `shard_id` and `shard`; input columns of these names are replaced."""
    names = [c for c in docs.columns if c not in ("slot", "shard_id", "shard")]
    key = F.coalesce(docs[id_column].cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(docs[text_column], F.lit("")))))
    placed = docs.select(*(docs[c] for c in names), slot_of(key, slots).alias("slot"))
    owners = table_frame(docs.sparkSession, lookup_table(shards, slots), [name for name, _ in shards])
    return placed.join(F.broadcast(owners), "slot").select(*names, "slot", "shard_id", "shard")
