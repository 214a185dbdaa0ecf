"""The richest copy per key as a stream: keyed state that emits a row whenever a richer copy arrives.

A micro-batch brings narrow rows (key, size, id). The state of a key, kept by buckets of keys, is the size and id of its best copy so far;
the emitted changes are an append-only log, and the best copy of a key is the largest change of the log. So
the state only saves emissions: it may be dropped after `ttl`, and a key that comes back later starts anew without harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ionloom.operators.dedup import has_inchikey, row_richness

KEYS = ["splash", "inchikey"]
CHANGES = "splash string, inchikey string, size bigint, record_id bigint"
RANKED = [*KEYS, "size", "record_id"]
#: State of a bucket of keys: their best copies, the ids negated as they are compared, and when the keys came last.
BEST = "splash array<string>, inchikey array<string>, size array<bigint>, negative array<bigint>, at array<bigint>"
#: Calls into Python and states are counted by buckets of keys: one for every key costs milliseconds a key.
BUCKETS = 4096


def ranked(df: DataFrame) -> DataFrame:
    """(splash, inchikey, size, record_id) of the rows that have a key; rows without one have no copies."""
    size = row_richness(df).cast("bigint").alias("size")
    return df.filter(has_inchikey()).select(*KEYS, size, F.col("record_id").cast("bigint").alias("record_id"))


def richest_changes(rows: DataFrame, ttl: str | None = None) -> DataFrame:
    """The stream of changes: a row of `ranked` for every key whose best copy a micro-batch replaces.

    Larger sizes win, then smaller ids. With ``ttl`` (milliseconds) the state of a key that was quiet so long is dropped.
    """
    wait = int(ttl) if ttl else None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs() if wait is not None else 0
        rows = zip(*state.get, strict=True) if state.exists else ()
        known = {(s, k): (size, negative, at) for s, k, size, negative, at in rows if wait is None or now - at < wait}
        best = {}
        for batch in batches:  # pieces of a bucket, never all of its rows at once
            for s, k, size, number in zip(*(batch[c].tolist() for c in RANKED), strict=True):
                mine = (int(size), -int(number))
                if (s, k) not in best or mine > best[s, k]:
                    best[s, k] = mine
        changed = {k: v for k, v in best.items() if k not in known or v > known[k][:2]}
        if changed or wait is not None:
            # A key that came again was not quiet, even if its best copy stays.
            known |= {k: (*max(v, known[k][:2] if k in known else v), now) for k, v in best.items()}
            state.update(tuple(map(list, zip(*((*k, *v) for k, v in known.items()), strict=True))))
        if changed:
            yield pd.DataFrame([(*k, size, -negative) for k, (size, negative) in changed.items()], columns=RANKED)
        if wait is not None:
            state.setTimeoutDuration(wait)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait is not None else GroupStateTimeout.NoTimeout
    keyed = rows.select(F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).alias("bucket"), *RANKED)
    return keyed.groupBy("bucket").applyInPandasWithState(step, CHANGES, BEST, "append", timeout)


def current_richest(changes: DataFrame) -> DataFrame:
    """The best copy of every key, of the log written so far (a partial maximum before the shuffle)."""
    rank = F.struct("size", (-F.col("record_id")).alias("id"))
    best = changes.groupBy(*KEYS).agg(F.max(rank).alias("b"))
    return best.select(*KEYS, F.col("b.size").alias("size"), (-F.col("b.id")).alias("record_id"))
