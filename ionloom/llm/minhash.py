"""MinHash near-duplicates with fast similarity sketches.

Sketch: `COORDINATES` bins are filled in rounds. In round r every shingle is hashed to one bin with
a value that is larger than all values of earlier rounds; the smallest value wins. After as many
rounds as there are bins, bin b is offered all shingles in round COORDINATES + b, so every bin
fills. Two sketches agree in each bin with probability equal to the similarity, concentrated as for
independent hash functions, at the cost of about one hash per shingle.

Banding follows the threshold: the widest bands with which a pair at it misses all of them with a
probability below `MISS`. At 0.85 these are 28 bands of 5 bins, (1 - 0.85^5)^28 < 1e-7; at 0.80 35
bands of 4, (1 - 0.80^4)^35 < 1e-7. Band collisions only propose groups; links are decided on the
full shingle sets (64-bit shingle hashes).

Hot groups: equal sets are one class before banding, and one row stands for a class, however often its
id and text are repeated. Members of a group are checked inside tiles of bounded size; a group above
`TILE` classes or `TILE_BYTES` of text is first compared with a few hubs (the members that
collide most), which settles most of it, and then only what is in different components by then
meets in tiles. No pair between different components is left unchecked, no group is collected
whole, and pairs are never listed: a tile returns the links that join components.

Defined cases: null text or no words: an empty set that links with nothing; fewer than `SHINGLE`
words: the whole sequence is the only shingle; equal rows share a component; a null id never names
a component (the smallest other id does). Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm import kernels as kn
from ionloom.llm.common import KEY, arrow_map, key_columns
from ionloom.llm.components import components
from ionloom.session import stage

SHINGLE = 5
PERCENT = 85
COORDINATES = 140
#: Probability with which a pair at the threshold may miss all bands.
MISS = 1e-7
TILE = 512
TILE_BYTES = 32 << 20
HUBS = 3
_BIN, _ROUND = np.uint64(56), np.uint64(47)
_VALUE = np.uint64((1 << 47) - 1)


def sketch(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Smallest (round, value) of every bin; `shingles` are distinct 64-bit hashes, at least one."""
    out = np.zeros(coordinates, dtype=np.uint64)
    open_bins = np.ones(coordinates, dtype=bool)
    step = min(coordinates, max(1, -(-8 * coordinates // len(shingles))))
    starts = np.arange(coordinates, dtype=np.uint64) << _BIN
    for first in range(0, coordinates, step):
        rounds = range(first, min(first + step, coordinates))
        keys = np.empty((len(rounds), len(shingles)), dtype=np.uint64)
        for k, r in enumerate(rounds):
            h = kn.mix(shingles, 1000 + r)
            bins = ((h >> np.uint64(48)) * np.uint64(coordinates)) >> np.uint64(16)
            keys[k] = (bins << _BIN) | (np.uint64(r) << _ROUND) | (h & _VALUE)
        keys = np.sort(keys.ravel())
        at = np.minimum(np.searchsorted(keys, starts), len(keys) - 1)
        found = open_bins & ((keys[at] >> _BIN) == np.arange(coordinates, dtype=np.uint64)) & (keys[at] >= starts)
        out[found] = keys[at][found]
        open_bins &= ~found
        if not open_bins.any():
            return out
    for b in np.flatnonzero(open_bins):
        r = coordinates + int(b)
        out[b] = (np.uint64(b) << _BIN) | (np.uint64(r) << _ROUND) | (kn.mix(shingles, 1000 + r) & _VALUE).min()
    return out


def band_rows(percent: int) -> int:
    """Bins in a band: as many as leave a pair at the threshold a chance below `MISS` to share no band."""
    for rows in range(COORDINATES, 0, -1):
        if (1 - (percent / 100) ** rows) ** (COORDINATES // rows) < MISS:
            return rows
    raise ValueError(f"{COORDINATES} coordinates are too few for a similarity of {percent} percent")


def band_hashes(bins: np.ndarray, rows: int) -> np.ndarray:
    table = bins[: len(bins) // rows * rows].reshape(-1, rows)
    h = kn.mix(np.arange(len(table), dtype=np.uint64), 31)
    for k in range(rows):
        h = kn.mix(h ^ table[:, k], 32)
    return h.view(np.int64)


def signatures(docs: DataFrame, id_column: str, text_column: str, percent: int = PERCENT) -> DataFrame:
    """(doc_id, keys, n_bytes, n_shingles, set1, set2, bands): null set hashes and bands for empty sets."""
    in_band = band_rows(percent)
    narrow = docs.select(F.col(id_column).alias("doc_id"), *key_columns(id_column, text_column), F.col(text_column).alias("text"))

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        sizes, first, second, bands = [], [], [], []
        for s in kn.distinct_sets(batch.column(batch.schema.get_field_index("text")), SHINGLE):
            sizes.append(len(s))
            if not len(s):
                first.append(None), second.append(None), bands.append(None)
                continue
            h = xxhash.xxh3_128_intdigest(s.tobytes())
            first.append((h >> 64) - (1 << 63)), second.append((h & ((1 << 64) - 1)) - (1 << 63))
            bands.append(band_hashes(sketch(s), in_band))
        return {
            "n_bytes": pc.cast(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0), pa.int64()),
            "n_shingles": pa.array(sizes, pa.int64()), "set1": pa.array(first, pa.int64()),
            "set2": pa.array(second, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64())),
        }

    schema = "n_bytes bigint, n_shingles bigint, set1 bigint, set2 bigint, bands array<bigint>"
    return arrow_map(narrow, fn, schema, ["doc_id", *KEY])


def memberships(classes: DataFrame) -> DataFrame:
    """(node, head, weight): the smallest node of each band bucket a node shares, and the bucket sizes' sum."""
    rows = classes.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1")
    shared = stage(shared, "buckets")  # so that the partition of a hot bucket can be split
    return rows.join(shared, "band").groupBy("node", "head").agg(F.sum("n").alias("weight"))


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, of a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.r_[0, np.flatnonzero(change), batch.num_rows]
        if held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != c[0] for k, c in zip(keys, columns, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def linked(common: np.ndarray, size: np.ndarray, other: int, percent: int) -> np.ndarray:
    return 100 * common >= percent * (size + other - common)


class Forest:
    """Union-find over the rows of a tile."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def tile_links(sets: list[np.ndarray], labels: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links, as row pairs, that join what `labels` doesn't join yet: a spanning forest of them all."""
    n = len(sets)
    forest = Forest(n)
    first_of: dict[int, int] = {}
    for i, label in enumerate(labels):
        forest.join(i, first_of.setdefault(label, i))
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    tokens, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    posting = owner[np.argsort(ids, kind="stable")]
    begin = np.r_[0, np.cumsum(df)]
    bounds = np.r_[0, np.cumsum(size)]
    found = []
    for i in range(n):
        root = np.array([forest.root(j) for j in range(n)])
        if (root == root[0]).all():
            break
        mine = ids[bounds[i] : bounds[i + 1]]
        mine = mine[df[mine] > 1]
        if not len(mine):
            continue
        counts = df[mine]
        offsets = np.repeat(begin[mine] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        common = np.bincount(posting[offsets], minlength=n)
        for j in np.flatnonzero(linked(common, size, len(sets[i]), percent) & (root != root[i])):
            if forest.join(i, int(j)):
                found.append((i, int(j)))
    return found


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def check_tiles(tiles: DataFrame, percent: int) -> DataFrame:
    """Links inside every (gid, tile) group of rows (gid, tile, node, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["gid", "tile"]):
            nodes, at = np.unique(group.column("node").to_numpy(), return_index=True)
            group = group.take(pa.array(at))
            sets = [s for chunk in group.column("text").chunks for s in kn.distinct_sets(chunk, SHINGLE)]
            found = tile_links(sets, group.column("label").to_pylist(), percent)
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[list(u)]), pa.array(nodes[list(v)])], schema=LINKS)

    dealt = tiles.repartition("gid", "tile").sortWithinPartitions("gid", "tile")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def check_hubs(members: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Links of every member of a group with the group's hub."""
    pairs = members.join(hubs, "gid").filter("node <> hub").select("node", "text", "hub", "hub_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            text, of, hub_text = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "hub", "hub_text"))
            keep = []
            for i, s in enumerate(kn.distinct_sets(text, SHINGLE)):
                if of[i].as_py() != hub:
                    hub = of[i].as_py()
                    hub_set = next(kn.distinct_sets(hub_text.slice(i, 1), SHINGLE))
                common = len(np.intersect1d(s, hub_set, assume_unique=True))
                if linked(np.array(common), np.array(len(s)), len(hub_set), percent):
                    keep.append(i)
            if keep:
                u, v = (batch.column(batch.schema.get_field_index(c)).take(pa.array(keep)) for c in ("node", "hub"))
                yield pa.RecordBatch.from_arrays([u, v], schema=LINKS)

    return pairs.mapInArrow(run, "u bigint, v bigint")


def with_tiles(members: DataFrame, label: DataFrame | None, tile: int, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Rows of `members` in every tile where they must meet others, with their component so far."""
    if label is None:
        return members.withColumns({"label": F.col("node"), "tile": F.lit("0")})
    known = members.join(label.withColumnRenamed("component", "label"), "node", "left")
    known = known.withColumn("label", F.coalesce("label", "node"))
    sizes = known.groupBy("gid", "label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    total = sizes.groupBy("gid").agg(F.sum("n").alias("total"), F.sum("b").alias("bytes"), F.max(F.struct("n", "label", "b")).alias("main"))
    total = total.select("gid", "total", "bytes", F.col("main.label").alias("main"), F.col("main.n").alias("n_main"), F.col("main.b").alias("b_main")).filter("n_main < total")
    half, half_bytes = tile // 2, tile_bytes // 2
    strays = F.greatest(F.ceil((F.col("total") - F.col("n_main")) / half), F.ceil((F.col("bytes") - F.col("b_main")) / half_bytes))
    mains = F.greatest(F.ceil(F.col("n_main") / half), F.ceil(F.col("b_main") / half_bytes))
    spread = known.join(total, "gid").withColumns({"stray": F.col("label") != F.col("main"), "s": strays, "m": mains})
    chunk = F.pmod(F.xxhash64("node"), F.when(F.col("stray"), F.col("s")).otherwise(F.col("m")))
    spread = spread.withColumn("chunk", chunk)
    stray_chunks = F.sequence(F.lit(0).cast("long"), F.col("s") - 1)
    main_chunks = F.sequence(F.lit(0).cast("long"), F.col("m") - 1)
    name = lambda kind, a, b: F.concat(F.lit(kind), a.cast("string"), F.lit("-"), b.cast("string"))
    with_strays = F.transform(stray_chunks, lambda j: name("s", F.least(F.col("chunk"), j), F.greatest(F.col("chunk"), j)))
    with_mains = F.transform(main_chunks, lambda j: name("m", F.col("chunk"), j))
    from_main = F.transform(stray_chunks, lambda i: name("m", i, F.col("chunk")))
    tiles = F.when(F.col("stray"), F.concat(with_strays, with_mains)).otherwise(from_main)
    return spread.select("gid", F.explode(tiles).alias("tile"), "node", "label", "text")


def links(classes: DataFrame, narrow: DataFrame, percent: int = PERCENT, tile: int = TILE, hubs: int = HUBS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(u, v): verified links whose components are those of all links."""
    shared = stage(memberships(classes), "memberships")
    group = components(shared.select(F.col("node").alias("u"), F.col("head").alias("v")))
    weight = shared.groupBy("node").agg(F.sum("weight").alias("weight"))
    group = group.join(classes.select("node", "n_bytes", *KEY), "node")
    sizes = group.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"))
    fits = (F.col("n") <= tile) & (F.col("b") <= tile_bytes)
    wanted = (
        group.join(sizes.select("component", fits.alias("fits")), "component").join(weight, "node")
        .select("node", F.col("component").alias("gid"), "fits", "weight", *KEY)
    )
    # Rows that repeat id and text share their key: one of them stands for the node, chosen before the shuffle.
    members = narrow.join(wanted, KEY).groupBy("node", "gid", "fits", "weight").agg(F.first("text").alias("text"))
    members = stage(members, "members")
    small = check_tiles(with_tiles(members.filter("fits").select("gid", "node", "text"), None, tile), percent)
    found = stage(small, "links")
    large = members.filter("not fits")
    if large.isEmpty():
        return found
    stars = None
    for _ in range(hubs):
        free = large if stars is None else large.join(stars.select(F.col("u").alias("node")), "node", "left_anti")
        best = free.groupBy("gid").agg(F.max_by(F.struct("node", "text"), F.struct("weight", "node")).alias("h"))
        best = best.select("gid", F.col("h.node").alias("hub"), F.col("h.text").alias("hub_text"))
        new = check_hubs(large, best, percent)
        mine = best.select(F.col("hub").alias("u"), F.col("hub").alias("v"))
        stars = stage((new if stars is None else stars.unionByName(new)).unionByName(mine), "stars")
    label = stage(components(stars), "labels")
    rest = check_tiles(with_tiles(large.select("gid", "node", "text"), label, tile, tile_bytes), percent)
    return found.unionByName(stars.filter("u <> v")).unionByName(stage(rest, "links"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, tile: int = TILE, hubs: int = HUBS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """doc_id, keys, n_shingles, class (null for empty sets), component and component_id of every row."""
    narrow = docs.select(*key_columns(id_column, text_column), F.col(text_column).alias("text"))
    signed = stage(signatures(docs, id_column, text_column, percent), "signatures")
    full = signed.filter("n_shingles > 0")
    classes = full.groupBy(F.col("set1").alias("node"), "set2").agg(
        F.min("doc_id").alias("smallest"), F.min(F.struct(*KEY)).alias("k"), F.max("bands").alias("bands"), F.max("n_bytes").alias("n_bytes")
    )
    classes = stage(classes.select("node", "set2", "smallest", F.col("k._k1"), F.col("k._k2"), "bands", "n_bytes"), "classes")
    label = components(links(classes, narrow, percent, tile, hubs, tile_bytes))
    joined = classes.select("node", "smallest").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = stage(joined, "labelled")
    named = joined.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_class = joined.join(named, "component").select(F.col("node").alias("set1"), "component", "component_id")
    result = signed.drop("bands", "set2").join(of_class, "set1", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select("doc_id", *KEY, "n_shingles", F.col("set1").alias("class"), "component", alone.alias("component_id"))


def one_per_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, that stay: the smallest id of each group (nulls last), once;
    rows without words all stay."""
    names = docs.columns
    found = near_duplicates(docs, id_column, text_column, percent)
    empty = found.filter("n_shingles = 0").select(*KEY, F.lit(True).alias("all")).distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)
    best = found.filter("n_shingles > 0").groupBy("component").agg(F.min(order).alias("b"))
    kept = best.select("b._k1", "b._k2", F.lit(False).alias("all")).unionByName(empty)
    plain = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), *key_columns(id_column, text_column))
    joined = plain.join(kept, KEY)
    once = joined.filter(~F.col("all")).dropDuplicates(KEY).unionByName(joined.filter("all"))
    return once.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
