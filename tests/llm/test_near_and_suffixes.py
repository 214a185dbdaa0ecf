"""MinHash components and repeated strings against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionloom.llm import kernels as kn
from ionloom.llm import minhash, q_corpus, suffixes
from ionloom.llm.components import components
from tests.llm.helpers import SF_DIR, awkward, awkward_rows, covered, near_components, prose, shingles, words


def test_minhash_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    want = dict(zip((d for d, _ in docs), near_components(docs), strict=True))
    sizes = {d: len(shingles(t)) for d, t in docs}
    rows = q_corpus.op6_minhash(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    assert all((r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], sizes[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]) for r in rows)


def test_minhash_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    got = minhash.near_duplicates(awkward(spark)).collect()
    want = [(d, len(shingles(t)), c) for (d, t), c in zip(rows, near_components(rows), strict=True)]
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == sorted(map(repr, want))
    kept = minhash.one_per_group(awkward(spark))
    assert kept.columns == awkward(spark).columns
    empty = sum(not shingles(t) for _, t in rows)
    groups = {c for (_, t), c in zip(rows, near_components(rows), strict=True) if shingles(t)}
    assert kept.count() == empty + len(groups)
    assert minhash.near_duplicates(awkward(spark).limit(0)).count() == 0


def edited(rng: random.Random, base: list[str], edits: int) -> str:
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_large_group_by_hubs_and_tiles(spark):
    """Groups above the tile size: near copies around a hub, with members that only chain to others."""
    rng = random.Random(4)
    base = prose(11, 150).split()
    docs = [(i, edited(rng, base, rng.choice([0, 1, 2, 3, 4, 5, 6]))) for i in range(120)]
    docs += [(200 + i, edited(rng, prose(12, 60).split(), rng.choice([0, 1, 2]))) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame, tile=16).collect()}
    assert got == dict(zip((d for d, _ in docs), near_components(docs), strict=True))


def test_repeated_rows_and_bytes_are_bounded_in_tiles(spark, monkeypatch):
    """Rows that repeat id and text reach the tiles once, and a group of few but long texts is cut by its bytes."""
    rng = random.Random(6)
    base = prose(13, 150).split()
    docs = [(i, edited(rng, base, rng.choice([0, 1, 2, 3, 4]))) for i in range(40)] + [(None, " ".join(base) + " end")] * 300
    real, seen = minhash.check_tiles, []
    monkeypatch.setattr(minhash, "check_tiles", lambda tiles, percent: seen.append(tiles.groupBy("gid", "tile").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()) or real(tiles, percent))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    for tile_bytes in (minhash.TILE_BYTES, 16_000):
        seen.clear()
        got = minhash.near_duplicates(frame, tile_bytes=tile_bytes).collect()
        assert sorted(repr((r["doc_id"], r["component_id"])) for r in got) == sorted(repr((d, c)) for (d, _), c in zip(docs, near_components(docs), strict=True))
        assert all(r["n"] <= 41 for rows in seen for r in rows)
    assert all(r["b"] <= 2 * 16_000 for rows in seen for r in rows)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    for n in (3, 40, 2000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.r_[a[: n * 2 // 3], rng.integers(0, 2**63, n - n * 2 // 3).astype(np.uint64)]
        equal = (minhash.sketch(np.unique(a), 400) == minhash.sketch(np.unique(b), 400)).mean()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(equal - true) < 0.15
        assert (minhash.sketch(np.unique(a)) > 0).sum() >= minhash.COORDINATES - 1


def test_components_of_chains(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def brute_removed(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc, _), t, mask in zip(rows, texts, covered(texts, length), strict=True):
        kept = bytes(c for c, m in zip(t, mask, strict=True) if not m)
        out.append((doc, len(t), sum(mask), len(re.findall(rb"\x01+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return out


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = q_corpus.op1_suffix_dedup(spark, SF_DIR).collect()
    assert sorted(map(tuple, got)) == sorted(brute_removed(rows, suffixes.LENGTH))


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_suffixes_awkward_rows(spark, hot):
    rng = random.Random(8)
    base = prose(21, 400)
    rows = [(r[0], r[1]) for r in awkward_rows()]
    for i in range(25):
        a = rng.randrange(len(base) - 300)
        rows.append((50 + i, prose(30 + i, 12) + base[a : a + rng.randrange(40, 300)] + prose(60 + i, 9) + base[rng.randrange(900) :][:70]))
    frame = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id bigint, text string, spans string")
    got = suffixes.without_repeats(frame, length=60, gram=24, hot=hot).select(*COLUMNS).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, brute_removed(rows, 60)))
    assert suffixes.without_repeats(frame.limit(0), length=60, gram=24).count() == 0


def test_multikey_quicksort_is_byte_order():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(500)]
    table = suffixes.as_words(strings, max(map(len, strings)))
    order = suffixes.multikey_quicksort(table)
    padded = [s.ljust(table.shape[1] * 8, b"\0") for s in strings]
    assert [padded[i] for i in order] == sorted(padded)
    lcp = suffixes.neighbour_prefixes(table, order)
    for k in range(1, len(order)):
        a, b = padded[order[k - 1]], padded[order[k]]
        assert lcp[k] == next((i for i in range(len(a)) if a[i] != b[i]), len(a))


def test_words_match_the_pattern():
    texts = [r[1] for r in awkward_rows()] + ["a\x0bb\x0cc\rd", " lead", "trail ", "\x1cnot blank"]
    for _, data, offsets in kn.blocks(pa.array(texts), size=50):
        starts, ends, rows = kn.words(data, offsets)
        for row in range(len(offsets) - 1):
            text = bytes(data[offsets[row] : offsets[row + 1]]).decode()
            assert [bytes(data[a:b]) for a, b, r in zip(starts, ends, rows, strict=True) if r == row] == words(text)
