"""Quality rules, sharding, mixing and decontamination."""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter, defaultdict

import pytest
import zstandard

from ionloom.llm import decontam, mixing, q_corpus, quality, sharding
from pyspark.sql import functions as F
from tests.llm.helpers import SF_DIR, awkward, awkward_rows, benchmark_words, prose, words


def brute_quality(text):
    text = text or ""
    w, data = words(text), text.encode()
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    pack = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    good = True
    if data:
        low, high = quality.band(len(data))
        good = low <= len(pack(data)) / len(data) <= high
        if len(data) > quality.CHUNK:
            parts = [data[i : i + quality.CHUNK] for i in range(0, len(data), quality.CHUNK)]
            parts[-1] = data[-quality.CHUNK :]
            low, high = quality.band(quality.CHUNK - 1)
            good &= all(low <= len(pack(p)) / len(p) <= high for p in parts)
    chars = sum(len(x.decode()) for x in w)
    return (len(w), chars, sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat), failed, good and not failed)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_quality_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = q_corpus.op7_quality_rules(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[f] for f in FIELDS) == brute_quality(texts[r["doc_id"]])


def test_quality_awkward_rows(spark):
    df = awkward(spark)
    got = sorted(repr(tuple(r[f] for f in ("doc_id", *FIELDS))) for r in quality.quality_rules(df.drop("n_words", "kept")).collect())
    assert got == sorted(repr((r[0], *brute_quality(r[1]))) for r in awkward_rows())
    kept = quality.good_documents(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(brute_quality(r[1])[-1] for r in awkward_rows())
    assert quality.good_documents(df.limit(0)).count() == 0


def test_bands_reject_what_prose_is_not(spark):
    noise = base64.b64encode(b"".join(hashlib.sha512(str(i).encode()).digest() for i in range(80))).decode()
    good = prose(5, 900)
    texts = [("prose", good), ("noise in prose", good[:4096] + noise + good[4096:]), ("repeats", "lorem ipsum dolor sit amet " * 300)]
    reasons = {r["doc_id"]: r["reason"] for r in quality.quality_rules(spark.createDataFrame(texts, "doc_id string, text string")).collect()}
    assert reasons["prose"] is None and "incompressible" in reasons["noise in prose"] and reasons["repeats"] == "repetitive"


def brute_table(shards, slots):
    """Each shard's whole preference list, claimed turn by turn."""
    prefer = {}
    for i, (name, _) in enumerate(shards):
        a, b = (int.from_bytes(hashlib.sha256(f"{kind} {name}".encode()).digest()[:8], "big") for kind in ("offset", "step"))
        prefer[i] = iter([(a % slots + k * (b % (slots - 1) + 1)) % slots for k in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i, (_, weight) in enumerate(shards):
            for _ in range(weight):
                if len(owner) < slots:
                    owner[next(s for s in prefer[i] if s not in owner)] = i
    return [owner[s] for s in range(slots)]


def test_lookup_table():
    shards = (("a", 1), ("b", 2), ("c", 1))
    owner = sharding.lookup_table(shards, 1009)
    assert owner == brute_table(shards, 1009)
    count = Counter(owner)
    assert abs(count[1] - 2 * count[0]) <= 2 and abs(count[0] - count[2]) <= 1
    fewer = sharding.lookup_table(shards[:2], 1009)
    stay = sum(a == b for a, b in zip(owner, fewer, strict=True) if a != 2) / sum(a != 2 for a in owner)
    assert stay > 0.75
    for bad in (1000, 2):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, bad)


def test_sharding_awkward_rows(spark):
    df = awkward(spark)
    placed = sharding.shard_rows(df).collect()
    assert len(placed) == len(awkward_rows()) and all(0 <= r["slot"] < sharding.SLOTS for r in placed)
    by_id = defaultdict(set)
    for r in placed:
        by_id[(r["doc_id"], r["text"] if r["doc_id"] is None else "")].add(r["shard"])
    assert all(len(s) == 1 for s in by_id.values())
    assert sharding.shard_rows(df.limit(0)).count() == 0


def brute_targets(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, left, active = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and active:
        total, excess = sum(weight[n] for n in active), 0.0
        for n in list(active):
            target[n] += left * weight[n] / total
            if target[n] >= 2 * sizes[n]:
                excess += target[n] - 2 * sizes[n]
                target[n] = 2.0 * sizes[n]
                active.discard(n)
        left = excess
    return target


@pytest.mark.parametrize("awkward_input", [False, True])
def test_mixing(spark, awkward_input):
    docs = awkward(spark) if awkward_input else spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = mixing.mixture(docs, block=16).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len(words(r["text"]))
    target, taken = brute_targets(sizes), defaultdict(int)
    assert len(rows) == docs.count()
    for r in rows:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mixture(docs.repartition(3), block=16).collect()))
    blocks = mixing.mixed_blocks(docs, block=16).collect()
    assert sum(b["n_words"] for b in blocks) == sum(taken.values())
    assert all(len(words(b["text"])) == b["n_words"] <= 16 for b in blocks)
    cut = mixing.mixed_documents(docs, block=16)
    assert cut.columns == docs.columns
    assert sum(len(words(r["text"])) for r in cut.collect()) == sum(taken.values())


def test_mixing_empty_table(spark):
    assert mixing.mixture(awkward(spark).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    images = mixing.permute(range(n), n, 12345)
    assert sorted(images) == list(range(n))
    assert list(mixing.permute(images, n, 12345, inverse=True)) == list(range(n))


def test_shard_counts_do_not_depend_on_tasks():
    whole = []
    for first in range(0, 200, mixing.TASK_SHARDS):
        before, counts = mixing.shard_counts(5000, 200, 3, first, min(first + mixing.TASK_SHARDS, 200))
        assert before == sum(whole)
        whole += list(counts)
    assert sum(whole) == 5000 and len(whole) == 200


def brute_contamination(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = benchmark_words(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            windows[tuple(w[i : i + size])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = benchmark_words(text), set(), set()
        for k in {len(g) for g in windows}:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[g]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [
    (1, prose(1, 14)), (2, prose(1, 14)), (2, prose(9, 3)), (None, "One"), (3, None), (4, "?!"), (5, "ab ab ab ab ab ab ab ab ab ab"), (6, prose(2, 9)),
]


@pytest.mark.parametrize("rows", [250_000, 3])
def test_decontamination_awkward_rows(spark, rows):
    docs = awkward(spark)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontam.contamination(docs, items, rows=rows).drop("_k1", "_k2").collect()
    want = brute_contamination([(r[0], r[1]) for r in awkward_rows()], ITEMS)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    clean = decontam.clean_documents(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)
    nothing = decontam.contamination(docs, items.limit(0))
    assert nothing.count() == len(awkward_rows()) and nothing.filter("contaminated").count() == 0
    assert decontam.contamination(docs.limit(0), items).count() == 0


def test_native_plans_run_no_python(spark):
    for name in ("op5_surrogates", "op8_licenses", "op9_decontamination", "op10_sharding"):
        plan = q_corpus.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_slot_text_is_portable(spark):
    row = spark.range(1).select(sharding.slot_of(F.lit("7")).alias("s")).first()
    assert row["s"] == int(hashlib.md5(b"7").hexdigest()[:13], 16) % sharding.SLOTS
