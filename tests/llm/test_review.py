"""Cases that reviews asked for: colliding polynomials, odd columns, hot keys, large files."""

from __future__ import annotations

import gzip
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from ionloom.llm import components as cc
from ionloom.llm import decontam, minhash, mixing, quality, warc
from ionloom.llm import kernels as kn
from tests.llm.helpers import prose, words


def thue_morse(n: int, flip: bool = False) -> str:
    """Two texts of `n` letters that polynomials modulo a power of two can't tell apart."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_that_polynomials_confuse_stay_apart(spark):
    a, b = thue_morse(1024), thue_morse(1024, True)
    text = f"{a}\n{b}\n{a}"
    row = quality.quality_rules(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row["n_dup_lines"] == 1
    rows = [(1, a), (2, b), (3, a)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 2, 3: 1}


def test_slice_hashes_follow_the_bytes_alone():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    starts = rng.integers(0, 3500, 3000)
    ends = np.minimum(starts + rng.integers(0, 500, 3000), 4000)
    ends[:500] = starts[:500] + rng.integers(0, 12, 500)
    by_bytes: dict[bytes, int] = {}
    for a, b, h in zip(starts, ends, kn.slice_hashes(data, starts, ends).tolist(), strict=True):
        assert by_bytes.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(by_bytes.values())) == len(by_bytes)


def test_the_end_of_a_long_text_is_judged(spark):
    good = prose(5, 3000)
    noise = "".join(chr(33 + int(x)) for x in np.random.default_rng(2).integers(0, 90, 1000))
    cut = good.encode()[: 2048 * 6].decode(errors="ignore")
    df = spark.createDataFrame([(1, cut + " " + noise), (2, cut + " " + "ha " * 333), (3, cut)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    assert rows[3]["chunk_low"] > rows[2]["chunk_low"]
    assert rows[1]["chunk_high"] > rows[3]["chunk_high"]


def test_map_columns_are_mixed_too(spark):
    rows = [(i, prose(i, 40), "en", f"s{i % 2}", {"a": str(i)}) for i in range(12)]
    rows += [(0, rows[0][1], "en", "s0", {"a": "other"}), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, facts map<string,string>")
    assert mixing.mixture(df).count() == len(rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert {r["facts"]["a"] for r in out.collect()} <= {str(i) for i in range(12)} | {"other"}
    assert mixing.mixed_blocks(df).agg(F.sum("n_words")).first()[0] == sum(len(words(r["text"])) for r in out.collect())


def test_windows_with_one_rarest_word_are_cut_into_chunks(spark):
    """Forty windows share a word; chunks of four windows find what one finds."""
    items = [(f"i{k}", " ".join(f"w{k}x{j}" if j != 4 else "zebra" for j in range(10))) for k in range(40)]
    docs = [(k, f"before {items[k][1]} after") for k in range(0, 40, 3)] + [(99, "zebra zebra"), (100, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    pick = lambda rows: sorted((r["doc_id"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in rows.collect())
    small = pick(decontam.contamination(d, b, rows=4))
    assert small == pick(decontam.contamination(d, b))
    assert sum(r[2] for r in small) == 14
    sizes = [c.count() for c in decontam.chunks(b.select(F.col("text").alias("window")), "window", 4)]
    assert len(sizes) == 10 and sum(sizes) == 40


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 64)
    monkeypatch.setattr(warc, "FILE_BYTES", 64 * 1000)
    pages = [(i, f"http://a.b/{i}", "x" * (100_000 if i % 10 == 0 else 500) + str(i)) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(1)
    path = str(tmp_path / "warc")
    merged = warc.capture_histories(df, path)
    assert {r["page_id"]: r["payload_bytes"] for r in merged.collect()} == {i: len(h) for i, _, h in pages}
    for file in Path(path).glob("*.gz"):
        assert len(gzip.decompress(file.read_bytes())) < 64 * 1000 + 101_000


def test_revisits_name_the_record_they_repeat(spark, tmp_path):
    html = "y" * 2000
    df = spark.createDataFrame([(1, "http://a/1", html), (2, "http://a/2", html), (3, "http://a/3", "z")], "page_id bigint, url string, html string")
    warc.capture_histories(df, str(tmp_path / "w"))
    text = "".join(gzip.decompress(f.read_bytes()).decode() for f in Path(tmp_path / "w").glob("*.gz"))
    ids = {line.split(": ")[1] for line in text.split("\r\n") if line.startswith("WARC-Record-ID")}
    named = [line.split(": ")[1] for line in text.split("\r\n") if line.startswith("WARC-Refers-To:")]
    assert len(named) == 1 and named[0] in ids


def test_hot_star_nodes_are_split(spark):
    """A node with most edges: its partition is split, as the lowest neighbours are read as they lie."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16",
    }
    kept = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(80_000).select((F.col("id") + 1).alias("u"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 999).cast("long").alias("v")).repartition(8)
        out, low = cc.large_star(edges)
        low.count()
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
