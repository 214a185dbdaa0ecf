"""Work that grew with files and records: calls of the driver per file, searches per field, patterns per layer, disk for texts."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F


from ionloom.functions import inchi as ic
from ionloom.functions import parse as ps
from ionloom.plans import q_files, q_normalize
from ionloom.session import shared_dir
from ionloom.sources import readers as rd


def _objects(k: int) -> list[dict]:
    return [{"Name": f"n{k}-{i}", "peaks": [[i + 1.0, 2.0]]} for i in range(3)]


def test_many_json_files_are_told_apart_without_calls_per_file(spark, tmp_path, monkeypatch):
    """Arrays, lines, broken arrays, blank and odd files, more than the driver looks into."""
    monkeypatch.setattr(rd, "DRIVER_FILES", 4)
    heads = []
    monkeypatch.setattr(rd, "head_bytes", lambda *a: heads.append(a))
    monkeypatch.setattr(rd, "path_of", lambda spark, uri: heads.append(uri))
    texts = []
    for k in range(12):
        own = [json.dumps(o) for o in _objects(k)]
        array = "[" + ", ".join(own) + "]"
        texts.append([array, "\n".join(own), "﻿ \n" + array, array[:-2]][k % 4])
    for k, text in enumerate([*texts, "", " \n ", "}[", " [" + json.dumps({"Name": "wide", "peaks": [[1, 2]]}) + "]"]):
        (tmp_path / f"part={k}").mkdir()
        (tmp_path / f"part={k}" / "a b.json").write_text(text, encoding="utf-8")
    rows = rd.read_json(spark, str(tmp_path)).select("name", "deletion_reason").collect()
    kept = sorted(r["name"] for r in rows if r["deletion_reason"] is None)
    want = [o["Name"] for k in range(12) for o in (_objects(k)[:2] if k % 4 == 3 else _objects(k))]
    assert kept == sorted([*want, "wide"]) and len(rows) - len(kept) == 4
    assert heads == []


def test_large_broken_files_among_many_are_read_too(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rd, "DRIVER_FILES", 2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400b")
    try:
        for k in range(4):
            n = 40 if k % 2 else 2
            text = "[" + ",".join(json.dumps({"Name": f"n{k}-{i}", "peaks": [[1, 2]]}) for i in range(n))
            (tmp_path / f"{k}.json").write_text(text + ("]" if k > 2 else ""))
        names = [r["name"] for r in rd.read_json(spark, str(tmp_path)).filter("deletion_reason is null").select("name").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(names) == sorted(f"n{k}-{i}" for k in range(4) for i in range(40 if k % 2 else 2))


def test_layers_are_read_once_for_all_facts_of_an_inchi(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    out = q_normalize.inchi_layers(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InChI=1S?/.*?") == 1 and out.filter("exactmass is null or averagemass is null").count() == 0


def test_facts_of_odd_inchis(spark):
    texts = [None, "", "x", "InChI=1S/CH4/i1+1\n", "InChI=1S/CH4/i1D,", "InChI=1S/CH4/i1+1?", "InChI=1S/CH4/i9+1", "InChI=1S/C2H6.ClH/i;1+2/hD,", "InChI=1/CH4/p+1/f/q-1", "InChI=1/CH4/p+1/fCH3/h1H"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ic.facts(F.col("t")).alias("f"), F.round(ic.inchi_mass(F.col("t")), 4).alias("m"))
    got = [(r["f"]["formula"], r["f"]["protons"], r["f"]["charge"], r["m"]) for r in rows.coalesce(1).collect()]
    assert got[:3] == [(None, 0, None, None)] * 3 and got[4] == ("CH4", 0, 0, 17.0376) and got[5] == ("CH4", 0, 0, None) and got[6] == ("CH4", 0, 0, None)
    assert got[7] == ("C2H6.ClH", 0, 0, round(30.046950192 + 1.0078250322 + 36.965902602 + 1.0062767, 4)) and got[8] == ("CH4", 1, -1, 16.0313) and got[9] == ("CH3", 1, 1, 16.0313)


def test_names_are_searched_among_those_of_their_length(spark):
    synonyms = {"name": ["name", "nom", "ab", "é"], "rt": ["rt", "ab", "", "zeit"], "formula": ["a long name of a field"]}
    named = [(n, c) for c, names in synonyms.items() for n in names]
    keys = [None, "", "a", "é", "rt", "ab", "nom", "xx", "xxx", "name", "zeit", "a long name of a field", "a longer name of any field", "xxxxxxxxxx", *[n for n, _ in named]]
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    old = F.get(F.lit([c for _, c in named]), F.array_position(F.lit([n for n, _ in named]), F.col("k")).cast("int") - 1)
    got = rows.select("k", ps.canonical_key(F.col("k"), synonyms).alias("new"), old.alias("old"))
    assert [r for r in got.collect() if r["new"] != r["old"]] == []
    assert "length(" in got._jdf.queryExecution().analyzed().toString()


def _tables(spark, folder) -> str:
    rows = [(n, n % 3, 500.0 + n, "O", "5-LOW") for n in range(1, 9)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(n, f"Customer#{n}") for n in range(3)], "c_custkey bigint, c_name string").write.parquet(f"{folder}/customer.parquet")
    items = [(n, 100.0 * k, 30.0 + k) for n in range(1, 8) for k in range(1, 4)]
    spark.createDataFrame(items, "l_orderkey bigint, l_extendedprice double, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def _new_files(spark, run) -> tuple[list, list[str]]:
    folder = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(folder.rglob("part-*"))
    rows = run().collect()
    return rows, [str(f) for f in folder.rglob("part-*") if f not in before]


def test_separator_libraries_and_their_records_lie_packed(spark, tmp_path):
    rows, files = _new_files(spark, lambda: q_files.read_msp_separators(spark, _tables(spark, tmp_path)))
    assert sorted((r["layout"], r["record_id"]) for r in rows) == sorted((x, n) for x in ("blanks", "mixed", "several") for n in range(1, 8))
    assert {r["name"] for r in rows} == {"Customer#0", "Customer#1", "Customer#2"}
    texts, records = [f for f in files if "/separators-" in f], [f for f in files if "/records-" in f]
    assert texts and all(f.endswith(".txt.gz") for f in texts) and records and all(".zstd." in f for f in records)


def test_ingested_libraries_lie_packed(spark, tmp_path):
    rows, files = _new_files(spark, lambda: q_files.ingest_all(spark, _tables(spark, tmp_path)))
    assert sorted((r["spectrumid"], r["copies"], r["peaks"]) for r in rows) == sorted((f"SP{n}", 4, 12) if n < 8 else (f"SP{n}", 2, 0) for n in range(1, 9))
    texts = [f for f in files if any(f".{kind}/" in f for kind in ("msp", "mgf", "json", "csv"))]
    assert texts and all(f.endswith(".gz") for f in texts)
