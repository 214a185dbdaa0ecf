"""Figures that grew with the tables: parsing work per record, Python calls per key, what the driver keeps per file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.functions import parse as ps
from ionloom.functions.peaks import to_text
from ionloom.plans import q_normalize
from ionloom.sources import readers as rd
from ionloom.streaming import richest


def test_peak_text_is_that_of_the_formatter(spark):
    numbers = [0.0, -0.0, 1e-7, 9.9e-7, 1e-6, 0.5, 1.000000005, 123.456789125, 1e9, 1e12, -3.25, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([([(a, b) for b in numbers],) for a in numbers], "peaks array<struct<mz:double,intensity:double>>")
    old = F.array_join(F.transform("peaks", lambda p: F.format_string("%.8f %.8f", p["mz"], p["intensity"])), ";")
    assert all(r["new"] == r["old"] for r in rows.select(to_text(F.col("peaks"), ";").alias("new"), old.alias("old")).collect())


def test_a_filter_on_parsed_records_does_not_parse_them_again(spark, tmp_path):
    path = str(tmp_path / "a.msp")
    spark.createDataFrame([("NAME: a\nDB#: 7\n1 2\n3:4 x",), ("NAME: b\nno peaks",)], "value string").coalesce(1).write.option("lineSep", "\n\n").text(path)
    kept = rd.read_msp(spark, path).filter("deletion_reason is null").select("name", "spectrumid", "peaks")
    assert [(r["name"], r["spectrumid"], [tuple(p) for p in r["peaks"]]) for r in kept.collect()] == [("a", "7", [(1.0, 2.0), (3.0, 4.0)])]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Filter" in line and "transform(" in line for line in plan.splitlines()) == 0


def test_lines_and_keys_with_odd_edges(spark):
    text = " NAME : x \r\n\"_Ion mode_\": \"p\"\n\t12 3\r-1:2\n.5 6\n5\n"
    row = spark.createDataFrame([(text,)], "t string").select(ps.lines(F.col("t")).alias("rows"))
    got = row.select("rows", ps.peak_lines(F.col("rows")).alias("p"), ps.clean_entries(ps.msp_entries(ps.metadata_lines(F.col("rows")))).alias("e")).first()
    assert got["rows"] == ["NAME : x", '"_Ion mode_": "p"', "12 3", "-1:2", ".5 6", "5"] and got["p"] == ["12 3", "-1:2"]
    assert [tuple(e) for e in got["e"]] == [("name", "x"), ("ion mode", "p")]


def test_heads_of_json_files_keep_no_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text("[" + '{"a": "' + "x" * 200_000 + '"}]')
    (tmp_path / "b.json").write_text(" " * 5000 + "\n" + '{"a": "b"}')
    heads = rd.file_heads(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], first_char_only=True)
    assert [h.first_char for h in heads] == ["[", "{"] and all(len(h.header) <= rd.HEAD_BYTES for h in heads) and heads[0].header == ""


def test_inchi_layers_use_more_than_one_task(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    out = q_normalize.inchi_layers(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_streamed_states_are_bounded_in_number(spark, tmp_path):
    """Many keys share a state; still a change is emitted for every key, once."""
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    rows = spark.range(9000).select(F.concat(F.lit("S"), F.col("id") % 6000).alias("splash"), F.lit("K").alias("inchikey"), (F.col("id") % 7).alias("size"), F.col("id").alias("record_id"))
    rows.write.parquet(source)
    sink = richest.richest_changes(spark.readStream.schema(richest.CHANGES).parquet(source)).writeStream.format("parquet").option("path", log)
    query = sink.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= richest.BUCKETS
    got = {r["splash"]: r["record_id"] for r in spark.read.schema(richest.CHANGES).parquet(log).collect()}
    want = {f"S{n}": max((n, n + 6000) if n < 3000 else (n,), key=lambda i: (i % 7, -i)) for n in range(6000)}
    assert got == want
