"""Work per spectrum that set the time of a run: fields behind the shuffle, splash terms once, one pattern per text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.functions import text as tx
from ionloom.functions.splash import splash
from ionloom.plans import fixture as fx


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fields_of_raw_spectra_are_derived_after_the_shuffle(spark, tmp_path):
    rows = [(1, 7, 500.0, "P", "1-URGENT"), (2, 8, 250.0, "O", "5-LOW"), (2, 7, 250.0, "O", "5-LOW"), (None, 7, 1.0, "F", "5-LOW")]
    orders = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string, o_orderpriority string")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(7, "Customer#7")], "c_custkey bigint, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    items = spark.createDataFrame([(2, 100.0, 1.0), (2, 50.0, 3.0), (None, 50.0, 3.0)], "l_orderkey bigint, l_extendedprice double, l_quantity double")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    raw = fx.spectra_raw(spark, str(tmp_path))
    got = sorted((r["record_id"] or 0, r["name"], [tuple(p) for p in r["peaks"]]) for r in raw.collect())
    assert got == [(0, "Customer#7", []), (1, "Customer#7", []), (2, "", [(1.0, 3.0), (2.0, 1.0)]), (2, "Customer#7", [(1.0, 3.0), (2.0, 1.0)])]
    assert raw.columns == ["record_id", *[c for c in fx.HEADER if c != "record_id"], "peaks"]
    above, below = _plan(raw).split("RepartitionByExpression")
    assert "md5(" in above and "md5(" not in below


def test_the_terms_of_a_splash_are_written_once(spark):
    peaks = spark.createDataFrame([([(100.0, 5.0)],)], "peaks array<struct<mz:double,intensity:double>>")
    # The slice of the strongest ions: every further one is evaluated again for every spectrum.
    assert peaks.select(splash(F.col("peaks")).alias("s"))._jdf.queryExecution().analyzed().toString().count("slice(") == 1


def test_empty_words_are_found_by_one_pattern(spark):
    words = [*tx.EMPTY_WORDS, "UnKnown", "un\u212anown", "UN\u212a", "N/A", "nothing", "x1", "0.00", "0x0", ".", "", " ", "\u0130", "ccs", "\u017fnan"]
    texts = [None, *[a + b for a in words for b in ("", " ", " 5 eV", "\n", " \n", "\tx", " x\ny", "\r", " \r", "\u00a0x")], *[" " + a for a in words]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    word = F.lower(F.substring_index("t", " ", 1))
    empty = word.isin([w.lower() for w in tx.EMPTY_WORDS]) & ~F.contains("t", F.lit("\n"))
    got = rows.select("t", tx.normalize_empty(F.col("t")).alias("new"), F.when((F.col("t") != "") & ~empty, F.col("t")).alias("old"))
    assert [r["t"] for r in got.collect() if r["new"] != r["old"]] == []
    assert "substring_index" not in got.select("new")._jdf.queryExecution().analyzed().toString().split("AS old")[0].split("AS new")[0]
