"""Skewed keys, replays and plan shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.operators import dedup as dd
from ionloom.operators.joins import SALTS, lookup_join
from ionloom.plans import q_denovo, q_library, q_peaks
from ionloom.schema import PEAKS_TYPE, Params

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def hot_frame(spark, n=3000):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(n).select(F.col("id").alias("record_id"), key.alias("k"))


def test_salted_join_equals_plain_join(spark):
    left = hot_frame(spark)
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("k5", 3), (None, 9)], "k string, v int")
    for how in ("left", "left_semi", "left_anti"):
        plain = left.join(right, "k", how).select(sorted(set(left.columns) | ({"v"} if how == "left" else set())))
        salted = lookup_join(left, right, "k", how, at_least=10).select(plain.columns)
        assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_hot_key_is_spread(spark):
    spread = hot_frame(spark).filter("k = 'hot'").select(F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).alias("s"))
    counts = [r["count"] for r in spread.groupBy("s").count().collect()]
    assert len(counts) == SALTS and max(counts) < 60


def test_duplicates_with_one_huge_group(spark):
    """A third of all rows shares one key; one row of it stays, the richest, else the oldest."""
    rows = spark.range(900).select(
        F.col("id").alias("record_id"),
        F.when(F.col("id") % 3 == 0, "S").otherwise(F.concat(F.lit("S"), "id")).alias("splash"),
        F.when(F.col("id") % 90 == 1, "").otherwise("KEY").alias("inchikey"),
        F.when(F.col("id").isin(300, 600), "longer").otherwise("x").alias("comment"),
        F.array().cast(PEAKS_TYPE).alias("peaks"),
    )
    kept = dd.dedup_keep_richest(rows)
    assert [r["record_id"] for r in kept.filter("splash = 'S'").collect()] == [300]
    assert kept.count() == 601
    assert dd.dedup_rejects(rows).count() == 299


def test_replayed_batch_changes_nothing(spark, tmp_path):
    from ionloom.plans.pipeline import Lookups
    from ionloom.sources.lookups import adduct_table
    from ionloom.streaming.incremental import library_stream, start_curation

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.msp").write_text("NAME: a\n50 1\n60 2\n\nNAME: b\n50 1\n61 2\n")
    lookups, params = Lookups(adduct_table(spark)), Params(csv=False, json=False)

    def go(checkpoint):
        start_curation(library_stream(spark, source), out, str(tmp_path / checkpoint), lookups, params).awaitTermination()
        rejects = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/REJECTS")
        keys = spark.read.parquet(f"{out}/REGISTRY")
        return sorted((r["NAME"], r["batch_id"]) for r in rejects.collect()), sorted(r["batch_id"] for r in keys.collect())

    assert go("c1") == ([("a", 0), ("b", 0)], [0, 0])
    # A new checkpoint makes the same files batch 0 again, as after a crash before the commit.
    assert go("c2") == ([("a", 0), ("b", 0)], [0, 0])


def test_no_cartesian_products(spark):
    for query in (q_library.enrich, q_library.incremental_new, q_library.dedup_keep_richest, q_denovo.annotated_peaks):
        plan = plan_of(query(spark, SF_DIR))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(q_peaks.splash(spark, SF_DIR))
    assert "o_totalprice" not in plan and "l_tax" not in plan


def test_cleaning_is_one_narrow_stage(spark):
    from ionloom.operators.clean import accept_spectra, require_peaks

    schema = f"record_id bigint, filename string, instrumenttype string, precursormz string, peaks {PEAKS_TYPE}, deletion_reason string"
    df = spark.createDataFrame([(1, "f", "LC", "200", [(60.0, 1.0)], None)], schema)
    assert "Exchange" not in plan_of(accept_spectra(require_peaks(df)))


def pipeline_input(spark):
    from ionloom.plans import fixture as fx
    from ionloom.plans.pipeline import fingerprint

    return fingerprint(fx.spectra_raw(spark, SF_DIR).drop("source"))


def test_describe_reads_each_table_once_per_lookup(spark):
    from ionloom.operators.clean import accept_spectra, require_peaks
    from ionloom.plans import fixture as fx
    from ionloom.plans.pipeline import Lookups, describe
    from ionloom.session import stage
    from ionloom.sources.lookups import adduct_table

    compounds = stage(fx.compounds(spark, SF_DIR), "compounds")
    ontologies = stage(fx.ontologies(spark, SF_DIR), "ontologies")
    spectra = pipeline_input(spark)
    cleaned = stage(accept_spectra(require_peaks(spectra)), "cleaned")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plan_of(describe(cleaned, Lookups(adduct_table(spark), compounds=compounds, ontologies=ontologies)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert plan.count("FileScan") <= 6
    assert plan.count("Exchange") - plan.count("ReusedExchange") <= 12


def test_null_keys_are_spread(spark):
    """A third of the keys is NULL: their rows get join keys of their own."""
    from ionloom.operators.joins import null_apart

    keys = hot_frame(spark).select(null_apart("k", "record_id").alias("j"), "k").filter("k is null")
    assert keys.select("j").distinct().count() == keys.count()
    left = hot_frame(spark)
    right = spark.createDataFrame([("hot", 1), ("k2", 2), (None, 9)], "k string, v int")
    for how in ("left", "left_semi", "left_anti"):
        plain = left.join(right, "k", how)
        ours = lookup_join(left, right, "k", how).select(plain.columns)
        assert ours.exceptAll(plain).count() == 0 and plain.exceptAll(ours).count() == 0


def test_run_that_broke_off_is_repeated(spark, tmp_path, monkeypatch):
    """Outputs written but nothing registered: the next run has the same number and replaces them."""
    from ionloom.plans import pipeline as pl
    from ionloom.sources import readers as rd
    from ionloom.sources.lookups import adduct_table

    record = (
        "NAME: s{k}\nPRECURSORMZ: {mz}\nPRECURSORTYPE: M+H\nIONMODE: P\nINSTRUMENTTYPE: LC-ESI-QTOF\n"
        "INCHIKEY: AAAAAAAAAAAAA{letter}\nINCHI: InChI=1S/C6H12O6/c1\nSMILES: C(C1CO)OC\n60.1 10\n70.2 8\n80.3 {k}\n"
    )
    path = tmp_path / "in.msp"
    path.write_text("\n".join(record.format(k=k, mz=200 + k, letter=chr(65 + k)) for k in range(3, 8)))
    out, lookups, params = str(tmp_path / "out"), pl.Lookups(adduct_table(spark)), Params(csv=False, json=False)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(pl.wr, "append_registry", broken)
        try:
            pl.run(spark, [str(path)], out, lookups, params)
        except RuntimeError:
            pass
    assert rd.read_msp(spark, f"{out}/MSP").count() == 5
    pl.run(spark, [str(path)], out, lookups, params)
    assert rd.read_msp(spark, f"{out}/MSP").count() == 5
    pl.run(spark, [str(path)], out, lookups, params)
    assert rd.read_msp(spark, f"{out}/MSP").count() == 5
    assert {r["batch_id"] for r in spark.read.parquet(f"{out}/REGISTRY").collect()} == {0}


def test_fragment_search_of_a_large_formula(spark):
    """Only heavy atoms are enumerated; the hits are those of the whole lattice."""
    from ionloom.operators import denovo as dn

    schema = "record_id bigint, formula string, peaks array<struct<mz:double,intensity:double>>"
    large = spark.createDataFrame([(1, "C60H90N10O30S2", [(400.0 + 7 * k, 1.0) for k in range(150)])], schema)
    heavy = dn.heavy_compositions(dn.parse_formula(large), dn.largest_targets(large))
    assert heavy.count() < 200_000
    assert dn.match_hydrogens(dn.peak_targets(large), heavy).count() < 200_000
    small = spark.createDataFrame([(1, "C9H13N3O5S", [(30.0 + 0.013 * k, 1.0) for k in range(4000)]), (2, "CHCl3", [(84.9611, 1.0)])], schema)
    wide = Params(ppm_tolerance=300.0)
    formulas, limits, targets = dn.parse_formula(small), dn.largest_targets(small, wide), dn.peak_targets(small, wide)
    columns = ["formula", "mz", "error_ppm", "mass", *[f"n_{s}" for s in dn.HEAVIEST_FIRST]]
    whole = dn.annotate_range_join(targets, dn.subformula_candidates(formulas, limits).filter(dn.plausible())).select(columns)
    ours = dn.match_hydrogens(targets, dn.heavy_compositions(formulas, limits)).select(columns)
    assert whole.count() > 50
    assert whole.exceptAll(ours).count() == 0 and ours.exceptAll(whole).count() == 0


def test_streamed_curation_equals_the_batch_run(spark, tmp_path):
    """All formats and rejects: one micro-batch gives what one run gives, row by row; a second adds what is new."""
    from ionloom.plans.pipeline import Lookups, run
    from ionloom.sources.lookups import adduct_table
    from ionloom.streaming.incremental import library_stream, start_curation

    record = "NAME: s{k}\nPRECURSORMZ: {mz}\nPRECURSORTYPE: M+H\nIONMODE: P\nINSTRUMENTTYPE: LC-ESI-QTOF\nINCHIKEY: AAAAAAAAAAAAA{c}\nSMILES: C(C1CO)OC\n60.1 10\n70.2 8\n80.3 {k}\n"
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.msp").write_text("\n".join(record.format(k=k, mz=200 + k, c=chr(65 + k)) for k in (3, 4, 4, 5)) + "\nNAME: empty\n")
    (source / "b.mgf").write_text("BEGIN IONS\nNAME=g\nPEPMASS=300\nION=x\n60.1 1\n70.1 9\n80.1 5\nEND IONS\n")
    (source / "c.json").write_text('[{"name": "j", "peaks": [[60.5, 1], [61.5, 2], [62.5, 3]], "smiles": "CC"}]')
    lookups = Lookups(adduct_table(spark))

    def outcome(out):
        sides = {"kept": f"{out}/CSV", "rejected": f"{out}/REJECTS"}
        rows = {}
        for side, path in sides.items():
            table = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path)
            rows[side] = sorted(tuple(str(r[c]) for c in sorted(table.columns)) for r in table.collect())
        return rows

    params = Params(msp=False, json=False)
    run(spark, [str(source)], str(tmp_path / "batch"), lookups, params)
    stream = str(tmp_path / "stream")

    def advance():
        start_curation(library_stream(spark, str(source)), stream, str(tmp_path / "checkpoint"), lookups, params).awaitTermination()

    advance()
    first = outcome(stream)
    assert first == outcome(str(tmp_path / "batch")) and first["kept"] and first["rejected"]
    (source / "d.msp").write_text("\n".join(record.format(k=k, mz=200 + k, c=chr(65 + k)) for k in (5, 6)))
    advance()
    assert len(outcome(stream)["kept"]) == len(first["kept"]) + 1
    assert {r["batch_id"] for r in spark.read.parquet(f"{stream}/REGISTRY").collect()} == {0, 1}


def test_many_instrument_rules_are_a_table(spark, monkeypatch):
    """The table gives what the literal patterns give, and thousands of rules plan quickly."""
    import time

    from ionloom.operators import instruments as ins
    from ionloom.sources.lookups import DEFAULT_INSTRUMENTS

    texts = ["Thermo Q Exactive", "Sciex QQQ qtof esi high", "Agilent 6530 Q-TOF ESI", "waters GC EI qtof", "", None, "LTQ thermo it esi"]
    df = spark.createDataFrame([(i, t, t, None) for i, t in enumerate(texts)], "record_id bigint, instrument string, instrumenttype string, comment string")
    df = df.withColumns({"resolution": F.lit(None).cast("string"), "ionization": F.lit(None).cast("string")})
    literal = ins.normalize_instruments(df, DEFAULT_INSTRUMENTS)
    monkeypatch.setattr(ins, "LITERAL_RULES", 0)
    table = ins.normalize_instruments(df, DEFAULT_INSTRUMENTS).select(literal.columns)
    assert sorted(map(repr, literal.collect())) == sorted(map(repr, table.collect()))
    monkeypatch.undo()
    many = [
        ins.InstrumentRule(f"brand{i % 50}", f"model{i}", "not found", "qtof", "esi", "high", f"M{i}, LC-ESI-QTOF, high") for i in range(5000)
    ]
    start = time.perf_counter()
    plan_of(ins.normalize_instruments(df, many))
    assert time.perf_counter() - start < 5


def test_the_instrument_index_equals_the_rules_one_by_one(spark):
    """Plain keys, keys of several words and patterns; keys that are parts of others; texts with many hits."""
    import random
    import re as regex

    from ionloom.operators import instruments as ins

    rng = random.Random(4)
    words = ["orbi", "trap", "q", "tof", "ltq", "xl", "6530", "gc", "ei", "esi", "brand"]
    key = lambda: rng.choice([" ".join(rng.sample(words, rng.randint(1, 2))), "(?:6530|6550)", rng.choice(words), "not found"])
    rules = [ins.InstrumentRule(key(), key(), key(), key(), key(), "high", f"S{i}, LC-ESI-QTOF, high") for i in range(600)]
    texts = [". " + " ".join(rng.choices([*words, "xq", "6550", "tof2"], k=rng.randint(0, 7))) + " ." for _ in range(150)]
    tree = ins._children(rules)

    def one_by_one(text):
        path = ()
        for _ in ins.LEVELS:
            keys = tree.get(path)
            if keys is None:
                return path
            path += (next((k for k in keys if regex.search(rf"(\b|^|$){k}(\b|^|$)", text)), ins.NO_MATCH),)
        return path

    df = spark.createDataFrame([(t,) for t in set(texts)], "_text string")
    for r in ins.match_by_table(df, rules).collect():
        path = one_by_one(r["_text"])
        assert tuple(r[c] for c in ins.LEVELS) == path + (None,) * (len(ins.LEVELS) - len(path)), r["_text"]


def test_lower_bounds_cut_the_lattice_and_lose_nothing(spark):
    from ionloom.operators import denovo as dn
    from ionloom.plans import fixture as fx

    spectra = fx.denovo_spectra(spark, SF_DIR).limit(150)
    heavy = spectra.withColumn("peaks", F.filter("peaks", lambda p: p["mz"] >= 100)).filter(F.size("peaks") > 0)
    formulas, limits, targets = dn.parse_formula(heavy), dn.largest_targets(heavy), dn.peak_targets(heavy)
    symbols = [s for s in dn.HEAVIEST_FIRST if s != "H"]
    names = ["formula", "is_simple", "max_C", "max_H", "mass", *(f"n_{s}" for s in symbols)]
    bounded = dn.heavy_compositions(formulas, limits)
    whole = dn.compositions(formulas, limits, symbols).select(names)
    assert 0 < bounded.count() < whole.count()
    a, b = (dn.match_hydrogens(targets, c) for c in (bounded, whole))
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


def test_totals_of_batches_are_merged(spark, tmp_path):
    """A compound of two batches counts once; a repeated batch replaces its totals; a reset leaves one."""
    from ionloom.operators import classify as cl
    from ionloom.sinks import writers as wr

    rows = spark.range(4000).select(
        F.when(F.col("id") % 4 == 0, None).otherwise("positive").alias("polarity"), F.lit("LC").alias("chromatography"),
        F.when(F.col("id") % 2 == 0, "experimental").otherwise("in_silico").alias("origin"), (F.col("id") % 700).cast("string").alias("inchikey"),
        (F.col("id") % 3).alias("batch"),
    )
    path = str(tmp_path / "totals")
    for batch in (0, 1, 2, 1):
        wr.write_cube(cl.class_cube(rows.filter(F.col("batch") == batch)), path, batch)
    got = {tuple(r[c] for c in cl.CLASSES): (r["spectra"], r["compounds"]) for r in cl.merged_cubes(wr.read_cubes(spark, path)).collect()}
    assert got[None, None, None][0] == 4000 and abs(got[None, None, None][1] - 700) <= 25
    assert got["positive", None, None][0] == 3000 and got["positive", "LC", "in_silico"][0] == 2000
    assert not any(k[0] == "unknown" for k in got)
    wr.write_cube(cl.class_cube(rows.filter("batch = 0")), path, 3, reset=True)
    assert cl.merged_cubes(wr.read_cubes(spark, path)).filter("polarity is null and chromatography is null and origin is null").first()["spectra"] == 1334


def test_streamed_richest_copy_follows_every_change(spark, tmp_path):
    """Ties go to the smaller id; rows without a key are left out; a replayed file changes nothing."""
    from ionloom.streaming.richest import CHANGES, KEYS, current_richest, ranked, richest_changes

    schema = "record_id bigint, splash string, inchikey string, comment string, peaks array<struct<mz:double,intensity:double>>"
    batches = [
        [(5, "S", "K", "xx", []), (6, "S", "K", "xx", []), (7, "T", "K", "x", []), (8, "S", "", "xxxx", [])],
        [(4, "S", "K", "xx", []), (9, "T", "K", "", []), (10, "S", None, "xxxx", [])],
        [(3, "T", "K", "xxxxx", []), (11, "S", "K", "xxxxxxx", []), (12, "U", "K", "", [])],
    ]
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    seen = []
    for rows in batches:
        ranked(spark.createDataFrame(rows, schema)).coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(CHANGES).parquet(source)
        sink = richest_changes(arriving).writeStream.format("parquet").option("path", log).option("checkpointLocation", str(tmp_path / "c"))
        sink.trigger(availableNow=True).start().awaitTermination()
        best = current_richest(spark.read.schema(CHANGES).parquet(log))
        seen.append({(r["splash"], r["inchikey"]): r["record_id"] for r in best.collect()})
    assert seen == [{("S", "K"): 5, ("T", "K"): 7}, {("S", "K"): 4, ("T", "K"): 7}, {("S", "K"): 11, ("T", "K"): 3, ("U", "K"): 12}]
    assert spark.read.schema(CHANGES).parquet(log).groupBy(*KEYS).count().agg(F.sum("count")).first()[0] == 6
