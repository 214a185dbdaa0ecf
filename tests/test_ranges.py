"""Ranged readers on small ranges, heads, lookup files, adduct names and InChI layers."""

from __future__ import annotations

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from ionloom.functions import inchi as ic
from ionloom.functions.adducts import read_adduct
from ionloom.sources import lookups as lk
from ionloom.sources import ranges as rg
from ionloom.sources import readers as rd


@pytest.fixture
def small_ranges(spark):
    """Files are split every 3,000 bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def objects():
    rng = random.Random(1)
    notes = ["plain", "br}ace", 'quo"te', "back\\", 'bs\\"q}', "{[", 'a,{"x":1}', "é✓ }{"]
    out = []
    for i in range(150):
        r = {"name": f"n{i}", "note": rng.choice(notes) * rng.randint(1, 3), "peaks": [[rng.random(), 1.5] for _ in range(rng.choice([1, 3, 40]))]}
        if i % 7 == 0:
            r["annotation"] = {"meta": [{"a": 1}, {"b": [1, {"c": "}"}]}]}
        if i % 31 == 0:
            r["note"] = "x}" * 3000  # longer than two ranges
        out.append(r)
    return out


LAYOUTS = {
    "compact": lambda rs: json.dumps(rs, separators=(",", ":")),
    "default": json.dumps,
    "lines": lambda rs: "[\n" + ",\n".join(map(json.dumps, rs)) + "\n]\n",
    "pretty": lambda rs: json.dumps(rs, indent=2),
    "unicode": lambda rs: "﻿" + json.dumps(rs, ensure_ascii=False),
    "two a line": lambda rs: "[\n" + "\n,".join(f"{json.dumps(a)} , {json.dumps(b)}" for a, b in zip(rs[::2], rs[1::2], strict=True)) + "]",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_arrays_in_any_layout_are_cut_by_ranges(spark, tmp_path, small_ranges, layout):
    path = tmp_path / "with blank %20.json"
    path.write_text(LAYOUTS[layout](objects()), encoding="utf-8")
    found, broken = rg.json_array_elements(spark, str(path))
    assert not broken
    assert sorted(r["value"] for r in found.select(F.to_json(F.parse_json("value")).alias("value")).collect()) == sorted(
        r["value"] for r in spark.createDataFrame([(json.dumps(o),) for o in objects()], "value string").select(F.to_json(F.parse_json("value")).alias("value")).collect()
    )
    ranges = rg.pieces(spark, str(path), "}").select("at").distinct().count()
    assert ranges > 15
    parsed = rd.read_json(spark, str(path))
    assert parsed.filter("deletion_reason is null").count() == 150


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ('[1, "a,b", {"name":"x"}, null, {"oops"}, {"name":"y"}, [1,2,{"q":1}], {"name":"z"}]', ["x", "y", "z", *[None] * 5]),
        ('[{"name":"a"},{"name":"b","x":{"q":1},{"name":"c"},{"name":"d"}]', ["a", "c", "d", None]),
        ('[{"name":"a"},{"name":"b","x":"q},{"name":"c"},{"name":"d"}]', ["a", "c", "d", None]),
        ('[{"name":"a"}},{"name":"b"}]', ["a", "b", None]),
        ('[{"name":"a"},{"name":"b"', ["a", None]),
        ("[]", []), (" [ \n ] ", []), ('[{"name":"a"}]', ["a"]),
        ('{"name":"a"}\n{"name":"b"}\n', ["a", "b"]),
    ],
)
def test_no_element_is_lost(spark, tmp_path, text, names):
    path = tmp_path / "odd.json"
    path.write_text(text)
    got = [r["raw"] and r["raw"].get("name") for r in rd.scan_json(spark, str(path)).collect()]
    assert sorted(got, key=lambda n: (n is None, n or "")) == names


def test_three_records_on_few_lines(spark, tmp_path):
    record = '{"name": "%s", "peaks": [[1, 2]]}'
    for i, text in enumerate((f"[{record % 'a'}, {record % 'b'}, {record % 'c'}]", f"[{record % 'a'}, {record % 'b'},\n{record % 'c'}]")):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        assert sorted(r["name"] for r in rd.read_json(spark, str(path)).collect()) == ["a", "b", "c"]


SEPARATORS = {
    "plain": ["\n\n"], "blank": ["\n \t\n"], "mixed": ["\n\n", "\n  \n", "\r\n\r\n", "\n\r\n", "\n\n\n \n"],
    "crlf": ["\r\n\r\n"], "crlf blank": ["\r\n \r\n"],
}


@pytest.mark.parametrize("lead", ["", "\n \n"])
@pytest.mark.parametrize("kind", SEPARATORS)
def test_msp_records_between_any_blank_lines(spark, tmp_path, small_ranges, kind, lead):
    rng = random.Random(2)
    records = []
    for i in range(60):
        n = rng.choice([1, 4, 60, 400])
        records.append(f"NAME: r{i}\nPRECURSORMZ: {i}\nNum Peaks: {n}\n" + "\n".join(f"{j}.5 {j}" for j in range(1, n + 1)))
    text = "".join((r.replace("\n", "\r\n") if "crlf" in kind else r) + rng.choice(SEPARATORS[kind]) for r in records)
    path = tmp_path / "lib.msp"
    path.write_bytes((lead + (text.rstrip() if lead else text)).encode())
    for scan in (rd.scan_msp, rg.blank_line_records):
        got = [r["value"].replace("\r", "").strip("\n") for r in scan(spark, str(path)).collect()]
        assert sorted(got) == sorted(records)
    assert rd.file_heads(spark, str(path))[0].plain == (kind in ("plain", "crlf") and not lead)
    assert rg.pieces(spark, str(path), "\n").select("at").distinct().count() > 8


def test_heads_read_no_more_than_the_start(spark, tmp_path):
    """No job runs, and the bytes read stay the same for a file of 40 MB."""
    (tmp_path / "small.csv").write_text("NAME;peaks\na;1 2\n")
    with open(tmp_path / "big.csv", "w") as handle:
        handle.write("NAME\tpeaks\n" + "b\t1 2\n" * 8_000_000)
    with gzip.open(tmp_path / "packed.csv.gz", "wt") as handle:
        handle.write("ID;NAME;peaks\nc;c;1 2\n")
    (tmp_path / "wide.csv").write_text(";".join(f"column{i}" for i in range(20_000)) + "\n1\n")
    (tmp_path / "empty.csv").write_text("")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    statistics = spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics
    read = lambda: statistics().get("file").getLong("bytesRead")
    before = read()
    heads = {h.path.rpartition("/")[2]: h for h in rd.file_heads(spark, str(tmp_path))}
    assert read() - before < 2_000_000
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs
    assert {n: h.header[:8] for n, h in heads.items()} == {
        "small.csv": "NAME;pea", "big.csv": "NAME\tpea", "packed.csv.gz": "ID;NAME;", "wide.csv": "column0;", "empty.csv": "",
    }
    assert heads["wide.csv"].header.endswith("column19999")


def test_lookup_files(spark, tmp_path):
    (tmp_path / "names.csv").write_text("known;canonical\nMy Name;NAME\nmy name;SMILES\nPk;PEAKS_LIST\nodd;no_column\nrt2;RT\n")
    assert lk.read_synonyms(spark, str(tmp_path / "names.csv")) == {"smiles": ["my name"], "peaks": ["pk"], "rt": ["rt2"]}
    tree = {"thermo": {"ltq": {"x": {"it": {"esi": {"low": {"SOLUTION": "A"}, "high": {"SOLUTION": "B"}}}}}}}
    (tmp_path / "tree.json").write_text(json.dumps(tree, indent=1))
    assert [r.solution for r in lk.read_instruments(spark, str(tmp_path / "tree.json"))] == ["A", "B"]


def test_a_folder_named_as_a_library_gives_its_format(spark, tmp_path):
    spark.createDataFrame([("NAME: a\n50 1",)], "value string").write.option("lineSep", "\n\n").text(str(tmp_path / "in" / "lib.msp"))
    assert [r["name"] for r in rd.ingest(spark, [str(tmp_path / "in")]).collect()] == ["a"]
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(ValueError, match="no library format"):
        rd.ingest(spark, [str(tmp_path / "notes.txt")])


ADDUCTS = [
    ("M+H", "[M+H]+", 1, 1.007276), ("[M+2H]2+", "[M+2H]2+", 2, 2.014553), ("M-H", "[M-H]-", -1, -1.007276),
    ("M-H+Na+Na", "[(M-H+Na)+Na]+", 1, 44.971165), ("[(M-H+Na)+Na]+", "[(M-H+Na)+Na]+", 1, 44.971165),
    ("2M-2H+Ca+Na+K", "[(2M-2H+Ca)+Na+K]2+", 2, 99.89932), ("M+Na+Cl+Cl_37Cl1", "[(M+Na+Cl)+Cl]-_37Cl1", -1, 94.925074),
    ("2(M-H)+Na", "[2(M-H)+Na]-", -1, 20.974668), ("M+2(Na+Cl)+H", "[M+2(Na+Cl)+H]+", 1, 116.92452),
    ("M+37Cl", "[M+37Cl]-", -1, 36.966451), ("[M-CH3]-", "[M-CH3]-", -1, -15.022927), ("M+ACN+H", "[M+ACN+H]+", 1, 42.033826),
    ("M+foo", None, None, None), ("M+(Na", None, None, None), ("Na", None, None, None), ("M-CH3", None, None, None), ("", None, None, None),
    (None, None, None, None),
]


def test_adduct_grammar(spark):
    df = spark.createDataFrame([(i, case[0]) for i, case in enumerate(ADDUCTS)], "i int, t string")
    rows = df.select("i", read_adduct(F.col("t")).alias("a")).collect()
    for r in rows:
        text, canonical, charge, shift = ADDUCTS[r["i"]]
        a = r["a"]
        assert (a and (a["canonical"], a["charge"])) == (canonical and (canonical, charge)), text
        if a:
            assert a["massdiff"] == pytest.approx(shift, abs=2e-6), text
            assert a["ionmode"] == ("positive" if charge > 0 else "negative")


def test_the_grammar_agrees_with_the_default_table(spark):
    table = lk.adduct_table(spark).filter(~F.col("known_adduct").isin(list(lk.READINGS)))
    rows = table.select("*", F.inline(F.array(read_adduct(F.col("known_adduct")).alias("a"))).alias("c", "z", "m", "i")).collect()
    unread = [r["known_adduct"] for r in rows if r["c"] is None]
    assert set(unread) <= {"M+", "M-"}
    for r in rows:
        if r["c"] is not None:
            assert (r["canonical"], r["ionmode"]) == (r["c"], r["i"]), r["known_adduct"]
            assert abs(r["massdiff"] - r["m"]) <= 2e-6, r["known_adduct"]


def test_adducts_in_use_beyond_the_table(spark):
    names = ["[M-H+2CH3COOH]-", "M+K+CH3CO2Ca-H", "M+H", "M-3H+2Na+Ca", "what", None]
    df = spark.createDataFrame([(n,) for n in names], "precursortype string")
    full = lk.complete_adducts(df, lk.adduct_table(spark))
    rows = {r["known_adduct"]: r for r in full.collect()}
    assert len(rows) == len(lk.default_adducts()) + 2
    assert rows["M+K+CH3CO2Ca-H"]["massdiff"] == pytest.approx(136.931228, abs=2e-5)
    assert rows["M-H+2CH3COOH"]["canonical"] == "[M-H+2CH3COOH]-"
    assert rows["M-3H+2Na+Ca"]["canonical"] == "[(M-3H+2Na)+Ca]+"


INCHIS = [
    ("InChI=1S/C2H4O2/c1-2(3)4/h1H3,(H,3,4)", 0, 60.021129), ("InChI=1S/C2H4O2/c1-2(3)4/h1H3,(H,3,4)/p-1", -1, 59.013304),
    ("InChI=1S/CH4/h1H4/i1D3", 0, 19.050130), ("InChI=1S/C2H6O/c1-2-3/h3H,2H2,1H3/i1+1,2D2", 0, 49.057773),
    ("InChI=1S/2C2H4O2.Ca/c2*1-2(3)4;/h2*1H3,(H,3,4);/q;;+2/p-2", 0, 157.989200),
    ("InChI=1S/C6H5Br/c7-6-4-2-1-3-5-6/h1-5H/i7+1", 0, 157.955416), ("InChI=1/C2H4O2/c1-2(3)4/h1H3,(H,3,4)/p-1/fC2H3O2/q-1", -1, 59.013304),
    ("InChI=1S/H2O/h1H2/i/hD2", 0, 20.023118), ("InChI=1S/2C2H6/c2*1-2/h2*1-2H3/i2*1D", 0, 62.106454),
    ("InChI=1S/CH4/h1H4/i1+9", 0, None), ("InChI=1S/C2H6Xx", 0, None), ("", None, None), (None, None, None),
]


def test_inchi_layers(spark):
    df = spark.createDataFrame([(n, case[0]) for n, case in enumerate(INCHIS)], "n int, i string")
    i = F.col("i")
    for r in df.select("n", ic.charge(i).alias("q"), ic.inchi_mass(i).alias("m"), ic.structure_mass(i).alias("s")).collect():
        inchi, charge, mass = INCHIS[r["n"]]
        want = mass and pytest.approx(mass, abs=2e-6)
        assert (r["q"], r["m"], r["s"]) == (charge, want, want), inchi


def test_hot_keys_of_lookups_are_split(spark):
    """A lookup that was written out lies in the join as it is read, so its hot partner's partition is split."""
    from ionloom.operators.enrich import enrich_ontology
    from ionloom.schema import ONTOLOGY_COLUMNS

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16",
    }
    kept = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(60_000).select(F.col("id").alias("record_id"), F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("K"), F.col("id") % 500)).alias("inchikey"),
                                          F.sha2(F.col("id").cast("string"), 512).alias("text")).repartition(8)
        lookup = spark.range(500).select(F.concat(F.lit("K"), "id").alias("inchikey"), *(F.lit("c").alias(c) for c in ONTOLOGY_COLUMNS))
        lookup = lookup.unionByName(lookup.limit(1).withColumn("inchikey", F.lit("HOT")))
        out = enrich_ontology(rows.withColumns({c: F.lit("") for c in ONTOLOGY_COLUMNS}), lookup)
        assert out.count() == 60_000
        plan = out.select("record_id", "text", ONTOLOGY_COLUMNS[0])
        assert len(plan.collect()) == 60_000
        assert "skew=true" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
