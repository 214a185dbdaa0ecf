"""Hand-written library files, one trap each."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ionloom.functions import text as tx
from ionloom.operators.denovo import annotate_peaks
from ionloom.plans.pipeline import Lookups, run
from ionloom.schema import Params
from ionloom.sources import readers as rd
from ionloom.sources.lookups import adduct_shift, adduct_table, default_adducts, default_synonyms

MSP = (
    "Name: First\nPrecursorMZ: 200.1\nFILENAME: old.msp\nNum Peaks: 2\n100.5 10 \"C5H8O2\"\n150:20\n"
    "\n\n"
    'NAME: Second\nno colon here\nComments: "SMILES=CCO" "computed InChI=x" note="deep" ev=35.5 mode=pos; end\n'
    "Computed SMILES: C\nNum Peaks: 1\n77 1e2\n"
    " \t \n"
    "Name: Empty\nNum Peaks: 0\n"
    "\n"
    "Name: Last\nName: Twice\nNum Peaks: 1\n99.0\t5,5"
)


def rows(df, *cols):
    out = df.select("name", *cols, F.transform("peaks", lambda p: F.array(p["mz"], p["intensity"])).alias("p")).collect()
    return {r["name"]: r for r in out}


def test_msp(spark, tmp_path):
    path = tmp_path / "lib.msp"
    path.write_text(MSP)
    got = rows(rd.read_msp(spark, str(path)), "filename", "smiles", "precursormz", "deletion_reason")
    assert set(got) == {"First", "Second", "Empty", "Twice"}
    assert got["First"]["p"] == [[100.5, 10.0], [150.0, 20.0]]
    assert got["First"]["filename"] == "lib.msp"
    assert got["Second"]["p"] == [[77.0, 100.0]]
    assert got["Second"]["smiles"] == "CCO"
    assert got["Empty"]["deletion_reason"] == "unparsable"
    assert got["Twice"]["p"] == [[99.0, 5.5]]


def test_msp_with_crlf(spark, tmp_path):
    path = tmp_path / "dos.msp"
    path.write_bytes(MSP.replace("\n", "\r\n").encode())
    got = rows(rd.read_msp(spark, str(path)), "precursormz")
    assert set(got) == {"First", "Second", "Empty", "Twice"}
    assert got["First"]["precursormz"] == "200.1"


def test_mgf(spark, tmp_path):
    path = tmp_path / "lib.mgf"
    path.write_text(
        "BEGIN IONS\nNAME=bad\nEND IONS\n\nBEGIN IONS\nNAME=good\nPEPMASS=300.2 1000\nRTINSECONDS=42\n80.1 5\nEND IONS\n"
        "BEGIN IONS\nNAME=also good\nA:SMILES=CC=O\n81.1 6\nEND IONS\nBEGIN IONS\nNAME=tail\n82 7\n"
    )
    got = rows(rd.read_mgf(spark, str(path)), "rt", "smiles", "precursormz", "deletion_reason")
    assert set(got) == {"bad", "good", "also good", "tail"}
    assert got["tail"]["deletion_reason"] == "unparsable"
    assert got["bad"]["deletion_reason"] == "unparsable"
    assert (got["good"]["rt"], got["good"]["precursormz"]) == ("42", "300.2 1000")
    assert got["also good"]["smiles"] == "CC=O"


def test_json(spark, tmp_path):
    array = tmp_path / "array.json"
    array.write_text('[\n {"name": "a", "peaks": [[79.05, 12.5], [80, 1]]},\n {"name": "b", "no": 1}\n]\n')
    lines = tmp_path / "lines.json"
    lines.write_text('{"name": "c", "peaks_json": "10.5:3 11:4"}\n\n{"name": "d", "peaks_list": "1.5 2;3 4"}\n')
    got = rows(rd.read_json(spark, [str(array), str(lines)]), "deletion_reason", "filename")
    assert got["a"]["p"] == [[79.05, 12.5], [80.0, 1.0]]
    assert got["b"]["deletion_reason"] == "unparsable"
    assert got["c"]["p"] == [[10.5, 3.0], [11.0, 4.0]]
    assert got["d"]["p"] == [[1.5, 2.0], [3.0, 4.0]]
    assert got["d"]["filename"] == "lines.json"


def test_csv(spark, tmp_path):
    semi = tmp_path / "semi.csv"
    semi.write_text('Name;Adduct;peaks\nx;M+H;"[[79.05, 12.5], [80, 1]]"\ny;;"57.07 0.7\n71.08 1.5"\n')
    tab = tmp_path / "tab.csv"
    tab.write_text("NAME\tpeaks_list\tFilename\nz\t314.0 1.0;315.0 0.157\tkept.csv\nempty\t\tkept.csv\n")
    got = rows(rd.read_csv(spark, [str(semi), str(tab)]), "precursortype", "filename")
    assert got["x"]["p"] == [[79.05, 12.5], [80.0, 1.0]]
    assert got["y"]["p"] == [[57.07, 0.7], [71.08, 1.5]]
    assert got["y"]["precursortype"] is None
    assert got["z"]["p"] == [[314.0, 1.0], [315.0, 0.157]]
    assert got["z"]["filename"] == "kept.csv"
    assert got["empty"]["p"] == []


def test_retention_times(spark):
    values = ["90000 ms", "5,2 min", "312 sec", "3 m", "4.1", "", "1 hour", "2 Minutes"]
    df = spark.createDataFrame([(v,) for v in values], "rt string")
    got = {r[0]: r[1] for r in df.select("rt", tx.normalize_rt(F.col("rt"))).collect()}
    assert got == {
        "90000 ms": 1.5, "5,2 min": 5.2, "312 sec": 5.2, "3 m": 3.0, "4.1": 4.1, "": None, "1 hour": None, "2 Minutes": 2.0,
    }


def test_adduct_table():
    shifts = {known: shift for known, _, shift, _ in default_adducts()}
    assert round(shifts["M+H"], 5) == 1.00728
    assert round(shifts["M-H2O+H"], 4) == -17.0033
    assert round(shifts["M+Cl"], 4) == 34.9694
    assert round(adduct_shift("2M+2Na", 2), 5) == 45.97844
    assert len(shifts) == len(default_adducts())


def test_annotation_picks(spark):
    df = spark.createDataFrame(
        [(1, "C6H12O6", [(73.02896, 10.0), (500.0, 1.0)]), (2, None, [(73.02896, 10.0)])],
        "record_id bigint, formula string, peaks array<struct<mz:double,intensity:double>>",
    )
    for pick in ("first", "closest"):
        got = {r["record_id"]: r["annotated_peaks"] for r in annotate_peaks(df, Params(annotation_pick=pick)).collect()}
        assert got[1][0]["formula"] == "C3H5O2+"
        assert got[1][1]["formula"] is None and got[2][0]["formula"] is None


def test_two_runs(spark, tmp_path):
    """Second run with the same file adds nothing; a reset starts over."""
    record = (
        "NAME: s{k}\nPRECURSORMZ: {mz}\nPRECURSORTYPE: M+H\nIONMODE: P\nINSTRUMENTTYPE: LC-ESI-QTOF\n"
        "INCHIKEY: AAAAAAAAAAAAA{letter}\nINCHI: InChI=1S/C6H12O6/c1\nSMILES: C(C1CO)OC\n60.1 10\n70.2 8\n80.3 {k}\n"
    )
    path = tmp_path / "in.msp"
    path.write_text("\n".join(record.format(k=k, mz=200 + k, letter=chr(65 + k)) for k in range(3, 8)))
    out = str(tmp_path / "out")
    lookups = Lookups(adduct_table(spark))

    def spectra(batch, **options):
        report = run(spark, [str(path)], out, lookups, Params(csv=False, msp=True, json=False, **options), batch)
        return {(r["section"], r["metric"]): r["value"] for r in report.collect()}

    assert spectra(0)[("spectra", "TOTAL/TOTAL/TOTAL")] == "5"
    second = spectra(1)
    assert second[("spectra", "TOTAL/TOTAL/TOTAL")] == "0"
    assert second[("filtered_out", "already_seen")] == "5"
    assert rd.read_msp(spark, f"{out}/MSP").count() == 5
    assert spectra(2, reset=True)[("spectra", "TOTAL/TOTAL/TOTAL")] == "5"
    assert rd.read_msp(spark, f"{out}/MSP").count() == 5


def test_mgf_broken_blocks(spark, tmp_path):
    """Unclosed blocks are rejected one by one; marker words inside a line are text."""
    path = tmp_path / "broken.mgf"
    path.write_text(
        "# made by a tool\nBEGIN IONS\nNAME=open\n80.1 5\nBEGIN IONS\nNAME=closed\nCOMMENT=BEGIN IONS and END IONS\n80.1 5\nEND IONS\n"
    )
    got = rows(rd.read_mgf(spark, str(path)), "deletion_reason")
    assert {k: v["deletion_reason"] for k, v in got.items()} == {"open": "unparsable", "closed": None}


def test_json_files_are_read_by_their_own_kind(spark, tmp_path):
    folder = tmp_path / "lib.json"
    folder.mkdir()
    (folder / "a.json").write_text('\n[{"name": "a", "peaks": [[79.05, 1]]},\n{"name": broken},\n{"name": "b", "peaks": [[80, 1]]}]\n')
    (folder / "b.json").write_text('[ {"name": "c",\n "peaks": [[81, 1]]}, {"name": oops, "x": 1}, {"name":\n "d", "peaks": [[82, 1]]} ]')
    (folder / "c.json").write_text('{"name": "e", "peaks": [[83, 1]]}\nnonsense\n')
    out = rd.read_json(spark, str(folder)).select("name", "deletion_reason").collect()
    assert sorted(r["name"] for r in out if r["deletion_reason"] is None) == ["a", "b", "c", "d", "e"]
    assert sum(r["deletion_reason"] == "unparsable" for r in out) == 3


def test_csv_folder_with_several_headers(spark, tmp_path):
    folder = tmp_path / "lib.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("name;ionmode;peaks\nx;positive;79.05 1\n")
    (folder / "b.csv").write_text("ionmode;name;peaks\nnegative;y;80 1\n")
    (folder / "c.csv").write_text("name\tpeaks\tionmode\nz\t81 1\tpositive\n")
    got = {r["name"]: (r["ionmode"], r["n"]) for r in rd.read_csv(spark, str(folder)).select("name", "ionmode", F.size("peaks").alias("n")).collect()}
    assert got == {"x": ("positive", 1), "y": ("negative", 1), "z": ("positive", 1)}


def test_ingest_folder_and_unknown_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.MSP").write_text("NAME: m\n50 1\n60 2\n")
    (tmp_path / "in" / "b.mgf").write_text("BEGIN IONS\nNAME=g\n50 1\nEND IONS\n")
    assert {r["name"] for r in rd.ingest(spark, [str(tmp_path / "in")]).collect()} == {"m", "g"}
    (tmp_path / "in" / "notes.txt").write_text("not a library")
    with pytest.raises(ValueError, match="notes.txt"):
        rd.ingest(spark, [str(tmp_path / "in")])


def test_cluster_adducts():
    """Shifts of clusters from element masses written out here."""
    rows = {known: (canonical, shift, mode) for known, canonical, shift, mode in default_adducts()}
    h, na, k, cl, cl37, ca, e = 1.00782503, 22.98976928, 38.96370649, 34.96885268, 36.96590260, 39.96259086, 0.00054858
    want = {
        "M+37Cl": ("[M+37Cl]-", cl37 + e, "negative"), "M+2Cl": ("[M+2Cl]2-", 2 * (cl + e), "negative"),
        "2M+Na+K": ("[2M+Na+K]2+", na + k - 2 * e, "positive"), "2M+K+Na": ("[2M+K+Na]2+", na + k - 2 * e, "positive"),
        "M-2H+3Na": ("[M-2H+3Na]+", 3 * na - 2 * h - e, "positive"), "M+3Na-2H": ("[M+3Na-2H]+", 3 * na - 2 * h - e, "positive"),
        "M+Ca-H": ("[(M+Ca)-H]+", ca - h - e, "positive"), "M-H+Ca": ("[(M-H)+Ca]+", ca - h - e, "positive"),
    }
    for name, (canonical, shift, mode) in want.items():
        assert rows[name][0] == canonical and rows[name][2] == mode and abs(rows[name][1] - shift) < 1e-5, name
    assert {"auxinfo", "inchiaux"}.isdisjoint(n for names in default_synonyms().values() for n in names)
    assert "submittecomputed_mass_erroname" in default_synonyms()["name"]
