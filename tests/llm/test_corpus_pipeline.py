"""The pipeline against brute force, stage by stage and as a whole."""

from __future__ import annotations

import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
from ionloom.llm import minhash, mixing
from tests.llm.helpers import SF_DIR, awkward, near_components, prose, shingles, words
from tests.llm.test_small_operators import brute_contamination, brute_quality, brute_targets
from ionloom.llm import sharding

ROOT = Path(__file__).resolve().parents[2]


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    good = [r for r in docs if brute_quality(r["text"])[-1]]
    label = near_components([(r["doc_id"], r["text"]) for r in good], corpus_pipeline.NEAR_PERCENT)
    alone = [r for r, c in zip(good, label, strict=True) if r["doc_id"] == c]
    bad = {b[0] for b in brute_contamination([(r["doc_id"], r["text"]) for r in alone], items) if b[-1]}
    clean = {r["doc_id"]: r for r in alone if r["doc_id"] not in bad}
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    # The mix takes words of clean documents only, in the shares that brute force gives.
    sizes, taken, per_doc = defaultdict(int), defaultdict(int), Counter()
    for r in clean.values():
        sizes[r["source"]] += len(words(r["text"]))
    target = brute_targets(sizes)
    for r in rows:
        own = clean[r["doc_id"]]
        assert {"lang": own["lang"], "source": own["source"]} == {"lang": r["lang"], "source": r["source"]}
        assert r["text"] == own["text"] or not Counter(words(r["text"])) - Counter(words(own["text"]))
        assert r["n_chars"] == len(r["text"])
        taken[r["source"]] += len(words(r["text"]))
        per_doc[r["doc_id"]] += len(words(r["text"]))
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert all(n <= 2 * len(words(clean[d]["text"])) for d, n in per_doc.items())
    owner = sharding.lookup_table()
    assert all(r["shard_id"] == owner[r["slot"]] for r in rows)


def test_near_duplicates_from_80_percent_on(spark):
    """Pairs between 0.80 and 0.85 lose one copy, pairs below 0.80 none."""
    rows, want = [], []
    for k in range(40):
        base = prose(500 + k, 200).split()
        edits = 4 if k % 2 else 5  # Far apart, each edit changes 5 of the 196 shingles: 176 / 216 and 171 / 221.
        copy = [f"edit{i}" if i % 38 == 19 and i // 38 < edits else w for i, w in enumerate(base)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        assert 80 <= 100 * len(a & b) / len(a | b) < 85 if k % 2 else 75 < 100 * len(a & b) / len(a | b) < 80
        want += [2 * k] if k % 2 else [2 * k, 2 * k + 1]
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF_DIR)
    assert sorted(r["doc_id"] for r in got.collect()) == want
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    brute = [d for (d, t), c in zip(docs, near_components(docs, 80), strict=True) if d == c or not shingles(t)]
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"), SF_DIR)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(brute)


def test_bands_follow_the_threshold():
    assert minhash.band_rows(85) == 5 and minhash.band_rows(80) == 4
    for percent in (50, 60, 70, 80, 85, 90, 95):
        rows = minhash.band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** (minhash.COORDINATES // rows) < minhash.MISS


def test_stages_keep_the_columns(spark):
    docs = awkward(spark)
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, SF_DIR).columns == docs.columns, name
        assert step(spark, docs.limit(0), SF_DIR).count() == 0
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_mixing_cuts_only_what_it_takes(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    taken = {(r["doc_id"]): r["taken"] for r in mixing.mixture(docs).collect()}
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert got == Counter({d: n for d, n in taken.items() if n})


def test_library_works_without_the_corpus_operators():
    code = (
        "import sys\n"
        "class Hide:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('ionloom.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Hide())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 100 and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())\n"
        "assert 'ionloom.llm' not in sys.modules\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_run_takes_one_of_each_group_at_80(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    good = [(r["doc_id"], r["text"], r["source"]) for r in docs if brute_quality(r["text"])[-1]]
    label = near_components([g[:2] for g in good], 80)
    alone = [g for g, c in zip(good, label, strict=True) if g[0] == c]
    bad = {b[0] for b in brute_contamination([g[:2] for g in alone], items) if b[-1]}
    clean = {d: (t, s) for d, t, s in alone if d not in bad}
    sizes, taken = defaultdict(int), defaultdict(int)
    for t, s in clean.values():
        sizes[s] += len(words(t))
    for r in corpus_pipeline.run(spark, SF_DIR).collect():
        assert r["doc_id"] in clean
        taken[r["source"]] += len(words(r["text"]))
    target = brute_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
