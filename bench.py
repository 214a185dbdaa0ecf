"""Headline timings: one JSON line with the median of three warm runs per query."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators import dedup as dd
from ionloom.operators import enrich as en
from ionloom.operators.clean import accept_spectra, require_peaks
from ionloom.operators.denovo import annotate_peaks
from ionloom.plans import fixture as fx
from ionloom.plans.pipeline import Lookups, curate, describe, fingerprint
from ionloom.session import new_path, stage
from ionloom.sinks.writers import write_spectra
from ionloom.sources.lookups import adduct_table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", CPUS)
        # Spectra are small in bytes and heavy in CPU: keep one partition per core.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def full_run(spark: SparkSession, sf_dir: str) -> None:
    """Everything: copies in, duplicates out, cleaning, enrichment, classes, partitioned output."""
    lookups = Lookups(
        adduct_table(spark), compounds=fx.compounds(spark, sf_dir), ontologies=fx.ontologies(spark, sf_dir)
    )
    result, _ = curate(fx.spectra_with_copies(spark, sf_dir).drop("source"), lookups)
    write_spectra(result.kept, new_path(spark, "library"))


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Input tables of the single-step timings, staged before the clock starts."""
    reason = F.lit(None).cast("string")
    raw = stage(fx.spectra_raw(spark, sf_dir).withColumn("deletion_reason", reason).repartition(int(CPUS)), "raw")
    copies = dd.with_splash(fx.spectra_with_copies(spark, sf_dir).drop("source")).repartition(int(CPUS))
    copies = stage(copies, "copies")
    masses = {c: F.lit(None).cast("double") for c in ("exactmass", "averagemass")}
    return {
        "raw": raw,
        "copies": copies,
        "registry": stage(copies.filter("record_id % 2 = 0").select("splash").distinct(), "registry"),
        "described": raw.withColumns(masses),
        "cleaned": stage(accept_spectra(require_peaks(fingerprint(fx.spectra_raw(spark, sf_dir).drop("source")))), "cleaned"),
        "compounds": stage(fx.compounds(spark, sf_dir), "compounds"),
        "ontologies": stage(fx.ontologies(spark, sf_dir), "ontologies"),
        "denovo": stage(fx.denovo_spectra(spark, sf_dir).repartition(int(CPUS)), "denovo"),
    }


def incremental(t: dict[str, DataFrame]) -> None:
    drain(dd.unseen(t["copies"], t["registry"]))
    drain(dd.new_registry_rows(t["copies"], t["registry"], 1))


STEPS = {
    "clean_peaks": lambda t: drain(accept_spectra(require_peaks(t["raw"]))),
    "splash": lambda t: drain(dd.with_splash(t["raw"]).select("record_id", "splash")),
    "dedup_keep_richest": lambda t: drain(dd.flag_duplicates(t["copies"])),
    "incremental_new": incremental,
    "enrich": lambda t: drain(
        en.enrich_ontology(en.enrich_compounds(t["described"], t["compounds"]), t["ontologies"])
    ),
    "describe": lambda t: drain(
        describe(t["cleaned"], Lookups(adduct_table(t["raw"].sparkSession), compounds=t["compounds"], ontologies=t["ontologies"]))
    ),
    "denovo": lambda t: drain(annotate_peaks(t["denovo"])),
}


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    spectra = fx.table(spark, SF_DIR, "orders").count()
    timings = {}
    tables = inputs(spark, SF_DIR)
    benches = {name: partial(step, tables) for name, step in STEPS.items()}
    benches["full_curation"] = partial(full_run, spark, SF_DIR)
    for name, run in benches.items():
        run()
        samples = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            samples.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(samples), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "spectra_per_second": {n: round(spectra / t) for n, t in timings.items()},
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cores": int(CPUS),
                "shuffle_partitions": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
