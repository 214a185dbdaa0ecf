"""Spectra derived from the relational test tables.

One order is one spectrum and its line items are the peaks. The scalar expressions are plain SQL
that every engine reads the same way, so an oracle can build the same input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.schema import PEAKS_TYPE


def _pick(values: str, by: str) -> str:
    n = values.count("|") + 1
    return f"split_part('{values}', '|', cast(({by}) % {n} + 1 as int))"


# o_orderkey is the record id; expressions use the columns of orders and customer.
INCHIKEY = (
    "upper(translate(substr(md5(cast({0} as varchar(20))), 1, 14), '0123456789', 'ghijklmnop'))"
)
COMPOUND_FORMULA = "concat('C', 2 + {0} % 9, 'H', 4 + {0} % 7, 'N', 1 + {0} % 3, 'O', 1 + {0} % 4)"
INCHI = "concat('InChI=1S/', " + COMPOUND_FORMULA + ", '/c', {0}, '-1')"
SMILES = "concat('CC(=O)NC', {0} % 7, '[', {0}, ']C=O')"
K = "o_orderkey"

HEADER = {
    "record_id": K,
    "filename": f"case when {K} % 41 = 0 then 'lib_GC.msp' when {K} % 43 = 0 then 'lib_insilico.msp' "
    f"else concat('lib_', {K} % 3, '.msp') end",
    "filehash": f"md5(cast({K} % 3 as varchar(20)))",
    "predicted": f"case when {K} % 7 = 0 then 'true' when {K} % 7 in (1, 2) then 'false' else '' end",
    "spectrumid": f"concat('SP', {K})",
    "resolution": "''",
    "synon": "case when o_orderstatus = 'P' then 'unknown' else '' end",
    "ionization": _pick("ESI source||N/A|apci|electrospray", K),
    "mslevel": _pick("MS2|2|MS3-MS2||MS", K),
    "fragmentationmode": _pick("HCD|CID|unk", K),
    "name": "coalesce(c_name, '')",
    "precursormz": f"case when {K} % 23 = 0 then '' when {K} % 11 = 0 then 'N/A' when {K} % 13 = 0 then '0.0' "
    "else printf('%.4f', o_totalprice / 250) end",
    "precursortype": f"case when {K} % 19 = 0 then '' when {K} % 31 = 0 then 'M' when {K} % 37 = 0 then 'xyz' "
    f"else {_pick('M+H|[M+H]+|M+Na|[M-H]-|M-H|M+Cl', K)} end",
    "instrumenttype": _pick("LC-ESI-QTOF|GC-EI-QTOF|LC-ESI-ITFT|ESI-QTOF", K),
    "instrument": _pick(
        "Thermo Q Exactive Plus|Applied Biosystems TripleTOF 5600|Agilent 6530 Q-TOF|Waters Xevo G2-S||AB Sciex", K
    ),
    "smiles": f"case when {K} % 53 = 0 then '' when {K} % 8 = 0 then {INCHI} else {SMILES} end".replace(
        "{0}", "o_custkey"
    ),
    "inchi": f"case when {K} % 53 = 0 then '' when {K} % 8 = 0 then {SMILES} "
    f"when {K} % 9 = 0 then replace({INCHI}, 'InChI=', 'inchi=') else {INCHI} end".replace("{0}", "o_custkey"),
    "inchikey": f"case when {K} % 53 = 0 or {K} % 10 = 0 then '' when {K} % 59 = 0 then 'not-a-key' "
    f"else {INCHIKEY} end".replace("{0}", "o_custkey"),
    "collisionenergy": f"concat({K} % 4 * 10, ' eV')",
    "formula": f"concat('C', 2 + {K} % 5, 'H', 4 + {K} % 7, 'N', {K} % 3, 'O', 1 + {K} % 3)",
    "rt": _pick("5.2 min|312 sec|90000 ms|4.1|3 m|", K),
    "ionmode": f"case when {K} % 29 = 0 then 'other' else {_pick('P|positive|+|Negative|n', K)} end",
    "comment": f"case when {K} % 47 = 0 then concat(o_orderpriority, ' in-silico') else o_orderpriority end",
    "source": _pick("MSP|CSV|JSON|MGF", K),
}
MZ = "l_extendedprice / 50"
INTENSITY = "l_quantity - case when l_orderkey % 17 = 0 then 10 else 0 end"

# De novo view: every line item is a sub-composition of its order's formula, shifted by -8 .. 8 ppm.
DENOVO_FORMULA = (
    f"concat('C', 3 + {K} % 5, 'H', 4 + {K} % 7, case when {K} % 3 > 0 then concat('N', {K} % 3) else '' end, "
    f"'O', 1 + {K} % 3, case when {K} % 4 = 0 then 'Cl' else '' end, case when {K} % 10 = 0 then 'S' else '' end)"
)
DENOVO_MASS = (
    "(1 + l_partkey % (3 + l_orderkey % 5)) * 12.0e0 + (l_suppkey + l_linenumber) % (5 + l_orderkey % 7) * 1.0078250322e0"
    " + l_suppkey % (1 + l_orderkey % 3) * 14.003074004e0 + l_linenumber % (2 + l_orderkey % 3) * 15.994914619e0"
    " + case when l_orderkey % 4 = 0 and l_linenumber % 2 = 0 then 34.9688527e0 else 0.0e0 end"
)
DENOVO_MZ = f"round(({DENOVO_MASS}) * (1 + ((l_partkey + l_suppkey) % 17 - 8) / 1000000.0e0) + 1.0078250322e0, 6)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _peaks(spark: SparkSession, sf_dir: str, mz: str, intensity: str) -> DataFrame:
    """Peak lists, most intense peak first."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct((-F.expr(intensity)).alias("o"), F.expr(mz).alias("mz")).alias("p")
    )
    lists = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return lists.select(
        F.col("l_orderkey").alias("record_id"),
        F.transform("p", lambda p: F.struct(p["mz"].alias("mz"), (-p["o"]).alias("intensity"))).alias("peaks"),
    )


def _spread(joined: DataFrame) -> DataFrame:
    """Hash partitioning on the join key. After a shuffled join it is there already and costs
    nothing; small tables, joined by broadcast in one task, get their parallelism from it."""
    return joined.repartition("record_id")


def _orders(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """Orders, with their customers where a field needs the name."""
    orders = table(spark, sf_dir, "orders")
    if any("c_name" in HEADER[n] for n in names):
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
        orders = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
    return orders


def _fields(names: list[str]) -> list[Column]:
    return [F.expr(HEADER[n].replace("varchar(20)", "string")).alias(n) for n in dict.fromkeys(["record_id", *names])]


def headers(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    names = list(HEADER) if columns is None else columns
    return _orders(spark, sf_dir, names).select(*_fields(names))


def spectra_raw(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Raw spectra; ``columns`` names the header fields a query needs.

    The fields are derived after the join: the shuffle moves the few columns of an order instead of all
    its fields, and the work on the fields is spread over its tasks, not over the splits of one file.
    """
    names = list(HEADER) if columns is None else columns
    peaks = _peaks(spark, sf_dir, MZ, INTENSITY).withColumnRenamed("record_id", K)
    joined = _orders(spark, sf_dir, names).join(peaks, K, "left").repartition(K)
    return joined.select(*_fields(names), F.coalesce("peaks", F.array().cast(PEAKS_TYPE)).alias("peaks"))


def spectra_with_copies(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Raw spectra plus richer or equal copies of every seventh one."""
    raw = spectra_raw(spark, sf_dir, columns)
    copies = raw.filter("record_id % 7 = 0").withColumns(
        {
            "comment": F.expr("concat(comment, repeat('x', cast(record_id % 13 as int)))"),
            "record_id": F.col("record_id") + 1_000_000_000,
        }
    )
    return raw.unionByName(copies)


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound table from customers; odd keys have no name."""
    return table(spark, sf_dir, "customer").select(
        *[
            F.expr(e.replace("{0}", "c_custkey").replace("varchar(20)", "string")).alias(c)
            for c, e in COMPOUND_EXPRS.items()
        ]
    )


COMPOUND_EXPRS = {
    "inchikey": INCHIKEY,
    "inchi": INCHI,
    "smiles": SMILES,
    "formula": COMPOUND_FORMULA,
    "name": "case when {0} % 2 = 1 then null else c_name end",
    "exactmass": "100 + {0} * 0.5e0",
    "averagemass": "100 + {0} * 0.75e0",
}
ONTOLOGY_EXPRS = {
    "inchikey": INCHIKEY,
    "classyfire_superclass": "r_name",
    "classyfire_class": "n_name",
    "classyfire_subclass": "c_mktsegment",
    "npclass_pathway": "concat('pathway ', {0} % 5)",
    "npclass_superclass": "case when {0} % 3 = 0 then null else n_name end",
    "npclass_class": "c_mktsegment",
}


def ontologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ontology table from customer, nation and region; every fifth compound is absent."""
    joined = (
        table(spark, sf_dir, "customer")
        .filter("c_custkey % 5 <> 0")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(
        *[
            F.expr(e.replace("{0}", "c_custkey").replace("varchar(20)", "string")).alias(c)
            for c, e in ONTOLOGY_EXPRS.items()
        ]
    )


def denovo_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra with a formula and peaks that are mostly explained by it."""
    peaks = _peaks(spark, sf_dir, DENOVO_MZ, INTENSITY)
    orders = table(spark, sf_dir, "orders").select(
        F.col(K).alias("record_id"), F.expr(DENOVO_FORMULA).alias("formula")
    )
    return _spread(orders.join(peaks, "record_id"))
