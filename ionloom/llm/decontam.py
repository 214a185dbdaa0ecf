"""Benchmark decontamination by a prefix-filtered set join.

A window is `size` consecutive words of a benchmark item (a shorter item is one window). A document
that holds a window holds every shingle of it, so joining on one necessary shingle, the prefix of
length one in the order of rarity, loses nothing. Rarity is counted over all documents. Matches of
the prefix word give a start (its position less its offset in the window); the length and position
bounds drop starts outside the document, and the words there are compared with the whole window.

The document side never shuffles: words are unfolded, probed and verified in one pass. Windows are
joined in chunks of at most `CHUNK_ROWS` rows, each small enough to broadcast; a larger benchmark
takes more passes, never a larger broadcast. DataFrame functions only.

Defined cases: null text has no words; A-Z is lower-cased, other letters are not; items without
words have no window; a null item_id counts as the id ''; rows that repeat an id count once as an
item, documents are judged row by row; columns of the input other than those named are not read.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import KEY, key_columns
from ionloom.session import stage

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHUNK_ROWS = 250_000


def lower_ascii(text: Column) -> Column:
    return F.when(F.lower(text) == text, text).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def item_windows(items: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """(item, window, n): distinct windows of each item, the words joined by blanks."""
    split = items.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"),
        words(lower_ascii(F.col(text_column))).alias("w"),
    ).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    spread = split.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("s"))
    window = F.slice("w", F.col("s") + 1, size)
    return spread.select("item", F.concat_ws(" ", window).alias("window"), F.size(window).alias("n")).distinct()


def chunks(df: DataFrame, key: str, rows: int = CHUNK_ROWS) -> list[DataFrame]:
    """Parts of at most about `rows` rows, cut by the key's hash and fit to broadcast."""
    n = max(1, ceil(df.count() / rows))
    part = F.pmod(F.xxhash64(key), F.lit(n))
    return [F.broadcast(df.filter(part == i) if n > 1 else df) for i in range(n)]


def document_words(docs: DataFrame, text_column: str) -> DataFrame:
    """(keys, words, position, lower-cased word)"""
    split = docs.select(*KEY, words(F.col(text_column)).alias("w"))
    return split.select(*KEY, "w", F.posexplode("w").alias("at", "raw")).withColumn("word", lower_ascii(F.col("raw")))


def rarest_words(docs: DataFrame, windows: DataFrame, text_column: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """(window, n, word, offset): the word of each window that documents hold least often."""
    spread = windows.select("window", "n", F.posexplode(F.split("window", " ")).alias("offset", "word"))
    vocabulary = stage(spread.select("word").distinct(), "vocabulary")
    exploded = document_words(docs, text_column).select("word")
    counted = [exploded.join(part, "word", "left_semi") for part in chunks(vocabulary, "word", rows)]
    counts = reduce(DataFrame.union, counted).groupBy("word").agg(F.count("*").alias("freq"))
    order = F.struct("freq", "word", "offset")
    # A window word that no document has rules its window out: the inner join and the size check drop it.
    best = spread.join(counts, "word").groupBy("window", "n").agg(F.min(order).alias("first"), F.count("*").alias("known"))
    return best.filter(F.col("known") == F.col("n")).select("window", "n", "first.word", "first.offset")


def window_hits(docs: DataFrame, prefixes: DataFrame, text_column: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, start, n, window): every occurrence of a window."""
    exploded = document_words(docs, text_column)

    def verified(part: DataFrame) -> DataFrame:
        start = F.col("at") - F.col("offset")
        inside = (start >= 0) & (start + F.col("n") <= F.size("w"))
        there = lower_ascii(F.concat_ws(" ", F.slice("w", start + 1, F.col("n"))))
        joined = exploded.join(part, "word").filter(inside).filter(there == F.col("window"))
        return joined.select(*KEY, start.alias("start"), "n", "window")

    return reduce(DataFrame.union, [verified(part) for part in chunks(prefixes, "window", rows)])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int = WINDOW,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """A row per document row: id, keys, n_words, n_hit, n_items, items_sha256, contaminated."""
    narrow = docs.select(id_column, text_column, *key_columns(id_column, text_column))
    owned = stage(item_windows(items, size, item_id, item_text), "windows")
    windows = owned.select("window", "n").distinct()
    prefixes = stage(rarest_words(narrow, windows, text_column, rows), "prefixes")
    hits = stage(window_hits(narrow, prefixes, text_column, rows).distinct(), "hits")
    covered = F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("n") - 1)))
    hit_words = hits.groupBy(*KEY).agg(F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    named = hits.select(*KEY, "window").distinct().join(owned.select("window", "item"), "window")
    hit_items = named.groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("ids"))
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    count = F.regexp_count(F.coalesce(F.col(text_column), F.lit("")), F.lit(WORD)).cast("long")
    return (
        narrow.select(id_column, *KEY, count.alias("n_words"))
        .join(hit_words.join(hit_items, KEY), KEY, "left")
        .select(
            id_column, *KEY, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        )
    )


def clean_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW, **names: str) -> DataFrame:
    """The documents, with all their columns, that hold no window."""
    id_column, text_column = names.get("id_column", "doc_id"), names.get("text_column", "text")
    bad = contamination(docs, items, size, **names).filter("contaminated").select(F.col("_k1").alias("_b1"), F.col("_k2").alias("_b2"))
    k1, k2 = key_columns(id_column, text_column)
    return docs.join(bad.distinct(), (k1 == F.col("_b1")) & (k2 == F.col("_b2")), "left_anti")
