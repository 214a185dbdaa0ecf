"""Instrument recognition with an ordered five-level rule tree."""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions.text import clean_instrument_text
from ionloom.session import local_table

LEVELS = ["brand", "model", "spectrum_type", "instrument_type", "ionisation"]
NO_MATCH = "not found"
PATH_MARK = " > "
RESOLUTIONS = ["high", "low", "unknown"]
#: Rules up to this number become literal patterns of a narrow projection; more become a table.
LITERAL_RULES = 200


class InstrumentRule(NamedTuple):
    brand: str
    model: str
    spectrum_type: str
    instrument_type: str
    ionisation: str
    resolution: str
    solution: str


def _children(rules: list[InstrumentRule]) -> dict[tuple, list[str]]:
    """Parent path -> keys in rule order."""
    tree: dict[tuple, list[str]] = {}
    for rule in rules:
        for depth in range(len(LEVELS)):
            keys = tree.setdefault(tuple(rule[:depth]), [])
            if rule[depth] not in keys:
                keys.append(rule[depth])
    return tree


def _path(keys: tuple) -> str:
    return PATH_MARK.join(keys)


def word_pattern(key: str) -> str:
    return rf"(\b|^|$){key}(\b|^|$)"


def has_word(text: Column, key: str) -> Column:
    """Whole-word match; a plain key is looked for as a substring first, which is cheaper."""
    whole = text.rlike(word_pattern(key))
    return F.contains(text, F.lit(key)) & whole if re.fullmatch(r"[\w ]+", key) else whole


def match_instrument(df: DataFrame, rules: list[InstrumentRule], by_index: bool | None = None) -> DataFrame:
    """Add one column per level with the first key found as a whole word, else ``not found``.

    A path that leaves the tree turns every deeper level NULL. A few rules become literal patterns:
    the match is a narrow projection without a join. Many are matched by an index, on distinct texts.
    """
    text = F.concat(
        F.lit(". "), clean_instrument_text(F.col("instrument"), F.col("instrumenttype"), F.col("comment")), F.lit(" .")
    )
    out = df.withColumn("instrument_text", text)
    if by_index if by_index is not None else len(rules) > LITERAL_RULES:
        texts = out.select(F.col("instrument_text").alias("_text")).distinct()
        matched = match_by_table(texts, rules)
        return out.join(matched, F.col("instrument_text").eqNullSafe(F.col("_text")), "left").drop("_text")
    tree = _children(rules)
    for depth, level in enumerate(LEVELS):
        branch: Column | None = None
        for path, keys in tree.items():
            if len(path) != depth:
                continue
            found = F.coalesce(
                *[F.when(has_word(F.col("instrument_text"), k), F.lit(k)) for k in keys], F.lit(NO_MATCH)
            )
            here = F.col("instrument_path") == _path(path) if depth else F.lit(True)
            branch = F.when(here, found) if branch is None else branch.when(here, found)
        out = out.withColumn(level, branch)
        trail = F.concat("instrument_path", F.lit(PATH_MARK), level) if depth else F.col(level)
        out = out.withColumn("instrument_path", trail)
    return out


def match_by_table(texts: DataFrame, rules: list[InstrumentRule]) -> DataFrame:
    """The same match on distinct texts (``_text``) by an inverted index.

    A key that is plain words is posted under its rarest word, the one that fewest keys of the rules have; a text
    meets only the keys, below its path so far, whose rarest word it has. They are verified as whole words,
    and the first in rule order wins. Keys that are patterns are posted under no word and met by every text there.
    """
    out = texts.withColumn("instrument_path", F.lit(""))
    postings, inner = _postings(rules)
    for depth, level in enumerate(LEVELS):
        index = local_table(texts.sparkSession, postings[depth], ["_parent", "_word", "_order", "_key"])
        words = F.array_distinct(F.concat(F.split("_text", r"\W+"), F.array(F.lit(""))))
        posted = out.select("_text", "instrument_path", F.explode(words).alias("_word"))
        met = posted.join(index, (F.col("instrument_path") == F.col("_parent")) & (posted["_word"] == index["_word"]))
        whole = F.rlike("_text", F.concat(F.lit(r"(\b|^|$)"), "_key", F.lit(r"(\b|^|$)")))
        first = met.filter(whole).groupBy("_text").agg(F.min_by("_key", "_order").alias("_found"))
        nodes = local_table(texts.sparkSession, [(p, True) for p in inner[depth]], ["instrument_path", "_inner"])
        joined = out.join(first, "_text", "left").join(nodes, "instrument_path", "left")
        joined = joined.withColumn(level, F.when(F.col("_inner"), F.coalesce("_found", F.lit(NO_MATCH))))
        trail = F.concat("instrument_path", F.lit(PATH_MARK), level) if depth else F.col(level)
        out = joined.withColumn("instrument_path", trail).drop("_found", "_inner")
    return out.select("_text", *LEVELS, "instrument_path")


def _postings(rules: list[InstrumentRule]) -> tuple[dict[int, list[tuple]], dict[int, list[str]]]:
    """Per level the index rows (path, rarest word or '', place in rule order, key) and the paths that have keys."""
    tree = _children(rules)
    own = {key: re.findall(r"\w+", key) if re.fullmatch(r"[\w ]+", key) else [] for keys in tree.values() for key in keys}
    frequency = Counter(word for words in own.values() for word in set(words))
    postings: dict[int, list[tuple]] = {d: [] for d in range(len(LEVELS))}
    inner: dict[int, list[str]] = {d: [] for d in range(len(LEVELS))}
    for path, keys in tree.items():
        inner[len(path)].append(_path(path))
        for place, key in enumerate(keys):
            rarest = min(own[key], key=lambda w: (frequency[w], -len(w), w), default="")
            postings[len(path)].append((_path(path), rarest, place, key))
    return postings, inner


def assign_resolution(df: DataFrame, rules: list[InstrumentRule]) -> DataFrame:
    """Write instrument, type, resolution and ionisation of the matched leaf; keep unmatched rows."""
    leaves: dict[str, dict[str, str]] = {}
    for rule in rules:
        leaves.setdefault(_path(rule[:5]), {}).setdefault(rule.resolution, rule.solution)
    table = {
        path: next(options[r] for r in RESOLUTIONS if r in options)
        for path, options in leaves.items()
        if any(r in options for r in RESOLUTIONS)
    }
    usable = {path: text for path, text in table.items() if text.count(",") >= 2}
    if len(usable) > LITERAL_RULES:
        table = local_table(df.sparkSession, list(usable.items()), ["_path", "_solution"])
        df = df.join(table, F.col("instrument_path") == F.col("_path"), "left").drop("_path")
        solution = F.col("_solution")
    else:
        solutions = F.create_map(*[F.lit(x) for x in chain.from_iterable(usable.items())])
        solution = F.try_element_at(solutions, F.col("instrument_path"))
    parts = F.split(solution, ",")

    def part(i: int) -> Column:
        return F.trim(F.get(F.col("_parts"), F.lit(i)))

    source = F.trim(F.get(F.split(F.get(F.col("_parts"), F.lit(1)), "-"), F.lit(1)))
    return (
        df.withColumn("_parts", parts)
        .withColumns(
            {
                "instrument": F.coalesce(part(0), F.col("instrument")),
                "instrumenttype": F.coalesce(part(1), F.col("instrumenttype")),
                "resolution": F.coalesce(part(2), F.col("resolution")),
                "ionization": F.coalesce(source, F.col("ionization")),
            }
        )
        .drop("_parts", "_solution", "instrument_path")
    )


def normalize_instruments(df: DataFrame, rules: list[InstrumentRule]) -> DataFrame:
    return assign_resolution(match_instrument(df, rules), rules).drop("instrument_text", *LEVELS)
