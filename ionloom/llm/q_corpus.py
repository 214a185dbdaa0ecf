"""Queries of the corpus operators over the whole given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm import (
    conversations,
    decontam,
    html_text,
    language,
    licenses,
    minhash,
    mixing,
    quality,
    sharding,
    suffixes,
    surrogates,
    warc,
    whitening,
)
from ionloom.llm.common import table

QUERIES = {}
ORACLES = {}


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression bands and base counts of every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "slot", "shard_id", "shard", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))


QUERIES |= {"op7_quality_rules": op7_quality_rules, "op10_sharding": op10_sharding}

ORACLES["op10_sharding"] = f"""
WITH owners AS (
  SELECT unnest(range({sharding.SLOTS})) AS slot,
         unnest([{",".join(map(str, sharding.lookup_table()))}]) AS shard_id
), placed AS (
  SELECT doc_id, coalesce(text, '') AS t,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT
           % {sharding.SLOTS} AS slot
  FROM documents
)
SELECT doc_id, slot, CAST(shard_id AS INTEGER) AS shard_id, 'shard-' || lpad(CAST(shard_id AS VARCHAR), 3, '0') AS shard,
       length(t) AS n_chars
FROM placed JOIN owners USING (slot)
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("_k1", "_k2")


QUERIES["op9_decontamination"] = op9_decontamination

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLES["op9_decontamination"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
s AS (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM s),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
hit AS (SELECT pos.r, pos.p, pos.k, win.item FROM pos JOIN win ON pos.k = win.k AND array_to_string(pos.w[p:p + pos.k - 1], ' ') = win.g),
spread AS (SELECT DISTINCT r, unnest(range(p, p + k)) AS at FROM hit),
hits AS (SELECT r, count(*) AS n_hit FROM spread GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


QUERIES["op4_mixing"] = op4_mixing


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


QUERIES["op6_minhash"] = op6_minhash


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record facts of every page, from the merged index of the archives read back."""
    merged = warc.capture_histories(table(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op3_warc"] = op3_warc
ORACLES["op3_warc"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= {warc.MIN_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)
"""


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


QUERIES["op2_html_text"] = op2_html_text


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 400-byte strings."""
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES["op1_suffix_dedup"] = op1_suffix_dedup


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data and secrets."""
    return surrogates.replace_entities(table(spark, sf_dir, "documents"))


QUERIES["op5_surrogates"] = op5_surrogates


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families declared in every document."""
    return licenses.document_licenses(table(spark, sf_dir, "documents"))


QUERIES["op8_licenses"] = op8_licenses


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first whitened components of every embedding."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES["op11_whitening"] = op11_whitening


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return conversations.repaired_conversations(table(spark, sf_dir, "conversations"))


QUERIES["op12_conversations"] = op12_conversations

# The checksum bit by bit; an automaton over the rows with the least (cost, audit) per state.
ORACLES["op12_conversations"] = r"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), src AS (
  SELECT conv_id, turn, role, text,
         encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k
  FROM conversations
), codes AS (
  SELECT *, list_transform(range(CAST(octet_length(k) AS BIGINT)), lambda i: CAST(('0x' || substr(hex(k), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)) AS b FROM src
), harmed AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[1 + xor(c & 255, x)])), 4294967295) % 20 AS harm
  FROM codes, bytes
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
         unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy
  FROM harmed WHERE harm <> 0
), placed AS (
  SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS role_before,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), faults AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank FROM placed
), kinds AS (
  SELECT *, NOT blank AND nth > 1 AS duplicate,
         NOT blank AND nth = 1 AND NOT regexp_matches(text, '[.!?][ 	-
]*$') AS truncated,
         pos > 1 AND left(role_before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM faults
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, max(pos) AS n
  FROM kinds GROUP BY conv_id
), ways AS (
  SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(s, c, t)
), needs AS (
  SELECT * FROM (VALUES (0, 2, 'user:'), (1, 2, 'user:'), (2, 3, 'assistant:'), (3, 2, 'user:')) v(s, t, line)
), steps AS (
  SELECT s, '' AS letters, s AS t, 0 AS cost, CAST([] AS VARCHAR[]) AS lines FROM (VALUES (0), (1), (2), (3)) v(s)
  UNION ALL SELECT s, 'I', t, 2, [line] FROM needs
  UNION ALL SELECT a.s, 'II', b.t, 4, [a.line, b.line] FROM needs a JOIN needs b ON b.s = a.t
), best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS s, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])} AS v FROM counts
  UNION ALL
  SELECT conv_id, pos, s, min(v) FROM (
    SELECT b.conv_id, k.pos, e.t AS s,
           {'cost': b.v.cost + i.cost + e.cost, 'audit': b.v.audit || i.letters || e.letter,
            'lines': b.v.lines || i.lines || (CASE WHEN e.role = '' THEN [] ELSE [e.role || ':' || k.text] END)} AS v
    FROM best b JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM b.conv_id AND k.pos = b.pos + 1
    JOIN steps i ON i.s = b.s
    CROSS JOIN LATERAL (
      SELECT i.t AS t, 3 AS cost, 'D' AS letter, '' AS role
      UNION ALL SELECT w.t, CASE WHEN k.truncated THEN 1 ELSE 0 END, 'K', k.role FROM ways w WHERE w.s = i.t AND w.c = left(k.role, 1) AND NOT k.blank AND NOT k.duplicate
      UNION ALL SELECT x.t, CASE WHEN k.truncated THEN 3 ELSE 2 END, 'R', CASE WHEN x.t = 2 THEN 'user' ELSE 'assistant' END
        FROM needs x WHERE x.s = i.t AND NOT k.blank AND NOT k.duplicate
    ) e
  ) GROUP BY conv_id, pos, s
), ends AS (
  SELECT b.conv_id, min({'cost': b.v.cost + i.cost, 'audit': b.v.audit || i.letters, 'lines': b.v.lines || i.lines}) AS v
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.pos JOIN steps i ON i.s = b.s
  WHERE i.t IN (0, 3) GROUP BY b.conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(e.v.cost, 0) AS cost, coalesce(e.v.audit, '') AS audit,
       sha256(coalesce(array_to_string(e.v.lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


QUERIES["op13_language"] = op13_language
