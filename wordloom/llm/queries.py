"""Queries over the driver's tables, one per operator, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from wordloom.llm import bpe, chat, decontaminate, licenses, minhash, pii, prefix_trie, quality, simhash, token_counts, token_store, warc, whitening
from wordloom.session import table


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = chat.format_chats(table(spark, folder, "conversations"))
    return rows.select("conv_id", "call_id", "turn", "kind", "role", "level", "place", "linked", "valid", "result_turn", "message")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_token_store(spark: SparkSession, folder: str) -> DataFrame:
    rows = token_store.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    rows = pii.spans(table(spark, folder, "documents"))
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return rows.select("doc_id", *counts, F.sha2(pii.rendered(F.col("base")), 256).alias("base_sha256"), pii.rendered(F.col("spans")).alias("spans"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, folder, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("failed").alias("failed_rules"))


def op9_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.decode(bpe.encode(table(spark, folder, "documents"), vocabulary), vocabulary)
    return rows.select("doc_id", "n_tokens", bpe.sha256_hex(F.col("ids")).alias("ids_sha256"), bpe.sha256_hex(F.col("decoded")).alias("decoded_sha256"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


def op11_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), shingle_words=2)


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    lists = prefix_trie.turn_lists(table(spark, folder, "conversations"))
    rows = prefix_trie.prefix_trie(prefix_trie.with_shared_openings(lists))
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(i - prev, 8))) AS n_repeat_words
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM repeated) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_upper,
         len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutter
  FROM d LEFT JOIN covered USING (doc_id)),
f AS (
  SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_upper > 30 * word_chars THEN 8 ELSE 0 END)
    + (CASE WHEN 100 * n_stutter > 20 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines THEN 32 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS failed_rules
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_rules & 3) <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules
FROM f
"""

# The driver's conversations hold plain turns only: no marked calls or references.
OP3_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
e AS (
  SELECT *, role = 'user' AS asks, CASE role WHEN 'user' THEN turn ELSE turn - 1 END AS asked,
         row_number() OVER (PARTITION BY conv_id, role, turn ORDER BY text) AS nth
  FROM t WHERE role IN ('user', 'assistant') AND conv_id IS NOT NULL AND turn IS NOT NULL),
first_answer AS (SELECT conv_id, asked, text, turn FROM e WHERE NOT asks AND nth = 1),
questions AS (SELECT DISTINCT conv_id, asked FROM e WHERE asks),
linked AS (
  SELECT e.conv_id, e.asked, e.turn, CASE WHEN nth = 1 THEN 'call' ELSE 'repeated' END AS kind, e.role, 'reply' AS name,
         CASE WHEN nth = 1 THEN 0 END AS level, CASE WHEN nth = 1 THEN a.turn IS NOT NULL END AS linked,
         CASE WHEN nth = 1 THEN true END AS valid, CASE WHEN nth = 1 THEN a.turn END AS result_turn, e.text AS ask,
         CASE WHEN nth = 1 THEN a.text END AS content
  FROM e LEFT JOIN first_answer a ON e.conv_id = a.conv_id AND e.asked = a.asked WHERE asks
  UNION ALL
  SELECT e.conv_id, e.asked, e.turn, CASE WHEN nth = 1 THEN 'orphan' ELSE 'repeated' END, e.role, NULL, NULL, NULL, NULL, e.turn, NULL, e.text
  FROM e LEFT JOIN questions q ON e.conv_id = q.conv_id AND e.asked = q.asked
  WHERE NOT asks AND (nth > 1 OR q.asked IS NULL)
  UNION ALL
  SELECT conv_id, CASE role WHEN 'user' THEN turn ELSE turn - 1 END, turn, CASE role WHEN 'user' THEN 'call' ELSE 'orphan' END, role,
         CASE role WHEN 'user' THEN 'reply' END, CASE role WHEN 'user' THEN 0 END, CASE role WHEN 'user' THEN false END,
         CASE role WHEN 'user' THEN true END, CASE role WHEN 'assistant' THEN turn END,
         CASE role WHEN 'user' THEN text END, CASE role WHEN 'assistant' THEN text END
  FROM t WHERE role IN ('user', 'assistant') AND (conv_id IS NULL OR turn IS NULL)
  UNION ALL
  SELECT conv_id, NULL, turn, 'message', role, NULL, NULL, NULL, NULL, NULL, NULL, text
  FROM t WHERE role NOT IN ('user', 'assistant', 'tool'))
SELECT conv_id, 'turn-' || asked AS call_id, turn, kind, role, CAST(level AS INTEGER) AS level, turn AS place, linked, valid, result_turn,
       '{"arguments":' || CASE WHEN ask IS NULL THEN 'null' ELSE '{"text":' || CAST(to_json(ask) AS VARCHAR) || '}' END
       || ',"call_id":' || coalesce('"turn-' || asked || '"', 'null')
       || ',"content":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null')
       || ',"kind":"' || kind || '","level":' || coalesce(CAST(level AS VARCHAR), 'null')
       || ',"name":' || CASE WHEN name IS NULL THEN 'null' ELSE '"' || name || '"' END
       || ',"role":"' || role || '","turn":' || coalesce(CAST(turn AS VARCHAR), 'null') || '}' AS message
FROM linked
"""


# Sets that share 80 percent differ in size by 20 percent at most, and share one of their rarest
# shingles, a fifth of the set and one more.
OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
ranked AS (
  SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS place
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS f FROM flat)),
rare AS (SELECT doc_id, n, g FROM ranked WHERE place <= n - ceil(0.8 * n) + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM rare a JOIN rare b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
shared AS (SELECT a, b, count(*) AS common FROM pairs JOIN flat x ON x.doc_id = a JOIN flat y ON y.doc_id = b AND y.g = x.g GROUP BY a, b),
links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * common >= 80 * (len(x.s) + len(y.s) - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON l.a = r.b)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) ON a = doc_id
"""

OP12_SQL = r"""
WITH codes AS (
  SELECT list(c ORDER BY n) AS crc FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n))),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
         lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), codes),
rebuilt AS (
  SELECT i.conv_id, place, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 100 AND place <= h
  UNION ALL SELECT i.conv_id, place, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND place > h),
lists AS (SELECT i.conv_id, list(md5(length(role) || ':' || role || text) ORDER BY place) FILTER (WHERE text IS NOT NULL) AS s, list(length(text) ORDER BY place) FILTER (WHERE text IS NOT NULL) AS c FROM ids i LEFT JOIN rebuilt r ON r.conv_id = i.conv_id GROUP BY i.conv_id),
members AS (SELECT conv_id, coalesce(len(s), 0) AS size, unnest(range(0, coalesce(len(s), 0) + 1)) AS depth, coalesce(s, []) AS s, c FROM lists),
nodes AS (
  SELECT s[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN c[depth] ELSE 0 END) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM members GROUP BY s[1:depth], depth),
kids AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY node[1:depth - 1], depth - 1),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.node = n.node AND k.depth = n.depth),
below AS (
  SELECT node[1:up] AS node, up AS depth, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM own) GROUP BY node[1:up], up)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, CAST(o.n_children AS BIGINT) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN below b ON b.node = o.node AND b.depth = o.depth LEFT JOIN nodes p ON p.depth = o.depth - 1 AND p.node = o.node[1:o.depth - 1]
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_license_scan, op3_chat_format, op4_token_counts, op5_token_store, op6_warc, op7_pii, op8_quality_rules, op9_bpe_encoding, op10_decontamination, op11_minhash_near_dedup, op12_prefix_trie, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3_SQL, "op8_quality_rules": OP8_SQL, "op11_minhash_near_dedup": OP11_SQL, "op12_prefix_trie": OP12_SQL}
