"""The queries of this subpackage: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import (
    bpe, embeddings, fim, merkle, mixing, pii, quality, quality_rules, sharding, simhash, token_files, toxicity, url_filter,
)
from tallyloom.llm.samples import held_out
from tallyloom.llm.common import new_folder, table, word_count

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, TOKENIZER)
    written = token_files.read_tokens(spark, path)
    rows = token_files.with_starts(token_files.with_crc(written), lengths=written)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER).drop("text")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, count="n_entities")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.label_documents(docs, model).drop("text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = word_count(F.col("text")).alias("size")
    mixed = mixing.mix(docs.select("source", size, F.col("doc_id").cast("string").alias("hash")))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select(F.col("hash").cast("long").alias("doc_id"), "size", "source_size", "target", taken)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, toxicity.THRESHOLD)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.grades(table(spark, sf_dir, "labels")))
    return quality.rate(docs, model).drop("text")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text, 256)
    restored = fim.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored).alias("restored_sha256"),
    )


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    row = lambda t: merkle.digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = table(spark, sf_dir, "documents").select(
        "doc_id", "source", row(text).alias("leaf"), F.when(tampered, row(merkle.lowered(text))).alias("tampered_leaf")
    )
    found = merkle.proofs(leaves, "source", "doc_id")
    again = merkle.folded(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


# Host case is the only place where lower() could differ from A-Z alone: letters beyond ASCII in a host.
OP4_SQL = r'''
WITH RECURSIVE rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
p AS (
  SELECT page_id, coalesce(url, '') AS url, html FROM pages),
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE regexp_matches(html, '(?i)canonical|refresh')),
quoted AS (
  SELECT url, lower(tag[2:5]) AS kind, [trim(trim(regexp_extract(tag, '(?i)[\s"''/]' || name || '\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), chr(34) || chr(39)), chr(9) || chr(10) || chr(12) || chr(13) || ' ')
    FOR name IN ['rel', 'href', 'http-equiv', 'content']] AS found
  FROM tags),
attributes AS (
  SELECT url, kind, list_transform(found, lambda x: replace(replace(replace(replace(replace(replace(replace(
    x, '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&#38;', '&'), '&#x26;', '&'), '&amp;', '&')) AS found
  FROM quoted),
targets AS (
  SELECT url, found[2] AS target FROM attributes WHERE kind = 'link' AND list_contains(regexp_split_to_array(lower(found[1]), '\s+'), 'canonical')
  UNION ALL
  SELECT url, trim(ltrim(regexp_extract(found[4], '(?is)^[\d.\s]*[;,]?\s*url\s*=\s*("[^"]*|''[^'']*|[^"''\s].*)', 1), chr(34) || chr(39))) FROM attributes
  WHERE kind = 'meta' AND lower(found[3]) = 'refresh'),
resolved AS (
  SELECT url, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN starts_with(target, '/') THEN 'http://' || regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) || target
    ELSE 'http://' || regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)
      || coalesce(nullif(regexp_extract(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(?s)^(.*/)', 1), ''), '/') || target END AS target
  FROM targets WHERE target <> '' AND regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) <> ''),
ends AS (SELECT url AS a, target AS b FROM resolved UNION ALL SELECT target, url FROM resolved),
edges AS (
  SELECT DISTINCT lower(regexp_extract(a, '(?s)^.*?://([^/?#]*)', 1)) || coalesce(nullif(regexp_extract(a, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(a, '(?s)^.*?://[^/?#]*[^?#]*([^#]*)', 1) AS a,
    lower(regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1)) || coalesce(nullif(regexp_extract(b, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(b, '(?s)^.*?://[^/?#]*[^?#]*([^#]*)', 1) AS b
  FROM ends WHERE regexp_extract(a, '(?s)^.*?://([^/?#]*)', 1) <> '' AND regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1) <> ''),
nodes AS (
  SELECT DISTINCT a AS node, regexp_extract(a, '^[^/?#]*') AS host, regexp_extract(a, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM edges),
seeds AS (
  SELECT node, arg_max(r.verdict, length(r.host || r.path)) AS verdict FROM nodes n
  JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY node),
reach(node, verdict) AS (
  SELECT node, verdict FROM seeds UNION SELECT e.b, reach.verdict FROM reach JOIN edges e ON e.a = reach.node),
aliases AS (SELECT node, min(verdict) AS verdict FROM reach GROUP BY node),
own AS (
  SELECT page_id, url, lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*([^#]*)', 1) AS query
  FROM p)
SELECT o.page_id, o.host, o.path,
  (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM rules r WHERE (o.host = r.host OR ends_with(o.host, '.' || r.host)) AND starts_with(o.path, r.path)) AS rule,
  coalesce((SELECT arg_max(r.verdict, length(r.host || r.path)) FROM rules r WHERE (o.host = r.host OR ends_with(o.host, '.' || r.host)) AND starts_with(o.path, r.path)),
    a.verdict, 'allow') AS verdict
FROM own o LEFT JOIN aliases a ON o.host <> '' AND a.node = o.host || coalesce(nullif(o.path, ''), '/') || o.query
'''

OP11_SQL = r'''
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || doc_id) AS h FROM documents),
cuts AS (
  SELECT doc_id, text, lines, len(lines) AS n, ('0x' || h[1:8])::BIGINT % (len(lines) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(lines) + 1) AS c2,
    ('0x' || h[25:32])::BIGINT % 100 AS pick
  FROM d),
parts AS (
  SELECT doc_id, text, n, pick, array_to_string(lines[1:least(c1, c2)], '') AS p, array_to_string(lines[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
    array_to_string(lines[greatest(c1, c2) + 1:], '') AS s,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain
  FROM cuts)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN pick < 50 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN pick < 50 THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
'''

# A proof step is the hashes before and after a node's own in its run. CRC-32 goes bit by bit over the id's few bytes.
OP13_SQL = r'''
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, text IS NULL AS no_text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    (4294967295 - list_reduce(list_concat([4294967295::BIGINT], flatten([[(ord(c) >> b) & 1 FOR b IN range(8)] FOR c IN string_split(doc_id::VARCHAR, '')])),
      lambda crc, bit: xor(crc >> 1, CASE WHEN (crc & 1) <> bit THEN 3988292384 ELSE 0 END))) % 5 = 0 AS tampered
  FROM documents),
leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank,
    sha256(head || CASE WHEN no_text THEN '-' ELSE strlen(t) || ':' || t END) AS leaf,
    CASE WHEN tampered THEN sha256(head || CASE WHEN no_text THEN '-'
      ELSE strlen(t) || ':' || translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS changed
  FROM d),
nodes(source, level, rank, hash, n) AS (
  SELECT source, 0, rank, leaf, count(*) OVER (PARTITION BY source) FROM leaves
  UNION ALL
  SELECT source, level + 1, rank, hash, count(*) OVER (PARTITION BY source) FROM (
    SELECT source, level, rank // 16 AS rank, sha256(string_agg(hash, '' ORDER BY rank)) AS hash FROM nodes WHERE n > 1 GROUP BY source, level, rank // 16)),
subroots AS (SELECT source, hash, level AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank FROM nodes WHERE n = 1),
above(level, rank, hash, n) AS (
  SELECT 0, rank, hash, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, rank, hash, count(*) OVER () FROM (
    SELECT level, rank // 16 AS rank, sha256(string_agg(hash, '' ORDER BY rank)) AS hash FROM above WHERE n > 1 GROUP BY level, rank // 16)),
steps AS (
  SELECT a.source, a.level, a.rank, coalesce(string_agg(b.hash, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS before,
    coalesce(string_agg(b.hash, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS after
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.rank // 16 = b.rank // 16
  WHERE a.n > 1 GROUP BY ALL),
steps_above AS (
  SELECT a.level, a.rank, coalesce(string_agg(b.hash, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS before,
    coalesce(string_agg(b.hash, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS after
  FROM above a JOIN above b ON a.level = b.level AND a.rank // 16 = b.rank // 16 WHERE a.n > 1 GROUP BY ALL),
paths AS (
  SELECT l.doc_id, l.source, l.rank, l.leaf, l.changed, s.hash AS subroot,
    list({'level': p.level, 'before': p.before, 'after': p.after} ORDER BY p.level) FILTER (p.level IS NOT NULL) AS low
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
  LEFT JOIN steps p ON p.source IS NOT DISTINCT FROM l.source AND p.rank = l.rank // (16 ** p.level)::BIGINT GROUP BY ALL),
tops AS (
  SELECT s.source, list({'level': p.level, 'before': p.before, 'after': p.after} ORDER BY p.level) FILTER (p.level IS NOT NULL) AS high
  FROM subroots s LEFT JOIN steps_above p ON p.rank = s.rank // (16 ** p.level)::BIGINT GROUP BY ALL),
whole AS (
  SELECT doc_id, leaf, coalesce(changed, leaf) AS shown, subroot, (SELECT hash FROM above WHERE n = 1) AS root,
    list_concat(coalesce(low, []), coalesce(high, [])) AS path
  FROM paths p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source),
folds AS (
  SELECT *, list_reduce(list_concat([{'level': 0::BIGINT, 'before': shown, 'after': ''}], [{'level': s.level::BIGINT, 'before': s.before, 'after': s.after} FOR s IN path]),
    lambda h, s: {'level': 0::BIGINT, 'before': sha256(s.before || h.before || s.after), 'after': ''}).before AS folded_root
  FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s.before || s.after FOR s IN path], '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folds
'''

QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_token_files": op2_token_files,
    "op3_bpe": op3_bpe,
    "op4_urls": op4_urls,
    "op5_pii": op5_pii,
    "op6_embeddings": op6_embeddings,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_sharding": op12_sharding,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {"op4_urls": OP4_SQL, "op11_fill_in_middle": OP11_SQL, "op13_merkle": OP13_SQL}
