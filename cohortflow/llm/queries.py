"""Registered queries of the training-data operators and their DuckDB SQL.

Each query applies its operator to its whole table with production
parameters and derives the result columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (centroids, decontaminate, fingerprints, html_extract, license_scan, line_dedup, merkle, mixing,
               quality_model, quality_rules, simhash, suffix_dedup, token_counts)
from .common import table
from .oracle_sql import centroids_sql, merkle_sql

Q, O = {}, {}


def _query(fn):
    Q[fn.__name__] = fn
    return fn


@_query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                     F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@_query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mixing.mix(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "size", "source_size", "target", "taken", "copies")


@_query
def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    df = html_extract.extract(pages, html_extract.train(pages))
    return df.select("_row.page_id", "_row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


@_query
def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    df = quality_model.scores(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))
    return df.select("doc_id", quality_model.held_out("doc_id").alias("held_out"), "score",
                     (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"))


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    df = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                   budget=token_counts.LIMIT)
    return df.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"),
                     "budget_bytes")


@_query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return df.select("doc_id", *quality_rules.MEASURES, (~quality_rules.passes("base")).alias("base_failed"),
                     quality_rules.passes("v1").alias("kept"), "failure_bits")


@_query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@_query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = simhash.grouped(table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


@_query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fingerprints.edited_neighbours(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                     "near_next", "next_prefix")


@_query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@_query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = merkle.manifest(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                     "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


O["op1_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM d, lens, LATERAL (SELECT unnest(range(1, greatest(len(w) - n, -1) + 2)) AS i)),
hits AS (SELECT g.doc_id, g.i, g.n, wins.item_id FROM grams g JOIN wins ON g.n = wins.n AND g.win = wins.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL)
        GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

# shared with the pipeline: measurements, then failure bits and verdicts
MEASURED_SQL = r"""
w AS (SELECT doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, hash(w[i], w[i + 1], w[i + 2]) AS h, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
      FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
       FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
bits AS (SELECT *, """ + " + ".join(
    f"CASE WHEN {p} THEN CAST({quality_rules.bit(r)} AS BIGINT) ELSE 0 END" for r, p in quality_rules.RULES.items()
) + " AS failure_bits FROM m)"

O["op6_quality_rules"] = f"""
WITH {MEASURED_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failure_bits & {quality_rules.mask("base")}) <> 0 AS base_failed,
  (failure_bits & {quality_rules.mask("v1")}) = 0 AS kept, failure_bits
FROM bits
"""

O["op12_centroids"] = centroids_sql()
O["op13_merkle"] = merkle_sql()
