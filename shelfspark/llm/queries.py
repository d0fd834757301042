"""One query for each operator of this subpackage, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import (
    byte_bpe,
    decontaminate,
    hard_negatives,
    minhash,
    passages,
    quality,
    secret_scan,
    sharding,
    suffix_array,
    token_alignment,
    topk,
    toxicity,
    warc,
)
from shelfspark.llm.registry import query
from shelfspark.suite import sqltext as q


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("*", F.lit(True).alias("contaminated"))


@query("op2_suffix_array")
def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(table(spark, sf_dir, "documents"), 400).drop("spans", "kept")


@query("op3_passages")
def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query("op4_minhash")
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = minhash.Near(shingle=3, percent=85, bands=36, rows=6)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), near)


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"] != "checked")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(spans, one), ",")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        count("checked"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def _urn_sql(kind: str, seed: str) -> str:
    h = f"md5('{kind}:' || {seed})"
    parts = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {parts} || '>'"


OP6_SQL = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html,
    coalesce(CAST(page_id AS VARCHAR), '') || ' ' || coalesce(url, '') AS seed, chr(13) || chr(10) AS nl FROM pages
), r AS (
  SELECT *, {_urn_sql("response", "seed")} AS refers_to, 'sha256:' || sha256(html) AS source_digest,
    {q.visible_text("html")} AS txt, {q.title("html")} AS title FROM p
), b AS (
  SELECT *, 'conversion' AS warc_type, {_urn_sql("conversion", "refers_to")} AS record_id,
    'text/plain; charset=utf-8' AS content_type, txt AS block FROM r
  UNION ALL
  SELECT *, 'metadata' AS warc_type, {_urn_sql("metadata", "refers_to")} AS record_id,
    'application/warc-fields' AS content_type,
    'http-header: HTTP/1.1 200 OK' || nl || 'http-header: Content-Type: text/html; charset=utf-8' || nl
    || 'http-header: Content-Length: ' || CAST(strlen(html) AS VARCHAR) || nl || 'payload-digest: ' || source_digest || nl
    || CASE WHEN title = '' THEN '' ELSE 'title: ' || title || nl END
    || 'derivative: ' || {_urn_sql("conversion", "refers_to")} || nl || 'text-digest: sha256:' || sha256(txt) || nl AS block
  FROM r
), d AS (
  SELECT *, CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest FROM b
)
SELECT page_id, warc_type, record_id, refers_to, url AS target_uri, content_type, content_length, block_digest, source_digest,
  'WARC/1.1' || nl || 'WARC-Type: ' || warc_type || nl || 'WARC-Record-ID: ' || record_id || nl
  || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || coalesce('WARC-Target-URI: ' || url || nl, '')
  || 'WARC-Refers-To: ' || refers_to || nl || 'WARC-Block-Digest: ' || block_digest || nl
  || 'Content-Type: ' || content_type || nl || 'Content-Length: ' || CAST(content_length AS VARCHAR) || nl || nl AS header,
  block
FROM d
"""


@query("op6_warc", OP6_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        sharding.byte_size(F.col("text"), 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
    )
    return sharding.balanced_shards(rows, ["doc_id", "text_crc32", "size"], "size", 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.encode(table(spark, sf_dir, "documents"), path, pattern, keep=["doc_id"], decoded="decoded").select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), pos AS (
  SELECT r, unnest(range(1, len(ws) - 3)) AS i, unnest([ws[k:k + 4] for k in range(1, len(ws) - 3)]) AS win
  FROM w WHERE len(ws) >= 5
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM pos) WHERE c > 1
), rep AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k.k AS p FROM twice, (SELECT unnest(range(5)) AS k) k) GROUP BY r
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)
), b AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m
)
SELECT *, NOT base_failed AND 100 * n_symbols <= 30 * n_words AND word_chars <= 25 * n_words
  AND 2 * word_chars >= 3 * n_words AND 12 * n_dup_lines <= n_words AS kept
FROM b
"""


@query("op10_quality_rules", OP10_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The verdict is the cascade's; the base counts are asked for of every row, rejected or not.
    judged = quality.cascade(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality.measures(judged).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (quality.MEASURED["few_words"]() | quality.MEASURED["repetitive"]()).alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"),
    )


# Scores as whole numbers; components are narrow floats, widened before they are scaled.
OP11_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.w[i] * c.w[i] FOR i IN range(1, len(c.w) + 1)]) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query("op11_topk", OP11_SQL)
def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20, 64)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.l = c.l AS same, CAST(list_sum([a.w[i] * c.w[i] FOR i IN range(1, len(c.w) + 1)]) AS BIGINT) AS score
  FROM v a, v c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = token_alignment.Paths(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return token_alignment.align(table(spark, sf_dir, "documents"), paths, keep=["doc_id"])
