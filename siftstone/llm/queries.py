"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import bpe, decontamination, exact_dedup, line_dedup, lm_scoring, near_dedup, sharding, token_counts, token_files, toxicity
from siftstone.llm.common import crc32, durable, settle, table


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are installed; they are no part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle(spark)
    path = f"{sf_dir}/documents.parquet"
    written = sharding.rewrite(spark, path, durable(sharding.reshard(spark, path, shards=16), "shard-plan"), shards=16)
    rows, text = written.rows(spark, "doc_id", "text"), F.col("text")
    size, crc = sharding.text_size(text).alias("size"), crc32(F.coalesce(text, F.lit(""))).alias("text_crc32")
    return rows.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    kept = line_dedup.drop_repeated_lines(docs, min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontamination.contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    target = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").where("quality = 1 and toxic = 0").select("doc_id")
    return lm_scoring.cross_entropy_difference(docs, target)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    codec = bpe.Codec.from_ranks(tokenizer_path("byte_bpe_50k.tiktoken"))
    return bpe.digests(bpe.round_trip(docs, codec))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(toxicity.learnable())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    held_out = F.coalesce(~toxicity.learnable(), F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents", "doc_id", "text"), size=2, similarity=80)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    codec = bpe.Codec.from_json(tokenizer_path("byte_bpe_50k.json"))
    return token_files.write(docs, codec, end_id=2).documents()


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.json"), limit=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_line_dedup, op3_decontamination, op4_lm_scoring, op5_exact_dedup, op6_byte_bpe, op7_toxicity, op8_near_dedup, op9_token_files, op10_token_counts)}


_OP2 = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, row_number() OVER () AS r FROM documents
), line AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
), frequent AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT keyed.*, frequent.k IS NOT NULL AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

_OP5 = r"""
WITH squeezed AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM squeezed WINDOW w AS (PARTITION BY t)
"""


_OP8 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM worded
), one AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS n, count(*) AS c FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM shared WHERE 100 * c >= 80 * (n - c)
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT link.y, reach.root FROM reach JOIN link ON reach.doc_id = link.x
), least AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _OP2, "op5_exact_dedup": _OP5, "op8_near_dedup": _OP8}
