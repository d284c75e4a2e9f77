"""A training corpus from ``documents`` in five stages, each one operator over all that the stage before it kept.

toxicity       documents that the weakly supervised classifier scores 0.3 or more go
line_dedup     lines whose key at least 10 documents have go, in all of them; every document stays, with what is left of its text
near_dedup     of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays
decontaminate  documents that hold a benchmark item, literally or re-parameterised, go
byte_bpe       each text as byte-level BPE ids, and the digest of what they decode to

Rows without an id are never dropped by the third and fourth stage, which name documents by id; rows that share an id stay or go
together.  Null and empty texts are documents without lines, words or tokens, and stay.  Very long texts are read whole.  Extra
columns, whatever their names, are carried along up to the last stage.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import bpe, decontamination, line_dedup, near_dedup, toxicity
from siftstone.llm.common import durable, fits, free, settle, spread, table
from siftstone.llm.queries import tokenizer_path

#: SQL cannot express the classifier, the templates or the merges; the stages are tested against brute force.
ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with its columns named c0, c1, ..., which no operator's own columns clash with; the names of id and text."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), f"c{docs.columns.index('doc_id')}", f"c{docs.columns.index('text')}"


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``gone`` (doc_id), which are sent to the rows if their measured bytes allow it, else joined by a shuffle."""
    ids = durable(gone.where("doc_id is not null").distinct(), "gone")
    return docs.join(F.broadcast(ids) if fits(ids) else ids, "doc_id", "left_anti").select(*(docs[c] for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    plain, doc_id, text = _plain(docs)
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(toxicity.learnable())
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(plain, model, text).where("score < 0.3").drop("score").toDF(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    plain, _, text = _plain(docs)
    kept = line_dedup.drop_repeated_lines(plain, min_docs=10, text_col=text).drop("n_lines", "n_dropped").toDF(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    groups = near_dedup.near_groups(docs.select("doc_id", "text"), size=5, similarity=80)
    return _without(docs, groups.where("not kept").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    found = decontamination.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return _without(docs, found.select("doc_id"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    codec = bpe.Codec.from_ranks(tokenizer_path("byte_bpe_50k.tiktoken"))
    decoded = bpe.round_trip(docs.select("doc_id", "text"), codec)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("decontaminate", drop_contaminated), ("byte_bpe", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            free(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
