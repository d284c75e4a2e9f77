"""The index as a directory of Parquet tables: chunks, vectors, term counts, metadata.

An index is built beside its place and takes it over at the end, so a failed build leaves the old one serving.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.config import EngineConfig
from siftstone.operators import embed
from siftstone.operators.retrieve import Terms, bm25_terms, terms_of
from siftstone.sources.tables import exists, free, ranked, scratch


class IndexMissing(FileNotFoundError):
    """There is no index at the place."""


class IndexMismatch(ValueError):
    """The index was built with another embedding model or dimension."""


@dataclass(frozen=True)
class Index:
    """An opened index; ``id`` numbers the chunks in order of source and place."""

    chunks: DataFrame
    vectors: DataFrame
    terms: Terms
    meta: dict

    @property
    def size(self) -> int:
        return self.meta["chunk_count"]


def _move(spark: SparkSession, old: str, new: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path
    system = at(new).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{new}.{uuid.uuid4().hex}"
    if system.exists(at(new)) and not system.rename(at(new), at(aside)):
        raise OSError(f"cannot move {new} away")
    if not system.rename(at(old), at(new)):
        system.rename(at(aside), at(new))
        raise OSError(f"cannot move {old} to {new}")
    system.delete(at(aside), True)


def numbered(chunks: DataFrame) -> DataFrame:
    """``chunks``, written, with id: their rank by source and place, so ids are unique and in that order at any size."""
    return ranked(chunks, [F.asc_nulls_first("source"), F.asc("chunk_index"), F.asc("chunk_id")], "numbered-chunks", "id")


def fill_cache(spark: SparkSession, chunks: DataFrame, config: EngineConfig, make, cache: str) -> DataFrame:  # noqa: ANN001
    """The vectors (k, v) of all contents: those of the cache, and the missing ones, embedded once each and appended to it."""
    path = f"{cache}/{config.embedding_model.replace('/', '_')}"
    old = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], "k string, v array<float>")
    todo = embed.cache_misses(chunks, old.select("k").distinct())
    embed.embed_texts(todo, make, config.embed_batch_size, config.embed_rpm, config.embed_max_retries).write.mode("append").parquet(path)
    return spark.read.schema("k string, v array<float>").parquet(path).dropDuplicates(["k"])


def build_index(chunks: DataFrame, path: str, config: EngineConfig | None = None, make=None, cache: str | None = None) -> None:  # noqa: ANN001
    """Writes the index of ``chunks`` (as made by build_chunks) to ``path``.  ``make`` makes an embedder in each task."""
    config = config or EngineConfig()
    make = make or (lambda dim=config.embed_dim, unit=config.embed_normalize: embed.HashingEmbedder(dim, unit))
    spark, work = chunks.sparkSession, f"{path.rstrip('/')}.building-{uuid.uuid4().hex}"
    made = numbered(chunks)
    made.write.parquet(f"{work}/chunks")
    free(made)
    rows = spark.read.parquet(f"{work}/chunks")
    vectors = fill_cache(spark, rows, config, make, cache or scratch(spark, "cache"))
    attached = embed.attach_vectors(rows.select("id", "content"), vectors)
    attached.select("id", F.col("v").alias("vector")).write.parquet(f"{work}/vectors")
    written = spark.read.parquet(f"{work}/vectors")
    missing = written.where("vector is null").count()
    if missing:
        raise ValueError(f"{missing} chunks have no vector")
    terms = bm25_terms(rows, "content", config.bm25_epsilon, f"{work}/terms")
    dim = written.select(F.max(F.size("vector"))).first()[0] or 0
    meta = (config.embed_provider, config.chat_provider, config.embedding_model, config.chunk_size, config.chunk_overlap, terms.documents, dim, terms.average)
    names = "embed_provider string, chat_provider string, embedding_model string, chunk_size int, chunk_overlap int, chunk_count bigint, dim int, avgdl double"
    spark.createDataFrame([meta], names).withColumn("built_at", F.current_timestamp()).write.json(f"{work}/meta")
    _move(spark, work, path.rstrip("/"))


def read_meta(spark: SparkSession, path: str) -> dict:
    """The metadata of an index, empty if there is none."""
    return spark.read.json(f"{path}/meta").first().asDict() if exists(spark, f"{path}/meta") else {}


def open_index(spark: SparkSession, path: str, config: EngineConfig | None = None) -> Index:
    meta = read_meta(spark, path)
    if not meta:
        raise IndexMissing(f"no index at {path}; build it first")
    if config and meta["embedding_model"] != config.embedding_model:
        raise IndexMismatch(f"the index was built with {meta['embedding_model']}, not {config.embedding_model}; build it anew")
    if config and config.embed_provider == "hashing" and meta["dim"] not in (0, config.embed_dim):
        raise IndexMismatch(f"the index has vectors of {meta['dim']} dimensions, not {config.embed_dim}; build it anew")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(read("chunks"), read("vectors"), terms_of(read("terms"), (config or EngineConfig()).bm25_epsilon), meta)
