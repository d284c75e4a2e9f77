"""Embeddings: the provider protocol, a deterministic offline embedder, retries and pacing, the vector cache."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import text as T


class Embedder(Protocol):
    """Anything that turns texts into vectors; made once in each worker."""

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]: ...


class _Buckets(dict):
    """Token to bucket, from the first 28 bits of its MD5; at ``MOST`` tokens it begins anew."""

    MOST = 500_000

    def __init__(self, dim: int) -> None:
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[token] = bucket = int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % self.dim
        return bucket


class HashingEmbedder:
    """The offline embedder: counts of lower-cased words by bucket, to unit length; a text without words is the zero vector."""

    def __init__(self, dim: int = 64, unit: bool = True) -> None:
        self.dim, self.unit = dim, unit
        self.bucket = _Buckets(dim)

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            for token in (text or "").lower().split():
                out[row, self.bucket[token]] += 1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (np.divide(out, norms, out=out, where=norms > 0) if self.unit else out).tolist()


def by_batch(make: Callable[[], Embedder]) -> Callable[[Column], Column]:
    """An embedder as a function of a text column, made once in each task, a call for each Arrow batch."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for texts in batches:
            yield pd.Series(embedder.embed_documents(texts.fillna("").tolist()), dtype=object)

    return run


def hash_vectors(docs: DataFrame, id_col: str, text_col: str, dim: int = 64, unit: bool = True) -> DataFrame:
    """The offline embedding, (id, vector), a row at a time: no shuffle, whatever the length of a text.

    Each distinct token is hashed once in a worker; a batch's buckets are counted by one numpy call.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, tokens = _Buckets(dim).__getitem__, re.compile(T.TOKEN).findall
        for batch in batches:
            lists = [list(map(bucket, tokens(text))) for text in batch.column(1).to_pylist()]
            row = np.repeat(np.arange(len(lists)), list(map(len, lists)))
            counts = np.bincount(row * dim + np.array([b for one in lists for b in one], np.int64), minlength=len(lists) * dim).reshape(-1, dim).astype(np.float64)
            norms = np.linalg.norm(counts, axis=1, keepdims=True)
            vectors = np.divide(counts, norms, out=counts, where=norms > 0) if unit else counts
            at = pa.array(np.arange(len(lists) + 1) * dim, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(vectors.reshape(-1)))], [id_col, "vector"])

    lowered = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col), lowered).mapInArrow(run, f"`{id_col}` {kind}, vector array<double>")


class Pacer:
    """Departure times of requests, so that no ``WINDOW`` seconds hold more than ``ceiling`` units (0: no ceiling).

    A ledger of (time, units) says when the next request may leave: the wait is computed once, from the entries that have
    to grow old first.  A request larger than the ceiling leaves when the ledger is empty.
    """

    WINDOW, MARGIN = 60.0, 0.05

    def __init__(self, ceiling: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.ceiling, self.clock, self.sleep = ceiling, clock, sleep
        self.ledger: list[tuple[float, int]] = []

    def departure(self, units: int, now: float) -> float:
        """The earliest time from ``now`` on at which ``units`` fit beside what is in the ledger then."""
        if not self.ceiling:
            return now
        recent = [(at, n) for at, n in self.ledger if at + self.WINDOW >= now]
        loads = [sum(n for _, n in recent[k:]) for k in range(len(recent))]
        old = next((k for k, load in enumerate(loads) if load + units <= self.ceiling), len(recent))
        self.ledger = recent[old:]
        return max(now, recent[old - 1][0] + self.WINDOW + self.MARGIN) if old else now

    def admit(self, units: int) -> None:
        """Returns when ``units`` may leave, and enters them."""
        now = self.clock()
        at = self.departure(units, now)
        if at > now:
            self.sleep(at - now)
        self.ledger.append((at, units))


class QuotaExhausted(RuntimeError):
    """The provider's quota is used up, and retries gave up."""


@dataclass(frozen=True)
class Refusal:
    """What a provider's error message says: worth another try or not, the quota's end or not, seconds it asks to wait."""

    retriable: bool
    quota: bool
    hint: float | None

    @staticmethod
    def of(error: Exception) -> Refusal:
        message = str(error)
        says = lambda *tokens: any(t in message.lower() for t in tokens)
        hints = [float(x) for pattern in T.RETRY_HINTS for x in re.findall(pattern, message)[:1] if x.strip(".")]
        return Refusal(says(*T.RETRIABLE), says(*T.QUOTA), next(iter(hints), None))


#: Pauses between attempts where the provider gives no hint: the first, the longest, and the most that is added at random.
FIRST_PAUSE, LONGEST_PAUSE, JITTER = 2.0, 60.0, 1.0


def pauses(attempts: int) -> list[float]:
    """The pause after each attempt but the last, each twice as long as the one before up to the longest."""
    return [min(FIRST_PAUSE * 2**k, LONGEST_PAUSE) for k in range(attempts - 1)]


def embed_with_retry(embedder: Embedder, batch: Sequence[str], pacer: Pacer | None = None, attempts: int = 8, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """The vectors of one batch, with at most ``attempts`` paced attempts; what can't be retried is raised at once."""
    for pause in (*pauses(attempts), None):
        if pacer:
            pacer.admit(len(batch))
        try:
            return embedder.embed_documents(batch)
        except Exception as error:  # noqa: BLE001  providers raise what they like
            met, last = Refusal.of(error), error
        if pause is None or not met.retriable:
            break
        sleep((met.hint or pause) + random.uniform(0, JITTER))
    if met.quota:
        raise QuotaExhausted(f"the embedding quota is used up; a lower embed_rpm, a later run or another provider may help: {last}") from last
    raise last


def embed_texts(texts: DataFrame, make: Callable[[], Embedder], batch_size: int = 64, per_minute: int = 0, attempts: int = 8) -> DataFrame:
    """``texts`` (k, text) as (k, v array<float>), batch by batch in each task.

    A ceiling holds for the whole job: the texts go through so many lanes, each one task with its share of the ceiling, that a
    batch fits into a lane's share.
    """
    lanes = max(1, min(texts.sparkSession.sparkContext.defaultParallelism, per_minute // batch_size))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder, pacer = make(), Pacer(max(1, per_minute // lanes)) if per_minute else None
        for frame in frames:
            for first in range(0, len(frame), batch_size):
                part = frame.iloc[first : first + batch_size]
                vectors = embed_with_retry(embedder, part["text"].tolist(), pacer, attempts)
                yield pd.DataFrame({"k": part["k"].to_numpy(), "v": [np.asarray(v, np.float32) for v in vectors]})

    asked = texts.select("k", "text")
    return (asked.repartition(lanes) if per_minute else asked).mapInPandas(run, "k string, v array<float>")


def newest(cache: DataFrame) -> DataFrame:
    """Of a cache (k, v, seq), the last vector of each key; torn rows (null key or vector) do not count."""
    return cache.where("k is not null and v is not null").groupBy("k").agg(F.max_by("v", "seq").alias("v"))


def cache_misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct contents (k, text) that the cache lacks."""
    return chunks.select(T.content_key(F.col("content")).alias("k"), F.col("content").alias("text")).dropDuplicates(["k"]).join(cache.select("k"), "k", "left_anti")


def attach_vectors(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """``chunks`` with the vector of their content; a missing one stays null, for ``missing_vectors`` to report."""
    return chunks.withColumn("k", T.content_key(F.col("content"))).join(cache, "k", "left")


def missing_vectors(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    return cache_misses(chunks, cache).select("k")
