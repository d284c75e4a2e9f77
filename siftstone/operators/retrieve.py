"""Retrieval over batches of questions: exact dense search, maximal marginal relevance, BM25, weighted rank fusion.

Every ranking breaks ties by the id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.sources.tables import durable

#: Bytes of the questions that one task holds, questions and scores it makes at once, terms it counts before it hands them on.
BLOCK_BYTES, ROWS, CELLS, PARTIAL = 32 << 20, 512, 4_000_000, 500_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def top_ranked(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """``scored`` with rank from 1, the first ``k`` of each qid; Spark prunes each task's rows to k before the shuffle."""
    window = Window.partitionBy("qid").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.sqrt(((a - b) ** 2).sum(axis=1))
    norms = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return 1 - np.divide((a * b).sum(axis=1), norms, out=np.zeros(len(a)), where=norms > 0)


def blocks_of(questions: DataFrame, size: Column) -> list[DataFrame]:
    """``questions`` (qid, ...) in blocks of about BLOCK_BYTES, by the ``size`` of a row in bytes; no block if there are none."""
    total = questions.agg(F.sum(size.cast("bigint"))).first()[0]
    if not total:
        return []
    n = -(-total // BLOCK_BYTES)
    return [questions.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == k) if n > 1 else questions for k in range(n)]


def _best(qid: np.ndarray, ids: np.ndarray, costs: np.ndarray, k: int, name: str, exact) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """For each question (row of ``costs``) its k cheapest ids of the batch, ties by id; ``exact`` gives the costs of candidates."""
    edge = np.partition(costs, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
    rows, at = np.nonzero((costs <= edge[:, None] + 1e-6) & np.isfinite(costs))
    d = exact(rows, at)
    order = np.lexsort((ids[at], d, rows))
    rows, at, d = rows[order], at[order], d[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    yield pa.RecordBatch.from_arrays([pa.array(qid[rows[keep]]), pa.array(ids[at[keep]]), pa.array(d[keep])], ["qid", "id", name])


def _ranked(spark: SparkSession, found: list[DataFrame], k: int, name: str, order: Column) -> DataFrame:
    """The k best of all batches' own; a few rows a question, which joins send to the other side."""
    if not found:
        return spark.createDataFrame([], f"qid bigint, id bigint, {name} double, rank int")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return top_ranked(out, k, order, F.asc("id"))


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", not_itself: bool = False) -> DataFrame:
    """(qid, id, distance, rank): the ``k`` nearest of ``vectors`` (id long, vector) to each of ``queries`` (qid long, vector).

    The question side is sent to all tasks in blocks of a bounded size; each Arrow batch is one matrix product and hands on
    its own k best for each question, ranked by exact distances.  Distances are rounded to 9 places before they rank.  metric: l2 or cosine.
    """
    spark, found = vectors.sparkSession, []
    base = vectors.select(F.col("id").cast("bigint"), "vector").where("id is not null and vector is not null")
    asked = queries.select(F.col("qid").cast("bigint"), "vector").where("qid is not null and vector is not null")
    for own in blocks_of(asked, 8 * F.size("vector") + 16):
        rows = own.toArrow()
        sent = spark.sparkContext.broadcast((rows.column(0).to_numpy(), _vectors(rows.column(1).combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            qid, q = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, v = batch.column(0).to_numpy(), _vectors(batch.column(1))
                for first in range(0, len(qid), ROWS):
                    some = q[first : first + ROWS]
                    rough = (v**2).sum(1) - 2 * some @ v.T if metric == "l2" else -(some @ v.T) * np.divide(1, norms := np.linalg.norm(v, axis=1), out=np.zeros(len(v)), where=norms > 0)
                    if not_itself:
                        rough[qid[first : first + ROWS, None] == ids] = np.inf
                    # what the rounding of a matrix product may have put in another order is ranked by exact distances
                    exact = lambda rows, at, some=some, v=v: np.round(_distance(some[rows], v[at], metric), 9)
                    yield from _best(qid[first : first + ROWS], ids, rough, k, "distance", exact)

        found.append(base.mapInArrow(run, "qid bigint, id bigint, distance double"))
    return _ranked(spark, found, k, "distance", F.asc("distance"))


def mmr(candidates: DataFrame, k: int, weight: float) -> DataFrame:
    """(qid, id, rank) by maximal marginal relevance over ``candidates`` (qid, id, rank, sim, vector), at most fetch_k rows a question.

    Greedy: weight * sim - (1 - weight) * the largest cosine to what is chosen.  With weight 1 that is the given ranking.
    """
    if weight == 1:
        return candidates.where(F.col("rank") <= k).select("qid", "id", "rank")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        vectors = np.array(frame["vector"].tolist(), np.float64)
        norms = np.linalg.norm(vectors, axis=1)
        unit = np.divide(vectors, norms[:, None], out=np.zeros_like(vectors), where=norms[:, None] > 0)
        sim, chosen = frame["sim"].to_numpy(), []
        near = np.full(len(frame), -np.inf)
        for _ in range(min(k, len(frame))):
            value = sim if not chosen else weight * sim - (1 - weight) * near
            value = np.round(value, 9)
            value[chosen] = -np.inf
            best = int(np.argmax(value))
            chosen.append(best)
            near = np.maximum(near, unit @ unit[best])
        return pd.DataFrame({"qid": frame["qid"].iloc[chosen], "id": frame["id"].iloc[chosen], "rank": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    return candidates.groupBy("qid").applyInPandas(run, "qid bigint, id bigint, rank int")


@dataclass(frozen=True)
class Terms:
    """What BM25 knows of a corpus: term weights (term, df, total, idf), the number of documents, their mean length."""

    idf: DataFrame
    documents: int
    average: float


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, total): documents with each term, and its occurrences; of the null term the documents and tokens in all.

    Counts are added up in each task before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, df, total = re.compile(T.TOKEN).findall, Counter(), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([df[t] for t in total], pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "df", "total"])
            df.clear()
            total.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = tokens(text or "")
                counts = Counter(found)
                df.update(counts.keys())
                total.update(counts)
                df[None] += 1
                total[None] += len(found)
                if len(total) >= PARTIAL:
                    yield flush()
        if total:
            yield flush()

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "term string, df bigint, total bigint")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def bm25_terms(docs: DataFrame, text_col: str = "text", epsilon: float = 0.25, path: str | None = None) -> Terms:
    """Okapi weights; a negative idf becomes ``epsilon`` times the mean idf of all terms.  Documents count with all their tokens, none too.

    One pass over the documents, whose counts are written (to ``path``, if given); what reaches the driver are sums.
    """
    spark = docs.sparkSession
    if path:
        term_counts(docs, text_col).write.parquet(path)
        counts = spark.read.parquet(path)
    else:
        counts = durable(term_counts(docs, text_col), "term-counts")
    return terms_of(counts, epsilon)


def terms_of(counts: DataFrame, epsilon: float = 0.25) -> Terms:
    """Term weights from written counts."""
    whole = counts.where("term is null").first()
    n, tokens = (whole.df, whole.total) if whole else (0, 0)
    own = counts.where("term is not null").withColumn("raw", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = own.agg(F.avg("raw")).first()[0] or 0.0
    return Terms(own.select("term", "df", "total", F.when(F.col("raw") < 0, epsilon * mean).otherwise(F.col("raw")).alias("idf")), n, tokens / n if n else 0.0)


@dataclass(frozen=True)
class _Asked:
    """A block of questions as a sparse matrix: each term's questions and its weight there."""

    qids: np.ndarray
    number: dict[str, int]
    at: np.ndarray
    question: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(questions: DataFrame, terms: Terms) -> _Asked:
        """From ``questions`` (qid, question), few enough for a task; their terms and weights pass through the driver."""
        asked = questions.select("qid", F.explode(T.tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
        weighted = F.broadcast(asked).join(terms.idf, "term").select(F.col("qid").cast("bigint"), "term", (F.col("times") * F.col("idf")).alias("w")).toArrow()
        qids = np.sort(questions.select(F.col("qid").cast("bigint")).toArrow().column(0).to_numpy())
        coded = weighted.column("term").combine_chunks().dictionary_encode()
        term = coded.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        at = np.searchsorted(term[order], np.arange(len(coded.dictionary) + 1))
        return _Asked(qids, {t: i for i, t in enumerate(coded.dictionary.to_pylist())}, at, np.searchsorted(qids, weighted.column("qid").to_numpy()[order]), weighted.column("w").to_numpy()[order])

    def scores(self, term: list[int], doc: list[int], part: list[float], docs: int) -> np.ndarray:
        """Questions times documents: the sums of ``part`` (of a term in a document) times the term's weights."""
        term, n = np.array(term, np.int64), len(self.qids)
        each = self.at[term + 1] - self.at[term]
        place = np.repeat(self.at[term] - np.concatenate([[0], np.cumsum(each)[:-1]]).astype(np.int64), each) + np.arange(each.sum())
        cell = self.question[place] * docs + np.repeat(np.array(doc, np.int64), each)
        return np.bincount(cell, self.weight[place] * np.repeat(np.array(part, np.float64), each), n * docs).reshape(n, docs).round(9)


class _Running:
    """The k cheapest ids of each question so far, ties by id."""

    def __init__(self, n: int, k: int) -> None:
        self.cost, self.ids, self.k = np.full((n, k), np.inf), np.zeros((n, k), np.int64), k
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: np.ndarray, costs: np.ndarray) -> None:
        row, at = np.nonzero(costs <= self.cost[:, -1:])
        self.held.append((row, ids[at], costs[row, at]))
        if sum(len(x[0]) for x in self.held) >= self.cost.size:
            self.merge()

    def merge(self) -> None:
        there = np.isfinite(self.cost)
        row, ids, cost = (np.concatenate(x) for x in zip((np.nonzero(there)[0], self.ids[there], self.cost[there]), *self.held, strict=True))
        order = np.lexsort((ids, cost, row))
        row, ids, cost = row[order], ids[order], cost[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        self.cost.fill(np.inf)
        self.cost[row[best], place[best]], self.ids[row[best], place[best]] = cost[best], ids[best]
        self.held.clear()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.merge()
        row, place = np.nonzero(np.isfinite(self.cost))
        return row, self.ids[row, place], self.cost[row, place]


def bm25(docs: DataFrame, terms: Terms, questions: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(qid, id, score, rank): the best ``k`` documents of each question, by score and then id.

    Documents that share no term with a question have score 0 and rank with the others, before negative scores.  A term counts as often as
    the question has it.  The questions' terms go to all tasks in blocks of questions, so documents meet them where they are read,
    and each task hands on its own k best for each question: no postings and no scores are shuffled.
    """
    spark, found, average = docs.sparkSession, [], terms.average or 1.0
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    for own in blocks_of(questions.select("qid", "question").where("qid is not null"), 8 * F.coalesce(F.octet_length("question"), F.lit(0)) + 64):  # a token and its weight take some times its bytes
        sent = spark.sparkContext.broadcast(_Asked.of(own, terms))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            asked, tokens = sent.value, re.compile(T.TOKEN).findall
            number, best, most = asked.number, _Running(len(asked.qids), k), max(1, CELLS // len(asked.qids))
            for batch in (batch.slice(first, most) for batch in batches for first in range(0, batch.num_rows, most)):
                term, doc, part = [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    every = tokens(text or "")
                    below = k1 * (1 - b + b * len(every) / average)
                    for t, tf in Counter(filter(number.__contains__, every)).items():
                        term.append(number[t])
                        doc.append(row)
                        part.append(tf * (k1 + 1) / (tf + below))
                best.add(batch.column(0).to_numpy(), -asked.scores(term, doc, part, batch.num_rows))
            row, ids, cost = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(asked.qids[row]), pa.array(ids), pa.array(0.0 - cost)], ["qid", "id", "score"])

        found.append(base.mapInArrow(run, "qid bigint, id bigint, score double"))
    return _ranked(spark, found, k, "score", F.desc("score"))


def fuse(legs: list[tuple[DataFrame, float]], k: int, c: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of ``legs`` (qid, key, id, rank), first leg first in ties: (qid, key, id, score, rank).

    Rows of one key are one content: each adds weight / (c + rank), repeats inside a leg too; its id is that of its first row.
    """
    rows = None
    for number, (leg, weight) in enumerate(legs):
        part = leg.select("qid", "key", "id", "rank", F.lit(number).alias("leg"), (F.lit(weight) / (F.lit(c) + F.col("rank"))).alias("share"))
        rows = part if rows is None else rows.unionByName(part)
    seen = F.struct("leg", "rank", "id")
    fused = rows.groupBy("qid", "key").agg(F.round(F.sum("share"), 12).alias("score"), F.min(seen).alias("seen"))
    ranked = top_ranked(fused, k, F.desc("score"), F.asc("seen"))
    return ranked.select("qid", "key", F.col("seen.id").alias("id"), "score", "rank")


def fetch_depth(k: int, fetch_k: int = 20) -> int:
    return max(fetch_k, 4 * k)
