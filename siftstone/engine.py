"""The engine: ingest, ask, report, evaluate, over an index directory; every question batch is one plan."""

from __future__ import annotations

import functools
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.config import EngineConfig
from siftstone.functions import text as T
from siftstone.operators import answer, attribution, chunk, embed, evaluate, retrieve
from siftstone.operators import index as ix
from siftstone.plans.registry import plain_unions
from siftstone.sources.files import load_directory
from siftstone.sources.tables import scratch


class EngineNotReady(RuntimeError):
    """No index is open."""


class Engine:
    """Opens the index at ``config.index_dir`` if there is one; ``embedder`` and ``generator`` are factories for tasks."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, embedder=None, generator=None) -> None:  # noqa: ANN001
        plain_unions(spark)
        self.spark, self.config = spark, config or EngineConfig()
        dim, unit = self.config.embed_dim, self.config.embed_normalize
        self.embedder = embedder or (lambda: embed.HashingEmbedder(dim, unit))
        self.generator = generator or answer.Extractive
        self.index: ix.Index | None = None
        if ix.read_meta(spark, self.config.index_dir):
            self.reload()

    def ingest(self, data_dir: str | None = None, dry_run: bool = False) -> DataFrame:
        """Scans, chunks and indexes a document tree; the statistics of its chunks.  A dry run stops before embedding."""
        sections, _ = load_directory(self.spark, data_dir or self.config.data_dir)
        chunks = chunk.build_chunks(sections, self.config)
        if not dry_run:
            self.config.check_key(self.config.embed_provider)
            ix.build_index(chunks, self.config.index_dir, self.config, self.embedder, self.config.embed_cache_dir if self.config.embed_cache else None)
            self.reload()
            chunks = self.index.chunks
        return chunk.chunk_stats(chunks)

    def reload(self) -> None:
        self.index = ix.open_index(self.spark, self.config.index_dir, self.config)

    def _ready(self) -> ix.Index:
        if not self.index:
            raise EngineNotReady(f"no index at {self.config.index_dir}")
        return self.index

    def health(self) -> dict:
        return {"ready": self.index is not None, "config": self.config.summary(), **({"chunks": self.index.size, "meta": self.index.meta} if self.index else {})}

    def sources(self) -> DataFrame:
        return chunk.source_counts(self._ready().chunks)

    def search(self, questions: DataFrame, top_k: int | None = None, variant: evaluate.Variant | None = None) -> DataFrame:
        """(qid, rank, id and the chunk's columns): the first ``top_k`` chunks for ``questions`` (qid, question)."""
        found, c, k = self._ready(), self.config, top_k or self.config.top_k
        v = variant or evaluate.Variant("configured", c.use_hybrid, True, c.mmr_lambda, c.weight_dense, c.weight_sparse)
        asked = questions.select("qid", embed.by_batch(self.embedder)(F.col("question")).alias("vector"))
        diverse = v.mmr and v.weight != 1
        dense = retrieve.knn(asked, found.vectors, retrieve.fetch_depth(k, c.fetch_k) if diverse else k)
        if diverse:
            candidates = dense.join(found.vectors, "id").join(asked.withColumnRenamed("vector", "asked"), "qid")
            dense = retrieve.mmr(candidates.select("qid", "id", "rank", retrieve.cosine(F.col("asked"), F.col("vector")).alias("sim"), "vector"), k, v.weight)
        ranked = dense.select("qid", "id", "rank")
        if v.hybrid and found.size:
            keys = found.chunks.select("id", T.content_key(F.col("content")).alias("key"))
            sparse = retrieve.bm25(found.chunks, found.terms, questions, k, c.bm25_k1, c.bm25_b, text_col="content")
            ranked = retrieve.fuse([(ranked.join(keys, "id"), v.dense), (sparse.join(keys, "id"), v.sparse)], k, c.rrf_c).select("qid", "id", "rank")
        return ranked.join(found.chunks, "id")

    def ask(self, requests: DataFrame, top_k: int | None = None) -> DataFrame:
        """(qid, question, search_query, answer, sources, latency_ms) for requests (qid, question; history string or turns array of (role, text)).

        Of turns, the last ``max_history_turns`` are the history.

        Searches with the condensed question, answers the original one, cites afterwards in citation mode auto.
        latency_ms is the time since the plan was made, the batch's, not a single question's.
        """
        began = int(time.time() * 1000)
        self.config.check_key(self.config.chat_provider)
        if "turns" in requests.columns:
            requests = requests.withColumn("history", answer.history_of(F.col("turns"), self.config.max_history_turns))
        asked = answer.condensed(requests if "history" in requests.columns else requests.withColumn("history", F.lit(None).cast("string")), self.generator)
        found = self.search(asked.select("qid", F.col("search_query").alias("question")), top_k)
        joined = asked.join(answer.contexts(found), "qid", "left").join(answer.citations(found, self.config.snippet_chars), "qid", "left")
        answers = answer.answered(joined, self.generator)
        if self.config.citation_mode == "auto":
            cited = attribution.attribute(
                answers.select(F.col("qid").alias("answer_id"), "answer"), found.select(F.col("qid").alias("answer_id"), F.col("rank").alias("n"), "content"), embed.by_batch(self.embedder), self.config.cite_threshold, self.config.cite_min_chars
            )
            answers = answers.drop("answer").join(cited.select(F.col("answer_id").alias("qid"), F.col("cited").alias("answer")), "qid")
        latency = (F.unix_millis(F.current_timestamp()) - F.lit(began)).alias("latency_ms")
        return answers.select("qid", "question", "search_query", "answer", "sources", latency)

    def ask_events(self, requests: DataFrame, top_k: int | None = None) -> DataFrame:
        """The answers as ordered stream events."""
        answers = self.ask(requests, top_k)
        plain = F.regexp_replace("answer", r" ?\[\d+\]", "")
        return answer.stream_events(answers.select("qid", "search_query", F.split(plain, "(?= )").alias("pieces"), F.col("answer").alias("cited")))

    def evaluate(self, questions: DataFrame, k: int | None = None, variant: evaluate.Variant | None = None) -> DataFrame:
        """questions, hit_rate, mrr and precision of a golden set (qid, question, relevant_sources, must_contain)."""
        return evaluate.metrics(evaluate.per_question(self._judged(questions, k, variant), questions))

    def _judged(self, questions: DataFrame, k: int | None, variant: evaluate.Variant | None) -> DataFrame:
        found = self.search(questions.select("qid", "question"), k, variant).join(questions.select("qid", "relevant_sources", "must_contain"), "qid")
        return found.select("qid", "rank", "source", evaluate.is_relevant(F.col("source"), F.col("content"), F.col("relevant_sources"), F.col("must_contain")).alias("relevant"))

    def ablate(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """The seven variants over this index: (seq, config, chunks, questions, hit_rate, mrr, precision)."""
        out = None
        for seq, variant in enumerate(evaluate.ablations(self.config.mmr_lambda)):
            row = self.evaluate(questions, k, variant).select(F.lit(seq).alias("seq"), F.lit(variant.name).alias("config"), F.lit(self._ready().size).alias("chunks"), "*")
            out = row if out is None else out.unionByName(row)
        return out

    def measure(self, sections: DataFrame, questions: DataFrame, setup: evaluate.Setup, seq: int = 0, k: int | None = None) -> DataFrame:
        """A set-up's row (seq, config, label, chunks, questions, hit_rate, mrr, precision), over an index of its own that goes with the program."""
        config = replace(self.config, chunk_size=setup.size, chunk_overlap=setup.overlap, context_headers=setup.headers, index_dir=scratch(self.spark, setup.name))
        chunks = chunk.build_chunks(sections, config, setup.splitter)
        ix.build_index(chunks, config.index_dir, config, self.embedder, self.config.embed_cache_dir if self.config.embed_cache else None)
        own = Engine(self.spark, config, self.embedder, self.generator)
        return own.evaluate(questions, k, setup.variant).select(F.lit(seq).alias("seq"), F.lit(setup.name).alias("config"), F.lit(setup.label).alias("label"), F.lit(own.index.size).alias("chunks"), "*")

    def compare(self, sections: DataFrame, questions: DataFrame, setups: list[evaluate.Setup] | None = None, k: int | None = None) -> DataFrame:
        """The rows of several set-ups in order, of the two ends of the tuning by default."""
        c = self.config
        rows = [self.measure(sections, questions, s, seq, k) for seq, s in enumerate(setups or evaluate.setups(c.chunk_size, c.chunk_overlap, c.mmr_lambda))]
        return functools.reduce(DataFrame.unionByName, rows)

    def sweep(self, sections: DataFrame, questions: DataFrame, k: int | None = None) -> DataFrame:
        """The tuned set-up with each size and overlap of the grid."""
        tuned = evaluate.setups(mmr_lambda=self.config.mmr_lambda)[-1]
        return self.compare(sections, questions, [replace(tuned, name=f"size{size}", label=f"tuned, {size}/{overlap}", size=size, overlap=overlap) for size, overlap in evaluate.SWEEP], k)

    def validate(self, questions: DataFrame) -> DataFrame:
        return evaluate.problems(questions, self._ready().chunks)
