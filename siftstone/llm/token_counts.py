"""Token counts by a two-tier look-up on the map side; no pre-token is ever shuffled.

Tier one is a broadcast table of the token lengths of frequent pre-tokens.  Tier two is a bounded cache in each worker,
which asks the tokenizer library for every pre-token the table lacks.  The table comes from a bounded sample of
documents (the ``sample_docs`` ids with the smallest hash, whole texts) and changes speed only: with any table, or none, each
pre-token has the length that the library gives it.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.bpe import Codec, Memo, Worker
from siftstone.llm.common import sampled
from siftstone.llm.textscan import parts

SAMPLE_DOCS = 1000
TABLE = 50_000


@dataclass(frozen=True)
class Pieces:
    """A SentencePiece model, as bytes."""

    model: bytes = field(repr=False)


def load(path: str) -> Codec | Pieces:
    """A tokenizer by the kind of its file: .json (tokenizers) or .model (sentencepiece)."""
    if path.endswith(".model"):
        with open(path, "rb") as file:
            return Pieces(file.read())
    return Codec.from_json(path)


class Counters:
    """Counts whole texts inside a worker."""

    _own: dict[int, Counters] = {}

    def __init__(self, spec: Codec | Pieces, frequent: dict[str, int]) -> None:
        if isinstance(spec, Pieces):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=spec.model)
            self.count = lambda text: len(processor.encode(text))
            return
        worker = Worker(spec)
        if not spec.by_pretoken:
            self.count = lambda text: len(worker.tokenizer.encode(text, add_special_tokens=False).ids)
            return
        length = lambda pretoken: frequent.get(pretoken) or len(worker.merged(pretoken))
        lengths, find = Memo(length), worker.find
        plain = lambda text: sum(map(lengths.__getitem__, find(text)))

        def count(text: str) -> int:
            if worker.cut and any(s in text for s in worker.special):
                return sum(1 if part in worker.special else plain(part) for part in worker.cut(text))
            return plain(text)

        self.count = count

    @classmethod
    def of(cls, spec: Codec | Pieces, frequent: dict[str, int], key: int) -> Counters:
        if key not in cls._own:
            cls._own.clear()
            cls._own[key] = cls(spec, frequent)
        return cls._own[key]


def frequent_lengths(docs: DataFrame, codec: Codec, id_col: str, text_col: str, sample_docs: int = SAMPLE_DOCS, table: int = TABLE) -> dict[str, int]:
    """Token lengths of the frequent pre-tokens of a bounded sample of documents."""
    if not sample_docs or not codec.by_pretoken:
        return {}
    worker, seen = Worker(codec), Counter()
    for (text,) in sampled(docs, sample_docs, id_col, text_col).toLocalIterator():
        seen.update(worker.find(text or ""))
    special = set(worker.special)
    return {p: len(worker.merged(p)) for p, n in seen.most_common(table) if n > 1 and p not in special}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``path``: a tokenizer file.  A null text is empty: 0 bytes, 0 tokens.  Null and repeated ids and equal rows keep their rows; a very
    long text is counted whole; ids are of any type; other columns, whatever their names, are dropped; an empty table gives an empty
    result.
    """
    spec = load(path)
    frequent = frequent_lengths(docs, spec, id_col, text_col, sample_docs) if isinstance(spec, Codec) else {}
    sent = docs.sparkSession.sparkContext.broadcast((spec, frequent))
    key = hash((spec, len(frequent), json.dumps(sorted(frequent)[:50])))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counters.of(*sent.value, key).count
        for batch in (part for whole in batches for part in parts(whole, 1)):
            n = [count(text) if text else 0 for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes")
    counted = docs.select(F.col(id_col), F.col(text_col), n_bytes).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
