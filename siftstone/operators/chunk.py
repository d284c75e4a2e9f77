"""Sections to chunks: fixed windows in pure expressions, the structure-aware splitter as an Arrow-batched function."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.config import EngineConfig
from siftstone.functions import text as T

#: Separators from coarse to fine; a finer one serves only pieces that are still too long.  Fixed values.
SEPARATORS = ("\n## ", "\n### ", "\n\n", "\n", ". ", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Cut so that the separator begins the piece after it; no piece is empty."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Joins neighbours up to ``size``; the next chunk begins with the last whole pieces that fit in ``overlap``."""
    chunks: list[str] = []
    held: list[str] = []
    length = 0
    for piece in pieces:
        if held and length + len(piece) > size:
            chunks.append("".join(held))
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    return [*chunks, "".join(held)] if held else chunks


def split_structured(text: str, size: int = 1000, overlap: int = 150, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Stripped, non-empty chunks of at most ``size`` characters; overlaps consist of whole pieces."""
    here = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[here + 1 :]
    chunks: list[str] = []
    small: list[str] = []
    for piece in _pieces(text, separators[here]):
        if len(piece) < size:
            small.append(piece)
            continue
        chunks += _packed(small, size, overlap)
        small = []
        chunks += split_structured(piece, size, overlap, finer) if finer else [piece]
    chunks += _packed(small, size, overlap)
    return [c for c in (c.strip() for c in chunks) if c]


def structured_windows(text: Column, size: int, overlap: int) -> Column:
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_structured(t, size, overlap) if t else [])

    return split(text)


def build_chunks(sections: DataFrame, config: EngineConfig | None = None, splitter: str = "structured") -> DataFrame:
    """``sections`` (source, page, title, text) as (source, page, title, chunk_index, chunk_id, char_count, text, content).

    Numbers run through all pages of a source and count only chunks of at least the minimum length, so the length filter
    stands before the window.
    """
    config = config or EngineConfig()
    if splitter == "structured":
        windows = structured_windows(F.col("text"), config.chunk_size, config.chunk_overlap)
    elif splitter == "naive":
        windows = T.fixed_windows(F.col("text"), config.chunk_size, config.chunk_overlap)
    else:
        raise ValueError(f"splitter {splitter!r}: structured or naive")
    pieces = sections.select("source", "page", "title", F.posexplode(windows).alias("pos", "text")).withColumn("text", T.strip(F.col("text")))
    kept = pieces.where(F.length("text") >= config.min_chunk_chars)
    order = Window.partitionBy("source").orderBy(F.asc_nulls_first("page"), "pos")
    numbered = kept.withColumn("chunk_index", F.row_number().over(order) - 1)
    return numbered.select(
        "source", "page", "title", "chunk_index",
        T.chunk_id(F.col("source"), F.col("chunk_index"), F.col("text")).alias("chunk_id"),
        F.length("text").alias("char_count"), "text",
        T.with_header(T.header(F.col("title"), F.col("source"), F.col("page")), F.col("text"), config.context_headers).alias("content"),
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: count, sources, min_chars, median_chars, max_chars, mean_chars (half to even); nulls without chunks.

    The median comes from counts by length, not from a list of all lengths.
    """
    lengths = chunks.groupBy("char_count").agg(F.count(F.lit(1)).alias("n"))
    position = Window.orderBy("char_count").rowsBetween(Window.unboundedPreceding, 0)  # one row for each distinct length
    total = lengths.agg(F.sum("n").alias("total"))
    median = lengths.withColumn("upto", F.sum("n").over(position)).crossJoin(F.broadcast(total)).where(F.expr("upto > total div 2")).agg(F.min("char_count").alias("median_chars"))
    rest = chunks.agg(
        F.count(F.lit(1)).alias("count"),
        F.countDistinct(F.coalesce("source", F.lit("\0"))).alias("sources"),
        F.min("char_count").alias("min_chars"),
        F.max("char_count").alias("max_chars"),
        F.bround(F.avg("char_count"), 0).cast("bigint").alias("mean_chars"),
    )
    return rest.crossJoin(F.broadcast(median)).select("count", "sources", "min_chars", "median_chars", "max_chars", "mean_chars")


def source_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("chunks")).orderBy("source")
