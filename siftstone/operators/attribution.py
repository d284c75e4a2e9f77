"""Citations after the fact: each sentence of an answer gets the marker of the passage it is most similar to.

Fences, lines and sentences are exploded with their places, distinct sentences are embedded, the best passage of
each comes from an aggregate, and three ordered joins put the answer together again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.operators.retrieve import cosine

FENCE = "```"

#: White space after a sentence ender and before what can begin a sentence.  Fixed value.
SENTENCE_BREAK = r"(?U)(?<=[.!?:])\s+(?=[A-Z`\d*\-])"

#: Lines that get no marker: headings, table rows, fences, bare bullets and ordinals.  Fixed value.
SKIPPED_LINE = r"(?U)^\s*(?:#{1,6}\s|\||```|\s*[-*]\s*$|\d+\.\s*$)"


def segments(answers: DataFrame) -> DataFrame:
    """(answer_id, segment, is_code, part): between fences; an unclosed fence makes the rest code."""
    cut = answers.select("answer_id", F.posexplode(F.split("answer", FENCE)).alias("segment", "part"))
    return cut.select("answer_id", "segment", (F.col("segment") % 2 == 1).alias("is_code"), "part")


def sentences(answers: DataFrame, least: int = 40) -> DataFrame:
    """(answer_id, segment, is_code, line, place, sentence, eligible): every sentence of every line; code, skipped and short lines stay whole."""
    lines = segments(answers).select("answer_id", "segment", "is_code", F.posexplode(F.split("part", "\n")).alias("line", "text"))
    open_ = ~F.col("is_code") & (F.length(T.strip(F.col("text"))) >= least) & ~F.col("text").rlike(SKIPPED_LINE)
    pieces = F.split("text", SENTENCE_BREAK)
    some = open_ & F.exists(pieces, lambda s: F.length(T.strip(s)) >= least)
    cut = lines.select("answer_id", "segment", "is_code", "line", some.alias("open"), F.posexplode(F.when(some, pieces).otherwise(F.array("text"))).alias("place", "sentence"))
    return cut.select("answer_id", "segment", "is_code", "line", "place", "sentence", (F.col("open") & (F.length(T.strip(F.col("sentence"))) >= least)).alias("eligible"))


def best_passages(sentence_vectors: DataFrame, passage_vectors: DataFrame, threshold: float = 0.55, per_place: int | None = None) -> DataFrame:
    """(answer_id, sentence, n, sim): the most similar passage of each sentence at or above the threshold; the first one in ties.

    With ``per_place``, a passage also has to be more similar by 1 / per_place for each place it comes later; ``sim``, which the
    threshold is for, stays the highest one.  Both sides carry the answer_id, so this is an equi-join over an answer's own passages.
    """
    pairs = sentence_vectors.join(passage_vectors.withColumnRenamed("vector", "passage"), "answer_id")
    scored = pairs.withColumn("sim", F.round(cosine(F.col("vector"), F.col("passage")), 9))
    score = F.col("sim") if per_place is None else F.col("sim") * per_place - F.col("n")
    best = scored.groupBy("answer_id", "sentence").agg(F.max(F.struct(score.alias("score"), "sim", (-F.col("n")).alias("m"))).alias("b"), F.max("sim").alias("sim"))
    return best.where(F.col("sim") >= threshold).select("answer_id", "sentence", (-F.col("b.m")).cast("int").alias("n"), "sim")


def marked(sentence: Column, n: Column) -> Column:
    """The marker goes before a final ``. ! ? :``, whose trailing white space is dropped, else at the end."""
    marker = F.concat(F.lit("["), n.cast("string"), F.lit("]"))
    end = r"(?U)([.!?:])\s*$"
    return F.when(sentence.rlike(end), F.concat(F.regexp_replace(sentence, end, ""), F.lit(" "), marker, F.regexp_extract(sentence, end, 1))).otherwise(F.concat(sentence, F.lit(" "), marker))


def _joined(rows: DataFrame, keys: list[str], place: str, value: str, separator: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct(place, value)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[value]), separator).alias(value))


def attribute(answers: DataFrame, passages: DataFrame, embed: Callable[[Column], Column], threshold: float = 0.55, least: int = 40, per_place: int | None = None) -> DataFrame:
    """``answers`` (answer_id, answer) as (answer_id, answer, cited); ``passages`` (answer_id, n, content); ``embed`` makes a vector column.

    ``per_place`` is that of ``best_passages``.  Blank answers, answers without passages and answers that cite already come back unchanged.
    """
    have = passages.select("answer_id").distinct()
    todo = answers.where((T.strip(F.col("answer")) != "") & ~T.already_cited(F.col("answer"))).join(have, "answer_id", "left_semi")
    cut = sentences(todo, least)
    distinct = cut.where("eligible").select("answer_id", "sentence").distinct().withColumn("vector", embed(F.col("sentence")))
    best = best_passages(distinct, passages.select("answer_id", "n", embed(F.col("content")).alias("vector")), threshold, per_place)
    found = cut.join(best, ["answer_id", "sentence"], "left").withColumn("text", F.when(F.col("eligible") & F.col("n").isNotNull(), marked(F.col("sentence"), F.col("n"))).otherwise(F.col("sentence")))
    lines = _joined(found, ["answer_id", "segment", "line"], "place", "text", " ")
    parts = _joined(lines, ["answer_id", "segment"], "line", "text", "\n")
    whole = _joined(parts, ["answer_id"], "segment", "text", FENCE).withColumnRenamed("text", "cited")
    return answers.join(whole, "answer_id", "left").select("answer_id", "answer", F.coalesce("cited", "answer").alias("cited"))
