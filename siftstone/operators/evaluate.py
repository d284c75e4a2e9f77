"""Retrieval quality as aggregations: relevance, hit rate, reciprocal rank, precision, ablations, sweeps, validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.operators.retrieve import blocks_of


@dataclass(frozen=True)
class Variant:
    """How candidates are ranked."""

    name: str
    hybrid: bool
    mmr: bool
    weight: float = 1.0
    dense: float = 0.6
    sparse: float = 0.4


def ablations(mmr_lambda: float = 1.0) -> list[Variant]:
    """The seven retrievers over one shared index, fixed values; ``mmr_lambda`` serves those that name none."""
    return [
        Variant("dense-only", False, False),
        Variant("dense+mmr", False, True, mmr_lambda),
        Variant("hybrid", True, False),
        Variant("hybrid+mmr", True, True, mmr_lambda),
        Variant("hybrid+mmr(l=0.8)", True, True, 0.8),
        Variant("hybrid+mmr(l=1.0)", True, True, 1.0),
        Variant("sparse-heavy", True, True, mmr_lambda, 0.4, 0.6),
    ]


@dataclass(frozen=True)
class Setup:
    """A whole configuration: how chunks are made and ranked."""

    name: str
    label: str
    splitter: str
    size: int
    overlap: int
    headers: bool
    variant: Variant


def setups(size: int = 1000, overlap: int = 150, mmr_lambda: float = 1.0) -> list[Setup]:
    """The two ends of the tuning, fixed values but for the arguments, which are the present settings."""
    return [
        Setup("baseline", "fixed windows without overlap or headers, dense search", "naive", 1000, 0, False, Variant("baseline", False, False)),
        Setup("tuned", "structured chunks with overlap and headers, hybrid search", "structured", size, overlap, True, Variant("tuned", True, True, mmr_lambda)),
    ]


#: Characters of a phrase that the automaton knows.
ANCHOR = 32

#: Chunk size and overlap of a sweep.  Fixed values.
SWEEP = ((500, 75), (800, 120), (1000, 150), (1500, 225))


def is_relevant(source: Column, content: Column, relevant_sources: Column, must_contain: Column) -> Column:
    """The source ends with one of the relevant ones, and the content has one of the phrases, if there are any, in any case."""
    place = F.exists(relevant_sources, lambda s: F.endswith(source, s))
    phrase = must_contain.isNull() | (F.size(must_contain) == 0) | F.exists(must_contain, lambda p: F.contains(F.lower(content), F.lower(p)))
    return F.coalesce(place & phrase, F.lit(False))


def per_question(ranked: DataFrame, questions: DataFrame, *keys: str) -> DataFrame:
    """(keys, qid, hit, first_rank, reciprocal, precision) for every question from ranked (keys, qid, rank, relevant); no rows, no hit.

    Precision divides by the rows returned.
    """
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    got = ranked.groupBy(*keys, "qid").agg(first.alias("first"), F.avg(F.col("relevant").cast("double")).alias("precision"))
    return questions.select(*keys, "qid").join(got, [*keys, "qid"], "left").select(
        *keys, "qid", F.col("first").isNotNull().alias("hit"), F.coalesce("first", F.lit(0)).alias("first_rank"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal"), F.coalesce("precision", F.lit(0.0)).alias("precision"),
    )


def metrics(by_question: DataFrame, *keys: str) -> DataFrame:
    """questions, hit_rate, mrr, precision, to 6 places; null rates without questions."""
    mean = lambda c: F.round(F.avg(c), 6)
    aggregates = [F.count(F.lit(1)).alias("questions"), mean(F.col("hit").cast("double")).alias("hit_rate"), mean("reciprocal").alias("mrr"), mean("precision").alias("precision")]
    return by_question.groupBy(*keys).agg(*aggregates) if keys else by_question.agg(*aggregates)


def by_class(by_question: DataFrame, questions: DataFrame) -> DataFrame:
    """Hits of each tag of ``questions`` (qid, tags)."""
    tagged = by_question.join(questions.select("qid", F.explode("tags").alias("tag")), "qid")
    return tagged.groupBy("tag").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("questions"))


def detail(ranked: DataFrame) -> DataFrame:
    """(qid, retrieved): source, relevance and rank of what was found, in order."""
    return ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "source", "relevant"))).alias("retrieved"))


def delta(results: DataFrame, metric: str = "hit_rate") -> DataFrame:
    """(first_config, last_config, first, last, delta) of results (seq, config, metric)."""
    ends = results.agg(F.min_by("config", "seq").alias("first_config"), F.max_by("config", "seq").alias("last_config"), F.min_by(metric, "seq").alias("first"), F.max_by(metric, "seq").alias("last"))
    return ends.withColumn("delta", F.round(F.col("last") - F.col("first"), 6))


def printed(results: DataFrame, k: int) -> str:
    """The comparison as text: a heading, a line for each result, and what the last one gains over the first.  Results are a few rows."""
    heading = f"{'config':<20}{'chunks':>8}{f'hit@{k}':>10}{'MRR':>10}{'precision':>12}"
    lines = [heading, *(r.line for r in report(results).orderBy("seq").collect())]
    if len(lines) > 2:
        d = delta(results).first()
        lines.append(f"hit@{k}: {d['first']:.0%} to {d['last']:.0%} ({d.delta:+.0%} from {d.first_config} to {d.last_config})")
    return "\n".join(lines)


def report(results: DataFrame) -> DataFrame:
    """(seq, line): the fixed-width comparison table, a line for each result."""
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    return results.select("seq", F.concat(F.rpad("config", 20, " "), F.lpad(F.col("chunks").cast("string"), 8, " "), F.lpad(percent("hit_rate"), 10, " "), F.lpad(F.format_string("%.3f", F.col("mrr")), 10, " "), F.lpad(percent("precision"), 12, " ")).alias("line"))


def suffix_matches(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, source): the sources that end with a relevant suffix of the question.

    An equi-join: each distinct source has one ending for each length that suffixes have, which are few.
    """
    wanted = questions.select("qid", F.explode("relevant_sources").alias("suffix")).distinct()
    lengths = wanted.agg(F.collect_set(F.length("suffix")).alias("lengths"))
    endings = sources.select("source").distinct().crossJoin(F.broadcast(lengths)).withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("source"))
    named = endings.select("source", F.expr("right(source, n)").alias("suffix"))
    return named.join(wanted, "suffix").select("qid", "source").distinct()


def holders(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(qid, source): the documents (source, content) that hold a phrase (qid, phrase) as it stands; blank phrases are in none.

    The phrases go to all tasks in blocks; each text is searched once for all phrases of a block.
    """
    spark, out = docs.sparkSession, None
    for own in blocks_of(phrases.where("qid is not null and phrase <> ''"), 2 * F.octet_length("phrase") + 64 * F.least(F.length("phrase"), F.lit(ANCHOR)) + 64):
        by_phrase: dict[str, list[int]] = {}
        for row in own.select(F.col("qid").cast("bigint"), "phrase").toLocalIterator():
            by_phrase.setdefault(row.phrase, []).append(row.qid)
        sent = spark.sparkContext.broadcast(by_phrase)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            find = _finder(sent.value)
            for batch in batches:
                hits = [(q, source) for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for q in find(text or "")]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in hits], pa.int64()), pa.array([s for _, s in hits], pa.string())], ["qid", "source"])

        part = docs.select("source", "content").mapInArrow(run, "qid bigint, source string")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "qid bigint, source string")


def _finder(by_phrase: dict[str, list[int]]) -> Callable[[str], list[int]]:
    """A function that gives the questions whose phrase a text holds, each once.

    The automaton holds the phrases' beginnings; where one occurs, the whole phrases that begin so are compared.
    """
    try:
        from ahocorasick import Automaton
    except ImportError:
        return lambda text: [q for phrase, qids in by_phrase.items() if phrase in text for q in qids]
    automaton, begun = Automaton(), {}
    for phrase in by_phrase:
        begun.setdefault(phrase[:ANCHOR], []).append(phrase)
    for anchor, phrases in begun.items():
        automaton.add_word(anchor, (len(anchor), phrases))
    automaton.make_automaton()

    def find(text: str) -> list[int]:
        held = {phrase for end, (n, phrases) in automaton.iter(text) for phrase in phrases if text.startswith(phrase, end + 1 - n)}
        return list({q for phrase in held for q in by_phrase[phrase]})

    return find


def unreachable(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """Questions none of whose sources exist."""
    return questions.join(suffix_matches(questions, sources), "qid", "left_anti")


def unmatched(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions with sources and phrases, but none of the phrases in any chunk of those sources."""
    reach = suffix_matches(questions, chunks)
    asked = questions.where("size(must_contain) > 0").select("qid", F.explode("must_contain").alias("phrase"))
    texts = chunks.select("source", F.lower("content").alias("content")).join(reach, "source")
    found = texts.join(asked, "qid").where(F.contains("content", F.lower("phrase"))).select("qid").distinct()
    return questions.where("size(must_contain) > 0").join(reach.select("qid").distinct(), "qid", "left_semi").join(found, "qid", "left_anti")


def problems(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, question, problem) of every question that can never be a hit."""
    far = unreachable(questions, chunks).select("qid", "question", F.lit("unreachable").alias("problem"))
    return far.unionByName(unmatched(questions, chunks).select("qid", "question", F.lit("unmatched").alias("problem")))


def ordered(results: DataFrame, key: str = "config") -> DataFrame:
    return results.withColumn("seq", F.row_number().over(Window.orderBy(key)) - 1)
