"""Contexts, citations, conversation history, prompts, and answers by an injected generator."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions import text as T

NO_CONTEXT = "Nothing in the indexed documents answers this. The topic may be missing, or worded differently there: try the exact feature, error code or file name."

ANSWER_PROMPT = """Answer from the numbered passages only.
Cite a passage as [n] right after each claim it supports.
Say plainly what the passages leave out, report it when they disagree, and keep identifiers exactly as written.

Passages:
{context}

Question: {question}
"""

CONDENSE_PROMPT = """Rewrite the last question so that it can be understood without the conversation. Give the question alone.

{history}

Question: {question}
"""


class Generator(Protocol):
    """Anything that completes a prompt; ``stream`` gives the pieces of the same text."""

    def complete(self, prompt: str) -> str: ...

    def stream(self, prompt: str) -> Iterator[str]: ...


class Extractive:
    """The offline generator: the first sentences of the first passage; without passages, to condense, the question as it is."""

    def __init__(self, sentences: int = 2) -> None:
        self.sentences = sentences

    def complete(self, prompt: str) -> str:
        if "Passages:\n" not in prompt:
            return prompt.rsplit("Question: ", 1)[-1].strip()
        body = prompt.split("Passages:\n", 1)[-1].split("\n\nQuestion:", 1)[0].split(T.PASSAGE_SEPARATOR, 1)[0]
        prose = " ".join(body.split("\n")[1:]).strip()
        found = prose.replace("? ", "?\0").replace("! ", "!\0").replace(". ", ".\0").split("\0")
        return " ".join(s for s in found[: self.sentences] if s)

    def stream(self, prompt: str) -> Iterator[str]:
        text = self.complete(prompt)
        yield from (p if i == 0 else " " + p for i, p in enumerate(text.split(" ")))


def fill(template: str, **parts: Column) -> Column:
    """A prompt from a template; what one part brings in is not filled again."""
    pieces, rest = [], template
    while rest:
        at = min(((rest.find("{" + n + "}"), n) for n in parts if "{" + n + "}" in rest), default=None)
        if at is None:
            pieces.append(F.lit(rest))
            break
        pieces += [F.lit(rest[: at[0]]), parts[at[1]]]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*pieces)


def contexts(ranked: DataFrame) -> DataFrame:
    """(qid, context) from ``ranked`` (qid, rank, source, page, content): numbered passages in order of rank, at most top_k a question."""
    block = T.numbered_passage(F.col("rank"), F.col("source"), F.col("page"), F.col("content"))
    blocks = F.sort_array(F.collect_list(F.struct("rank", block.alias("block"))))
    return ranked.groupBy("qid").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), T.PASSAGE_SEPARATOR).alias("context"))


def citation(snippet_chars: int = 300) -> Column:
    """n, source, title, page, chunk_id, snippet of a ranked chunk."""
    return F.struct(
        F.col("rank").alias("n"), F.coalesce("source", F.lit("unknown")).alias("source"), "title", "page", "chunk_id", T.snippet(F.col("content"), snippet_chars).alias("snippet")
    )


def citations(ranked: DataFrame, snippet_chars: int = 300) -> DataFrame:
    return ranked.groupBy("qid").agg(F.sort_array(F.collect_list(citation(snippet_chars))).alias("sources"))


def history(turns: DataFrame, last: int = 6) -> DataFrame:
    """(conv_id, history): the last ``last`` messages of each conversation as lines, from turns (conv_id, turn, role, text)."""
    recent = turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= last)
    lines = F.sort_array(F.collect_list(F.struct("turn", T.history_line(F.col("role"), F.col("text")).alias("line"))))
    return recent.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))


def history_of(turns: Column, last: int = 6) -> Column:
    """The last ``last`` of an array of (role, text) as lines; null without turns."""
    recent = F.slice(turns, F.greatest(F.size(turns) - last, F.lit(0)) + 1, F.lit(max(last, 1)))
    lines = F.array_join(F.transform(recent, lambda t: T.history_line(t["role"], t["text"])), "\n")
    return F.when((F.size(turns) > 0) & F.lit(last > 0), lines)


def invalid_reasons(question: Column, top_k: Column, role: Column) -> Column:
    """What a request breaks: question of 1 to 2000 characters, top_k null or 1 to 20, role user or assistant."""
    return F.filter(
        F.array(
            F.when(F.length(question).between(1, 2000), F.lit(None)).otherwise("question"),
            F.when(top_k.isNull() | top_k.between(1, 20), F.lit(None)).otherwise("top_k"),
            F.when(role.isNull() | role.isin("user", "assistant"), F.lit(None)).otherwise("role"),
        ),
        lambda x: x.isNotNull(),
    )


def condensed(requests: DataFrame, make: Callable[[], Generator]) -> DataFrame:
    """``requests`` (question, history, ...) with search_query: the rewritten question; without history, or if that fails or is blank, the question."""

    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generator = make()

        def one(prompt: str | None) -> str | None:
            try:
                return generator.complete(prompt) if prompt else None
            except Exception:  # noqa: BLE001  then the question itself is searched for
                return None

        for prompts in batches:
            yield prompts.map(one)

    prompt = F.when(F.coalesce("history", F.lit("")) != "", fill(CONDENSE_PROMPT, history=F.col("history"), question=F.col("question")))
    return requests.withColumn("search_query", F.coalesce(T.blank_to_null(T.strip(rewrite(prompt))), F.col("question")))


def answered(requests: DataFrame, make: Callable[[], Generator]) -> DataFrame:
    """``requests`` (question, context, ...) with answer, made from the original question; without context the fixed message."""

    @F.pandas_udf("string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generator = make()
        for prompts in batches:
            yield prompts.map(lambda p: generator.complete(p) if p else None)

    prompt = F.when(F.col("context").isNotNull(), fill(ANSWER_PROMPT, context=F.col("context"), question=F.col("question")))
    return requests.withColumn("answer", F.coalesce(generate(prompt), F.lit(NO_CONTEXT)))


def uncited(text: str) -> list[str]:
    """An answer without its citations, cut before each space as it would stream."""
    return re.split("(?= )", re.sub(r" ?\[\d+\]", "", text))


def stream_events(answers: DataFrame) -> DataFrame:
    """(qid, seq, type, text, search_query) rows of each answer (qid, search_query, pieces array, cited): sources, tokens, a replacement if the cited text differs, done."""
    pieces = F.filter("pieces", lambda p: p != "")
    none = F.lit(None).cast("string")
    event = lambda kind, text=none, query=none: F.struct(F.lit(kind).alias("type"), text.alias("text"), query.alias("search_query"))
    events = F.concat(
        F.array(event("sources", query=F.col("search_query"))),
        F.transform(pieces, lambda p: event("token", p)),
        F.when(F.col("cited") != F.array_join(pieces, ""), F.array(event("replace", F.col("cited")))).otherwise(F.array().cast("array<struct<type:string,text:string,search_query:string>>")),
        F.array(event("done")),
    )
    return answers.select("qid", F.posexplode(events).alias("seq", "e")).select("qid", "seq", "e.type", "e.text", "e.search_query")


def frames(buffer: Column) -> Column:
    """The complete frames of an event buffer, and what is left after the last blank line: struct(frames, rest)."""
    parts = F.split(buffer, "\n\n")
    return F.struct(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("frames"), F.element_at(parts, -1).alias("rest"))
