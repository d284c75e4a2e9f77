"""Queries on prompts, stream frames, prepared pages, readers and the index."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.config import EngineConfig
from siftstone.functions import text as T
from siftstone.operators import answer, prepare
from siftstone.operators import index as ix
from siftstone.plans.corpus import chunks_sql, naive
from siftstone.plans.registry import query, sql_clean, sql_strip, table
from siftstone.sources import files
from siftstone.sources.tables import scratch


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(template: str, **parts: str) -> str:
    """The template as SQL: its literal pieces and the parts' expressions, joined."""
    for name, expression in parts.items():
        template = template.replace("{" + name + "}", f"\0{expression}\0")
    return " || ".join(_quoted(piece) if k % 2 == 0 else piece for k, piece in enumerate(template.split("\0")))


@query(f"SELECT conv_id, turn, {_filled(answer.ANSWER_PROMPT, context='text', question='role')} AS prompt, {_filled(answer.CONDENSE_PROMPT, history='text', question='role')} AS condense FROM conversations")
def q54_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with whole turns as context and history; braces in a text are no places to fill."""
    text, role = F.col("text"), F.col("role")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.fill(answer.ANSWER_PROMPT, context=text, question=role).alias("prompt"), answer.fill(answer.CONDENSE_PROMPT, history=text, question=role).alias("condense"))


@query(r"""WITH b AS (SELECT conv_id, string_split(string_agg('data: ' || text, chr(10) || chr(10) ORDER BY turn), chr(10) || chr(10)) AS parts FROM conversations GROUP BY conv_id)
SELECT conv_id, len(parts) - 1 AS frames, sha1(array_to_string(parts[:-2], '|')) AS k, parts[-1] AS rest FROM b""")
def q55_stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as an event buffer whose last frame is not complete."""
    events = F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("data: "), "text").alias("e"))))
    buffers = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(events, lambda x: x["e"]), "\n\n").alias("buffer"))
    cut = buffers.select("conv_id", answer.frames(F.col("buffer")).alias("f"))
    return cut.select("conv_id", F.size("f.frames").cast("bigint").alias("frames"), T.content_key(F.array_join("f.frames", "|")).alias("k"), "f.rest")


_PAGE_TEXT = sql_strip(r"regexp_replace(regexp_replace(regexp_replace(text, '(?m)^/{3,}\s*$', '', 'g'), '(?m)\s*\{\s*#[\w-]+\s*\}\s*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + " || chr(10)"


@query(f"""WITH p AS (SELECT length({_PAGE_TEXT}) AS n FROM documents)
SELECT count(*) FILTER (n >= 200) AS written, count(*) FILTER (n < 200) AS skipped, coalesce(sum(n) FILTER (n >= 200), 0)::BIGINT AS total_chars, 0::BIGINT AS inlined, 0::BIGINT AS missing FROM p""")
def q56_page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as documentation pages."""
    pages = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), "text")
    code = spark.createDataFrame([], "path string, text string")
    return prepare.totals(prepare.prepare(pages, code))


@query(f"""WITH c AS ({chunks_sql(1000, 0)}), m AS (SELECT count(*) AS n FROM c)
SELECT row_number() OVER (ORDER BY source, chunk_index) - 1 AS id, chunk_id, sha1(content) AS k, true AS has_vector, n AS chunk_count FROM c, m""")
def q57_index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows of all documents, indexed, opened under the guard and joined with their vectors."""
    config = EngineConfig(chunk_overlap=0)
    path = scratch(spark, "index")
    ix.build_index(naive(spark, sf_dir), path, config)
    found = ix.open_index(spark, path, config)
    return found.chunks.join(found.vectors, "id").select("id", "chunk_id", T.content_key(F.col("content")).alias("k"), F.col("vector").isNotNull().alias("has_vector"), F.lit(found.size).alias("chunk_count"))


def _docx(text: str) -> bytes:
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {space}><w:body>" + "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n")) + "</w:body></w:document>")
    return made.getvalue()


def _pages(content: bytes) -> list[files.Section]:
    return [(n, None, page) for n, page in enumerate(content.decode().split("\f"), 1)]


@query(f"""WITH d AS (SELECT *, doc_id % 4 AS kind FROM documents), r AS (
  SELECT doc_id, NULL::INT AS page, text, false AS bad FROM d WHERE kind IN (0, 1) UNION ALL
  SELECT doc_id, 1, text, false FROM d WHERE kind = 2 UNION ALL SELECT doc_id, 2, 'second page', false FROM d WHERE kind = 2 UNION ALL
  SELECT doc_id, NULL, NULL, true FROM d WHERE kind = 3)
SELECT doc_id, coalesce(page, 0) AS page, bad, sha1({sql_clean("text")}) AS k FROM r WHERE bad OR {sql_clean("text")} <> ''""")
def q58_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of four kinds: DOCX, Markdown, two-page files read by an injected reader, and broken archives for the quarantine."""

    @F.pandas_udf("binary")
    def content(ids: pd.Series, texts: pd.Series) -> pd.Series:
        make = (_docx, str.encode, lambda t: f"{t}\fsecond page".encode(), lambda t: b"no archive " + t.encode())
        return pd.Series([make[i % 4](t) for i, t in zip(ids, texts, strict=True)])

    suffix = F.element_at(F.array(*map(F.lit, (".docx", ".md", ".pages", ".docx"))), (F.col("doc_id") % 4 + 1).cast("int"))
    made = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), suffix.alias("suffix"), content("doc_id", "text").alias("content"))
    sections, bad = files.sections_of(files.extract(made, {".pages": _pages}))
    read = sections.select("source", "page", F.lit(False).alias("bad"), T.content_key(F.col("text")).alias("k"))
    none = F.lit(None)
    both = read.unionByName(bad.select("source", none.cast("int").alias("page"), F.lit(True).alias("bad"), none.cast("string").alias("k")))
    return both.select(F.col("source").cast("bigint").alias("doc_id"), F.coalesce("page", F.lit(0)).alias("page"), "bad", "k")
