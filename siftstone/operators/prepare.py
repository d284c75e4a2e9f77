"""Documentation pages to plain corpus pages: inlined examples, flattened admonitions, stripped anchors, stub filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import text as T

#: Pages that are no documentation, and directories without pages.  Fixed values.
SKIPPED_FILES = ("release-notes.md", "fastapi-people.md", "external-links.md", "translations.md", "translation-banner.md", "newsletter.md", "_llm-test.md", "management.md", "management-tasks.md")
SKIPPED_DIRS = ("resources", "img", "css", "js")


def is_page(path: Column) -> Column:
    """A Markdown file with neither a skipped name nor a skipped directory above it."""
    parts = F.split(path, "/")
    skipped = F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, SKIPPED_DIRS)))
    return F.endswith(path, F.lit(".md")) & ~T.file_name(path).isin(*SKIPPED_FILES) & ~skipped


def flat_name(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("__"))


def directives(pages: DataFrame) -> DataFrame:
    """(rel_path, place, directive, path, caption): the include lines of each page in order."""
    found = pages.select("rel_path", F.posexplode(F.regexp_extract_all("text", F.lit(T.INCLUDE), 0)).alias("place", "directive"))
    return found.select("rel_path", "place", "directive", T.include_path(T.include_target(F.col("directive"))).alias("path"), T.include_caption(F.col("directive")).alias("caption"))


def inline_includes(pages: DataFrame, code: DataFrame) -> DataFrame:
    """``pages`` (rel_path, text) with text after inlining, and counts inlined and missing; ``code`` (path, text).

    Pages are split at their directives; the code comes by an equi-join on its path, so neither side is held in memory.
    A missing file leaves nothing behind but its count.
    """
    blocks = directives(pages).join(code.select("path", F.col("text").alias("code")), "path", "left")
    block = T.code_block(F.col("caption"), T.code_language(F.col("path")), F.col("code"))
    per_page = blocks.groupBy("rel_path").agg(
        F.sort_array(F.collect_list(F.struct("place", F.coalesce(block, F.lit("")).alias("block")))).alias("blocks"),
        F.count("code").alias("inlined"),
        F.count_if(F.col("code").isNull()).alias("missing"),
    )
    pieces = F.split("text", T.INCLUDE)
    woven = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size("blocks"), F.element_at(F.col("blocks"), F.least(i + 1, F.size("blocks")))["block"]).otherwise(""))), "")
    out = pages.join(per_page, "rel_path", "left")
    none = F.lit(0).cast("bigint")
    return out.select("rel_path", F.when(F.col("blocks").isNull(), F.col("text")).otherwise(woven).alias("text"), F.coalesce("inlined", none).alias("inlined"), F.coalesce("missing", none).alias("missing"))


def clean_page(text: Column) -> Column:
    return T.finish_page(T.strip_anchors(T.flatten_admonitions(text)))


def prepare(pages: DataFrame, code: DataFrame, least: int = 200) -> DataFrame:
    """(name, rel_path, text, inlined, missing, kept): cleaned pages; stubs below ``least`` characters are marked, not kept."""
    woven = inline_includes(pages.where(is_page(F.col("rel_path"))), code).withColumn("text", clean_page(F.col("text")))
    return woven.select(flat_name(F.col("rel_path")).alias("name"), "rel_path", "text", "inlined", "missing", (F.length("text") >= least).alias("kept"))


def totals(prepared: DataFrame) -> DataFrame:
    """written, skipped, total_chars, inlined, missing."""
    kept = F.col("kept")
    return prepared.agg(
        F.count_if(kept).alias("written"), F.count_if(~kept).alias("skipped"), F.sum(F.when(kept, F.length("text")).otherwise(0)).alias("total_chars"), F.sum("inlined").alias("inlined"), F.sum("missing").alias("missing")
    )
