"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes.  The distinct blocks are sorted and numbered: equal blocks get
one integer name, different blocks different ones.  Then the names of adjacent pairs are numbered in the same way, level
after level, until one name is left of each document.  (level, name) is its identity: two documents have the same one
exactly if their texts are equal, since every name stands for one sequence of blocks.  No step trusts a hash: blocks are
sorted by a 128-bit digest only after all blocks with a repeated digest were compared byte by byte and no digest was found
to stand for two different blocks; else the blocks themselves are sorted.

Contents are shuffled of repeated digests alone, pre-aggregated to distinct ones in each task; all later rounds move integers.  Each
round halves the rows, and documents leave as soon as they have one name, so the rounds number log2 of the longest
text's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import durable, fits, free, ranked

BLOCK = 4096


def squeezed(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; a null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _names(distinct: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The distinct rows with their rank as name: the same rows get the same names in any session."""
    return ranked(distinct, [F.asc(c) for c in columns], name, "name")


def _last(block: int) -> Column:
    """The number of the last block of ``data``, from 0; the empty text is one empty block."""
    return F.floor(F.greatest(F.length("data") - 1, F.lit(0)) / block).cast("int")


def _cuts(each, block: int) -> Column:  # noqa: ANN001
    """``each`` of the blocks of the bytes in ``data``."""
    at = F.sequence(F.lit(0), _last(block))
    return F.transform(at, lambda i: each(F.substr("data", i * block + 1, F.lit(block))))


def _digest(block: Column) -> Column:
    return F.unhex(F.md5(block))


def _collide(docs: DataFrame, repeated: DataFrame, block: int, digest) -> bool:  # noqa: ANN001
    """Whether two different blocks have one digest.

    Blocks with different digests differ, so only blocks of a digest that occurs again are compared.  They are picked
    where they are read if the digests are few enough to be sent around.
    """
    if repeated.isEmpty():
        return False
    small = fits(repeated)
    blocks = docs.select(F.explode(_cuts(lambda b: b, block)).alias("block")).select(digest(F.col("block")).alias("digest"), "block")
    contents = blocks.join(F.broadcast(repeated) if small else repeated, "digest", "left_semi").distinct()
    return not contents.groupBy("digest").count().where("count > 1").isEmpty()


def identities(docs: DataFrame, block: int = BLOCK, digest=_digest) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """``docs`` (doc_id, data binary) as known (row, doc_id, n_bytes, sha256) and found (row, level, name).

    ``row`` numbers the rows; equal data, equal (level, name).  Names depend on the set of texts alone: they are ranks among
    its blocks, then among its pairs of names.
    """
    numbered = lambda df: df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "data")
    about = ["row", "doc_id", F.length("data").alias("n_bytes"), F.sha2("data", 256).alias("text_sha256")]
    known = durable(numbered(docs).select(*about, _cuts(digest, block).alias("digests")), "exact-docs")
    placed = known.select("row", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "digest"))
    counts = durable(placed.groupBy("digest").agg(F.count(F.lit(1)).alias("c")), "block-digests")
    if _collide(docs, counts.where("c > 1").select("digest"), block, digest):  # then the blocks themselves have to be named
        whole = durable(numbered(docs), "exact-whole")
        known = durable(whole.select(*about), "exact-docs")
        marked = whole.select("row", (_last(block) + 1).alias("n"), F.posexplode(_cuts(lambda b: b, block)).alias("pos", "block"))
        names, joined_by = _names(marked.select("block").distinct(), ["block"], "block-names"), ["block"]
    else:
        marked, names, joined_by = placed, _names(counts.select("digest"), ["digest"], "block-names"), ["digest"]
    found, level = None, 0
    while True:
        active = durable(marked.join(names, joined_by).select("row", "pos", "n", "name"), f"names-{level}")
        free(names, *([marked] if level else []))
        done = active.where("n = 1").select("row", F.lit(level).alias("level"), "name")
        found = done if found is None else found.unionAll(done)
        marked = active.where("n > 1").groupBy("row", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.min(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.min(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            F.ceil(F.min("n") / 2).cast("int").alias("n"),
        )
        marked = durable(marked, f"pairs-{level}")
        if marked.isEmpty():
            free(marked, counts)
            return known, found
        level, joined_by = level + 1, ["left", "right"]
        names = _names(marked.select(*joined_by).distinct(), joined_by, f"pair-names-{level}")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (after ``squeezed``) the row with the smallest doc_id stays; null ids come last, and of rows with one id a
    single one stays.  keep_id is the id of the row that stays.  A null text equals the empty one.  A very long
    text has as many blocks as it needs.  Other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    known, found = identities(docs.select(F.col(id_col).alias("doc_id"), F.encode(squeezed(F.col(text_col)), "utf-8").alias("data")), block)
    named = durable(known.select("row", "doc_id", "text_sha256").join(found, "row"), "exact-identities")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    groups = durable(named.groupBy("level", "name").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    joined = named.join(groups, ["level", "name"])
    return joined.select("doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
