"""Named queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftstone.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain_unions(spark: SparkSession) -> None:
    """Unions concatenate partitions.  Zipping those of equally partitioned sides fails where adaptive execution coalesces them differently."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            plain_unions(spark)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# --- SQL that several oracles share --------------------------------------------------------------------------------


def sql_clean(x: str) -> str:
    for pattern, by in ((r"\r\n?", "chr(10)"), (r"([\w\p{L}])-\n([\w\p{L}])", r"'\1\2'"), ("[ \t ]+", "' '"), (r"\n{3,}", "chr(10) || chr(10)"), (r"^\s+|\s+$", "''")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return x


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_hash_vector(x: str, dim: int) -> str:
    tokens = rf"list_filter(string_split_regex(lower({x}), '\s+'), lambda t: t <> '')"
    buckets = f"list_transform({tokens}, lambda t: ('0x' || substr(md5(t), 1, 7))::BIGINT % {dim})"
    counts = f"list_transform(range(0, {dim}), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE)"
    return f"(SELECT CASE WHEN s = 0 THEN c ELSE list_transform(c, lambda x: x / sqrt(s)) END FROM (SELECT c, list_sum(list_transform(c, lambda x: x * x)) AS s FROM (SELECT {counts} AS c FROM (SELECT {buckets} AS b))))"
