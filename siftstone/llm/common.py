"""What the operators share: tables in the shared folder, input tables, and the JVM's text helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.sources import tables
from siftstone.sources.tables import BROADCAST_BYTES, fits, free, ranked, save, scratch, spread  # noqa: F401  for the operators


#: Bounds of one Arrow batch: what the JVM and a worker hold of a table at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def settle(spark: SparkSession) -> None:
    """Session settings that the operators rely on: small Arrow batches, and unions that concatenate partitions.

    Zipping the partitions of equally partitioned sides fails where adaptive execution coalesces them differently.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def durable(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``tables.durable`` under the operators' settings."""
    settle(df.sparkSession)
    return tables.durable(df, name, compression)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table; other columns, whatever their names, are not read."""
    settle(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")).select(*columns)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sampled(docs: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text) of the ``most`` ids with the smallest hash; of rows that share an id the text with the smallest hash.  Null ids are none."""
    ids = docs.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull()).distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    return rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text")


def crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes."""
    return F.crc32(F.encode(text, "utf-8"))
