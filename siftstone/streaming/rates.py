"""Rolling event rates: as a window over a bounded table, and as a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000


def rolling_count(events: DataFrame, key: str, ts: str, micros: int = MINUTE) -> DataFrame:
    """``events`` with in_window: events of the key in the time before, this one and one exactly that old included.

    A key's time line is cut into slices of the window's length; each event meets its own slice and the one before, so a key
    with most of the events is counted by many tasks.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = events.withColumn("__at", at).withColumn("__slice", F.expr(f"__at div {micros}"))
    echo = own.select(F.col(key), (F.col("__slice") + 1).alias("__slice"), "__at", F.lit(True).alias("__echo"))
    both = own.withColumn("__echo", F.lit(False)).unionByName(echo, allowMissingColumns=True)
    window = Window.partitionBy(key, "__slice").orderBy("__at").rangeBetween(-micros, 0)
    return both.withColumn("in_window", F.count(F.lit(1)).over(window)).where(~F.col("__echo")).drop("__at", "__slice", "__echo")


def streaming_rate(events: DataFrame, key: str, ts: str, late: str = "10 minutes", size: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """An extension: events of each key in sliding windows of a stream, with late data up to the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide), key).agg(F.count(F.lit(1)).alias("n"))
