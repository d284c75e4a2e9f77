"""Tables in the shared folder, JSON-line tables and the vector cache."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that may stand in memory of every task.
BROADCAST_BYTES = 64 << 20
#: What a hashed row takes there beside its values: its header, its place in the map, its key once more.
ROW_BYTES = 64

#: Paths below the shared folder that nobody has freed.
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="siftstone-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def _set(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings (with _ for .) that hold inside alone."""
    names = {key: key.replace("_", ".") for key in settings}
    before = {key: spark.conf.get(name) for key, name in names.items()}
    try:
        for key, value in settings.items():
            spark.conf.set(names[key], value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(names[key], value)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def save(df: DataFrame, path: str, compression: str = "snappy", *partitions: str) -> None:
    """Writes ``df`` as Parquet; the shuffle files of its plan go at once.  Small row groups bound what a writing task holds."""
    with _set(df.sparkSession, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
        df.write.option("parquet.block.size", 32 << 20).option("compression", compression).partitionBy(*partitions).parquet(path)


def durable(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows of ``df``, written once as Parquet into the shared folder and read again from there.

    This cuts the lineage: a lost executor costs the rows of its running tasks only, and what was drawn or
    numbered on the way (row ids, hubs) keeps its value.  Shuffle files of the plan go when it is written.  The table's files go
    with ``free`` or when the program ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    save(df, path, compression)
    made = spark.read.schema(df.schema).parquet(path)
    made._durable_at = path
    return made


def ranked(rows: DataFrame, order: list[Column], name: str, column: str, first: int = 0) -> DataFrame:
    """``rows``, written, with ``column``: each row's rank in ``order``, from ``first`` on.

    Ranges of the order are sorted and numbered in their tasks, then the sizes of the ranges before are added.  The ranks depend on
    the rows alone, not on partitions or settings, if ``order`` leaves no ties.
    """
    spark, number = rows.sparkSession, F.monotonically_increasing_id()
    written = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", number), name)
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = [], first
    for number, n in sorted(tuple(r) for r in written.groupBy(part).agg(F.count(F.lit(1))).collect()):  # one row a partition
        before.append((number, total))
        total += n
    offsets = spark.createDataFrame(before, "__part bigint, __before bigint")
    made = written.join(F.broadcast(offsets), part == F.col("__part")).select(*rows.columns, (F.col("__before") + inside).alias(column))
    made._durable_at = written._durable_at
    return made


def free(*tables: DataFrame) -> None:
    """Deletes tables that ``durable`` wrote and that nothing reads any more."""
    for made in tables:
        path = made._durable_at
        _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _tidy() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; then the folder's owner tidies
            return


#: Bytes of a table in few files from which its rows are dealt out, and up to which.
SPREAD_FROM, SPREAD_TO = 4 << 20, 1 << 30


def spread(table: DataFrame) -> DataFrame:
    """``table`` with its rows dealt out to all cores, if it is a small one in fewer files than there are cores.

    Such a file may be one row group, which a single task reads, and would then do all work on its rows.  Larger tables are in many
    files or row groups and stay as they are.
    """
    spark, files = table.sparkSession, table.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if not 0 < len(files) < cores:
        return table
    size = 0
    for file in files:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
        size += at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    return table.repartition(cores) if SPREAD_FROM <= size <= SPREAD_TO else table


def held_bytes(table: DataFrame) -> int:
    """About the bytes that a hashed copy of ``table`` takes: each value's own, and ROW_BYTES a row."""
    wide = [2 * F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(16) for c, kind in table.dtypes]
    return int(table.agg(F.sum(sum(wide, F.lit(ROW_BYTES)).cast("bigint"))).first()[0] or 0)


def fits(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written table, measured in bytes, is small enough to be sent to all tasks."""
    return held_bytes(table) <= limit


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A missing file is an empty table; torn lines are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A vector cache (k, v, seq): the last of several vectors of a key counts, torn lines do not."""
    from siftstone.operators.embed import newest

    rows = read_json_lines(spark, path, "k string, v array<float>, seq bigint")
    return newest(rows.withColumn("seq", F.coalesce("seq", F.monotonically_increasing_id())))
