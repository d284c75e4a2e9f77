"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the block transfers that move the fewest bytes.

Rows of an old shard fall into blocks by size class (four classes to a doubling).  A flow network on the driver has a node for each old
and new shard: rows stay at home for nothing or leave through their block's arc at the block's mean bytes a row, and each
new shard takes its capacity, the row counts being at most one apart (which shards take the one row more is part of the
solution, by the mean sizes of blocks).  Its optimum says how many rows of which block move where, and of a block the smallest
rows leave: given the row counts, no other rows would be fewer bytes.

Old shards without a new one of their number move as a whole and are one node together, so the driver sees new shards times
classes, never rows nor old files.  Rows are numbered within their blocks by size and, among equal sizes, by file and runs of ``RUN`` file
positions, so a block that holds most of the rows is no single task's.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.llm.common import durable, fits, fresh, ranked, save, scratch

RUN = 1024
_UNIT = 1024  # costs are integers: 1/1024 of a byte


class FlowNetwork:
    """Minimum-cost maximum flow by shortest augmenting paths with node potentials; costs are not negative."""

    def __init__(self) -> None:
        self.arcs: list[list[int]] = []  # to, capacity left, cost; an arc's reverse is its number xor 1
        self.at: dict[object, list[int]] = {}

    def arc(self, a: object, b: object, capacity: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.at.setdefault(x, []).append(len(self.arcs))
            self.at.setdefault(y, [])
            self.arcs.append([y, c, w])
        return len(self.arcs) - 2

    def flow(self, arc: int) -> int:
        return self.arcs[arc ^ 1][1]

    def solve(self, source: object, sink: object) -> int:
        """The cost of the flow; ``flow`` then has each arc's share."""
        potential = dict.fromkeys(self.at, 0)
        total = 0
        while True:
            distance, via, queue, count = {source: 0}, {}, [(0, 0, source)], 0
            done = set()
            while queue:
                d, _, node = heapq.heappop(queue)
                if node in done:
                    continue
                done.add(node)
                for arc in self.at[node]:
                    to, left, cost = self.arcs[arc]
                    if left and to not in done:
                        new = d + cost + potential[node] - potential[to]
                        if new < distance.get(to, new + 1):
                            distance[to], via[to] = new, (node, arc)
                            count += 1
                            heapq.heappush(queue, (new, count, to))
            if sink not in done:
                return total
            far = max(distance[n] for n in done)
            for node in potential:
                potential[node] += min(distance[node], far) if node in done else far
            path, node = [], sink
            while node != source:
                node, arc = via[node]
                path.append(arc)
            amount = min(self.arcs[a][1] for a in path)
            for a in path:
                self.arcs[a][1] -= amount
                self.arcs[a ^ 1][1] += amount
                total += amount * self.arcs[a][2]


@dataclass(frozen=True)
class Transfer:
    """Rows start <= rank < end of a block (old shard, size class) stand in ``shard`` from slot ``slot`` on."""

    old: int
    size_class: int
    start: int
    end: int
    shard: int
    slot: int


@dataclass(frozen=True)
class Block:
    old: int
    size_class: int
    rows: int
    bytes: int


def solve(blocks: list[Block], shards: int) -> list[Transfer]:
    """The transfers of all rows of the blocks; those that stay at home (old shard number = new) come with them."""
    if not blocks:
        return []
    total = sum(b.rows for b in blocks)
    net, leaving = FlowNetwork(), {}
    rows: dict[int, int] = {}
    for b in sorted(blocks, key=lambda b: (b.old, b.size_class)):
        rows[b.old] = rows.get(b.old, 0) + b.rows
        leaving[b] = net.arc(("old", b.old), "moved", b.rows, b.bytes * _UNIT // b.rows + 1)
    for old, n in rows.items():
        net.arc("source", ("old", old), n)
        if old < shards:
            net.arc(("old", old), ("new", old), n)
    arriving = {}
    for new in range(shards):
        arriving[new] = net.arc("moved", ("new", new), total)
        net.arc(("new", new), "sink", total // shards)
        net.arc(("new", new), "one more", 1)
    net.arc("one more", "sink", total % shards)
    net.solve("source", "sink")

    slots, out = dict.fromkeys(range(shards), 0), []

    def place(block: Block, start: int, end: int, shard: int) -> None:
        if end > start:
            out.append(Transfer(block.old, block.size_class, start, end, shard, slots[shard]))
            slots[shard] += end - start

    for block, arc in leaving.items():
        if block.old < shards:
            place(block, net.flow(arc), block.rows, block.old)
    space = [[new, net.flow(arc)] for new, arc in arriving.items() if net.flow(arc)]
    for block, arc in leaving.items():
        start, end = 0, net.flow(arc)
        while start < end:
            new, left = space[0]
            step = min(left, end - start)
            place(block, start, start + step, new)
            start += step
            space[0][1] -= step
            if not space[0][1]:
                space.pop(0)
    return out


def text_size(text: Column) -> Column:
    """UTF-8 bytes (a null has none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (old int, pos long: position in the old shard, size long, more columns) with shard int and slot long.

    Row counts of the new shards are at most one apart, slots gapless from 0.  ``rows`` is read several times: give a
    written table.  An empty table gives an empty result; old shards beyond the new ones move as a whole.  Ties of size go by file and
    position.  Input columns named shard or slot give way to the result's.
    """
    spark, given = rows.sparkSession, [c for c in rows.columns if c not in ("shard", "slot")]
    node, kind, run = "__node", "__class", "__run"
    rows = rows.select(*given, F.least("old", F.lit(shards)).alias(node), F.floor(4 * F.log2("size")).cast("int").alias(kind), F.expr(f"pos div {RUN}").alias(run))
    runs = durable(rows.groupBy(node, kind, "size", "old", run).agg(F.count(F.lit(1)).alias("n")), "shard-runs")
    sizes = runs.groupBy(node, kind, "size").agg(F.sum("n").alias("n"))
    blocks = sizes.groupBy(node, kind).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("bytes"))
    transfers = solve([Block(r[node], r[kind], r.n, r.bytes) for r in blocks.collect()], shards)  # new shards times classes
    plan = spark.createDataFrame([(t.old, t.size_class, t.start, t.end, t.shard, t.slot) for t in transfers], f"{node} int, {kind} int, __start long, __end long, shard int, __first long")
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    smaller = sizes.select(node, kind, "size", before([node, kind], ["size"]).alias("__smaller"))
    earlier = runs.select(node, kind, "size", "old", run, before([node, kind, "size"], ["old", run]).alias("__earlier"))
    starts = earlier.join(smaller, [node, kind, "size"]).select(node, kind, "size", "old", run, (F.col("__smaller") + F.col("__earlier")).alias("__before"))
    within = F.row_number().over(Window.partitionBy(node, kind, "size", "old", run).orderBy("pos")) - 1
    ranked_rows = rows.withColumn("__within", within).join(starts, [node, kind, "size", "old", run]).withColumn("__rank", F.col("__before") + F.col("__within"))
    # the plan has a row for each block and at most one more for each new shard
    placed = ranked_rows.join(F.broadcast(plan), [node, kind]).where("__rank >= __start and __rank < __end")
    return placed.select(*given, "shard", (F.col("__first") + F.col("__rank") - F.col("__start")).alias("slot"))


def read_sharded(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet table with its files as old shards: the columns, __old int (files in order of their names), __pos long."""
    rows = spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__pos"))
    files = ranked(rows.select("__file").distinct(), [F.asc("__file")], "shard-files", "__old").withColumn("__old", F.col("__old").cast("int"))
    return rows.join(F.broadcast(files) if fits(files) else files, "__file").drop("__file")


def reshard(spark: SparkSession, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each row of a Parquet table goes: doc_id, size, old, pos, shard, slot.

    Null ids and texts keep their rows; a null text has size 1.  Repeated ids and rows are rows of their own; a very long text counts with
    all its bytes.  Other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    rows = read_sharded(spark, path, id_col, text_col)
    rows = rows.select(F.col(id_col).alias("doc_id"), text_size(F.col(text_col)).alias("size"), F.col("__old").alias("old"), F.col("__pos").alias("pos"))
    return assign(durable(rows, "shard-rows"), shards)


@dataclass(frozen=True)
class Rewritten:
    """Shards that differ from the old file of their number, in ``folder``/``shard``=N with their slots as column ``slot``.

    The others are not written: their old files go on serving.
    """

    path: str
    folder: str
    affected: list[int]
    shards: int
    shard: str
    slot: str

    def rows(self, spark: SparkSession, *columns: str) -> DataFrame:
        """All rows as they now stand, from the written shards and the old files that stay: the columns, shard int, slot long."""
        kept = read_sharded(spark, self.path, *columns).where((F.col("__old") < self.shards) & ~F.col("__old").isin(self.affected))
        kept = kept.select(*columns, F.col("__old").alias("__shard"), F.col("__pos").alias("__slot"))
        if not self.affected:
            return kept.withColumnsRenamed({"__shard": "shard", "__slot": "slot"})
        new = spark.read.parquet(self.folder).select(*columns, F.col(self.shard).cast("int").alias("__shard"), F.col(self.slot).alias("__slot"))
        return new.unionAll(kept).withColumnsRenamed({"__shard": "shard", "__slot": "slot"})


def rewrite(spark: SparkSession, path: str, placed: DataFrame, shards: int, folder: str | None = None) -> Rewritten:
    """Writes the new shards that take rows in or lose some, each in order of its slots; all columns of the table go along.

    ``folder``: one in the shared folder that goes with the program, if none is given.  A column named shard or slot keeps its name; the
    result's get another.
    """
    folder = folder or scratch(spark, "shards")
    moved = placed.where(F.col("shard") != F.col("old"))
    changed = moved.select(F.explode(F.array("shard", "old")).alias("shard")).where(F.col("shard") < shards).distinct()
    affected = sorted(r.shard for r in changed.collect())  # at most the new shards
    table = spark.read.parquet(path)
    shard, slot = fresh(table, "shard"), fresh(table, "slot")
    if affected:
        keys = placed.where(F.col("shard").isin(affected)).select(F.col("old").alias("__old"), F.col("pos").alias("__pos"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
        rows = read_sharded(spark, path, *table.columns).join(keys, ["__old", "__pos"])
        ordered = rows.repartition("__shard", F.expr(f"__slot div {16 * RUN}")).sortWithinPartitions("__shard", "__slot")
        save(ordered.select(*table.columns, F.col("__slot").alias(slot), F.col("__shard").alias(shard)), folder, "zstd", shard)
    return Rewritten(path, folder, affected, shards, shard, slot)
