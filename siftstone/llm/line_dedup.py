"""Incremental line dedup: sharded cuckoo filters backed by exact reference counts.

The reference-count table holds, for the 128-bit digest of each line key, the number of documents with that key.  A key
with at least ``min_docs`` documents is frequent: all its lines go.  Each shard (by the digest's first bytes) keeps its
frequent keys in a cuckoo filter, which takes insertions and deletions, so documents can be added and taken back.

A filter alone errs on the keep side never, on the drop side rarely.  The counts make it exact: every infrequent key that
its shard's filter wrongly accepts is found by probing the whole count table, and these exceptions go along with the
filters.  Filters travel to the tasks only while their measured size is within ``BROADCAST_BYTES``.  Beyond that, chunks of
rows ask for their distinct digests where each shard's filter is; what it accepts is checked against the counts and goes back to
the chunk, with the same result.  A line that most documents have is asked for once a chunk.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased; lines end at ``\\n``.  An empty key
is never counted or dropped.  A null or empty text is one empty line.  Repeated rows count as documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import BROADCAST_BYTES, durable, fresh
from siftstone.llm.textscan import mix, parts

_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
SLOTS = 4
#: Distinct keys that a task holds before it hands partial counts on.
PARTIAL = 200_000
#: Frequent keys of a shard, about.
SHARD_KEYS = 200_000
#: Rows of a chunk, and bytes of digests that a task asks one filter for.
CHUNK_ROWS, ASKED_BYTES = 256, 32 << 20


def digest(line: bytes) -> bytes | None:
    """The 128-bit digest of a line's key; None for an empty key."""
    key = line.strip(_BLANK).lower()
    return hashlib.blake2b(key, digest_size=16).digest() if key else None


class CuckooFilter:
    """A set of 128-bit digests by 32-bit fingerprints, four to a bucket; supports deletion of what was inserted."""

    def __init__(self, capacity: int = 16) -> None:
        self.n = 0
        self.table = np.zeros((1 << max(1, int(np.ceil(np.log2(max(capacity, 2) / (SLOTS * 0.8)))) + 1), SLOTS), np.uint32)

    @staticmethod
    def _parts(digests: list[bytes] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        mark = (raw[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return raw[:, 0] >> np.uint64(16), np.where(mark == 0, np.uint32(1), mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1))

    def _both(self, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        home, mark = self._parts(digests)
        first = home & np.uint64(len(self.table) - 1)
        return first, self._other(first, mark), mark

    def contains(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, bool)
        first, second, mark = self._both(digests)
        return ((self.table[first] == mark[:, None]) | (self.table[second] == mark[:, None])).any(axis=1)

    def insert(self, digests: list[bytes]) -> bool:
        """False if the table is too full; then build a larger one from the exact counts."""
        if not digests:
            return True
        mask = len(self.table) - 1
        for a, b, m in zip(*(x.tolist() for x in self._both(digests)), strict=True):
            for bucket in (a, b):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = m
                    break
            else:
                bucket = b
                for kick in range(500):
                    slot = (kick * 7 + m) % SLOTS
                    m, self.table[bucket, slot] = int(self.table[bucket, slot]), m
                    bucket ^= int(mix(np.array([m], np.uint64))[0]) & mask
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = m
                        break
                else:
                    return False
            self.n += 1
        return True

    def delete(self, digests: list[bytes]) -> None:
        """Takes back digests that were inserted before."""
        if not digests:
            return
        for a, b, m in zip(*(x.tolist() for x in self._both(digests)), strict=True):
            for bucket in (a, b):
                there = np.flatnonzero(self.table[bucket] == m)
                if len(there):
                    self.table[bucket, there[0]] = 0
                    self.n -= 1
                    break

    @classmethod
    def build(cls, digests: list[bytes]) -> CuckooFilter:
        capacity = max(16, len(digests))
        while not (made := cls(capacity)).insert(digests):
            capacity *= 2
        return made

    def to_bytes(self) -> bytes:
        return np.uint64(self.n).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.n = int(np.frombuffer(data, np.uint64, 1)[0])
        made.table = np.frombuffer(data, np.uint32, offset=8).reshape(-1, SLOTS).copy()
        return made


def key_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with each key: key binary, n long.  Counts are added up in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])
            counts.clear()
            return out

        for batch in (part for whole in batches for part in parts(whole, 0)):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                for key in set(map(digest, (text or b"").split(b"\n"))):
                    if key is not None:
                        counts[key] = counts.get(key, 0) + 1
                if len(counts) >= PARTIAL:
                    yield flush()
        if counts:
            yield flush()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _shard(shards: int) -> F.Column:
    return F.pmod(F.conv(F.hex(F.substring("key", 1, 3)), 16, 10).cast("int"), F.lit(shards))


@dataclass
class LineIndex:
    """Exact counts (key, n) and the cuckoo filter of each shard (shard, filter)."""

    counts: DataFrame
    filters: DataFrame
    min_docs: int = 10
    shards: int = 16

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, shards: int | None = None, text_col: str = "text") -> LineIndex:
        """``shards``: by default one for each SHARD_KEYS frequent keys, 16 at least; a task builds one shard's filter."""
        counts = durable(key_counts(docs, text_col), "line-counts")
        shards = shards or max(16, -(-counts.where(F.col("n") >= min_docs).count() // SHARD_KEYS))
        return cls(counts, durable(_changed_filters(counts.where(F.col("n") >= min_docs).select("key", F.lit(True).alias("added")), None, counts, min_docs, shards), "line-filters"), min_docs, shards)

    def _after(self, delta: DataFrame) -> LineIndex:
        both = self.counts.withColumn("d", F.lit(0).cast("bigint")).unionByName(delta.select("key", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("d")))
        merged = durable(both.groupBy("key").agg(F.sum("n").alias("was"), (F.sum("n") + F.sum("d")).alias("n")), "line-counts")
        crossed = merged.where((F.col("was") >= self.min_docs) != (F.col("n") >= self.min_docs)).select("key", (F.col("n") >= self.min_docs).alias("added"))
        counts = merged.where("n > 0").select("key", "n")
        return LineIndex(counts, durable(_changed_filters(crossed, self.filters, counts, self.min_docs, self.shards), "line-filters"), self.min_docs, self.shards)

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """The index with these documents added."""
        return self._after(key_counts(docs, text_col))

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """The index with these documents, inserted before, taken back: as if they had never been there."""
        return self._after(key_counts(docs, text_col).withColumn("n", -F.col("n")))

    def apply(self, docs: DataFrame, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """``docs`` with the text's frequent lines taken out, and n_lines (before), n_dropped; other columns stay.

        Input columns of those two names give way.  A null text comes back empty.  A very long text is split whole; repeated rows stay;
        an empty table stays empty.
        """
        docs = docs.drop("n_lines", "n_dropped")
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        if size <= broadcast_bytes:
            return self._by_filters(docs, text_col)
        return self._by_shards(docs, text_col)

    def _by_filters(self, docs: DataFrame, text_col: str) -> DataFrame:
        spark = docs.sparkSession
        filters, shards = {r.shard: CuckooFilter.from_bytes(bytes(r["filter"])) for r in self.filters.collect()}, self.shards
        sent = spark.sparkContext.broadcast((filters, frozenset()))

        def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([k for k, hit in zip(keys, _probe(sent.value[0], keys, shards), strict=True) if hit], pa.binary())], ["key"])

        # as many as the fingerprints' error lets through: about one in 10**8 infrequent keys
        exceptions = frozenset(bytes(r.key) for r in self.counts.where(F.col("n") < self.min_docs).select("key").mapInArrow(accepted, "key binary").toLocalIterator())
        sent = spark.sparkContext.broadcast((filters, exceptions))

        def dropped(keys: list[bytes]) -> np.ndarray:
            hits = _probe(sent.value[0], keys, shards)
            return hits & np.array([k not in sent.value[1] for k in keys], bool) if sent.value[1] and hits.any() else hits

        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in parts(whole, at)):
                lines = [(t or b"").split(b"\n") for t in batch.column(at).cast(pa.binary()).to_pylist()]
                keys = [digest(x) for doc in lines for x in doc]
                present = [k for k in keys if k is not None]
                drop = np.zeros(len(keys), bool)
                drop[[k is not None for k in keys]] = dropped(present)
                yield _rebuilt(batch, at, lines, drop)

        return docs.mapInArrow(run, _result_schema(docs, text_col))

    def _by_shards(self, docs: DataFrame, text_col: str) -> DataFrame:
        chunk, shards = fresh(docs, "chunk"), self.shards
        base = durable(docs.withColumn(chunk, F.expr(f"monotonically_increasing_id() div {CHUNK_ROWS}")), "line-docs")

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in parts(whole, 1)):
                keys: dict[int, set[bytes]] = {}
                for c, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    keys.setdefault(c, set()).update(k for line in (text or b"").split(b"\n") if (k := digest(line)))
                rows = []
                for c, own in keys.items():
                    own = sorted(own)
                    shard = _shard_of(own, shards)
                    rows += [(int(x), c, b"".join(own[i] for i in np.flatnonzero(shard == x))) for x in np.unique(shard)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["shard", "chunk", "keys"])

        asked = durable(base.select(chunk, F.col(text_col).cast("string")).mapInArrow(ask, "shard int, chunk bigint, keys binary"), "line-asked")
        most = asked.groupBy("shard").agg(F.sum(F.length("keys")).alias("n")).agg(F.max("n")).first()[0] or 0
        salts = max(1, -(-most // ASKED_BYTES))

        def accepted(key: tuple, asked: pa.Table, filters: pa.Table) -> pa.Table:
            found = []
            if filters.num_rows:
                known = CuckooFilter.from_bytes(filters.column("filter")[0].as_py())
                for c, data in zip(asked.column("chunk").to_pylist(), asked.column("keys").to_pylist(), strict=True):
                    own = [data[i : i + 16] for i in range(0, len(data), 16)]
                    found += [(c, own[i]) for i in np.flatnonzero(known.contains(own)).tolist()]
            return pa.table({"chunk": pa.array([c for c, _ in found], pa.int64()), "key": pa.array([k for _, k in found], pa.binary())})

        filters = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = asked.withColumn("salt", F.pmod("chunk", F.lit(salts)).cast("int"))
        probed = salted.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInArrow(accepted, "chunk bigint, key binary")
        gone = probed.join(self.counts.where(F.col("n") >= self.min_docs), "key", "left_semi").select(F.col("chunk").alias(chunk), "key")

        def run(rows: pa.Table, gone: pa.Table) -> pa.Table:
            known, out = set(gone.column("key").to_pylist()), []
            for batch in rows.drop_columns([chunk]).combine_chunks().to_batches():
                at = batch.schema.names.index(text_col)
                lines = [(t or b"").split(b"\n") for t in batch.column(at).cast(pa.binary()).to_pylist()]
                out.append(_rebuilt(batch, at, lines, np.array([digest(x) in known for doc in lines for x in doc], bool)))
            return pa.Table.from_batches(out)

        return base.groupBy(chunk).cogroup(gone.groupBy(chunk)).applyInArrow(run, _result_schema(docs, text_col))


def _result_schema(docs: DataFrame, text_col: str) -> str:
    return ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema) + ", n_lines bigint, n_dropped bigint"


def _shard_of(keys: list[bytes], shards: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)[:, :3].astype(np.int64)
    return (raw[:, 0] << 16 | raw[:, 1] << 8 | raw[:, 2]) % shards


def _probe(filters: dict[int, CuckooFilter], keys: list[bytes], shards: int) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    if not keys or not filters:
        return out
    shard = _shard_of(keys, shards)
    for s in np.unique(shard).tolist():
        if s in filters:
            at = np.flatnonzero(shard == s)
            out[at] = filters[s].contains([keys[i] for i in at.tolist()])
    return out


def _rebuilt(batch: pa.RecordBatch, at: int, lines: list[list[bytes]], drop: np.ndarray) -> pa.RecordBatch:
    texts, n, gone, first = [], [], [], 0
    for doc in lines:
        own = drop[first : first + len(doc)]
        first += len(doc)
        n.append(len(doc))
        gone.append(int(own.sum()))
        texts.append(b"\n".join(x for x, d in zip(doc, own.tolist(), strict=True) if not d) if gone[-1] else b"\n".join(doc))
    columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*batch.schema.names, "n_lines", "n_dropped"])


def _changed_filters(crossed: DataFrame, old: DataFrame | None, counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """The filters after the frequent set's changes; a shard whose filter overflows is built anew from the counts' keys.

    ``crossed``: key, added.  A task holds one shard's changed keys (choose ``shards`` so that they fit); untouched shards keep their filter.
    """
    spark = counts.sparkSession
    kept = old if old is not None else spark.createDataFrame([], "shard int, filter binary")
    changes = crossed.withColumn("shard", _shard(shards)).groupBy("shard")

    def run(key: tuple, changed: pa.Table, was: pa.Table) -> pa.Table:
        data = was.column("filter")[0].as_py() if was.num_rows else None
        sides = {True: [], False: []}
        for k, added in zip(changed.column("key").to_pylist(), changed.column("added").to_pylist(), strict=True):
            sides[added].append(k)
        added, gone = sorted(sides[True]), sorted(sides[False])
        if data is None:
            data = CuckooFilter.build(added).to_bytes()
        elif added or gone:
            made = CuckooFilter.from_bytes(data)
            made.delete(gone)
            data = made.to_bytes() if made.insert(added) else b""
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([data], pa.binary())})

    made = durable(changes.cogroup(kept.groupBy("shard")).applyInArrow(run, "shard int, filter binary"), "line-filters")
    full = [r.shard for r in made.where(F.length("filter") == 0).select("shard").collect()]
    if not full:
        return made
    again = counts.where(F.col("n") >= min_docs).select("key", F.lit(True).alias("added")).where(_shard(shards).isin(full))
    return made.where(F.length("filter") > 0).unionByName(_changed_filters(again, None, counts, min_docs, shards))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, text_col: str = "text", shards: int | None = None) -> DataFrame:
    """``docs`` without the lines whose key at least ``min_docs`` of them have, and n_lines, n_dropped."""
    return LineIndex.build(docs, min_docs, shards, text_col).apply(docs, text_col)
