"""Token ids as compressed binary files with a shared dictionary and random access to single documents.

A file image holds, little-endian: the magic ``SFTK``, version and id width (u16 each), number of documents (u64),
SHA-256 of the shared zstandard dictionary (32 bytes, zeros without one), the kind of doc_id (u8: 0 integer, 1 text), then per
document a null flag (u8), doc_id (i64; or for texts u64 ends, one more value than documents, and their UTF-8 bytes), the tokens before
it in the image (u64, one more value than documents) and the payload offset (u64, one more), and last the payloads: each
document's ids, compressed on their own.  One document is read by its index entry and the dictionary alone.

Images are rows of a table in the shared folder, each bounded by ``image_bytes`` of payload or one document: every
executor can write them through any store Spark can reach.  ``export`` puts single images into plain files.

Documents are encoded and compressed where they are read and written as a table of payloads; these are dealt out to tasks by
ranges of (doc_id, digest of the text, row), of about ``PART_BYTES`` of payload each.  So neither an id that most rows share nor null ids nor
equal rows meet in one task.  The dictionary is trained on the whole ids of a bounded sample of documents (``sample_docs``).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from siftstone.llm.bpe import Codec, Worker
from siftstone.llm.common import durable, free, sampled
from siftstone.llm.textscan import parts

MAGIC, VERSION = b"SFTK", 2
_HEAD = struct.Struct("<4sHHQ32sB")

#: Bounds of the dictionary: documents it is trained on, its size; ids of a longer document are several samples of SAMPLE_BYTES.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 1 << 14, 1 << 16
#: Payload of an image, and of the range of one task.
IMAGE_BYTES, PART_BYTES = 1 << 20, 16 << 20
LEVEL = 1


@dataclass(frozen=True)
class Dictionary:
    """A shared dictionary; empty data means that none could be trained."""

    data: bytes

    @property
    def hash(self) -> bytes:
        return hashlib.sha256(self.data).digest() if self.data else bytes(32)

    def _zstd(self) -> zstandard.ZstdCompressionDict | None:
        return zstandard.ZstdCompressionDict(self.data) if self.data else None

    def compressor(self) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=self._zstd(), write_checksum=False, write_dict_id=False)

    def decompressor(self) -> zstandard.ZstdDecompressor:
        return zstandard.ZstdDecompressor(dict_data=self._zstd())


def train(samples: list[bytes]) -> Dictionary:
    """A dictionary from serialized id arrays; too few samples give none."""
    samples = [s for s in samples if len(s) >= 8]
    if sum(map(len, samples)) < 20_000 or len(samples) < 16:
        return Dictionary(b"")
    try:
        return Dictionary(zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes())
    except zstandard.ZstdError:  # all samples alike, for instance
        return Dictionary(b"")


def image(doc_ids: list, payloads: list[bytes], counts: list[int], width: int, dictionary_hash: bytes, text_ids: bool = False) -> bytes:
    """A file image."""
    n = len(doc_ids)
    if text_ids:
        spelt = [(i or "").encode() for i in doc_ids]
        ids = [np.cumsum([0, *map(len, spelt)], dtype="<u8").tobytes(), *spelt]
    else:
        ids = [np.array([i or 0 for i in doc_ids], "<i8").tobytes()]
    return b"".join([
        _HEAD.pack(MAGIC, VERSION, width, n, dictionary_hash, text_ids),
        np.array([i is None for i in doc_ids], "u1").tobytes(),
        *ids,
        np.cumsum([0, *counts], dtype="<u8").tobytes(),
        np.cumsum([0, *map(len, payloads)], dtype="<u8").tobytes(),
        *payloads,
    ])


class Image:
    """Random access to the documents of a file image."""

    def __init__(self, data: bytes, dictionary: Dictionary) -> None:
        magic, version, self.width, n, found, text_ids = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        if found != dictionary.hash:
            raise ValueError("this file needs another dictionary")
        self.data, self._decompressor, self._at = memoryview(data), dictionary.decompressor(), _HEAD.size
        self.null = self._take("u1", n)
        if text_ids:
            ends = self._take("<u8", n + 1).tolist()
            spelt = bytes(self._take("u1", ends[-1]))
            self.doc_ids = [spelt[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        else:
            self.doc_ids = self._take("<i8", n).tolist()
        self.tokens_before, self.offsets = self._take("<u8", n + 1), self._take("<u8", n + 1)
        self.start = self._at

    def _take(self, kind: str, n: int) -> np.ndarray:
        values = np.frombuffer(self.data, kind, n, self._at)
        self._at += values.nbytes
        return values

    def __len__(self) -> int:
        return len(self.doc_ids)

    def doc_id(self, k: int) -> int | str | None:
        return None if self.null[k] else self.doc_ids[k]

    def ids(self, k: int) -> np.ndarray:
        """The ids of document number ``k`` of the image."""
        a, b = self.start + int(self.offsets[k]), self.start + int(self.offsets[k + 1])
        return np.frombuffer(self._decompressor.decompress(self.data[a:b]), f"<u{self.width}")


@dataclass(frozen=True)
class TokenFiles:
    """The written images (part, image, n_docs, n_tokens, tokens_before, data) and the dictionary.  ``parts`` has the ids before each part."""

    images: DataFrame
    dictionary: Dictionary
    parts: DataFrame
    id_type: str

    def documents(self) -> DataFrame:
        """Each document as the files have it: doc_id, start, n_tokens, ids_crc32 (ids as unsigned 32-bit integers)."""
        sent = self.images.sparkSession.sparkContext.broadcast(self.dictionary)
        kind = pa.string() if self.id_type == "string" else pa.int64()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    got = Image(data, sent.value)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([got.doc_id(k) for k in range(len(got))], kind),
                        pa.array(got.tokens_before[:-1].astype(np.int64) + first, pa.int64()),
                        pa.array(np.diff(got.tokens_before.astype(np.int64)), pa.int64()),
                        pa.array([zlib.crc32(got.ids(k).astype("<u4").tobytes()) for k in range(len(got))], pa.int64()),
                    ], ["doc_id", "start", "n_tokens", "ids_crc32"])

        placed = self.images.join(F.broadcast(self.parts), "part").select(F.col("before") + F.col("tokens_before"), "data")
        wide = "string" if self.id_type == "string" else "bigint"
        return placed.mapInArrow(run, f"doc_id {wide}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumn("doc_id", F.col("doc_id").cast(self.id_type))

    def export(self, folder: str, limit: int) -> list[str]:
        """Up to ``limit`` images as plain files beside the dictionary, in a folder of the driver's machine."""
        with open(f"{folder}/dictionary.zstd", "wb") as file:
            file.write(self.dictionary.data)
        names = []
        for row in self.images.select("part", "image", "data").orderBy("part", "image").limit(limit).toLocalIterator():
            names.append(f"{folder}/tokens-{row.part:05d}-{row.image:06d}.sftk")
            with open(names[-1], "wb") as file:
                file.write(row.data)
        return names


def write(docs: DataFrame, codec: Codec, end_id: int, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, image_bytes: int = IMAGE_BYTES, part_bytes: int = PART_BYTES) -> TokenFiles:
    """Encodes every whole text, appends ``end_id`` and writes images in ascending doc_id order, nulls first.

    Rows that share an id stand in order of a digest of their texts, so the files do not depend on partitions; equal rows are alike.  A
    null text is empty: its document is the end id alone.  A very long text is one payload, in an image of its own.  An empty table gives
    no images.  Ids are integers or texts and keep their type; other columns, whatever their names, are dropped.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    if not isinstance(kind, (IntegralType, StringType)):
        raise TypeError(f"ids are integers or texts, not {kind.simpleString()}")
    text_ids = isinstance(kind, StringType)
    wide = "string" if text_ids else "bigint"
    docs = docs.select(F.col(id_col).cast(wide).alias("doc_id"), F.col(text_col).alias("text"))
    spec = spark.sparkContext.broadcast(codec)
    end = np.array([end_id], codec.dtype).tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Worker.of(spec.value)
        for batch in (part for whole in batches for part in parts(whole, 0)):
            ids = [(worker.encode(t) if t else b"") + end for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([i[k : k + SAMPLE_BYTES] for i in ids for k in range(0, len(i), SAMPLE_BYTES)], pa.binary())], ["ids"])

    sample = sampled(docs, sample_docs).mapInArrow(packed, "ids binary")
    dictionary = train(sorted(bytes(r.ids) for r in sample.toLocalIterator()))
    sent = spark.sparkContext.broadcast((codec, dictionary))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, dictionary = sent.value
        worker, compress = Worker.of(codec), dictionary.compressor().compress
        for batch in (part for whole in batches for part in parts(whole, 1)):
            ids = [(worker.encode(t) if t else b"") + end for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([len(i) // codec.width for i in ids], pa.int64()), pa.array(list(map(compress, ids)), pa.binary()),
            ], ["doc_id", "digest", "n_tokens", "payload"])
        worker.rest()

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, dictionary = sent.value
        part, number, before, size, held = TaskContext.get().partitionId(), 0, 0, 0, ([], [], [])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, before, size
            if held[0]:
                tokens = sum(held[1])
                data = image(held[0], held[2], held[1], codec.width, dictionary.hash, text_ids)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (number, pa.int32()), (len(held[0]), pa.int64()), (tokens, pa.int64()), (before, pa.int64()), (data, pa.binary()))], ["part", "image", "n_docs", "n_tokens", "tokens_before", "data"])
                number, before, size = number + 1, before + tokens, 0
                for x in held:
                    x.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size + len(row[2]) > image_bytes:
                    yield from flush()
                for x, y in zip(held, row, strict=True):
                    x.append(y)
                size += len(row[2])
        yield from flush()

    payloads = durable(docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(encoded, f"doc_id {wide}, digest bigint, n_tokens bigint, payload binary").withColumn("row", F.monotonically_increasing_id()), "token-payloads")
    size = payloads.agg(F.sum(F.length("payload")).alias("n")).first().n or 0
    order = [F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("row")]
    dealt = payloads.repartitionByRange(max(1, -(-size // part_bytes)), *order).sortWithinPartitions(*order)
    written = durable(dealt.select("doc_id", "n_tokens", "payload").mapInArrow(images, "part int, image int, n_docs bigint, n_tokens bigint, tokens_before bigint, data binary"), "token-files")
    free(payloads)
    # a row for each range of payloads
    found, total = [], 0
    for part, n in sorted((r.part, r.n) for r in written.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        found.append((part, total))
        total += n
    return TokenFiles(written, dictionary, spark.createDataFrame(found, "part int, before bigint"), kind.simpleString())
