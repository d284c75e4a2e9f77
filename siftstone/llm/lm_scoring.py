"""Cross-entropy difference: matched target and background bigram models over one vocabulary.

Counts cover all documents (the background) and, beside them, those of the target domain.  The shared vocabulary
holds every word that occurs ``LEAST`` times (others are one unknown word), the models every pair that does, other pairs back off to
single words.  The cut-off is a count, so vocabulary and pairs grow with the input; callers may raise it to a share of all tokens.

Both models use the same pairs and absolute discounting: P(w|h) = max(c(h,w) - D, 0) / c(h) + rest(h) P(w), where rest(h)
is what the discounted pairs leave, and P(w) has add-one smoothing.  A document's score is the mean over its tokens of
background loss minus target loss, in nats: the higher, the more like the target.

No table is sent to all tasks.  Texts become chunks of about ``CHUNK`` bytes.  A first look-up turns each chunk's distinct words,
64-bit fingerprints, into their numbers in the vocabulary; a pair is then one 64-bit integer.  A second one fetches what the models
know of the chunk's distinct words and pairs.  Questions and entries meet in buckets of the keys' hash, so a word that all
texts have is asked for once a chunk and no bucket is larger than others.

Keys travel in blocks: ascending, as byte planes, whose upper planes compress, with their values.  Partial counts are added up over
``HELD`` entries in each task before they are shuffled.  Both look-ups go in ``SLICES`` slices of the chunks, one
after the other, so that their questions and answers never lie on disk all at once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import durable, fits, free, ranked
from siftstone.llm.textscan import mix, parts, words

WORD_SHARE, PAIR_SHARE, LEAST = 0.0, 0.0, 2
DISCOUNT = 0.75
#: Bytes of text in a chunk, entries added up in a task, tokens for each bucket, slices of the chunks.
CHUNK, HELD, BUCKET, SLICES = 1 << 21, 1_500_000, 1_000_000, 4

#: Numbers of the unknown word and the start of a text; those of the vocabulary begin after them.
_UNKNOWN, _START, _SPECIAL = 0, 1, 2
#: In a pair's place of the second word: the history alone.
_ALONE = np.uint64(0xFFFFFFFF)


# --- blocks ------------------------------------------------------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """The bytes of an array, all first ones, then all second ones, and so on."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _values(data: bytes | memoryview, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _block(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Ascending 64-bit keys and a row of values for each."""
    return np.int64(len(keys)).tobytes() + _planes(keys) + _planes(values.T.reshape(-1))


def _opened(data: bytes, width: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return _values(memoryview(data)[8 : 8 + 8 * n], np.uint64), _values(memoryview(data)[8 + 8 * n :], dtype).reshape(width, n).T


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((mix(keys) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ascending ``keys`` by bucket, ascending inside it, and where each bucket begins."""
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(values[order], new, axis=0)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


_BLOCKS = "bucket int, data binary"


def _batch(bucket: list[int], data: list[bytes], **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "data": pa.array(data, pa.binary()), **more})


def _counts(chunks: DataFrame, count: Callable[[dict], tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """Blocks of the counts (in all documents, in target documents) that ``count`` finds in a chunk, added up in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, values = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            order, edge = _dealt(keys, buckets)
            there = np.flatnonzero(np.diff(edge)).tolist()
            return _batch(there, [_block(keys[order[edge[b] : edge[b + 1]]], values[order[edge[b] : edge[b + 1]]].astype(np.uint32)) for b in there])

        for row in _rows(batches):
            held.append(count(row))
            if sum(len(keys) for keys, _ in held) >= HELD:
                yield flush()
        if sum(len(keys) for keys, _ in held):
            yield flush()

    return chunks.select("names", "place", "at", "target").mapInArrow(run, _BLOCKS)


def _all_of(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all counts of a bucket."""
    keys, values = zip(*(_opened(data, 2, np.uint32) for data in blocks.column("data").to_pylist()), strict=True)
    return _summed(np.concatenate(keys), np.concatenate(values).astype(np.int64))


def _packed(entries: DataFrame, buckets: int, dtype: type) -> DataFrame:
    """``entries`` (key bigint, then values) as one block for each bucket."""
    names, width = entries.columns, len(entries.columns) - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(keys, buckets).astype(np.int32)), *batch.columns], ["bucket", *names])

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        keys = rows.column(names[0]).to_numpy().view(np.uint64)
        order = np.argsort(keys)
        values = np.stack([rows.column(c).to_numpy().astype(dtype) for c in names[1:]], axis=1)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([_block(keys[order], values[order].reshape(-1, width))], pa.binary())})

    kinds = ", ".join(f"{c} {kind}" for c, kind in entries.dtypes)
    return entries.mapInArrow(deal, f"bucket int, {kinds}").groupBy("bucket").applyInArrow(pack, _BLOCKS)


# --- chunks ------------------------------------------------------------------------------------------------------------


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about CHUNK bytes of text, cut or put together."""
    held, size = [], 0

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for part in (part for batch in batches for part in parts(batch, 1, CHUNK)):
        held.append(part)
        size += part.column(1).nbytes
        if size >= CHUNK:
            yield whole()
            held, size = [], 0
    if held:
        yield whole()


def _chunks(docs: DataFrame) -> DataFrame:
    """Chunks of ``docs`` (id, text, target): distinct words, each token's place among them, row offsets, ids, target rows."""
    kind = docs.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in _larger(batches):
            found, at = words(batch.column(1))
            values, place = np.unique(found, return_inverse=True)
            ids = pa.ListArray.from_arrays(pa.array([0, len(at) - 1], pa.int32()), batch.column(0))
            target = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            data = [pa.array([x], pa.binary()) for x in (_planes(values), _planes(place.astype(np.int32)), at.astype(np.int64).tobytes(), target.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), *data, ids], ["chunk", "names", "place", "at", "target", "ids"])
            chunk += 1

    return docs.mapInArrow(run, f"chunk bigint, names binary, place binary, at binary, target binary, ids array<{kind}>")


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names in ascending order, places, offsets, and for each token whether it is of a target text."""
    at = np.frombuffer(row["at"], np.int64)
    return _values(row["names"], np.uint64), _values(row["place"], np.int32), at, np.repeat(np.frombuffer(row["target"], bool), np.diff(at))


def _pairs(names: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct pairs in ascending order, places of their histories and words, and each token's pair."""
    before = np.empty(len(place), np.int64)
    before[1:] = place[:-1]
    before[at[:-1][at[:-1] < at[1:]]] = _START
    code, where = np.unique(before * len(names) + place, return_inverse=True)
    of, to = code // len(names), code % len(names)
    return names[of] << np.uint64(32) | names[to], of, to, where


def _word_counts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    names, place, _, target = _read(row)
    return names, np.stack([np.bincount(place, weights, len(names)) for weights in (None, target)], axis=1)


def _pair_counts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs, and of histories."""
    names, place, at, target = _read(row)
    keys, of, _, where = _pairs(names, place, at)
    n = np.stack([np.bincount(where, weights, len(keys)) for weights in (None, target)], axis=1)
    own = np.unique(of)
    alone = np.stack([np.bincount(of, n[:, k], len(names))[own] for k in (0, 1)], axis=1)
    return np.concatenate([keys, names[own] << np.uint64(32) | _ALONE]), np.concatenate([n, alone])


def _look_up(chunks: DataFrame, keys: Callable[[dict], dict[str, np.ndarray]], entries: dict[str, DataFrame], width: dict[str, int], dtype: type, buckets: int, then: Callable[[dict, dict], pa.Table], schema: str) -> DataFrame:
    """``then`` of each chunk and what ``entries`` have for its ``keys``: for each kind, which keys are there, and their values.

    ``keys``: by kind, ascending.  ``entries``: by kind, one block of ``width`` values for each bucket.
    """
    kinds, names = {name: k for k, name in enumerate(entries)}, list(entries)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            out = []
            for name, asked in keys(row).items():
                order, edge = _dealt(asked, buckets)
                out += [(kinds[name], b, _planes(asked[order[edge[b] : edge[b + 1]]])) for b in np.flatnonzero(np.diff(edge)).tolist()]
            kind, bucket, data = zip(*out, strict=True) if out else ((), (), ())
            yield _batch(bucket, data, kind=pa.array(kind, pa.int32()), chunk=pa.array([row["chunk"]] * len(out), pa.int64()))

    def answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        own = width[names[key[0].as_py()]]
        has, value = _opened(known.column("data")[0].as_py(), own, dtype) if known.num_rows else (np.zeros(0, np.uint64), np.zeros((0, own), dtype))
        out = []
        for data in asked.column("data").to_pylist():
            wanted = _values(data, np.uint64)
            at = np.minimum(np.searchsorted(has, wanted), max(len(has) - 1, 0))
            hit = has[at] == wanted if len(has) else np.zeros(len(wanted), bool)
            out.append(np.packbits(hit).tobytes() + _planes(value[at[hit]].T.reshape(-1)))
        return asked.select(["bucket", "kind", "chunk"]).append_column("data", pa.array(out, pa.binary()))

    def gather(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = chunk.to_pylist()
        asked = keys(row)
        dealt = {name: _dealt(x, buckets) for name, x in asked.items()}
        found = {name: (np.zeros(len(x), bool), np.zeros((len(x), width[name]), dtype)) for name, x in asked.items()}
        for kind, b, data in zip(*(answers.column(x).to_pylist() for x in ("kind", "bucket", "data")), strict=True):
            order, edge = dealt[names[kind]]
            own, bits = order[edge[b] : edge[b + 1]], (edge[b + 1] - edge[b] + 7) // 8
            hit = np.unpackbits(np.frombuffer(data, np.uint8, bits), count=len(own)).astype(bool)
            there, value = found[names[kind]]
            there[own] = hit
            value[own[hit]] = _values(memoryview(data)[bits:], dtype).reshape(width[names[kind]], -1).T
        return then(row, found)

    asked = chunks.select("chunk", "names", "place", "at").mapInArrow(ask, f"{_BLOCKS}, kind int, chunk bigint")
    known = None
    for name, df in entries.items():
        part = df.select(F.lit(kinds[name]).alias("kind"), "bucket", "data")
        known = part if known is None else known.unionAll(part)
    answers = asked.groupBy("kind", "bucket").cogroup(known.groupBy("kind", "bucket")).applyInArrow(answer, "bucket int, kind int, chunk bigint, data binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(gather, schema)


def with_target(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with target boolean: whether the id is among ``target_ids`` (one column).  Null ids are no target."""
    ids = durable(target_ids.toDF(id_col).where(F.col(id_col).isNotNull()).distinct().withColumn("target", F.lit(True)), "target-ids")
    return docs.join(F.broadcast(ids) if fits(ids) else ids, id_col, "left").withColumn("target", F.coalesce("target", F.lit(False)))


def _in_vocabulary(chunks: DataFrame, numbers: DataFrame, buckets: int) -> DataFrame:
    """``chunks`` with the numbers of their words (blocks of fingerprint, number), the unknown word and the start as names."""

    def keys(row: dict) -> dict[str, np.ndarray]:
        return {"words": _values(row["names"], np.uint64)}

    def then(row: dict, found: dict) -> pa.Table:
        there, number = found["words"]
        names, place = np.unique(np.concatenate([[_UNKNOWN, _START], np.where(there, number[:, 0], _UNKNOWN)]).astype(np.uint64), return_inverse=True)
        row["names"], row["place"] = _planes(names), _planes(place[2:][_values(row["place"], np.int32)].astype(np.int32))
        return pa.Table.from_pylist([row], schema=shape)

    shape = pa.schema([("chunk", pa.int64()), *((x, pa.binary()) for x in ("names", "place", "at", "target")), ("ids", _arrow(chunks))])
    schema = f"chunk bigint, names binary, place binary, at binary, target binary, ids {chunks.schema['ids'].dataType.simpleString()}"
    return _look_up(chunks, keys, {"words": numbers}, {"words": 1}, np.uint32, buckets, then, schema)


def _arrow(chunks: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(chunks.schema["ids"].dataType)


def _kept_pairs(counts: DataFrame, least: int) -> DataFrame:
    """From blocks of counts, one block for each bucket: the kept pairs, and all histories."""

    def run(key: tuple, blocks: pa.Table) -> pa.Table:
        keys, values = _all_of(blocks)
        keep = (values[:, 0] >= least) | (keys & _ALONE == _ALONE)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([_block(keys[keep], values[keep].astype(np.float32))], pa.binary())})

    return counts.groupBy("bucket").applyInArrow(run, _BLOCKS)


def _histories(pairs: DataFrame) -> DataFrame:
    """(key, n, t, kn, kt) of each history: its counts, and those of its kept pairs less the discount."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            keys, values = _opened(row["data"], 2, np.float32)
            alone = (keys & _ALONE == _ALONE)[:, None]
            four = np.concatenate([np.where(alone, values, 0), np.where(alone, 0, np.maximum(values - DISCOUNT, 0))], axis=1).astype(np.float64)
            history, sums = _summed(keys >> np.uint64(32), four) if len(keys) else (keys, four)
            yield pa.RecordBatch.from_arrays([pa.array(history.view(np.int64)), *(pa.array(sums[:, k]) for k in range(4))], ["key", "n", "t", "kn", "kt"])

    found = pairs.select("data").mapInArrow(run, "key bigint, n double, t double, kn double, kt double")
    return found.groupBy("key").agg(*(F.sum(x).alias(x) for x in ("n", "t", "kn", "kt")))


def _word_entries(known: DataFrame, histories: DataFrame, totals: np.ndarray) -> DataFrame:
    """(key, ...) of words, the unknown one and the start: log P(w) in both models, counts as a history, what the kept pairs leave of it."""
    inside = known.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    below = [int(x) + inside.k + 1 for x in totals]
    rest = [float(np.log((total - (seen or 0) + 1) / b)) for total, seen, b in zip(totals, (inside.n, inside.t), below, strict=True)]
    special = known.sparkSession.createDataFrame([(_UNKNOWN, *rest), (_START, 0.0, 0.0)], "key bigint, a double, b double")
    words = known.select("key", F.log((F.col("n") + 1) / below[0]).alias("a"), F.log((F.col("t") + 1) / below[1]).alias("b")).unionAll(special)
    left = [F.when(F.col(x) > 0, F.greatest(1 - F.col(f"k{x}") / F.col(x), F.lit(0.0))).otherwise(1.0).alias(f"left_{x}") for x in "nt"]
    return words.join(histories, "key", "left").select("key", "a", "b", *(F.coalesce(x, F.lit(0.0)).alias(x) for x in "nt"), *left)


def _asked(row: dict) -> dict[str, np.ndarray]:
    names, place, at = _values(row["names"], np.uint64), _values(row["place"], np.int32), np.frombuffer(row["at"], np.int64)
    return {"words": names, "pairs": _pairs(names, place, at)[0]}


def _losses(row: dict, found: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean loss per token of each text under both models (2 x rows), and the numbers of tokens."""
    names, place, at, _ = _read(row)
    _, of, to, where = _pairs(names, place, at)
    there, count = found["pairs"]
    word, seen, left = np.split(found["words"][1].astype(np.float64), 3, axis=1)
    word, seen, left = word[to], seen[of], left[of]
    share = np.maximum(count.astype(np.float64) - DISCOUNT, 0) / np.maximum(seen, 1)
    backed = np.log(np.maximum(left, 1e-9)) + word
    value = np.where(there[:, None], np.log(np.maximum(share + left * np.exp(word), 1e-300)), backed)
    n = np.diff(at)
    sums = np.concatenate([np.zeros((1, 2)), np.cumsum(value[where], axis=0)])
    return -((sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)[:, None]).T, n


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", word_share: float = WORD_SHARE, pair_share: float = PAIR_SHARE) -> DataFrame:
    """Fits both models on ``docs``, the target one on those with an id in ``target_ids``, and scores every document.

    One row for each row of ``docs``: id, n_tokens, background_loss, target_loss, score.  A text without words, a null one too, has no
    tokens and 0 for the rest.  Rows that share an id are scored each with its own text, and are target rows together.  A very long
    text is a chunk of its own, read whole.  Other columns, whatever their names, are not read; an empty table gives an empty result,
    an empty target a target model of no counts.  The vocabulary has at most 2**32 words.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = durable(_chunks(with_target(plain, target_ids, "id").select("id", "text", "target")), "text-chunks", "zstd")
    rough = texts.agg(F.sum(F.length("place")).alias("bytes")).first().bytes or 0  # four for each token
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rough // (4 * BUCKET)))

    def words_of(key: tuple, blocks: pa.Table) -> pa.Table:
        keys, values = _all_of(blocks)
        return pa.table({"word": keys.view(np.int64), "n": values[:, 0], "t": values[:, 1]})

    unigrams = durable(_counts(texts, _word_counts, buckets).groupBy("bucket").applyInArrow(words_of, "word bigint, n bigint, t bigint"), "word-counts", "zstd")
    sums = unigrams.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    totals = np.array([sums.n or 0, sums.t or 0])
    least = lambda share: max(LEAST, int(np.ceil(share * totals[0])))
    known = ranked(unigrams.where(F.col("n") >= least(word_share)), [F.desc("n"), F.asc("word")], "vocabulary", "key", _SPECIAL)
    if (known.agg(F.max("key")).first()[0] or 0) >= int(_ALONE):
        raise ValueError("more than 2**32 words")
    numbers = durable(_packed(known.select("word", "key"), buckets, np.uint32), "word-numbers", "zstd")
    slices = max(1, min(SLICES, -(-int(totals[0]) // (4 * BUCKET))))
    slice_ = F.pmod(F.xxhash64("chunk"), F.lit(slices))
    chunks = [durable(_in_vocabulary(texts.where(slice_ == k), numbers, buckets), "known-chunks", "zstd") for k in range(slices)]
    free(texts, unigrams, numbers)
    pairs = durable(_kept_pairs(_counts(functools.reduce(DataFrame.unionAll, chunks), _pair_counts, buckets), least(pair_share)), "pair-counts", "zstd")
    words = durable(_packed(_word_entries(known, _histories(pairs), totals), buckets, np.float32), "word-entries", "zstd")

    def then(row: dict, found: dict) -> pa.Table:
        (background, target), n = _losses(row, found)
        return pa.table([pa.array(row["ids"], kind), *map(pa.array, (n.astype(np.int64), background, target, background - target))], [id_col, "n_tokens", "background_loss", "target_loss", "score"])

    kind = _arrow(texts).value_type
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, background_loss double, target_loss double, score double"
    scores = []
    for some in chunks:
        scores.append(durable(_look_up(some, _asked, {"words": words, "pairs": pairs}, {"words": 6, "pairs": 2}, np.float32, buckets, then, schema), "scores"))
        free(some)
    free(pairs, words, known)
    return functools.reduce(DataFrame.unionAll, scores)
