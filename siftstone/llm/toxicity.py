"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

1. Features are words and word beginnings of 4 to 6 bytes, as 64-bit fingerprints.  All that at least ``LEAST`` unlike toxic texts
   of the sample have, and that are ``ODDS`` times (as a logarithm) as frequent there as in clean ones, form the lexicon.
2. Voters: the lexicon dealt out to several lexicon voters for each kind of feature, pattern voters (shouting, exclamation
   runs, repeated words), and one voter that calls texts without any lexicon feature clean.  Every other voter abstains
   where it finds nothing.  A given label is one more noisy voter.
3. The label model treats the true class as hidden.  Expectation maximisation estimates how often each voter votes what
   in each class; the correlations of the voters within a class, estimated alike, divide the weight of voters that
   repeat each other.  It gives each sampled text a posterior.
4. A logistic regression on lexicon features and patterns learns those posteriors, weighted back to the true
   shares of the classes.  It alone scores texts.

The models are fitted on at most ``MOST_TOXIC`` + ``MOST_CLEAN`` labelled ids, those with the smallest hash, with one text each; class
shares count all labels.  These two parameters are the only bounds.  Scoring reads every whole text and nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import durable, free
from siftstone.llm.textscan import fingerprints, mix, parts, shingles, spans, text_bytes, words

#: Bounds of the training sample; what makes a feature one of the lexicon.
MOST_TOXIC, MOST_CLEAN = 4000, 8000
LEAST, ODDS = 3, 2.0
KINDS = (None, 4, 5, 6)  # a whole word, or its first bytes
DEALT = 4
PATTERNS = ("shouting", "exclamations", "repetition", "no_lexicon")

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All feature fingerprints of a text column with the row of each, and the pattern signals of each row."""
    data, offsets = text_bytes(column)
    starts, ends = spans(_WORD[data], offsets)
    rows = np.searchsorted(offsets, starts, "right") - 1
    found, where = [], []
    for k, size in enumerate(KINDS):
        if size is None:
            found.append(mix(fingerprints(data, starts, ends)))
            where.append(rows)
        else:
            longer = ends - starts > size
            found.append(mix(fingerprints(data, starts[longer], starts[longer] + size) + np.uint64(k)))
            where.append(rows[longer])
    n = np.maximum(np.bincount(rows, minlength=len(offsets) - 1), 1)
    length = np.maximum(np.diff(offsets), 1)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    capitals = sums((data >= 0x41) & (data <= 0x5A)) / length
    marks = sums(data == 0x21) / n
    same = np.zeros(len(starts), bool)
    if len(starts) > 1:
        same[1:] = (found[0][1:] == found[0][:-1]) & (rows[1:] == rows[:-1])
    repeated = np.bincount(rows, weights=same, minlength=len(offsets) - 1) / n
    return np.concatenate(found), np.concatenate(where), np.stack([capitals > 0.3, marks > 0.1, repeated > 0.3], axis=1)


@dataclass(frozen=True)
class Hits:
    """Which of a sorted array of fingerprints the rows of a column have, each once."""

    known: np.ndarray
    _gate: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        gate = np.zeros(1 << 16, bool)
        gate[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True
        object.__setattr__(self, "_gate", gate)

    def of(self, found: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known) or not len(found):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self._gate[(found & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, found[maybe]), len(self.known) - 1)
        real = self.known[at] == found[maybe]
        pairs = np.unique(rows[maybe[real]] * len(self.known) + at[real])
        return pairs // len(self.known), pairs % len(self.known)


@dataclass(frozen=True)
class LabelModel:
    """P(vote | class) of each voter for votes -1, 0, 1 in classes 0 and 1, the classes' shares, and the voters' weights."""

    table: np.ndarray
    shares: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1) for each row of votes."""
        ratio = np.log(self.table[:, 1, :]) - np.log(self.table[:, 0, :])
        total = np.log(self.shares[1] / self.shares[0]) + (ratio[np.arange(votes.shape[1]), votes + 1] * self.weight).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, row_weight: np.ndarray, rounds: int = 25) -> LabelModel:
    """Expectation maximisation from the posteriors ``start``, whose class shares hold; rows count by ``row_weight``."""
    posterior = start
    share = (row_weight @ start) / row_weight.sum()
    for _ in range(rounds):
        by_class = np.stack([row_weight * (1 - posterior), row_weight * posterior])
        mass = by_class.sum(axis=1) + 1e-9
        table = np.stack([np.stack([(by_class[:, votes[:, j] == v].sum(axis=1) + 0.1) / (mass + 0.3) for v in (-1, 0, 1)], axis=1) for j in range(votes.shape[1])])
        table /= table.sum(axis=2, keepdims=True)
        centred = [votes - (by_class[c] @ votes) / mass[c] for c in (0, 1)]
        covariance = sum((centred[c] * by_class[c][:, None]).T @ centred[c] for c in (0, 1))
        scale = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
        correlation = covariance / np.outer(scale, scale)
        np.fill_diagonal(correlation, 0)
        model = LabelModel(table, np.array([1 - share, share]), 1 / (1 + np.clip(correlation, 0, None).sum(axis=1)), correlation)
        new = model.posterior(votes)
        if np.abs(new - posterior).max() < 1e-4:
            break
        posterior = new
    return model


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted lexicon fingerprints, a weight for each and for each pattern, and the bias; ``labels`` is what it learnt from."""

    lexicon: np.ndarray
    weights: np.ndarray
    bias: float
    labels: LabelModel | None = None

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(column))
        found, rows, patterns = features(column)
        row, which = Hits(self.lexicon).of(found, rows)
        total = self.bias + np.bincount(row, weights=self.weights[which], minlength=len(column))[: len(column)]
        return 1 / (1 + np.exp(-np.clip(total + patterns @ self.weights[len(self.lexicon) :], -30, 30)))


def learnable(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be learnt from: crc32(id as text) mod 4 is not 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def _regression(rows: np.ndarray, cols: np.ndarray, n: int, d: int, target: np.ndarray, weight: np.ndarray, l2: float = 1.0, steps: int = 2000) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on a sparse 0/1 matrix, by accelerated gradient descent until the gradient is next to nothing.

    Steps are divided by a diagonal that bounds the curvature: a row adds to each of its features a quarter of its weight for each of its
    entries, the bias included.  Momentum begins anew where it leads uphill.
    """
    w, b = np.zeros(d), float(np.log((weight @ target + 1e-6) / (weight @ (1 - target) + 1e-6)))
    share = 0.25 * weight * (np.bincount(rows, minlength=n) + 1)
    scale, bias_scale = np.bincount(cols, weights=share[rows], minlength=d) + l2, share.sum() + 1e-9
    w_old, b_old, t = w, b, 0
    for _ in range(steps):
        momentum = t / (t + 3)
        y, c = w + momentum * (w - w_old), b + momentum * (b - b_old)
        p = 1 / (1 + np.exp(-np.clip(c + np.bincount(rows, weights=y[cols], minlength=n), -30, 30)))
        error = weight * (p - target)
        slope, bias_slope = np.bincount(cols, weights=error[rows], minlength=d) + l2 * y, error.sum()
        w_old, b_old = w, b
        w, b = y - slope / scale, c - bias_slope / bias_scale
        if max(np.abs(slope).max(initial=0), abs(bias_slope)) < 1e-6 * weight.sum():
            break
        t = 0 if slope @ (w - w_old) + bias_slope * (b - b_old) > 0 else t + 1
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> ToxicityModel:
    """Learns from the labelled rows; several labels of one id count as toxic if one does, null labels and ids not at all.

    Of rows that share an id the text with the smallest hash is learnt from.  Ties among ids of one hash go by the id.  An empty table,
    or one without labels of both classes, gives a model without a lexicon.  Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    given = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    totals = {r.y: r.n for r in given.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    if not totals.get(1) or not totals.get(0):
        return nothing
    pick = lambda y, most: given.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # noqa: E731  bounded by the parameters
    picked = docs.join(F.broadcast(pick(1, most_toxic).unionByName(pick(0, most_clean))), "doc_id")
    sample = durable(picked.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "toxic-sample")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, 0)):
            found, rows, _ = features(batch.column(0))
            pairs = np.unique(np.rec.fromarrays([found, alike(batch.column(0)).view(np.uint64)[rows]])) if len(found) else np.zeros(0, [("f0", np.uint64), ("f1", np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[c].view(np.int64).copy()) for c in ("f0", "f1")], ["feature", "alike"])

    # copies count once: a feature is frequent by the number of unlike texts that have it
    seen = sample.where("y = 1").select("text").mapInArrow(occurrences, "feature bigint, alike bigint").distinct()
    frequent = seen.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).select("feature")
    candidates = np.sort(frequent.toArrow().column(0).to_numpy().view(np.uint64))
    present = sample.select("y", "text").mapInArrow(present_in(spark.sparkContext.broadcast(candidates)), _PRESENT)
    by_class = present.select("y", "alike", F.explode("which").alias("i")).distinct().groupBy("i").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    counted = by_class.toArrow()  # a row for each candidate at most
    sizes = {r.y: r.n for r in present.groupBy("y").agg(F.countDistinct("alike").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        free(sample)
        return nothing
    which, t, c = (counted.column(x).to_numpy() for x in ("i", "t", "c"))
    odds = np.log((t + 0.5) / (n1 + 1)) - np.log((c + 0.5) / (n0 + 1))
    lexicon = candidates[np.sort(which[(odds > ODDS) & (t >= LEAST)])]

    got = sample.select("y", "text").mapInArrow(present_in(spark.sparkContext.broadcast(lexicon)), _PRESENT).collect()  # bounded by the parameters
    free(sample)
    y = np.array([r.y for r in got])
    rows = np.repeat(np.arange(len(got)), [len(r.which) for r in got])
    cols = np.array([i for r in got for i in r.which], np.int64)
    patterns = np.array([[r.patterns >> k & 1 for k in range(3)] for r in got])
    voter = mix(lexicon).astype(np.int64) % (DEALT * len(KINDS)) if len(lexicon) else np.zeros(0, np.int64)
    votes = np.zeros((len(got), DEALT * len(KINDS) + len(PATTERNS) + 1), np.int64)
    votes[rows, voter[cols]] = 1
    votes[:, -5:-2] = patterns
    votes[:, -2] = np.where(np.bincount(rows, minlength=len(got)) == 0, -1, 0)
    votes[:, -1] = np.where(y == 1, 1, -1)
    share = totals[1] / (totals[0] + totals[1])
    _, group, copies = np.unique([r.alike for r in got], return_inverse=True, return_counts=True)
    weight = 1 / copies[group]
    weight *= np.where(y == 1, share / weight[y == 1].sum(), (1 - share) / weight[y == 0].sum()) * (n0 + n1)
    labelled = fit_label_model(votes, np.where(y == 1, 0.95, 0.05), weight)
    target = labelled.posterior(votes)
    at = np.nonzero(patterns)
    w, b = _regression(np.concatenate([rows, at[0]]), np.concatenate([cols, len(lexicon) + at[1]]), len(got), len(lexicon) + 3, target, weight)
    return ToxicityModel(lexicon, w, b, labelled)


_PRESENT = "y int, alike bigint, which array<int>, patterns int"


def alike(column: pa.Array) -> np.ndarray:
    """A key that copies and most near copies of a text share: the least fingerprint of its runs of three words."""
    found, at = words(column)
    return np.array([shingles(found[a:b], 3).min(initial=2**64 - 1) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64).view(np.int64)


def present_in(sent):  # noqa: ANN001, ANN201  a broadcast of sorted fingerprints
    """For mapInArrow over (y, text): which of the fingerprints each text has, and its patterns as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(sent.value)
        for batch in (part for whole in batches for part in parts(whole, 1)):
            found, rows, patterns = features(batch.column(1))
            row, which = hits.of(found, rows)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(which, pa.int32()))
            columns = [batch.column(0), pa.array(alike(batch.column(1))), lists, pa.array(patterns @ np.array([1, 2, 4]), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["y", "alike", "which", "patterns"])

    return run


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher for likelier toxic; other columns stay, one of the score's name gives way.

    A null text scores as an empty one, a very long one whole; repeated rows score alike, and an empty table stays empty.  A model
    that had no toxic or no clean label to learn from scores everything 0.
    """
    docs = docs.drop(score_col)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{score_col}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, at)):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(batch.column(at)))], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, schema)
