"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

1. One scan gives each text's set of word shingles (64-bit fingerprints), the set's 128-bit digest, its one-permutation
   MinHash of ``bins`` bins (an empty bin borrows from a bin that a hash sequence of its own picks: optimal densification)
   and from it band keys, of as many bins each as ``similarity`` allows (``band_rows``).  Equal sets become one class, so exact copies never meet as pairs.
2. Classes that share a band key meet in a bucket.  Each bucket has a hub, the member whose buckets are the largest in sum,
   and only the edges from hub to members become candidates: as many as the bucket has members, whatever its size.  Candidates
   are confirmed on the full sets.
3. A star alone can lose a link between two members that the hub has no link with.  So the members of buckets that still
   hold more than one component are compared on their full sets, within tasks of two blocks each; what leaves a task is no
   pair list but the few links that join its components.  A link counts if its ends share a bucket, however the members are
   dealt out, so results do not depend on sizes.  No bucket is capped.

With 200 bins in bands of 5, as for 0.8, two sets of that similarity share no bucket with a probability of about 10**-7.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import durable, fits, free
from siftstone.llm.components import components
from siftstone.llm.textscan import mix, parts, shingles, words

BINS, MISSED = 200, 1e-6
#: Members in a block while a group has at most BLOCKS of them, bytes of sets in one beyond that; regions of more members are dealt out by bucket.
BLOCK, BLOCKS, BLOCK_BYTES, REGION = 128, 64, 16 << 20, 20_000


@functools.lru_cache
def _detours(bins: int) -> np.ndarray:
    """For each bin, the sequence of bins it borrows from when empty, fixed for all texts; every bin comes up."""
    own = np.arange(1, bins + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    random = (mix(own + np.arange(1, 4 * bins + 1, dtype=np.uint64)) % np.uint64(bins)).astype(np.int64)
    return np.concatenate([random, np.tile(np.arange(bins), (bins, 1))], axis=1)


def minhash(ordered: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation MinHash of a non-empty set of fingerprints in ascending order."""
    bin_of = (((ordered >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bin_of[1:] != bin_of[:-1]]))
    have = np.zeros(bins, bool)
    have[bin_of[first]] = True
    out = np.zeros(bins, np.uint64)
    out[bin_of[first]] = ordered[first]
    if len(first) < bins:
        empty = np.flatnonzero(~have)
        detours = _detours(bins)[empty]
        out[empty] = out[detours[np.arange(len(empty)), have[detours].argmax(axis=1)]]
    return out


def band_rows(similarity: int, bins: int = BINS, missed: float = MISSED) -> int:
    """The most rows of a band with which two sets of that similarity (of 100) share no bucket with a probability of at most ``missed``."""
    fits = [r for r in range(1, bins + 1) if (1 - (similarity / 100) ** r) ** (bins // r) <= missed]
    return max(fits, default=1)


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    table = minima[: len(minima) // rows * rows].reshape(-1, rows)
    keys = mix(np.arange(1, len(table) + 1, dtype=np.uint64))
    for k in range(rows):
        keys = mix(keys * np.uint64(0x2545F4914F6CDD1D) + table[:, k])
    return keys.view(np.int64)


def _sets(batch: pa.RecordBatch, text: int, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in parts(batch, text):
        found, at = words(part.column(text))
        yield part, [np.unique(shingles(found[a:b], size)) for a, b in zip(at[:-1], at[1:], strict=True)]


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, bins: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands) of each row; a set without shingles has null for the last two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, 1, size):
                minima = [minhash(s, bins) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(list(map(len, sets)), pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if m is None else band_keys(m, rows) for m in minima], pa.list_(pa.int64())),
                ], ["doc_id", "n_shingles", "set_id", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_id binary, bands array<bigint>")


class _Sets:
    """Full shingle sets of chosen classes, read again from their texts."""

    def __init__(self, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, size: int) -> None:
        self.docs, self.classes, self.size = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), classes, size

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, set binary) for the distinct ``nodes`` (node)."""
        size = self.size
        wanted = durable(self.classes.select("node", "doc_id", "set_id").join(nodes, "node", "left_semi"), "near-wanted")
        ids = wanted.select("doc_id").distinct()
        few = fits(wanted.select("doc_id"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, sets in _sets(batch, 0, size):
                    found = {hashlib.blake2b(raw, digest_size=16).digest(): raw for s in sets if len(s) and (raw := s.tobytes())}
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()) for x in (found, found.values())], ["set_id", "set"])

        texts = self.docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text")
        sets = texts.mapInArrow(run, "set_id binary, set binary")
        return sets.join(wanted.select("node", "set_id"), "set_id").dropDuplicates(["node"]).select("node", "set")

    def confirmed(self, pairs: DataFrame, similarity: int) -> DataFrame:
        """The distinct ``pairs`` (a, b) with 100 * intersection >= similarity * union, on the full sets."""
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = durable(self.of(nodes), "near-sets")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.sort(np.concatenate([x, y]))
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * shared >= similarity * (len(both) - shared))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        links = durable(joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), "near-links")
        free(sets)
        return links


def _near_size(similarity: int) -> F.Column:
    """Sets of more different sizes can't be similar enough."""
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * similarity


def _links_in_block(left: list[np.ndarray], right: list[np.ndarray], same: bool, labels: list[int], similarity: int, meet) -> list[tuple[int, int]]:  # noqa: ANN001
    """Links (x, y) between a left and a right set of different labels that ``meet``, as many as join the labels; ``labels`` is of left, then right.

    The left sets' fingerprints in order are an index; one look-up of a right set gives its intersections with all of them.
    """
    parent = {r: r for r in labels}

    def root(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    sizes = np.array(list(map(len, left)))
    values, owner = np.concatenate(left), np.repeat(np.arange(len(left)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    found = []
    for y, own in enumerate(right):
        first, last = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        n = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(left))
        near = np.flatnonzero(100 * shared >= similarity * (sizes + len(own) - shared))
        for x in near.tolist():
            if same and x >= y:
                continue
            p, q = root(labels[x]), root(labels[y if same else len(left) + y])
            if p != q and meet(x, y):
                parent[p] = q
                found.append((x, y))
    return found


def _open_links(sets: _Sets, multi: DataFrame, roots: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between different components whose members meet in a bucket.

    Classes that meet directly or over others in such buckets form a region; its members are compared within it, in pairs of
    blocks, each set sent once for each block of its region.  A region of more than ``REGION`` classes is dealt out by its buckets,
    with the same links.
    """
    labelled = multi.where("c > 2").join(roots, "node", "left").select("bucket", "node", "n_shingles", F.coalesce("root", "node").alias("root"))
    labelled = durable(labelled, "near-labelled")
    mixed = durable(labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("hub")).where("low <> high"), "near-mixed")
    open_ = durable(labelled.join(mixed.select("bucket", "hub"), "bucket"), "near-open")
    regions = components(open_.select(F.col("hub").alias("a"), F.col("node").alias("b"))).withColumnRenamed("root", "region")
    regions = durable(regions, "near-regions")
    nodes = durable(open_.groupBy("node").agg(F.min("root").alias("root"), F.min("n_shingles").alias("n"), F.collect_set("bucket").alias("buckets")).join(regions, "node"), "near-nodes")  # a node has as many buckets as bands
    large = nodes.join(durable(nodes.groupBy("region").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > REGION), "near-large-regions"), "region", "left")
    # kind 0: by region; kind 1: by bucket
    groups = F.when(F.col("m").isNull(), F.array("region")).otherwise(F.col("buckets"))
    placed = durable(large.select(F.col("m").isNotNull().cast("int").alias("kind"), F.explode(groups).alias("g"), "node", "root", "n"), "near-placed")
    size = durable(placed.groupBy("kind", "g").agg(F.count(F.lit(1)).alias("m"), (8 * F.sum("n")).alias("bytes")), "near-sizes")
    blocks = F.greatest(F.least(F.ceil(F.col("m") / BLOCK), F.lit(BLOCKS)), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = placed.join(size.select("kind", "g", blocks.alias("blocks")), ["kind", "g"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = durable(sets.of(nodes.select("node")).join(nodes.select("node", "buckets"), "node"), "near-open-sets")
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select("kind", "g", "i", "j", "own", "node", "root").join(found, "node")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        node, root, own = (group.column(c).to_numpy() for c in ("node", "root", "own"))
        data = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        buckets = group.column("buckets")
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links = []
        if len(left) and len(right):
            labels = [*root[left].tolist(), *(root[right].tolist() if i != j else ())]
            meet = lambda x, y: not set(buckets[int(left[x])].as_py()).isdisjoint(buckets[int(right[y])].as_py())
            links = _links_in_block([data[k] for k in left], [data[k] for k in right], i == j, labels, similarity, meet)
        return pa.table({"a": pa.array([node[left[x]] for x, _ in links], pa.int64()), "b": pa.array([node[right[y]] for _, y in links], pa.int64())})

    links = durable(dealt.groupBy("kind", "g", "i", "j").applyInArrow(run, "a bigint, b bigint"), "near-open-links")
    free(labelled, mixed, open_, regions, nodes, placed, size, found)
    return links


def near_groups(docs: DataFrame, size: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, rows: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= ``similarity`` * union of their sets of ``size``-word shingles.  component_id is the
    smallest doc_id reachable; kept marks the document with that id.  A text without words is linked with nothing.
    A row without id is linked with nothing and kept, with a null component.  Rows with one id count as that document, each
    with its own text.  A very long text's set is held whole in one task.  Ids are of any type with an order; other columns, whatever
    their names, are not read; an empty table gives an empty result.
    """
    rows = rows or band_rows(similarity, bins)
    found = durable(signatures(docs, id_col, text_col, size, bins, rows).withColumn("row", F.monotonically_increasing_id()), "near-signatures")
    linked = F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()
    first = F.struct("doc_id", "row")
    heads = found.where(linked).groupBy("set_id").agg(F.min(first).alias("first"))
    heads = heads.select("set_id", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("node"))
    classes = durable(heads.join(found.select(F.col("row").alias("node"), "n_shingles", "bands"), "node"), "near-classes")

    members = classes.select(F.explode("bands").alias("bucket"), "node")
    # aggregates are written before they are joined: then a hot key's rows come from plain exchanges, which adaptive execution splits
    several = durable(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-several")
    multi = durable(members.join(several, "bucket").join(classes.select("node", "n_shingles"), "node"), "near-buckets")
    weight = multi.groupBy("node").agg(F.sum("c").alias("w"))
    hubs = durable(multi.join(weight, "node").groupBy("bucket").agg(F.max(F.struct(F.col("w"), (-F.col("node")).alias("node"), F.col("n_shingles").alias("n"))).alias("hub")), "near-hubs")
    star = multi.join(hubs, "bucket").select((-F.col("hub.node")).alias("h"), F.col("hub.n").alias("na"), "node", F.col("n_shingles").alias("nb"))
    star = star.where(F.col("h") != F.col("node")).where(_near_size(similarity))
    edges = durable(star.select(F.least("h", "node").alias("a"), F.greatest("h", "node").alias("b")).distinct(), "near-star")

    sets = _Sets(docs, classes, id_col, text_col, size)
    links = sets.confirmed(edges, similarity)
    roots = durable(components(links), "near-roots")
    more = _open_links(sets, multi, roots, similarity)
    if not more.isEmpty():
        roots = durable(components(links.unionByName(more)), "near-roots")
    free(several, multi, hubs, edges, links, more)

    rooted = durable(classes.select("node", "set_id", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-rooted")
    least = durable(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "near-least")
    named = rooted.join(least, "root").select("set_id", "component_id")
    result = found.select("doc_id", "n_shingles", F.when(linked, F.col("set_id")).alias("set_id")).join(named, "set_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
