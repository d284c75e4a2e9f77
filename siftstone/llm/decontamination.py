"""Benchmark decontamination by template canonicalisation.

Texts become tokens: words, and numbers (``1,234.5`` is one).  In a template, numbers, names (capitalised words inside a sentence) and
units (a fixed list, after a number) are typed placeholders; other words are folded to lower case.  Windows of ``WINDOW``
template tokens are joined by hash with the windows of the benchmark's templates, and windows of the folded words
themselves with theirs, so that copies with changed case are found as well as questions with other numbers and names.

An item counts as found in a document if windows, literal or template, on at least ``COVER`` of its places occur there in the item's
order, with fewer tokens put in or left out than the item has.  The slots of the template windows must be consistent too: along the
match, one value of the item always becomes the same value in the document; two values of the item may become one.  An item
shorter than a window is one window of its own length; one of fewer than ``SHORTEST`` tokens, which any text may hold by
chance, is found only in a document that has no other tokens.

The benchmark's windows are sent to all tasks while they are few enough (measured); beyond that both sides' windows
are joined by a shuffle.  Only windows that match go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftstone.llm.common import BROADCAST_BYTES, durable
from siftstone.llm.textscan import PIECE, _powers, fingerprints, mix, parts, text_bytes

WINDOW, COVER, SHORTEST = 8, 0.5, 3

#: Units that make a placeholder after a number.
UNITS = "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds oz ounce ounces ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv a ma j kj cal kcal kb mb gb tb mph kmh percent dollar dollars euro euros cent cents usd eur gbp degree degrees celsius fahrenheit".split()

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x21, 0x2E, 0x3A, 0x3F]] = True
_SLOT = mix(np.array([11, 12, 13], np.uint64))  # number, name, unit


@dataclass(frozen=True)
class Tokens:
    """Tokens of a text column: folded fingerprints, template fingerprints, which are slots, the row of each, row offsets."""

    words: np.ndarray
    template: np.ndarray
    slot: np.ndarray
    row: np.ndarray
    at: np.ndarray


def _unit_prints() -> np.ndarray:
    data, at = text_bytes(pa.array(UNITS))
    return np.sort(fingerprints(data, at[:-1], at[1:]))


def tokens(column: pa.Array) -> Tokens:
    data, offsets = text_bytes(column)
    n = len(data)
    digit, letter = _DIGIT[data], _LETTER[data]
    if n > 2:
        digit[1:-1] |= ((data[1:-1] == 0x2C) | (data[1:-1] == 0x2E)) & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
    kind = digit * np.int8(2) + letter * np.int8(1)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    border[1:n] |= kind[1:] != kind[:-1]
    border[[0, n]] = True
    edges = np.flatnonzero(border)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] > 0 if n else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    row = np.searchsorted(offsets, starts, "right") - 1
    number = kind[starts] == 2 if n else np.zeros(0, bool)
    folded = data.copy()
    if n > 1:  # accented capitals of Latin-1, in UTF-8
        high = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        folded[1:][high] += 0x20
    word = fingerprints(folded, starts, ends)
    second = data[np.minimum(starts + 1, max(n - 1, 0))] if n else data
    capital = ((data[starts] >= 0x41) & (data[starts] <= 0x5A)) | ((data[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E)) if n else np.zeros(0, bool)
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    first = np.ones(len(starts), bool)
    first[1:] = (row[1:] != row[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    name = capital & ~first & ~number
    unit = np.zeros(len(starts), bool)
    known = _unit_prints()
    unit[1:] = number[:-1] & (row[1:] == row[:-1]) & (known[np.minimum(np.searchsorted(known, word[1:]), len(known) - 1)] == word[1:])
    template = word.copy()
    template[number], template[name & ~unit], template[unit] = _SLOT[0], _SLOT[1], _SLOT[2]
    return Tokens(word, template, number | name | unit, row, np.searchsorted(row, np.arange(len(offsets))))


def windows(found: Tokens, size: int, template: bool, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``size`` tokens inside one row, and their first tokens; of templates, those with slots.

    A template window of slots only says little, so it is longer: to the next literal word, and once more from the one before.
    If not ``whole``, for items shorter than a window, templates with more slots than words are left out.
    """
    values, n = found.template if template else found.words, len(found.words)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(max(PIECE, 1 << (n - 1).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[:n])])
    at = np.arange(n - size + 1)
    first, last = at, at + size
    good = found.row[at] == found.row[last - 1]
    if template:
        slots = np.concatenate([[0], np.cumsum(found.slot)])
        inside = slots[size:] - slots[:-size]
        good &= (inside > 0) & (inside < size if whole else 2 * inside <= size)
        literal = np.flatnonzero(~found.slot)
        if whole and len(literal):
            full = np.flatnonzero(inside == size)
            right, left = np.searchsorted(literal, full + size), np.searchsorted(literal, full) - 1
            starts = np.concatenate([full[right < len(literal)], literal[left[left >= 0]]])
            ends = np.concatenate([literal[right[right < len(literal)]] + 1, full[left >= 0] + size])
            spots = np.concatenate([full[right < len(literal)], full[left >= 0]])
            first, last, at = (np.concatenate([x[good], y]) for x, y in ((first, starts), (last, ends), (at, spots)))
            good = found.row[first] == found.row[last - 1]
    hashes = mix((sums[last] - sums[first]) * down[first] + (2 * (last - first) + template).astype(np.uint64))
    return hashes[good], at[good]


def _slots(found: Tokens, at: int, size: int) -> bytes:
    span = slice(at, at + size)
    return found.words[span][found.slot[span]].tobytes()


def index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The windows of all items: hash, item_id, place, size, places, template, slots.  Items without an id or without tokens have none."""
    kind = benchmark.schema[id_col].dataType
    schema = f"hash bigint, item_id {kind.simpleString()}, place int, size int, places int, template boolean, slots binary"
    types = (pa.int64(), to_arrow_type(kind), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, 1)):
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = tokens(pa.array([text or ""]))
                size = min(window, len(found.words))
                for template in (False, True)[: 2 if size >= SHORTEST else 1]:
                    if size:
                        hashes, at = windows(found, size, template, size == window)
                        out += [(h, item, p, size, len(found.words) - size + 1, template, _slots(found, p, size) if template else b"") for h, p in zip(hashes.view(np.int64).tolist(), at.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], [c.split()[0] for c in schema.split(", ")])

    items = benchmark.select(F.col(id_col), F.col(text_col)).where(F.col(id_col).isNotNull())
    return items.mapInArrow(run, schema)


def _document_windows(docs: DataFrame, sizes: list[int], known: np.ndarray | None, window: int) -> DataFrame:
    """(row, doc_id, hash, spot, slots) of the windows of ``docs`` (row, doc_id, text) whose hash is known, or of all."""
    gate = np.zeros(1 << 20, bool)
    if known is not None:
        gate[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    sent = docs.sparkSession.sparkContext.broadcast((known, gate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gate = sent.value
        for batch in (part for whole in batches for part in parts(whole, 2)):
            found = tokens(batch.column(2))
            lengths = np.diff(found.at)
            for size in sizes:
                for template in (False, True)[: 2 if size >= SHORTEST else 1]:
                    hashes, at = windows(found, size, template, size == window)
                    if size < SHORTEST:
                        alone = lengths[found.row[at]] == size
                        hashes, at = hashes[alone], at[alone]
                    if known is not None:
                        maybe = gate[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]
                        hashes, at = hashes[maybe], at[maybe]
                        there = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
                        hashes, at = hashes[there], at[there]
                    if len(at):
                        rows = found.row[at]
                        slots = [_slots(found, p, size) for p in at.tolist()] if template else [b""] * len(at)
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(hashes.view(np.int64)),
                            pa.array((at - found.at[rows]).astype(np.int32)), pa.array(slots, pa.binary()),
                        ], ["row", "doc_id", "hash", "spot", "slots"])

    return docs.mapInArrow(run, f"row bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, hash bigint, spot int, slots binary")


def _chain(spot: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The longest chain of hits whose spots and places both grow, of those the one that stays longest on one shift; hits are in order of place."""
    n, shift = len(spot), spot - place
    if (shift == shift[0]).all():
        return np.arange(n)
    rank, turn = np.unique(spot, return_inverse=True)[1], np.unique(shift, return_inverse=True)[1]
    top = np.full(rank.max() + 2, -1)  # by spot: a chain's score and last hit; score: n + 1 a hit, 1 a step on the same shift
    on, last, before = np.zeros(turn.max() + 1, np.int64), np.full(turn.max() + 1, -1), np.full(n, -1)
    edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
    for k, end in zip(edges[:-1], edges[1:], strict=True):
        hits = np.arange(k, end)
        jump, same = np.maximum.accumulate(top)[rank[hits]], on[turn[hits]]
        stay = (last[turn[hits]] >= 0) & (same + 1 >= jump // n)
        before[hits] = np.where(stay, last[turn[hits]], np.where(jump >= 0, jump % n, -1))
        score = n + 1 + np.where(stay, same + 1, np.maximum(jump // n, 0))
        on[turn[hits]], last[turn[hits]] = score, hits
        np.maximum.at(top, rank[hits] + 1, score * n + hits)
    out = [int(top.max() % n)]
    while before[out[-1]] >= 0:
        out.append(int(before[out[-1]]))
    return np.array(out[::-1])


def _agreed(chain: np.ndarray, shift: np.ndarray, literal: np.ndarray, pairs: list[frozenset]) -> int:
    """Hits of a chain that are literal or lie on a shift whose slots are consistent with those of the longer stretches."""
    count, known = int(literal[chain].sum()), frozenset()
    stretches = [chain[shift[chain] == s] for s in np.unique(shift[chain])]
    for stretch in sorted(stretches, key=len, reverse=True):
        more = known.union(*(pairs[k] for k in stretch.tolist()))
        if len(more) == len({a for a, _ in more}):
            count, known = count + int((~literal[stretch]).sum()), more
    return count


def _judge(spot: np.ndarray, place: np.ndarray, template: np.ndarray, slots: list[bytes], own: list[bytes], length: int) -> tuple[int, bool]:
    """The most places of an item of ``length`` tokens matched in order by one occurrence, and whether literal windows alone do so.

    Literal and template windows count together where the slots of the template ones are consistent: one value of the item always
    becomes the same value in the document.
    """
    at, where = np.unique(place.astype(np.int64) << 32 | spot, return_inverse=True)
    spot, place = at & 0xFFFFFFFF, at >> 32
    literal = np.zeros(len(at), bool)
    literal[where[~template]] = True
    pairs: list[frozenset] = [frozenset()] * len(at)
    for k in np.flatnonzero(template).tolist():
        pairs[where[k]] = frozenset(zip(np.frombuffer(own[k], np.uint64).tolist(), np.frombuffer(slots[k], np.uint64).tolist(), strict=True))
    shift, best, words = spot - place, 0, 0
    order = np.argsort(shift, kind="stable")
    for s in np.unique(shift):
        first, after, last = np.searchsorted(shift[order], [s, s + 1, s + length])
        near = np.sort(order[first:last])
        if len(np.unique(place[near][literal[near]])) > words:
            some = near[literal[near]]
            words = max(words, len(_chain(spot[some], place[some])))
        if len(np.unique(place[near])) > best:
            best = max(best, _agreed(np.sort(order[first:after]), shift, literal, pairs), _agreed(near[_chain(spot[near], place[near])], shift, literal, pairs))
    return max(best, words), words >= best


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, cover: float = COVER, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, cover (share of the item's places), kind.

    The kind is words if literal windows alone have as many places, else template.

    Null texts and ids: a null text holds nothing; rows with a null id are judged like others; items without an id are left out.
    Repeated rows give repeated results.  Ids keep their types.  A very long text is scanned whole, in rows of its own.  Of equally good
    alignments the share is the same, so ties need no rule.  Other columns, whatever their names, are not read; without
    documents or items the result is empty.
    """
    windows_of_items = durable(index(benchmark, item_col, item_text_col, window), "benchmark-windows")
    sizes = sorted(r["size"] for r in windows_of_items.select("size").distinct().collect())  # at most ``window`` of them
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hashes = windows_of_items.select("hash").distinct()
    known = None
    if 8 * hashes.count() <= broadcast_bytes:
        known = np.sort(hashes.toArrow().column(0).to_numpy().view(np.uint64))
    found = _document_windows(rows, sizes if known is None or len(known) else [], known, window)
    hits = found.join(windows_of_items.withColumnRenamed("slots", "own"), "hash")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        spot, place = group.column("spot").to_numpy(), group.column("place").to_numpy()
        template = group.column("template").to_numpy()
        places, size = group.column("places")[0].as_py(), group.column("size")[0].as_py()
        best, literal = _judge(spot, place, template, group.column("slots").to_pylist(), group.column("own").to_pylist(), places + size - 1)
        share = best / places
        keep = share >= cover
        one = lambda name: group.column(name).combine_chunks().slice(0, int(keep))
        return pa.table({"doc_id": one("doc_id"), "item_id": one("item_id"), "cover": pa.array([share] * keep, pa.float64()), "kind": pa.array(["words" if literal else "template"] * keep, pa.string())})

    return hits.groupBy("row", "item_id").applyInArrow(run, f"doc_id {kind}, item_id {benchmark.schema[item_col].dataType.simpleString()}, cover double, kind string")
