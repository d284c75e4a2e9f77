"""Byte-level BPE with the ``tokenizers`` library over Arrow batches: encode, offsets, decode, count.

The library merges each distinct pre-token once per worker; a bounded worker cache then serves its repeats, so a
text costs one regular-expression pass and one dictionary look-up per pre-token.  This is exact because byte-level
BPE never merges across pre-tokens.  Tokenizers of any other make go through the library as whole texts.

Ids travel as packed little-endian integers (``ids`` binary, two bytes each if the vocabulary allows, else four).
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.textscan import parts

#: The pre-token pattern of this family of byte-level tokenizers, the default where a file names none.  Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens in one generation of a worker's cache; bounds memory, never the result.
CACHE = 120_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 stands for itself, the others move up past 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return [chr(moved.get(b, b)) for b in range(256)]


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge list behind a rank table: the two parts that each longer token is made of when its turn comes."""
    found = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            options = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank]
            if not options:
                break
            i = min(options)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            found.append((parts[0], parts[1]))
    return found


_SPELLING = {b: c for b, c in enumerate(byte_characters()) if ord(c) != b}
_SPACE = _SPELLING[0x20]


@functools.lru_cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that finds all matches of a pre-token pattern.

    For PATTERN, Latin-1 texts are split by the standard library's engine with the 256 characters' classes spelt out, in half the
    time; alternatives that begin with different characters stand in order of frequency there.
    """
    every = regex.compile(pattern).findall
    if pattern != PATTERN:
        return every
    latin = "".join(map(chr, range(256)))
    letter, number, space = ("".join(f"\\x{ord(c):02x}" for c in regex.findall(kind, latin)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    short = re.compile(f" ?[{letter}]+| ?[{number}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall

    def find(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return every(text)
        return short(text)

    return find


@dataclass(frozen=True)
class Codec:
    """A tokenizer as a value that can be sent to workers: the library's JSON, and what the fast path needs.

    ``special``: strings that count as one id inside a text, as the library does by default.
    """

    source: str = field(repr=False)
    special: tuple[tuple[str, int], ...] = ()
    by_pretoken: bool = True
    pattern: str = PATTERN
    vocabulary: int = 0

    @staticmethod
    def from_json(path: str) -> Codec:
        with open(path, encoding="utf-8") as file:
            source = file.read()
        make = json.loads(source)
        model, pre = make["model"], make.get("pre_tokenizer") or {}
        added = make.get("added_tokens") or []
        plain = (
            model.get("type") == "BPE"
            and not model.get("dropout")
            and not model.get("ignore_merges")
            and not make.get("normalizer")
            and not make.get("truncation")
            and not make.get("padding")
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added)
        )
        size = 1 + max([*model["vocab"].values(), *(a["id"] for a in added)])
        return Codec(source, tuple((a["content"], a["id"]) for a in added), plain, PATTERN, size)

    @staticmethod
    def from_ranks(path: str, pattern: str = PATTERN) -> Codec:
        """From a rank file (base64 token, rank); no string is special."""
        from tokenizers import Tokenizer, decoders, models, pre_tokenizers

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        letters = byte_characters()
        spell = lambda token: "".join(letters[b] for b in token)
        tokenizer = Tokenizer(models.BPE({spell(t): r for t, r in ranks.items()}, [(spell(a), spell(b)) for a, b in merges_of(ranks)]))
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        tokenizer.decoder = decoders.ByteLevel()
        return Codec(tokenizer.to_str(), (), True, pattern, 1 + max(ranks.values()))

    @property
    def width(self) -> int:
        return 2 if self.vocabulary <= 1 << 16 else 4

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"<u{self.width}")


class Memo(dict):
    """Pre-token to what ``make`` gives for it, bounded: at CACHE entries the present generation becomes the old one.

    What is still in use moves back from the old generation, so frequent pre-tokens are made once.
    """

    def __init__(self, make: Callable[[str], object]) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, pretoken: str) -> object:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        value = self.old.get(pretoken)
        if value is None:
            value = self.make(pretoken)
        self[pretoken] = value
        return value


class Worker:
    """The codec inside a worker process."""

    _own: dict[int, Worker] = {}

    def __init__(self, codec: Codec) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.codec = codec
        self.tokenizer = Tokenizer.from_str(codec.source)
        self.merge = self.tokenizer.model.tokenize
        self.letter = "H" if codec.width == 2 else "I"
        self.cache = Memo(lambda pretoken: self.packed(self.merged(pretoken)))
        self.find = splitter(codec.pattern)
        self.special = {text: np.array([i], codec.dtype).tobytes() for text, i in codec.special}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    @classmethod
    def of(cls, codec: Codec) -> Worker:
        """One for each codec and process."""
        key = hash(codec)
        if key not in cls._own:
            cls._own.clear()
            cls._own[key] = cls(codec)
        return cls._own[key]

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def packed(self, ids: list[int]) -> bytes:
        packed = array(self.letter, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if not self.codec.by_pretoken:
            return self.whole(text)
        if self.cut and any(s in text for s in self.special):
            return b"".join(self.special.get(part) or self._plain(part) for part in self.cut(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.find(text)))

    def merged(self, pretoken: str) -> list[int]:
        """The ids of one pre-token: the library's merges over its spelling in byte characters."""
        if pretoken.isascii() and pretoken.isprintable():
            spelling = pretoken.replace(" ", _SPACE)
        else:
            spelling = pretoken.encode().decode("latin-1").translate(_SPELLING)
        return [t.id for t in self.merge(spelling)]

    def rest(self) -> None:
        """After a task: the old generation goes, as the process stays for other work."""
        self.cache.old = {}

    def byte_table(self) -> list[bytes]:
        """The bytes of each id."""
        code = {c: b for b, c in enumerate(byte_characters())}
        table = [b""] * self.codec.vocabulary
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            table[i] = bytes(code[c] for c in token)
        for text, i in self.codec.special:
            table[i] = text.encode()
        return table


def character_offsets(text: bytes, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in characters, from the tokens' byte lengths.

    A token that holds part of a character covers the whole of it, so tokens that share a split character overlap.
    """
    starts_character = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    begun = np.concatenate([[0], np.cumsum(starts_character)])
    ends = np.cumsum(token_bytes)
    starts = ends - token_bytes
    return begun[np.minimum(starts + 1, len(text))] - 1 if len(text) else starts, begun[ends]


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens long, ids binary; with ``offsets`` also starts and ends (characters).

    A null text is an empty one and has no tokens; a very long one is encoded whole.  Rows keep their number, null and repeated ids and
    equal rows included; ids are of any type; other columns, whatever their names, are dropped; an empty table gives an empty result.
    """
    spec = docs.sparkSession.sparkContext.broadcast(codec)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids binary" + ", starts array<int>, ends array<int>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Worker.of(spec.value)
        lengths = np.array(list(map(len, worker.byte_table()))) if offsets else None
        for batch in (part for whole in batches for part in parts(whole, 1)):
            ids = [worker.encode(text) if text else b"" for text in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(i) // spec.value.width for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            if offsets:
                both = [character_offsets((t or "").encode(), lengths[np.frombuffer(i, spec.value.dtype)]) for t, i in zip(batch.column(1).to_pylist(), ids, strict=True)]
                columns += [pa.array([x[k].astype(np.int32) for x in both], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids", "starts", "ends"][: len(columns)])
        worker.rest()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class _Decoder:
    """Packed ids to (number, decimal ids joined by one space, bytes).

    Bytes are joined before anything reads them as UTF-8, so characters that two or more tokens share come back whole.
    """

    def __init__(self, worker: Worker) -> None:
        self.dtype, self.table = worker.codec.dtype, worker.byte_table()
        self.spelled = [str(i) for i in range(len(self.table))]

    def columns(self, packed: list[bytes | None]) -> list[pa.Array]:
        n, text, data = [], [], []
        for ids in (np.frombuffer(p or b"", self.dtype).tolist() for p in packed):
            n.append(len(ids))
            text.append(" ".join(map(self.spelled.__getitem__, ids)))
            data.append(b"".join(map(self.table.__getitem__, ids)))
        return [pa.array(n, pa.int64()), pa.array(text, pa.string()), pa.array(data, pa.binary())]


_DECODED = "ids binary, n_tokens bigint, ids_text string, decoded binary"


def decode(tokens: DataFrame, codec: Codec, id_col: str = "doc_id") -> DataFrame:
    """From packed ids: id, ids, n_tokens, ids_text (decimal ids joined by one space), decoded binary.  Null ids decode to nothing."""
    spec = tokens.sparkSession.sparkContext.broadcast(codec)
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _Decoder(Worker.of(spec.value))
        for batch in (part for whole in batches for part in parts(whole, 1)):
            yield pa.RecordBatch.from_arrays([*batch.columns, *decoder.columns(batch.column(1).to_pylist())], [id_col, "ids", "n_tokens", "ids_text", "decoded"])

    return tokens.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, {_DECODED}")


def round_trip(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one worker a task, the decoder seeing the packed ids alone.

    Null, empty and very long texts, null and repeated ids, equal rows, other columns and empty tables are treated as by ``encode``.
    """
    spec = docs.sparkSession.sparkContext.broadcast(codec)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Worker.of(spec.value)
        decoder = _Decoder(worker)
        for batch in (part for whole in batches for part in parts(whole, 1)):
            ids = [worker.encode(text) if text else b"" for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), *decoder.columns(ids)], [id_col, "ids", "n_tokens", "ids_text", "decoded"])
        worker.rest()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {_DECODED}")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return decoded.select(id_col, "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def unpack(ids: Column, codec: Codec) -> Column:
    """Packed ids as array<int>, in the JVM."""
    w, digits = codec.width, F.hex(ids)
    at = lambda i, k: F.substr(digits, i * F.lit(2 * w) + F.lit(1 + 2 * k), F.lit(2))
    number = lambda i: F.conv(F.concat(*[at(i, k) for k in reversed(range(w))]), 16, 10).cast("int")
    n = F.floor(F.length(ids) / w).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), number)).otherwise(F.array().cast("array<int>"))
