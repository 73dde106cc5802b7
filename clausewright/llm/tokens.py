"""Encoding with a public byte-level BPE vocabulary through a sentencepiece model (problem 8).

The vocabulary file (token bytes and rank per line) is turned into a serialised sentencepiece BPE
model: every token is one piece, its bytes mapped to printable characters, its score the negative
rank, with identity normalisation. Sentencepiece merges the adjacent pair whose merged piece scores
best, which is the merge order of the vocabulary. Texts are cut into pre-tokens first; each
different pre-token is encoded once per worker. Decoding maps the pieces' bytes back.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
# The pre-token pattern of the vocabulary, and the characters of white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BEYOND = re.compile("[\U00010000-\U0010ffff]")
KEPT = 400_000  # pre-tokens remembered per worker


@cache
def splitters() -> tuple[regex.Pattern[str], re.Pattern[str]]:
    """The pattern itself, and the same with the letters and numbers of the basic plane spelt out:
    the standard engine keeps such classes as bitmaps and is several times as fast."""

    def members(prop: str) -> str:
        one = regex.compile(prop)
        spans: list[list[int]] = []
        for cp in range(0x10000):
            if one.match(chr(cp)):
                if spans and spans[-1][1] == cp - 1:
                    spans[-1][1] = cp
                else:
                    spans.append([cp, cp])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)

    letters, numbers = members(r"\p{L}"), members(r"\p{N}")
    plain = rf"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    return regex.compile(PATTERN), re.compile(plain)


def byte_letters() -> list[str]:
    """A printable character for each byte: itself if it is printable Latin-1, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float | str) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def model_bytes(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece model whose piece i is token i, and an unknown piece after the last."""
    letters = byte_letters()
    pieces = [_field(1, "".join(letters[b] for b in token)) + _field(2, -float(rank)) + _field(3, 1) for rank, token in enumerate(vocabulary)]
    pieces.append(_field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(vocabulary)) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normal = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normal)


@cache
def vocabulary(path: str) -> tuple[bytes, ...]:
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"the ranks in {path} are not 0 to n - 1")
    return tuple(t for _, t in pairs)


class Encoder:
    """Encodes and decodes texts; one per worker process and vocabulary."""

    def __init__(self, path: str) -> None:
        self.tokens = vocabulary(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(list(self.tokens)))
        self.letters = byte_letters()
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > KEPT:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        mapped = ["".join(map(self.letters.__getitem__, w.encode("utf-8", "surrogatepass"))) for w in new]
        self.known.update(zip(new, map(tuple, self.model.encode(mapped, num_threads=1))))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, special tokens taken as ordinary text; of null and empty text none."""
        if not text:
            return []
        words = splitters()[not BEYOND.search(text)].findall(text)
        known = self.known
        try:
            return list(chain.from_iterable(map(known.__getitem__, words)))
        except KeyError:
            self._learn(words)
        try:
            return list(chain.from_iterable(map(self.known.__getitem__, words)))
        except KeyError:  # the cache was emptied while it learnt this text
            self._learn(words)
            return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "surrogatepass")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = FOLDER) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def encoded(records: DataFrame, key: str, text: str, path: str, counts_only: bool = False) -> DataFrame:
    """(key, ids) of every row, or (key, tokens) with the number of ids.

    Null and empty texts have an empty list, a null key is kept, repeated rows are repeated. One
    pass over two columns; nothing is shuffled."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            lists = list(map(coder.encode, batch.column(1).to_pylist()))
            ends = np.cumsum([0, *map(len, lists)])
            if counts_only:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int32())], ["id", "tokens"])
                continue
            flat = np.fromiter(chain.from_iterable(lists), np.int32, ends[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "ids"])

    kind = records.schema[key].dataType.simpleString()
    out = records.select(F.col(key), F.col(text)).mapInArrow(rows, f"id {kind}, " + ("tokens int" if counts_only else "ids array<int>"))
    return out.withColumnRenamed("id", key)


def decoded(rows_: DataFrame, ids: str, path: str) -> Column:
    """A column with the text of a list of ids; null for null."""

    @F.pandas_udf("string")
    def text(s):  # noqa: ANN001, ANN202
        coder = encoder(path)
        return s.map(lambda x: None if x is None else coder.decode(x.tolist() if hasattr(x, "tolist") else x))

    return text(rows_[ids])
