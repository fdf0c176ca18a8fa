"""Vectorised words over Arrow string columns.

The text operators all cut texts at ASCII bytes, so words can be found on the
UTF-8 buffer of an Arrow column without decoding it: bytes above 0x7F are never
separators.  Everything here is numpy over that buffer; there is no loop over
words and none over documents.

Null texts have no words.  Empty texts have no words.  Memory is bounded by
``slices``: a caller works on one slice of a batch at a time, and a slice holds
at most ``SLICE_BYTES`` of text unless a single text is longer than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_U64 = np.uint64
_STEP = _U64(0x9E3779B97F4A7C15)
_ODD = 0xD6E8FEB86659FD93
_ODD_INV = pow(_ODD, -1, 1 << 64)


def byte_class(separators: bytes | None = None, words: bytes | None = None) -> np.ndarray:
    """A table of 256 booleans that is true for bytes that separate words."""
    table = np.zeros(256, bool)
    if separators is not None:
        table[list(separators)] = True
    else:
        table[:] = True
        table[list(words or b"")] = False
    return table


#: Separators of the words ``[^\x20\x09-\x0D]+``.
SPACES = byte_class(separators=bytes([0x20, *range(0x09, 0x0E)]))
#: Separators of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = byte_class(words=bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: a bijection that spreads every bit."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_powers = np.ones(1, _U64)
_inverse = np.ones(1, _U64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n of each."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 4096)
        up, down = np.full(size, _ODD, _U64), np.full(size, _ODD_INV, _U64)
        up[0] = down[0] = 1
        _powers, _inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers, _inverse


_LETTER = mix(np.arange(1, 257, dtype=_U64) * _STEP)


@dataclass
class Words:
    """Words of one slice of a string column, in order, documents one after another."""

    data: np.ndarray  #: the bytes of the slice
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    first: np.ndarray  #: for document i, words first[i] to first[i + 1]
    text: np.ndarray  #: for document i, bytes text[i] to text[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, from its bytes and its length."""
        if not len(self.start):
            return np.empty(0, _U64)
        power, inverse = _tables(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, _U64)
        np.cumsum(_LETTER[self.data] * power[: len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(_U64))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """(start, stop, texts) over a column, each of about ``limit`` bytes of text at most."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
    if not len(column):
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + limit, "right")) - 1)
        yield at, stop, column.slice(at, stop - at)
        at = stop


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its texts in them; nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    """Words of a slice.  No word reaches over the end of its text."""
    data, text = buffer_of(texts)
    if lower:
        data = LOWER[data]
    solid = np.empty(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(separators[data], out=solid[1:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[text] = True
    here, before = solid[1:], solid[:-1]
    start = np.flatnonzero(here & (edge | ~before))
    end = np.flatnonzero(before & (edge | ~here))
    return Words(data, start, end, np.searchsorted(start, text), text)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row; they may reach over the ends of documents."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, _U64)
    total = hashes[:n].copy()
    for j in range(1, size):
        total *= _U64(_ODD)
        total += hashes[j : j + n]
    return mix(total)


def inside(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n windows of ``size`` words lie inside one document."""
    ok = np.zeros(n + 1, np.int64)
    counts = np.diff(first)
    long = counts >= size
    np.add.at(ok, first[:-1][long], 1)
    np.add.at(ok, first[1:][long] - size + 1, -1)
    return np.cumsum(ok[:-1]) > 0


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
