"""Vectorised word splitting and hashing over Arrow string buffers.

A text is looked at as UTF-8 bytes. A table of 256 flags says which bytes
belong to words, so every word rule used here (runs of bytes outside a set of
ASCII bytes) is one table lookup per byte; no text is decoded. Words get a
64-bit hash: the sum of random values by byte, times powers of an odd base by
position, mixed at the end. Hashes only ever *select* or *count within one
document*; where a result could change by a collision the caller compares the
words themselves.

Texts are handled in blocks of about ``BLOCK`` bytes (a longer text is a block
of its own), so memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_LENGTH = _U(0xD6E8FEB86659FD93)


def byte_table(outside: str) -> np.ndarray:
    """Flags of the bytes that make words: all but ``outside`` (ASCII)."""
    table = np.ones(256, dtype=bool)
    table[list(outside.encode("ascii"))] = False
    return table


#: Runs of anything but ASCII white space: ``[^\x20\x09-\x0D]+``.
SPACED = byte_table(" \t\n\x0b\x0c\r")
#: Runs of ASCII letters, digits and all beyond ASCII.
ALNUM = byte_table("".join(c for c in map(chr, range(128)) if not c.isalnum()))

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240117)).integers(0, 2**64, 256, dtype=np.uint64)
_SHINGLE = np.random.Generator(np.random.PCG64(7177)).integers(0, 2**64, 64, dtype=np.uint64) | _U(1)
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS), 256), _BASE, dtype=np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that any of their bits can be used."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xCA9B0C1EBA6F5C11)
    return h ^ (h >> _U(32))


class Words(NamedTuple):
    """Words of a run of consecutive texts of one Arrow array."""

    first: int  #: index of the run's first text
    texts: int  #: number of texts in the run
    data: np.ndarray  #: bytes of the run
    starts: np.ndarray  #: of each word in ``data``
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  #: words of text i are ``bounds[i]:bounds[i + 1]``
    offsets: np.ndarray  #: bytes of text i are ``offsets[i]:offsets[i + 1]`` of ``data``

    def word(self, i: int, fold: bool) -> bytes:
        raw = self.data[self.starts[i] : self.ends[i]].tobytes()
        return raw.lower() if fold else raw


def _split(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool, hashed: bool) -> tuple:
    inside = table[data]
    start, last = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begun = offsets[:-1][offsets[:-1] < offsets[1:]]  # of texts that are not empty
    start[begun] = inside[begun]
    stop = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[stop] = inside[stop]
    starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
    if not hashed or not len(starts):
        return starts, ends, np.zeros(len(starts), dtype=np.uint64)
    lengths = ends - starts
    heads = np.zeros(len(lengths), dtype=np.int64)
    np.cumsum(lengths[:-1], out=heads[1:])
    at = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(heads.astype(np.int32), lengths)
    values = _BYTE_VALUES[(_FOLD[data] if fold else data)[inside]]
    values *= _powers(int(lengths.max()))[at]
    return starts, ends, mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64) * _LENGTH)


def words_of(texts: pa.Array, table: np.ndarray, fold: bool, hashed: bool = True) -> Iterator[Words]:
    """Words of all texts in order; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        j = min(j, n)
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, hashes = _split(part, own, table, fold, hashed)
        yield Words(i, j - i, part, starts, ends, hashes, np.searchsorted(starts, own, side="left"), own)
        i = j


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of ``k``-word shingles of each text.

    A text of fewer words, but not none, has its whole sequence as the one
    shingle; a text without words has none.
    """
    h, n = words.hashes, len(words.hashes)
    rolled = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for j in range(k if len(rolled) else 0):
        rolled += h[j : j + len(rolled)] * _SHINGLE[j]
    rolled = mix(rolled + _U(k))
    for lo, hi in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(rolled[lo : hi - k + 1])
        elif hi > lo:
            yield mix(np.array([(h[lo:hi] * _SHINGLE[: hi - lo]).sum(dtype=np.uint64) + _U(hi - lo)], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)
