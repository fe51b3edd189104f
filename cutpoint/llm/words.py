"""Words of whole texts, found on UTF-8 bytes with numpy.

Both word classes of this package are unions of byte values, because every byte of a
non-ASCII character is 0x80 or more: finding words on bytes equals finding them on
characters. A word is known by a 64-bit polynomial hash over randomised byte values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Text bytes handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(29))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[0x80:] = True
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _ALNUM[_a : _b + 1] = True
#: "space": runs without white space; "alnum": runs of ASCII letters, digits and non-ASCII.
CLASSES = {"space": ~_SPACE, "alnum": _ALNUM}

_powers = np.ones(1, U), np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i below ``n`` or more."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        made = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, U(b & (2**64 - 1)), U)
            p[0] = U(1)
            made.append(np.cumprod(p, dtype=U))
        _powers = made[0], made[1]
    return _powers


@dataclass
class Words:
    """Words of consecutive texts: byte spans in ``data``, hashes, and offsets by text."""

    data: np.ndarray
    text_starts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text offsets of a string array; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def find(data: np.ndarray, at: np.ndarray, kind: str, fold: bool) -> Words:
    """The words of the texts ``data[at[i]:at[i+1]]``, A-Z lower-cased first if ``fold``."""
    n = len(data)
    inside = CLASSES[kind][data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = at[:-1][at[:-1] < n]
    begin[cuts] = inside[cuts]
    finish = np.zeros(n + 1, bool)
    finish[1:] = inside
    finish[1:n] &= ~inside[1:]
    finish[cuts] |= np.where(cuts > 0, inside[cuts - 1], False)
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U)
    values = _VALUES[_LOWER[data]] if fold else _VALUES[data]
    np.cumsum(values * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return Words(data, at, starts, ends, hashes, np.searchsorted(starts, at))


def chunks(texts: pa.Array, kind: str, fold: bool) -> Iterator[tuple[int, int, Words]]:
    """``(first, stop, words)`` of runs of texts of at most CHUNK_BYTES, or of one text."""
    data, at = buffers(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
        yield i, j, find(data[at[i] : at[j]], at[i : j + 1] - at[i], kind, fold)
        i = j


def joined(w: Words, first: int, stop: int, keep: np.ndarray | None = None) -> bytes:
    """Words ``first`` to ``stop`` (those kept) joined by one space."""
    starts, ends = w.starts[first:stop], w.ends[first:stop]
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return b""
    size = ends - starts + 1
    total = int(size.sum())
    place = np.arange(total) + np.repeat(starts - (np.cumsum(size) - size), size)
    out = w.data[np.minimum(place, len(w.data) - 1)]
    out[np.cumsum(size) - 1] = 0x20
    return out[:-1].tobytes()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive words (over text borders too)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    if k == 2:
        return mix(hashes[:-1] * U(0xC2B2AE3D27D4EB4F) + hashes[1:] * U(0x165667B19E3779F9))
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """A hash of one whole word sequence, apart from those of fixed-length runs."""
    up, _ = powers(len(hashes) + 1)
    total = (hashes * up[: len(hashes)]).sum(dtype=U, keepdims=True) + np.array([len(hashes)], U) * U(0xA0761D6478BD642F)
    return mix(total)[0]
