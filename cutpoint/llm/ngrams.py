"""Hashed character n-grams of the words of whole texts, on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import _LOWER, CHUNK_BYTES, CLASSES, U, buffers

_MULTIPLIER = U(0x100000001B3)
_SPREAD = U(0x9E3779B97F4A7C15)


def padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased word bytes with 0 for all others and around each text; text starts there."""
    texts = len(at) - 1
    stream = np.zeros(len(data) + texts + 1, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(1, texts + 1), np.diff(at))
    stream[place] = np.where(CLASSES["alnum"][data], _LOWER[data], 0)
    return stream, at[:-1] + np.arange(texts)


def buckets(stream: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n in ``sizes``: places of n-grams and their buckets.

    An n-gram lies in one word; its first or last byte may be the border of the word.
    """
    n_all = len(stream)
    inside = stream != 0
    h = stream.astype(U)
    middle = np.ones(n_all, bool)  # bytes 1 .. n-2 from here are of a word
    shift = U(64 - bits)
    for n in range(2, max(sizes) + 1):
        if n_all < n:
            break
        h = h[: n_all - n + 1] * _MULTIPLIER + stream[n - 1 :]
        if n > 2:
            middle = middle[: n_all - n + 1] & inside[n - 2 : n_all - 1]
        else:
            middle = middle[: n_all - 1] & (inside[:-1] | inside[1:])
        if n in sizes:
            places = np.flatnonzero(middle)
            yield places, (((h[places] + U(n)) * _SPREAD) >> shift).astype(np.int64)


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, stop, stream, text starts in it)`` of runs of texts of bounded size."""
    data, at = buffers(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
        yield (i, j, *padded(data[at[i] : at[j]], at[i : j + 1] - at[i]))
        i = j
