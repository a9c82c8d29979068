"""Hashes of words, word windows and byte windows of whole texts, a batch of texts at a time.

Helpers for tasks: each works on the Arrow buffers of a column of texts with
numpy, in slices of about ``SLICE`` bytes so that its memory does not grow with
the batch. Texts are UTF-8 bytes; a null text is an empty one.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_RANDOM = np.random.default_rng(20240613)
#: a random number for each byte value
BYTE_CODE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROOT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
INVERSE = np.uint64(pow(int(ROOT), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers (one to one)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of ROOT and its inverse, computed as far as a partition needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(ROOT, 2 * n), _powers(INVERSE, 2 * n)
        return self.up[:n], self.down[:n]


_KEPT = _Powers()


def tidy(run: Callable) -> Callable:
    """``run`` (batches to batches), whose worker gives its memory back when a partition ends.

    Workers are reused by later stages, whose own memory comes on top.
    """

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _KEPT.__init__()
            pa.default_memory_pool().release_unused()
            trim()

    return tidied


def trim() -> None:
    """Hand free memory of the C library back to the system, where it can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def windows(symbols: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` symbols (64-bit numbers); by its first place."""
    n = len(symbols)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _KEPT.to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of [start, start + length) of all ranges, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more entry than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    at = at.astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text is one by itself."""
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word (runs of bytes other than ASCII white
    space), and the number of words before each text (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = SPACE[data]
    before = np.empty(len(data), bool)
    before[1:] = space[:-1]
    after = np.empty(len(data), bool)
    after[:-1] = space[1:]
    filled = at[:-1] < at[1:]
    before[at[:-1][filled]] = True
    after[at[1:][filled] - 1] = True
    word = ~space
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    where = ranges(starts, lengths)
    firsts = np.cumsum(lengths) - lengths
    up, _ = _KEPT.to(int(lengths.max()))
    inside = np.arange(len(where)) - np.repeat(firsts, lengths)
    sums = np.add.reduceat(BYTE_CODE[data[where]] * up[inside], firsts)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def starts_of_windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window of ``size`` symbols lies within one text, and its text.

    ``first``: number of symbols before each text, one more than texts.
    """
    counts = np.maximum(np.diff(first) - size + 1, 0)
    return ranges(first[:-1], counts), np.repeat(np.arange(len(counts)), counts)


def anchors(seeds: np.ndarray, first: np.ndarray, seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: the place of the smallest seed hash in each window.

    ``seeds``: hash of the ``seed`` symbols from each place on; ``first`` as
    above; ``size``: symbols of a window. Equal windows choose the same place
    within, wherever they are, so every window belongs to one anchor. Gives for
    each anchor its place, its text, and the first and the number of the
    windows that belong to it (they follow each other).
    """
    wide = size - seed + 1
    places, text = starts_of_windows(first, size)
    if not len(places):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    # 32 bits of the hash above 32 bits of the place: the leftmost smallest one
    low = (mix(seeds) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=np.uint64)
    reach, done = 1, low
    while reach * 2 <= wide:
        done = np.minimum(done[:-reach], done[reach:])
        reach *= 2
    if reach < wide:
        done = np.minimum(done[: len(low) - wide + 1], done[wide - reach : wide - reach + len(low) - wide + 1])
    chosen = (done[places] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.empty(len(chosen), bool)
    new[0] = True
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    return chosen[begin], text[begin], places[begin], np.diff(np.append(begin, len(chosen)))
