"""Vectorised words, hashes and shingles over Arrow string batches (numpy on raw UTF-8 bytes).

Words are runs of bytes other than 0x20 and 0x09-0x0D, which on UTF-8 equals ``[^\\x20\\x09-\\x0D]+``
on code points.  Null texts are empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that are looked at together; a longer text makes a chunk of its own.
CHUNK = 1 << 19
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *forget: Callable[[], None]):
    """``run`` for a Python worker that serves other tasks later: at the task's end it calls what empties
    the module's caches and gives memory back to the system, which else stays with the idle worker."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for f in forget:
            f()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1024)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; x is uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of consecutive texts: ``hashes[first[d]:first[d + 1]]`` are those of text d."""

    data: np.ndarray  # the bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        sums = np.empty(len(self.data) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power(_R, len(self.data))[: len(self.data)], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * _power(_RINV, len(self.data) + 1)[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts and the n + 1 offsets; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of texts that lie one behind the other in ``data``."""
    space = np.empty(len(data) + 1, dtype=bool)
    np.take(SPACE, data, out=space[:-1])
    space[-1] = True
    starts = ~space
    starts[1:] &= space[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    starts[edges] = ~space[edges]  # a text begins a word even right behind another text
    start = np.flatnonzero(starts)
    ends = ~space[:-1]
    ends[:-1] &= space[1:-1]
    inner = offsets[1:-1]
    inner = inner[inner > 0] - 1
    ends[inner] = ~space[inner]
    end = np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def words_by_chunk(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first text, end, words) of chunks of a batch's texts."""
    data, offsets = buffers(texts)
    for a, b in chunks(offsets):
        part = data[offsets[a] : offsets[b]]
        yield a, b, split_words(LOWER[part] if lower else part, offsets[a : b + 1] - offsets[a])


def shingles(words: Words, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes; fewer words make one shingle of all of them."""
    h = words.hashes
    n = len(h)
    odd = [np.uint64(pow(0xA0761D6478BD642F, j + 1, 1 << 64) | 1) for j in range(k)]
    rolled = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for j in range(k):
        if n >= k:
            rolled += h[j : n - k + 1 + j] * odd[j]
    rolled = mix(rolled)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            short = sum((h[a + j : a + j + 1] * odd[j] for j in range(b - a)), np.full(1, b - a, dtype=np.uint64))
            yield mix(short)
        else:
            yield np.zeros(0, dtype=np.uint64)
