"""Words and word shingles of many texts at once, as 64-bit hashes.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r,
with A-Z lower-cased; no other character is changed.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled in one go.
CHUNK = 1 << 19
_SPACE = b"\t\n\x0b\x0c\r "
_rng = np.random.default_rng(0x71E5)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[list(_SPACE)] = 0
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACE)] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the splitmix64 finaliser)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def _pow(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * _powers[-1] * _ODD])
    return _powers


def encoded(texts: list[str | None]) -> list[bytes]:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return [b"" if t is None else t.encode("utf-8", "replace").lower() for t in texts]


def spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the words of one text begin and end."""
    sp = np.ones(len(raw) + 2, bool)
    sp[1:-1] = _IS_SPACE[np.frombuffer(raw, np.uint8)]
    turn = np.flatnonzero(sp[1:] != sp[:-1])
    return turn[::2], turn[1::2]


def hash_words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin (one offset more than texts)."""
    lens = np.fromiter(map(len, raws), np.int64, len(raws))
    begin = np.zeros(len(raws) + 1, np.int64)
    np.cumsum(lens + 1, out=begin[1:])
    buf = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    sp = np.ones(len(buf) + 1, bool)
    sp[1:] = _IS_SPACE[buf]
    starts = np.flatnonzero(sp[:-1] & ~sp[1:])
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(raws) + 1, np.int64)
    first = starts[0]
    body = buf[first:]
    size = np.diff(np.append(starts, len(buf)))
    at = np.arange(len(body), dtype=np.int64) - np.repeat(starts - first, size)
    words = np.add.reduceat(_BYTE[body] * _pow(int(size.max()))[at], starts - first)
    return mix(words), np.searchsorted(starts, begin)


def shingle(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text; with fewer words than n, of the whole sequence."""
    if not len(words):
        return words
    n_all = len(words)
    k = min(n, n_all)
    out = np.full(n_all - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        out = mix(out * _ODD + words[j : n_all - k + 1 + j])
    return out


def shingle_all(words: np.ndarray, n: int) -> np.ndarray:
    """Shingle hashes from every position that has n words left in the array, texts not told apart."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    out = np.full(m, np.uint64(n), np.uint64)
    for j in range(n):
        out = mix(out * _ODD + words[j : m + j])
    return out


def chunks(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    """Index ranges of about CHUNK bytes; a longer text is one by itself."""
    a = total = 0
    for i, r in enumerate(raws):
        if total and total + len(r) > CHUNK:
            yield a, i
            a, total = i, 0
        total += len(r) + 1
    if a < len(raws):
        yield a, len(raws)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that at its end gives freed memory back to the system: workers live on, and an executor's heap has little room beside them."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return task
