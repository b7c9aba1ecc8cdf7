"""Vectorised hashing of words and word shingles of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: One pseudorandom 64-bit value for each byte.
_BYTE = None
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buffer[start:end) for arrays of spans, by one cumulative polynomial."""
    global _BYTE
    if _BYTE is None:
        _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    up, down = _powers(len(buffer) + 1)
    acc = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * down[:-1], out=acc[1:])
    return mix((acc[end] - acc[start]) * up[start] + (end - start).astype(np.uint64))


def words_of(text: str | None) -> bytes:
    """The text's words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, A-Z lower-cased, one space between them."""
    return b"" if not text else b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def word_spans(joined: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, first) of the words of texts that ``words_of`` made.

    Words of text i are first[i] .. first[i + 1] - 1.
    """
    buffer = np.frombuffer(b" ".join(joined) + b" ", np.uint8)
    ends = np.flatnonzero(buffer == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    limits = np.cumsum([0] + [len(x) + 1 for x in joined])
    return buffer, starts, ends, np.searchsorted(starts, limits)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; with fewer words, of all its words as one."""
    joined = [words_of(t) for t in texts]
    buffer, starts, ends, first = word_spans(joined)
    counts = np.diff(first)
    width = np.minimum(counts, k)
    n = np.where(counts > 0, counts - width + 1, 0)
    offset = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(offset[-1]) - offset[doc] + first[doc]
    h = span_hashes(buffer, starts[at], ends[at + width[doc] - 1]).view(np.int64) if len(at) else np.empty(0, np.int64)
    return [np.unique(h[a:b]) for a, b in zip(offset[:-1], offset[1:])]


def slices(lengths: list[int], most: int = 1_500_000):
    """Ranges of consecutive items whose lengths sum to about ``most``, so that work arrays stay small."""
    a = total = 0
    for b, n in enumerate(lengths):
        if total + n > most and b > a:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


def small_batches(batches, column: str, most: int = 1_000_000):
    """Arrow batches cut so that a text or binary column holds about ``most`` bytes in each: bounds a task's Python memory."""
    for batch in batches:
        for a, b in slices(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), most):
            yield batch.slice(a, b - a)
