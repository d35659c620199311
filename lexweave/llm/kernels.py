"""Vectorised text kernels over code points: words, shingles and 64-bit hashes without a Python loop per word."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np

MASK = (1 << 64) - 1


def release() -> None:
    """Gives back to the system what earlier tasks of this worker have freed."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass


RADIX = 0x9E3779B97F4A7C15 | 1
UNRADIX = pow(RADIX, -1, 1 << 64)
#: Code points worked on at once; a longer document is a chunk of its own.
CHUNK = 1 << 18


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower case (where that is one code point), and whether it belongs to words."""
    lower = np.arange(0x110000, dtype=np.uint32)
    word = np.zeros(0x110000, dtype=bool)
    for c in (*range(0xD800), *range(0xE000, 0x33480), *range(0xE0100, 0xE01F0)):  # beyond, nothing is a letter, digit or mark
        s = chr(c)
        low = s.lower()
        if len(low) == 1:
            lower[c] = ord(low)
        word[c] = s.isalnum() or unicodedata.category(s)[0] == "M"
    return lower, word


_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        m = max(n, CHUNK + 1)
        p, q = np.full(m, RADIX, np.uint64), np.full(m, UNRADIX, np.uint64)
        p[0] = q[0] = 1
        np.multiply.accumulate(p, out=p)
        np.multiply.accumulate(q, out=q)
        _POW[:] = [p, q]
    return _POW[0][:n], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about `limit` code points together, with the index of the first; null counts as ''."""
    first, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > limit:
            yield first, part
            first, size, part = i, 0, []
        part.append(t)
        size += len(t)
    if part:
        yield first, part


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text begins (one entry more than there are texts)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def span_hash(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of cp[start:end] for each span, equal for equal spans wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = powers(len(cp))
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * p, out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of texts: runs of letters, digits and marks in lower case.

    starts, ends: code points; doc: index of the text; hash: 64 bits; at: where each text's words begin.
    """

    def __init__(self, texts: list[str], hashed: bool = True):
        lower, word = _tables()
        raw, self.text_at = code_points(texts)
        self.raw = raw
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = word[raw]
        step = np.diff(inside)
        begin, end = step[:-1] == 1, step[1:] == -1
        cuts = self.text_at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        both = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # words that would run on into the next text
        begin[both] = True
        end[both - 1] = True
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.at = np.searchsorted(self.starts, self.text_at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.at))
        self.cp = lower[raw]
        self.hash = span_hash(self.cp, self.starts, self.ends) if hashed else None

    def word(self, i: int) -> str:
        return self.cp[self.starts[i] : self.ends[i]].tobytes().decode("utf-32-le", "surrogatepass")


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of k words; a text of fewer words has its whole run as the only one."""
    n, m = len(w.hash), len(w.at) - 1
    size = np.diff(w.at)
    count = np.where(size >= k, size - k + 1, (size > 0).astype(size.dtype))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    padded = np.concatenate([w.hash, np.zeros(k, np.uint64)])
    left = np.repeat(w.at[1:], size) - np.arange(n)  # words to the text's end, this one included
    for j in range(k):
        out += np.where(left > j, padded[j : j + n], np.uint64(0)) * np.uint64(pow(RADIX, j + 1, 1 << 64))
    first = np.arange(n) - np.repeat(w.at[:-1], size)
    return mix(out[first < np.repeat(count, size)]), np.repeat(np.arange(m), count)
