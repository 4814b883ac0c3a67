"""Vectorised words and word shingles over the buffers of Arrow string columns."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Odd multipliers and the byte table of the hashes, from a fixed seed.
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_SLOT = _RNG.integers(1, 2**62, 16, dtype=np.uint64) * _U(2) + _U(1)

#: A-Z as a-z, every other byte as itself.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Bytes that are in no word of the shingle contract: space, tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True

#: Bytes of words that consist of letters: a-z, A-Z and all that is not ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def lean(run):
    """Gives memory back once a partition is through: an idle worker keeps none of what it used."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def pieces(texts: pa.Array, limit: int = 1 << 20):
    """(first row, last row + 1, bytes, offsets) over slices of about limit bytes; null counts as empty.

    A text longer than limit is a slice of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def spans(data: np.ndarray, off: np.ndarray, w: np.ndarray):
    """(start, end, row) of each maximal run of bytes where w holds; a run never crosses rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = w[heads]
    tails = off[1:][off[:-1] < off[1:]] - 1
    last[tails] = w[tails]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, np.searchsorted(off, a, "right") - 1


_POW = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        p = np.full(max(n, 64), _STEP, np.uint64)
        p[0] = 1
        _POW = np.multiply.accumulate(p)
    return _POW


def hash_runs(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[a:b] of each run, A-Z folded."""
    size = b - a
    if not len(a):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(size)
    starts = ends - size
    pos = np.arange(ends[-1]) - np.repeat(starts, size)
    byte = _BYTE[FOLD][data[pos + np.repeat(a, size)]]
    return mix(np.add.reduceat(byte * _powers(int(size.max()))[pos], starts) + size.astype(np.uint64) * _SLOT[15])


def shingles(data: np.ndarray, off: np.ndarray, width: int = 5):
    """(row, hash) of the distinct word shingles of each row, ordered by row and then hash.

    Words are runs of bytes outside SPACES, A-Z folded. A row with fewer words
    than width has one shingle of all of them; a row without words has none.
    """
    a, b, row = spans(data, off, ~SPACES[data])
    h = hash_runs(data, a, b)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows, hashes = [], []
    if n >= width:
        full = row[: n - width + 1] == row[width - 1 :]
        s = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            s += h[j : n - width + 1 + j] * _SLOT[j]
        rows.append(row[: n - width + 1][full])
        hashes.append(mix(s[full]))
    count = np.bincount(row, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    for r in np.flatnonzero((count > 0) & (count < width)):
        own = h[first[r] : first[r] + count[r]]
        with np.errstate(over="ignore"):
            s = np.uint64(len(own)) * _SLOT[14] + (own * _SLOT[: len(own)]).sum(dtype=np.uint64)
        rows.append(np.array([r]))
        hashes.append(mix(np.array([s], np.uint64)))
    r, s = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((s, r))
    r, s = r[order], s[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
    return r[new], s[new]


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters, near enough: a-z and all that is not ASCII, but signs of Latin-1 and general punctuation."""
    w = LETTERS[data]
    at = np.flatnonzero((data == 0xC2) | (data == 0xE2))
    if len(at):
        nxt = data[np.minimum(at + 1, len(data) - 1)]
        sign = at[(data[at] == 0xC2) & (nxt != 0xAA) & (nxt != 0xB5) & (nxt != 0xBA)]
        mark = at[(data[at] == 0xE2) & (nxt < 0xB0)]
        for lead, size in ((sign, 2), (mark, 3)):
            for k in range(size):
                w[np.minimum(lead + k, len(data) - 1)] = False
    return w


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in lower case."""
    out = FOLD[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    up = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[up] += 32
    return out
