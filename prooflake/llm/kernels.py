"""Vectorised text kernels over Arrow string columns: buffers, words, hashes, shingles, BPE pre-tokens."""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call handles at once (one longer text makes a call of its own).
CALL_BYTES = 512 << 10
U = np.uint64
_P = 0x9E3779B97F4A7C55  # odd multiplier of the prefix hash
_P_INV = pow(_P, -1, 1 << 64)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, giving freed memory back to the system at its end: workers serve many tasks in turn."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass

    return lean_run


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def calls(col: pa.Array | pa.ChunkedArray, most: int = CALL_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, last row + 1, bytes, offsets) of at most ``most`` bytes or one row."""
    data, offsets = text_buffers(col)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over 64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, CALL_BYTES + 1)
        for k, base in (("p", _P), ("q", _P_INV)):
            a = np.full(size, base, U)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["q"]


def slice_hash(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every slice units[start:end], from one prefix sum over all units."""
    p, q = _powers(len(units) + 1)
    sums = np.zeros(len(units) + 1, U)
    np.cumsum((units.astype(U) + U(1)) * p[: len(units)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words ``[^\\x20\\x09-\\x0D]+``, and the first word of each row (one more at the end)."""
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    if len(data):
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_STEP = [U(pow(0xA24BAED4963EE407, k + 1, 1 << 64)) for k in range(64)]


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, U)
    out = np.zeros(len(h) - n + 1, U)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _STEP[k]
    return mix(out + U(n))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct n-word shingle hashes; with fewer words the whole sequence as one; else empty."""
    starts, ends, bounds = words(data, offsets)
    h = slice_hash(LOWER[data], starts, ends)
    grams = gram_hash(h, n)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        g = grams[a : b - n + 1] if b - a >= n else gram_hash(h[a:b], b - a) if b > a else grams[:0]
        g = np.sort(g)
        if len(g) > 1:
            g = g[np.concatenate(([True], g[1:] != g[:-1]))]
        out.append(g)
    return out


# ---- pre-tokens of the byte-level BPE pattern -----------------------------------------------------------------

_CLASS: list[np.ndarray] = []
LETTER, NUMBER, OTHER, BLANK = 1, 2, 0, 3


def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    if not _CLASS:
        c = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            k = unicodedata.category(chr(i))[0]
            if k == "L":
                c[i] = LETTER
            elif k == "N":
                c[i] = NUMBER
        c[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
        _CLASS.append(c)
    return _CLASS[0]


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the matches of the public byte-level BPE pattern, and the first match of each row (and the end).

    The pattern covers every character, so the matches are the runs of letters, numbers, other characters and white
    space, except that: a single U+0020 before a run joins it; the last character of white space that something
    follows stands alone or joins; and an apostrophe alone before s, t, re, ve, m, ll or d takes these letters.
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
    cp = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    rows = np.searchsorted(lead, offsets)  # offsets in characters
    kind = char_classes()[cp]
    fresh = np.zeros(n + 1, bool)
    fresh[rows] = True
    run = fresh[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = np.zeros(n + 1, bool)
    blank = kind == BLANK
    ended = np.ones(n, bool)  # the last character of its run
    ended[:-1] = run[1:]
    follows = ended & ~fresh[1:]  # something of the same row follows this run
    # runs that are not blank start at themselves, or at the U+0020 before them
    joined = np.zeros(n, bool)
    joined[1:] = (cp[:-1] == 32) & ~fresh[1:-1]
    start[:-1] |= run & ~blank & ~joined
    start[:-1] |= run & blank
    start[:-1] |= blank & follows
    # contractions
    p = np.flatnonzero((cp == 39) & run & ended & ~joined & follows)
    if len(p):
        wide = np.concatenate((cp, np.zeros(3, np.uint32)))
        c1, c2 = wide[p + 1], wide[p + 2]
        same = np.concatenate((~fresh[:-1], np.zeros(4, bool)))[p + 2]
        one = (c1 == 115) | (c1 == 116) | (c1 == 109) | (c1 == 100)
        two = same & (((c2 == 101) & ((c1 == 114) | (c1 == 118))) | ((c1 == 108) & (c2 == 108)))
        start[p[one | two] + 1] = False
        start[p[one] + 2] = True
        start[p[two] + 3] = True
    at = np.flatnonzero(start[:n])
    return lead[at], np.searchsorted(at, rows)
