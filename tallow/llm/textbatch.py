"""Vectorised word work on Arrow batches of texts.

A text column arrives as one byte buffer plus offsets.  All functions here
work on whole buffers with numpy: byte classes by lookup table, words as runs
of one class, and a hash of every word from running sums.

A word's hash is the polynomial of its bytes modulo the prime 2^61 - 1 at a
random base, spread over 64 bits by a one-to-one finaliser: two given words of
m letters share it with probability m / 2^61, whatever their pattern (modulo
2^64, Thue-Morse words would collide at every base).  A second base gives an
independent hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = (1 << 61) - 1
_BASE = [int(x) for x in _RNG.integers(1 << 32, _PRIME, 2, dtype=np.uint64)]
_pow: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

#: Bytes handled at once; bounds the memory of the running sums.
CHUNK = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words between white space: everything but space, tab and the line breaks.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Words of letters and digits after lower-casing: 0-9, a-z and all non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x >> np.uint64(61)) + (x & np.uint64(_PRIME))
    return np.where(x >= np.uint64(_PRIME), x - np.uint64(_PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b modulo the prime, for reduced a and b, by 31-bit limbs."""
    m31, m30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    ah, al, bh, bl = a >> np.uint64(31), a & m31, b >> np.uint64(31), b & m31
    mid = al * bh + ah * bl
    return _fold(ah * bh * np.uint64(2) + (mid >> np.uint64(30)) + ((mid & m30) << np.uint64(31)) + al * bl)


def _power_row(base: int, n: int) -> np.ndarray:
    row = np.ones(1, np.uint64)
    while len(row) < n:
        row = np.concatenate([row, _times(row, np.array([pow(base, len(row), _PRIME)], np.uint64))])
    return row[:n]


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low 32 and high 29 bits of the base's powers, and the powers of its inverse."""
    if base not in _pow or len(_pow[base][0]) < n:
        size = max(n, CHUNK + 1)
        up = _power_row(_BASE[base], size)
        _pow[base] = up & np.uint64(0xFFFFFFFF), up >> np.uint64(32), _power_row(pow(_BASE[base], -1, _PRIME), size)
    return _pow[base]


#: A run of more codes than this is summed in pieces: 2^32 times a code below 2^11 times 2^20 codes stays below 2^63.
_LONG = 1 << 20


def run_hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """64-bit hashes of the runs code[start : end]; codes are less than 2^11, 0 counts as 1 more than nothing."""
    low, high, down = _powers(len(code) + 1, base)
    value = code.astype(np.uint64) + np.uint64(1)
    sums = []
    for part in (low, high):
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(value * part[: len(code)], out=total[1:])  # may wrap; the differences below do not
        sums.append(total)
    shift = np.full(1, 1 << 32, np.uint64)
    span = lambda s, e: _fold(_times(_fold(sums[1][e] - sums[1][s]), shift) + _fold(sums[0][e] - sums[0][s]))
    found = span(start, np.minimum(end, start + _LONG))
    for i in np.flatnonzero(end - start > _LONG).tolist():
        for s in range(int(start[i]) + _LONG, int(end[i]), _LONG):
            found[i] = (int(found[i]) + int(span(np.array([s]), np.array([min(s + _LONG, int(end[i]))]))[0])) % _PRIME
    return mix(_times(found, down[start]))


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts of about size bytes.

    A null text is an empty one.  A text is never split: a longer one
    makes a run of its own.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + size, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


class Words:
    """The words of one chunk: byte ranges, owning text, 64-bit hash (by the one base or the other)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray, lower: bool = True, base: int = 0):
        low = LOWER[data] if lower else data
        inside = np.zeros(len(low) + 2, bool)
        inside[1:-1] = kind[low]
        here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
        edge = offs[:-1][offs[:-1] < offs[-1]]
        before[edge] = False
        after[edge[edge > 0] - 1] = False
        self.start = np.flatnonzero(here & ~before)
        self.end = np.flatnonzero(here & ~after) + 1
        self.hash = run_hashes(low, self.start, self.end, base)
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.low = low
        #: Words of each text, and where each text's words begin.
        self.count = np.bincount(self.doc, minlength=len(offs) - 1).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def text(self, i: int) -> str:
        return self.low[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def shingles(data: np.ndarray, offs: np.ndarray, k: int = 5, base: int = 0) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its k-word shingles.

    Words stand between white space, A-Z lower-cased.  A text of fewer than k
    words has the whole sequence as its one shingle; one without words none.
    """
    words = Words(data, offs, NOT_SPACE, base=base)
    h, m = words.hash, len(words.hash)
    windows = np.zeros(0, np.uint64)
    if m >= k:
        windows = h[: m - k + 1] * _ODD[0]
        for j in range(1, k):
            windows = windows + h[j : m - k + 1 + j] * _ODD[j]
        windows = mix(windows)
    out = []
    for d, (a, n) in enumerate(zip(words.first.tolist(), words.count.tolist())):
        if n >= k:
            out.append(np.unique(windows[a : a + n - k + 1]))
        elif n:
            part = (h[a : a + n] * _ODD[:n]).sum(dtype=np.uint64)
            out.append(mix(np.array([part]) + _ODD[39 + n]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(tokens: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a token set and its size."""
    n = np.uint64(len(tokens))
    with np.errstate(over="ignore"):
        a = mix(np.array([mix(tokens ^ _ODD[41]).sum(dtype=np.uint64) + n * _ODD[42]], np.uint64))
    return int(a.view(np.int64)[0])
