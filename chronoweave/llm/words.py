"""Words of many texts at once: spans and 64-bit hashes with numpy, no loop over words."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240101)
#: A random value per byte.
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of words made of a-z, 0-9 and everything outside ASCII (after lower-casing).
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = U(base)
        have = _pow[base] = np.multiply.accumulate(have)
    return have[:n]


INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (a bijection on 64 bits)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside` bytes that don't cross a row, and the number of the first word of each row (rows + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    on = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = on[1:] != on[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    runs = on[cut[:-1]]
    starts, ends = cut[:-1][runs], cut[1:][runs]
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of which differences are polynomial hashes of any span, modulo 2**64."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers(BASE, len(data)), out=s[1:])
    return s


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    s = prefix_sums(data)
    return mix((s[ends] - s[starts]) * powers(INVERSE, len(data) + 1)[starts])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * U(BASE) + h[i : i + m]
    return mix(out)


def doc_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from the first word of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
