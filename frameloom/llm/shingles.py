"""Word shingles of whole texts as 64-bit hashes, computed on byte buffers with numpy.

Words are maximal runs of bytes other than space and 0x09 to 0x0D after A-Z is
lower-cased. A word's hash is a polynomial over a random byte table modulo 2**64, a
shingle's hash mixes its words' hashes in order. Texts with fewer words than the
shingle size have one shingle, all their words.
"""

from __future__ import annotations

import hashlib

import numpy as np

_RANDOM = np.random.default_rng(20_240_229)
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_BREAK = np.zeros(256, bool)
_BREAK[[32, *range(9, 14)]] = True
_BASE = 0x9E37_79B9_7F4A_7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        k = 1
        while k < size:
            have[k : 2 * k] = have[:k] * np.uint64(pow(base, k, 2**64))
            k *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58_476D_1CE4_E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D0_49BB_1331_11EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_BREAK[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[raw] * _power(_BASE, len(raw)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(raw))[start])


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(size, len(w))
    out = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + w[i : len(w) - k + 1 + i]
    return np.unique(mix(out + np.uint64(k)))


def digest(sorted_set: np.ndarray) -> bytes:
    """Sixteen bytes that name the set."""
    return hashlib.blake2b(sorted_set.tobytes(), digest_size=16).digest()
