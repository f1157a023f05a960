"""Vectorised hashes of the words of many texts at once.

Everything works on the UTF-8 bytes of a block of texts: a polynomial prefix hash gives each word's
hash by one subtraction, and Rabin-Karp composition gives the hash of each run of k words.
"""

from __future__ import annotations

import hashlib

import numpy as np

CHUNK = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_POWERS = np.concatenate([[np.uint64(1)], np.full(CHUNK, _MULTIPLIER, np.uint64)]).cumprod(dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Where words `[^\\x20\\x09-\\x0D]+` start and end (with letters: runs without ASCII punctuation); no word crosses from one text to the next."""
    space = (_PUNCTUATION if letters else _SPACE)[data]
    inner = offsets[1:-1]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = True
        before[1:] = space[:-1]
        after[:-1] = space[1:]
        before[inner[inner < len(data)]] = True
        after[inner[inner > 0] - 1] = True
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of each span of bytes; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    values = _LOWER if lower else _BYTE
    lo = 0
    while lo < len(starts):
        at = starts[lo]
        hi = int(np.searchsorted(ends, at + CHUNK, "right"))
        if hi <= lo:  # a span longer than a chunk
            raw = data[at : ends[lo]].tobytes()
            out[lo] = int.from_bytes(hashlib.blake2b(raw.lower() if lower else raw, digest_size=8).digest(), "little")
            lo += 1
            continue
        sums = np.zeros(ends[hi - 1] - at + 1, np.uint64)
        np.cumsum(values[data[at : ends[hi - 1]]] * _POWERS[: ends[hi - 1] - at], out=sums[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = mix((sums[e] - sums[s]) * _POWERS[CHUNK - s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text where its words begin (one more at the end)."""
    starts, ends = word_bounds(data, offsets, letters)
    return span_hashes(data, starts, ends, lower), np.searchsorted(starts, offsets)


def runs(tokens: np.ndarray, k: int, multiplier: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """The Rabin-Karp hash of each run of k tokens, modulo 2**64: sum of token[i+j] * m**(k-1-j)."""
    if len(tokens) < k:
        return np.empty(0, np.uint64)
    n, done, out = len(tokens), 0, None
    power, size, part = int(multiplier), 1, tokens
    mask = (1 << 64) - 1
    rest = k
    while True:
        if rest & 1:
            if out is None:
                out, done = part, size
            else:  # the run so far, then `size` more tokens
                length = n - done - size + 1
                out = out[:length] * np.uint64(power) + part[done : done + length]
                done += size
        rest >>= 1
        if not rest:
            return out[: n - k + 1]
        part = part[: len(part) - size] * np.uint64(power) + part[size:]
        power, size = power * power & mask, size * 2


def sliding_min(values: np.ndarray, k: int) -> np.ndarray:
    """The least of each k consecutive values."""
    size = 1
    while size * 2 <= k:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (k - size)], values[k - size :]) if k > size else values
