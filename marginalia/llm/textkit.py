"""Vectorised word and shingle kernels over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(0x5EED)
#: A random 64-bit value for each byte, and an odd base with its inverse modulo 2**64.
BYTE = _rng.integers(0, 1 << 64, 256, dtype=U)
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHINGLE = 5
_PLACE = _rng.integers(0, 1 << 64, SHINGLE, dtype=U) | U(1)

_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE, name: str = "up") -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.full(size, base, U)
        out[0] = U(1)
        with np.errstate(over="ignore"):
            have = _powers[name] = np.multiply.accumulate(out)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every bit of the input moves about half of the output's."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] the sum of BYTE[b] * BASE**place over the first i bytes."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(data) + 1, U)
        np.cumsum(BYTE[data] * powers(len(data))[: len(data)], out=out[1:])
        return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end, whatever their place."""
    with np.errstate(over="ignore"):
        return mix((h[end] - h[start]) * powers(len(h), INVERSE, "down")[start] + (end - start).astype(U))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each text and in all) of runs of bytes that are no white space."""
    body = ~SPACE[data]
    n = len(data)
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[0] = True
    first[1:] = True
    first[1:n] = ~body[:-1]
    first[offsets] = True
    last[n] = True
    last[1:n] = ~body[1:] if n else False
    last[offsets] = True
    start = np.flatnonzero(first[:n] & body)
    end = np.flatnonzero(last[1:] & body) + 1
    return start, end, np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingle hashes of each text.

    Texts are lower-cased (A-Z only). A text with one to four words has the whole sequence as its
    one shingle; a text without words has none."""
    low = LOWER[data]
    start, end, words = word_spans(low, offsets)
    h = span_hash(prefix_hash(low), start, end)
    n = np.diff(words)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    to = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(to[-1], U)
    with np.errstate(over="ignore"):
        long = n >= SHINGLE
        if long.any():
            total = len(h) - SHINGLE + 1
            s = np.zeros(total, U)
            for j in range(SHINGLE):
                s += mix(h[j : j + total] * _PLACE[j] + U(j))
            s = mix(s)
            pick = np.arange(to[-1]) - np.repeat(to[:-1] - words[:-1], count)
            keep = np.repeat(long, count)
            out[keep] = s[pick[keep]]
        for i in np.flatnonzero((n > 0) & ~long):
            s = U(n[i])
            for j in range(n[i]):
                s = s + mix(h[words[i] + j : words[i] + j + 1] * _PLACE[j] + U(j + 77))[0]
            out[to[i]] = mix(np.array([s], U))[0]
    for a, b in zip(to[:-1], to[1:]):
        out[a:b].sort()
    if not len(out):
        return out, to
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[to[:-1][count > 0]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return out[fresh], kept[to]


def ragged_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values over each range of offsets, modulo 2**64 for uint64."""
    with np.errstate(over="ignore"):
        c = np.zeros(len(values) + 1, values.dtype)
        np.cumsum(values, out=c[1:])
        return c[offsets[1:]] - c[offsets[:-1]]


def ragged_index(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, … count[0] of them, then those of start[1] …"""
    to = np.cumsum(count)
    total = int(to[-1]) if len(to) else 0
    return np.arange(total) + np.repeat(start - (to - count), count)
