"""Whole-text word hashing in vectorised numpy.

A word is a maximal run of ASCII letters, digits and underscores or of non-ASCII characters other than
general punctuation and no-break signs; every character of the CJK blocks is a word of its own. ASCII and
Latin-1 letters are folded to lower case. Words get 64-bit hashes: a polynomial over their bytes, taken from
one prefix sum over the whole batch, then mixed. Nothing is done per word in Python.
"""

from __future__ import annotations

import functools

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, _INV):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte, first word of each text and one more, first byte of each text and one more).

    The bytes are those of the texts in UTF-8, each followed by a newline."""
    coded = [t.encode("utf-8", "replace") for t in texts]
    firsts = np.zeros(len(coded) + 1, np.int64)
    np.cumsum([len(c) + 1 for c in coded], out=firsts[1:])
    raw = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    if len(raw) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(coded) + 1, np.int64), firsts
    low = _FOLD[raw]
    inside = _LETTER[raw]
    breaks = None
    if (raw >= 0xC2).any():
        nxt = np.empty_like(raw)
        nxt[:-1], nxt[-1] = raw[1:], 0
        c3 = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        low[c3] += 0x20
        c2 = np.flatnonzero(raw == 0xC2)
        inside[c2] = False
        inside[c2 + 1] = False
        e2 = np.flatnonzero((raw == 0xE2) & (nxt == 0x80))
        for i in range(3):
            inside[e2 + i] = False
        cjk = (raw >= 0xE3) & (raw <= 0xED)
        breaks = cjk if cjk.any() else None
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    if breaks is not None:
        start |= breaks
        end[:-1] |= inside[:-1] & breaks[1:]
        after = np.flatnonzero(breaks) + 3
        after = after[after < len(raw)]
        start[after] |= inside[after]
        end[after - 1] |= True
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = powers(1 << max(16, int(len(raw)).bit_length()))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + U64(1)) * power[: len(raw)], out=total[1:])
    h = mix((total[e] - total[s]) * inverse[s])
    return h, s, e, np.searchsorted(s, firsts), firsts


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of every text, and where each text's begin; a text of 1 to k-1 words has one shingle of them all."""
    n = np.diff(first)
    x = np.zeros(len(h), np.uint64)
    m = len(h) - k + 1
    if m > 0:
        acc = h[:m].copy()
        for i in range(1, k):
            acc = acc * U64(0xD6E8FEB86659FD93) + h[i : i + m]
        x[:m] = mix(acc)
    keep = np.ones(len(h), bool)
    short = np.flatnonzero(n < k)
    ends = first[1:][n >= k]
    for i in range(1, k):
        keep[ends - i] = False
    for d in short:
        a, b = first[d], first[d + 1]
        if b > a:
            acc = h[a : a + 1].copy()
            for i in range(a + 1, b):
                acc = acc * U64(0xD6E8FEB86659FD93) + h[i : i + 1]
            x[a] = mix(acc ^ U64(b - a))[0]
            keep[a + 1 : b] = False
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.where(n >= k, n - k + 1, np.minimum(n, 1)), out=at[1:])
    return x[keep], at


def batches(texts: list[str], most: int = 1 << 18):
    """Slices of texts of about so many characters; a longer text is a slice of its own."""
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)
