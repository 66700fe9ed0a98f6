"""Hashes of the words of many texts at once. A word is a run of letters and digits, lower-cased."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(1)
def _in_word() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalnum() for c in range(0x110000)), bool)


class _Powers:
    """Powers of a number modulo 2^64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = np.uint64(pow(self.base, len(self.values), 1 << 64))
            self.values = np.concatenate([self.values, self.values * step])
        return self.values[:n]


_powers, _inverses = _Powers(_BASE), _Powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where each text's words begin (one number more than texts)."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer((" ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _in_word()[codes]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    begin, end = edge[::2], edge[1::2]
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers.upto(len(codes)), out=total[1:])
    length = (end - begin).astype(np.uint64)
    hashes = mix((total[end] - total[begin]) * _inverses.upto(len(codes))[begin] + length)
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1)])
    return hashes, np.searchsorted(begin, first)


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of runs of ``n`` words; fewer words are one run."""
    k = min(n, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    m = len(words) - k + 1
    total = np.full(m, k, np.uint64)
    for i in range(k):
        total = mix(total + words[i:i + m])
    return total


def stem_hashes(texts: list[str], lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and of their first letters as far as ``lengths`` say (0 where the word is no longer than that), a row
    a word; and where each text's words begin (one number more than texts)."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer((" ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    edge = np.flatnonzero(np.diff(_in_word()[codes].view(np.int8), prepend=0))
    begin, end = edge[::2], edge[1::2]
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers.upto(len(codes)), out=total[1:])
    scale = _inverses.upto(len(codes))[begin]
    out = np.zeros((len(begin), 1 + len(lengths)), np.uint64)
    out[:, 0] = mix((total[end] - total[begin]) * scale + (end - begin).astype(np.uint64))
    for k, n in enumerate(lengths, 1):
        long = end - begin > n
        out[long, k] = mix((total[begin[long] + n] - total[begin[long]]) * scale[long] + np.uint64(n + (1 << 40)))
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1)])
    return out, np.searchsorted(begin, first)
