"""Word shingles of whole texts as 64-bit hashes, computed for many documents at once with numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from papyrine.llm.common import LOWER, UPPER

#: Words of a shingle; bytes of text that are hashed together.
SHINGLE, CHUNK = 5, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.full(n, _BASE, np.uint64)
    q = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p), np.cumprod(q)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many words each text has."""
    lens = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b" ".join(texts).translate(_FOLD) + b" ", np.uint8)
    blank = _SPACE[data]
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = 1 << max(20, int(len(data)).bit_length())
    p, q = _powers(n)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
    words = mix((total[end] - total[start]) * q[start])
    text_end = np.cumsum(lens + 1)
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, text_end)]))
    return words, counts


def _combine(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = mix(out * np.uint64(_BASE) + words[j : j + n])
    return out


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its SHINGLE-word shingles; of fewer words the whole sequence is one;
    without words the set is empty."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    a = 0
    while a < len(coded):
        b, size = a, 0
        while b < len(coded) and (b == a or size + len(coded[b]) <= CHUNK):
            size += len(coded[b])
            b += 1
        words, counts = word_hashes(coded[a:b])
        at = 0
        whole = _combine(words, SHINGLE) if len(words) >= SHINGLE else np.zeros(0, np.uint64)
        for n in counts.tolist():
            if n >= SHINGLE:
                out.append(np.unique(whole[at : at + n - SHINGLE + 1]))
            else:
                out.append(_combine(words[at : at + n], n) if n else np.zeros(0, np.uint64))
            at += n
        a = b
    return out
