"""Repeated strings of a text by interval expansion on its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

#: Ends a string; no UTF-8 text has this byte, and it sorts last.
STOP = 0xFF


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` sorted by their first ``depth`` (or more) bytes, ties by position, by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    known = 8
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[False], ordered[1:] != ordered[:-1]])
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint64)
        if known >= depth or int(new.sum()) == n - 1:
            return order
        ahead = np.zeros(n, np.uint64)
        ahead[: max(0, n - known)] = rank[known:] + np.uint64(1)
        key = (rank << np.uint64(32)) | ahead
        known *= 2


def repeated_prefixes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and for each place in it whether the common prefix with the place before reaches ``least``.

    Breadth first, each interval of suffixes that begin with some string is extended backwards by every byte; where an
    extension's right end has no known common prefix yet, that is the length so far. Lengths come in increasing order,
    and the search stops at ``least``: whatever is unknown then is at least as long. Strings never run over a STOP.
    """
    n = len(text)
    order = suffix_array(text, least + 1)
    before = text[order - 1]
    by_byte = np.argsort(before, kind="stable")
    back = np.empty(n, np.int64)
    back[by_byte] = np.arange(n)
    head = before[by_byte]  # first byte of each suffix, in order
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    lo, hi = np.array([0]), np.array([n - 1])
    for _ in range(least):
        if not len(lo):
            break
        size = hi - lo + 1
        total = int(size.sum())
        skip = np.repeat(np.cumsum(size) - size - lo, size)
        at = np.arange(total) - skip
        owner = np.repeat(np.arange(len(lo)), size)
        on = before[at] != STOP
        place, owner = back[at[on]], owner[on]
        if not len(place):
            break
        o = np.argsort(place, kind="stable")
        place, owner = place[o], owner[o]
        first = np.ones(len(place), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (head[place[1:]] != head[place[:-1]])
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(place)) - 1
        left, right = place[start], place[end]
        fresh = ~known[right + 1]
        known[right[fresh] + 1] = True
        lo, hi = left[fresh], right[fresh]
    return order, ~known[:n]
