"""Vectorised word hashing: no Python object per word.

A word's hash is a polynomial of its bytes modulo 2**64, taken from prefix sums, then mixed. Words are runs of
bytes other than space and \\x09-\\x0D, as bytes.split() has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True
#: Bytes hashed at once (more only for a longer single word).
SLICE = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_powers.get("up", ())) < n:
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n, SLICE + 1024), b, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _slice_hashes(arr: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    space = SPACES[arr]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(arr) + 1)
    sums = np.zeros(len(arr) + 1, dtype=np.uint64)
    np.cumsum((arr.astype(np.uint64) + np.uint64(1)) * up[: len(arr)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts]), starts + offset


def hash_words(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start offset) of each word."""
    arr = np.frombuffer(buffer, dtype=np.uint8)
    out, low = [], 0
    while low < len(arr):
        high = min(len(arr), low + SLICE)
        while high < len(arr):
            back = np.flatnonzero(SPACES[arr[low:high]])
            if len(back):
                high = low + int(back[-1]) + 1
                break
            high = min(len(arr), high + SLICE)
        out.append(_slice_hashes(arr[low:high], low))
        low = high
    if not out:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def hash_docs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and each text's number of words."""
    hashes, starts = hash_words(b"\n".join(texts))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


def chunks(texts: list[bytes], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts that hold about size bytes."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= size:
            yield low, i + 1
            low, held = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def rolling(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; salt gives independent ones."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = mix64(hashes ^ np.uint64(salt)) if salt else hashes
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix64((sums[k:] - sums[:n]) * down[:n] + np.uint64(k))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values of x: by a sort, much faster on hashes than numpy's own."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), dtype=bool), x[1:] != x[:-1]])]


def index_distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values of x, a place of each, for each element the index of its value)."""
    order = np.argsort(x)
    x = x[order]
    first = np.concatenate([np.ones(min(1, len(x)), dtype=bool), x[1:] != x[:-1]])
    inverse = np.empty(len(x), dtype=np.int32)
    inverse[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return x[first], order[first], inverse
