"""Word shingles as sorted arrays of distinct 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

LONG = 64                                           # bytes of a word that is hashed by blocks
KEYS = (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)     # two independent word hashes: sets that must be equal agree under both
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
CHUNK = 1 << 20  # bytes hashed together


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _word_hashes(data: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word and its keyed hash; words are maximal runs without ASCII white space.

    A word of up to ``LONG`` bytes runs through ``mix`` eight bytes at a time, each step a bijection of the state, so no sums or
    powers can cancel; a longer one has a keyed cryptographic digest.
    """
    b = np.frombuffer(data, np.uint8)
    if not b.size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = np.concatenate(([False], ~_SPACE[b], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    size = stop - start
    padded = np.concatenate((b, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    h = mix(size.astype(np.uint64) + np.uint64(KEYS[seed]))
    short = size <= LONG
    for at in range(0, LONG, 8):
        some = np.flatnonzero(short & (size > at))
        if not some.size:
            break
        block = np.ascontiguousarray(eight[start[some] + at]).view("<u8").ravel()
        left = np.minimum(size[some] - at, 8).astype(np.uint64)
        block = block & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        h[some] = mix(h[some] ^ block) + np.uint64(_BASE)
    for i in np.flatnonzero(~short).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i]:stop[i]], digest_size=8, key=KEYS[seed].to_bytes(8, "little")).digest(), "little")
    return start, h


def shingle_sets(texts: list[str | None], n: int, seed: int = 0) -> list[np.ndarray]:
    """The set of each text: distinct ``n``-word shingles, A-Z lower-cased; with fewer words the whole sequence is the only one.
    ``seed`` picks one of two independent hashes.

    A null text, an empty one and one of white space have the empty set.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        group.append((t or "").encode("utf-8", "surrogatepass").lower())
        size += len(group[-1]) + 1
        if size >= CHUNK or i + 1 == len(texts):
            out += _sets(group, n, seed)
            group, size = [], 0
    return out


def _sets(group: list[bytes], n: int, seed: int) -> list[np.ndarray]:
    start, word = _word_hashes(b"\n".join(group), seed)
    ends = np.cumsum([len(g) + 1 for g in group])
    first = np.concatenate(([0], np.searchsorted(start, ends)))
    h = mix(word + np.uint64(n))
    for k in range(1, n):
        h = mix(h[: len(word) - k] * np.uint64(_BASE) + word[k:]) if len(word) > k else h[:0]
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            s = np.sort(h[a : b - n + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            v = np.full(1, b - a, np.uint64)
            for w in word[a:b]:
                v = mix(v * np.uint64(_BASE) + w)
            sets.append(v)
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
