"""Sorted suffixes with common prefixes by external induced sorting, to a bounded depth.

Suffixes are L or S by how they compare with the next one; the leftmost S of each run (S*) are sorted first.  Then all others are
induced: when suffix i leaves the queue in order, suffix i - 1 enters the bucket of its first byte.  The queue is a bucket
priority queue: 257 first-in first-out runs of tuples ``(position, common prefix with the tuple before it)`` that move to
anonymous files when they exceed a memory bound, and are only ever appended to and read in order.  Common prefixes are carried:
two suffixes induced next to each other share one byte more than the least prefix among the tuples that left between them.

Order is exact to ``depth`` bytes; beyond it suffixes count as equal.  The reduced problem, the order of the S* suffixes, is
therefore solved by at most ``depth / 8`` rounds that refine equal ones by their next eight bytes, instead of deeper levels.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY = 256 << 20   # bytes of queued tuples before runs move to files
BATCH = 1 << 19      # tuples that leave the queue together


class Runs:
    """First-in first-out runs of tuples by bucket, in memory up to a bound, then in files."""

    def __init__(self, buckets: int, memory: int):
        self.memory, self.held = memory, 0
        self.chunks: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(buckets)]
        self.files: dict[int, list] = {}  # file, sizes of its blocks, place of the next block to read

    def push(self, bucket: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.chunks[bucket].append((at, lcp))
        self.held += at.nbytes + lcp.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        for bucket in sorted(range(len(self.chunks)), key=lambda b: -sum(len(c[0]) for c in self.chunks[b])):
            if self.held <= self.memory // 2:
                return
            f = self.files.setdefault(bucket, [tempfile.TemporaryFile(), [], 0])
            f[0].seek(0, 2)
            for at, lcp in self.chunks[bucket]:
                f[0].write(at.tobytes() + lcp.tobytes())
                f[1].append(len(at))
                self.held -= at.nbytes + lcp.nbytes
            self.chunks[bucket] = []

    def pop(self, bucket: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The oldest tuples of a bucket, up to about a batch; None when it is empty."""
        f = self.files.get(bucket)
        if f and f[1]:
            n = f[1].pop(0)
            f[0].seek(f[2])
            raw = f[0].read(9 * n)
            f[2] += 9 * n
            return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, n, 8 * n)
        held = self.chunks[bucket]
        if not held:
            return None
        take, size = 0, 0
        while take < len(held) and (take == 0 or size + len(held[take][0]) <= BATCH):
            size += len(held[take][0])
            take += 1
        part, self.chunks[bucket] = held[:take], held[take:]
        self.held -= sum(a.nbytes + b.nbytes for a, b in part)
        return part[0] if take == 1 else (np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part]))

    def close(self) -> None:
        for f, _, _ in self.files.values():
            f.close()


class _Least:
    """Range minima of a batch of common prefixes, by a table over powers of two."""

    def __init__(self, lcp: np.ndarray):
        self.rows = [lcp]
        while 2 << (len(self.rows) - 1) <= len(lcp):
            r, h = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(r[:-h], r[h:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima over ``lo..hi`` inclusive, with ``lo <= hi``."""
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.uint8)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            r = self.rows[level]
            out[at] = np.minimum(r[lo[at]], r[hi[at] - (1 << int(level)) + 1])
        return out


class _Induction:
    """One pass over the queue: takes tuples in order and appends the suffixes before them."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, depth: int, memory: int):
        self.text, self.wanted, self.depth = text, wanted, depth
        self.runs = Runs(257, memory)
        self.since = np.full(257, 255, np.uint8)  # least prefix since a bucket was last appended to
        self.used = np.zeros(257, bool)

    def feed(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """``lcp[0]`` is the common prefix with the last tuple of the batch before."""
        before = at - 1
        ok = np.flatnonzero((at > 0) & self.wanted[before])
        overall = lcp.min(initial=255)
        if not ok.size:
            np.minimum(self.since, overall, out=self.since)
            return
        p = before[ok]
        bucket = self.text[p]
        order = np.argsort(bucket, kind="stable")
        ok, p, bucket = ok[order], p[order], bucket[order]
        first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
        least = _Least(lcp)
        value = np.empty(len(ok), np.uint8)
        rest = np.flatnonzero(~first)
        value[rest] = least(ok[rest - 1] + 1, ok[rest])
        heads = np.flatnonzero(first)
        names = bucket[heads]
        value[heads] = np.minimum(self.since[names], least(np.zeros(len(heads), np.int64), ok[heads]))
        value = np.minimum(value, self.depth - 1) + np.uint8(1)
        value[heads[~self.used[names]]] = 0
        ends = np.concatenate((heads[1:], [len(ok)]))
        tail = ok[ends - 1]
        np.minimum(self.since, overall, out=self.since)
        self.since[names] = 255
        inner = tail + 1 < len(lcp)
        if inner.any():
            self.since[names[inner]] = least(tail[inner] + 1, np.full(int(inner.sum()), len(lcp) - 1))
        self.used[names] = True
        for name, a, b in zip(names.tolist(), heads.tolist(), ends.tolist()):
            self.runs.push(name, p[a:b], value[a:b])


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next (S); the last suffix, the end mark, is S."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    rises = text[differs] < text[differs + 1]
    after = np.searchsorted(differs, np.arange(n - 1))
    out = np.ones(n, bool)
    out[:-1] = rises[after]
    return out


def _bit_length(x: np.ndarray) -> np.ndarray:
    high = x >> np.uint64(32)
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])


def _order_stars(text: np.ndarray, stars: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes in order to ``depth``, and the common prefix of each with the one before."""
    found = np.bincount(text, minlength=257) > 0
    if found.sum() <= 256:  # symbols, with the end mark as 0, fit one byte each
        data, per = (np.cumsum(found) - 1).astype(np.uint8)[text], 8
    else:
        data, per = text.astype(">u2"), 4
    rounds = -(-depth // per)
    data = np.concatenate((data, np.zeros(per * rounds + per, data.dtype)))
    words = np.lib.stride_tricks.sliding_window_view(data, per)
    order, lcp = stars, np.zeros(len(stars), np.int64)
    lcp_known = np.zeros(len(stars), bool)
    lcp_known[:1] = True
    groups = np.zeros(len(stars), np.int64)
    tied = np.arange(len(stars))
    for r in range(rounds):
        if not tied.size:
            break
        key = np.ascontiguousarray(words[np.minimum(order[tied] + per * r, len(words) - 1)]).view(">u8").ravel().astype(np.uint64)
        idx = np.lexsort((key, groups[tied]))
        order[tied], key = order[tied][idx], key[idx]
        g = groups[tied]  # groups are contiguous and ascending, so their places do not change
        same_group = np.concatenate(([False], g[1:] == g[:-1]))
        apart = same_group & np.concatenate(([False], key[1:] != key[:-1]))
        x = key[apart] ^ key[np.flatnonzero(apart) - 1]
        lcp[tied[apart]] = per * r + (64 - _bit_length(x)) // (64 // per)
        lcp_known[tied[apart]] = True
        new = np.cumsum(~same_group | apart)
        groups[tied] = new
        alone = np.concatenate((new[1:] != new[:-1], [True])) & np.concatenate(([True], new[1:] != new[:-1]))
        tied = tied[~alone]
    lcp[~lcp_known] = depth
    return order, np.minimum(lcp, depth).astype(np.uint8)


def _runs_at(text: np.ndarray, at: int, depth: int) -> int:
    part = text[at : at + depth]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if other.size else len(part)


def sorted_suffixes(data: np.ndarray, depth: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield, first byte by first byte, the start positions of all suffixes of ``data`` (uint8) in order and the length of the
    prefix each shares with the one before it, up to ``depth`` (at most 254).  Equal to ``depth`` bytes: any order.  The first of
    each yield has 0.  Empty data yields nothing.  A shared prefix may run past the end of ``data`` only through an end mark,
    which equals nothing."""
    n = len(data)
    if not n:
        return
    text = np.empty(n + 1, np.uint16)
    text[:n] = data
    text[:n] += 1
    text[n] = 0
    s = _types(text)
    is_star = s.copy()
    is_star[1:] &= ~s[:-1]
    is_star[0] = False
    stars, star_lcp = _order_stars(text, np.flatnonzero(is_star).astype(np.int64), depth)
    star_name = text[stars]
    cuts = np.searchsorted(star_name, np.arange(258))

    up = _Induction(text, ~s, depth, memory)
    larger: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(257)]
    for c in range(257):
        fresh, last = True, -1
        while (got := up.runs.pop(c)) is not None:
            at, lcp = got
            larger[c].append(got)
            lcp = lcp.copy()
            if fresh:
                lcp[0], fresh = 0, False
            last = int(at[-1])
            up.feed(at, lcp)
        a, b = cuts[c], cuts[c + 1]
        for i in range(a, b, BATCH):
            at, lcp = stars[i : min(b, i + BATCH)], star_lcp[i : min(b, i + BATCH)].copy()
            if i == a:
                lcp[0] = 0 if last < 0 else min(_runs_at(text, last, depth), _runs_at(text, int(at[0]), depth))
            up.feed(at, lcp)
    up.runs.close()

    down = _Induction(text, s, depth, memory)
    parts: list[tuple[np.ndarray, np.ndarray] | None] = [None] * 257
    for c in range(256, -1, -1):
        smaller, link, last = [], 0, -1  # link: prefix of the next tuple with the one before it, in falling order
        while (got := down.runs.pop(c)) is not None:
            smaller.append(got)
            lcp = got[1].copy()
            if last < 0:
                lcp[0] = 0
            last = int(got[0][-1])
            down.feed(got[0], lcp)
        if c == 0:  # the end mark itself
            down.feed(np.array([n], np.int64), np.zeros(1, np.uint8))
            continue
        l_at = np.concatenate([x[0] for x in larger[c]]) if larger[c] else np.empty(0, np.int64)
        l_lcp = np.concatenate([x[1] for x in larger[c]]) if larger[c] else np.empty(0, np.uint8)
        larger[c] = []
        if l_at.size and last >= 0:
            link = min(_runs_at(text, last, depth), _runs_at(text, int(l_at[-1]), depth))
        back = np.concatenate(([np.uint8(link)], l_lcp[:0:-1])) if l_at.size else l_lcp
        for i in range(0, len(l_at), BATCH):
            down.feed(l_at[::-1][i : i + BATCH], back[i : i + BATCH])
        s_at = np.concatenate([x[0] for x in smaller])[::-1] if smaller else np.empty(0, np.int64)
        s_lcp = np.concatenate([x[1] for x in smaller]) if smaller else np.empty(0, np.uint8)
        s_up = np.concatenate(([np.uint8(link)], s_lcp[:0:-1])) if s_at.size else s_lcp
        if l_at.size:
            l_lcp = l_lcp.copy()
            l_lcp[0] = 0
        if s_at.size + l_at.size:
            parts[c] = np.concatenate((l_at, s_at)), np.concatenate((l_lcp, s_up))
    down.runs.close()
    for c in range(1, 257):
        if parts[c] is not None:
            yield parts[c]
            parts[c] = None
