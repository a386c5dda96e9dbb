"""Suffix order of a byte text by external induced sorting, in numpy blocks.

The tuples of a suffix wait in a monotone priority queue: one append-only bucket
per first byte, kept in memory up to a budget and on disk beyond it. Scanning the
buckets upwards induces the L-suffixes, scanning them downwards the S-suffixes;
a whole bucket is taken out, looked up and dealt to later buckets at a time.
The leftmost S-suffixes are sorted first: one induction orders their substrings,
equal ones get equal names, and the string of names is sorted to the wanted depth.
The text may be a memory map, so a shard can be far larger than memory.
"""

from __future__ import annotations

import tempfile

import numpy as np


class Buckets:
    """256 append-only queues of positions; the largest ones go to disk beyond ``budget`` bytes in memory."""

    def __init__(self, budget: int, dtype: np.dtype):
        self.budget, self.dtype = budget, dtype
        self.held: list[list[np.ndarray]] = [[] for _ in range(256)]
        self.bytes = np.zeros(256, dtype=np.int64)
        self.files: dict[int, object] = {}

    def put(self, c: int, block: np.ndarray) -> None:
        self.held[c].append(block)
        self.bytes[c] += block.nbytes
        if self.bytes.sum() > self.budget:
            largest = int(self.bytes.argmax())
            out = self.files.setdefault(largest, tempfile.TemporaryFile())
            for x in self.held[largest]:
                out.write(np.ascontiguousarray(x).data)
            self.held[largest], self.bytes[largest] = [], 0

    def deal(self, positions: np.ndarray, firsts: np.ndarray) -> None:
        """Append each position to the bucket of its first byte, keeping the order."""
        if not len(positions):
            return
        order = np.argsort(firsts, kind="stable")
        counts = np.bincount(firsts, minlength=256)
        dealt, at = positions[order], 0
        for c in np.flatnonzero(counts):
            self.put(int(c), dealt[at:at + counts[c]])
            at += counts[c]

    def all(self, c: int) -> np.ndarray:
        parts = []
        if c in self.files:
            f = self.files[c]
            f.seek(0)
            parts.append(np.frombuffer(f.read(), dtype=self.dtype))
            f.seek(0, 2)
        parts += self.held[c]
        return np.concatenate(parts) if parts else np.zeros(0, self.dtype)

    def since(self, c: int, seen: int) -> np.ndarray:
        """What was appended to a bucket after its first ``seen`` positions."""
        return self.all(c)[seen:]

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for S-suffixes (smaller than the next suffix); the last one, followed by nothing, is not."""
    n = len(text)
    rises, falls = np.empty(n, bool), np.empty(n, bool)
    rises[:-1], falls[:-1] = text[:-1] < text[1:], text[:-1] > text[1:]
    rises[-1], falls[-1] = False, True
    decided = np.where(rises | falls, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(decided[::-1])[::-1]
    return rises[nearest]


def _induce(text: np.ndarray, leftmost: np.ndarray, budget: int) -> tuple[Buckets, Buckets]:
    """L- and S-buckets (the latter backwards) from the leftmost S-suffixes in their order."""
    dtype = leftmost.dtype
    seeds, low, high = Buckets(budget, dtype), Buckets(budget, dtype), Buckets(budget, dtype)
    seeds.deal(leftmost, text[leftmost])
    last = np.array([len(text) - 1], dtype=dtype)
    low.deal(last, text[last])  # what follows the last byte is smaller than all, and induces it first
    for c in range(256):
        seen = 0
        while len(block := low.since(c, seen)):
            seen += len(block)
            before = block[block > 0] - 1
            first = text[before]
            keep = first >= c
            low.deal(before[keep], first[keep])
        block = seeds.all(c)
        before = block[block > 0] - 1
        first = text[before]
        keep = first > c
        low.deal(before[keep], first[keep])
    seeds.close()
    for c in range(255, -1, -1):
        seen = 0
        while len(block := high.since(c, seen)):
            seen += len(block)
            before = block[block > 0] - 1
            first = text[before]
            keep = first <= c
            high.deal(before[keep], first[keep])
        block = low.all(c)[::-1]
        before = block[block > 0] - 1
        first = text[before]
        keep = first < c
        high.deal(before[keep], first[keep])
    return low, high


def _ordered(low: Buckets, high: Buckets) -> np.ndarray:
    out = np.concatenate([x for c in range(256) for x in (low.all(c), high.all(c)[::-1])])
    low.close()
    high.close()
    return out


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number; the text must have eight bytes to spare."""
    return np.ndarray((len(text) - 7,), dtype="<u8", buffer=np.ascontiguousarray(text), strides=(1,))


def _names(text: np.ndarray, leftmost: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Equal names for equal substrings from one leftmost S-suffix to the next, numbered in their order."""
    n = len(text)
    rank_of = np.full(n, -1, dtype=np.int64)
    rank_of[leftmost] = np.arange(len(leftmost))
    index = rank_of[ordered]
    stop = np.append(leftmost[1:] + 1, n)
    length = (stop - leftmost)[index]
    padded = np.concatenate([text, np.zeros(8, text.dtype)])
    words = words_at(padded)
    same = np.zeros(len(ordered), bool)
    same[1:] = (length[1:] == length[:-1]) & (index[1:] != len(leftmost) - 1) & (index[:-1] != len(leftmost) - 1)
    left, done = np.flatnonzero(same), 0
    while len(left):
        a, b, rest = ordered[left].astype(np.int64) + done, ordered[left - 1].astype(np.int64) + done, length[left] - done
        gap = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        gap = np.where(rest < 8, gap & ((np.uint64(1) << (np.minimum(rest, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)), gap)
        same[left[gap != 0]] = False
        left, done = left[(gap == 0) & (rest > 8)], done + 8
    names = np.empty(len(leftmost), dtype=np.int64)
    names[index] = np.cumsum(~same)
    return names


def _sort_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by at least ``depth`` names (prefix doubling of what is still equal)."""
    n, span = len(names), 1
    order = np.argsort(names)
    new = np.concatenate([[True], np.diff(names[order]) != 0])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # where those that are equal so far begin
    left = np.flatnonzero(~(new & np.append(new[1:], True)))
    while span < depth and len(left):
        own = order[left]
        after = own + span
        key = rank[own] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        within = np.argsort(key)
        own, key = own[within], key[within]
        order[left] = own
        new = np.concatenate([[True], np.diff(key) != 0])
        rank[own] = left[np.flatnonzero(new)[np.cumsum(new) - 1]]
        left, span = left[~(new & np.append(new[1:], True))], 2 * span
    return order


def suffix_order(text: np.ndarray, depth: int, budget: int = 256 << 20) -> np.ndarray:
    """Positions of all suffixes, ordered by their first ``depth`` bytes at least.

    Beyond its end a suffix compares smaller than any byte.
    """
    n = len(text)
    dtype = np.dtype(np.int32 if n < (1 << 31) else np.int64)
    if n == 1:
        return np.zeros(1, dtype)
    small = suffix_types(text)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]).astype(dtype) + dtype.type(1)
    if len(leftmost) > 1:
        ordered = _ordered(*_induce(text, leftmost, budget))
        mark = np.zeros(n, bool)
        mark[leftmost] = True
        ordered = ordered[mark[ordered]]
        # every substring between two leftmost S-suffixes moves on by two bytes at least
        names = _names(text, leftmost.astype(np.int64), ordered)
        leftmost = leftmost[_sort_names(names, depth // 2 + 1)]
    return _ordered(*_induce(text, leftmost, budget))
