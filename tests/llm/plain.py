"""Brute-force versions of the operators, over rows in memory."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def sha(data):
    return hashlib.sha256(data).hexdigest()


def simhash(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, near):
    """The smallest index that each index reaches over pairs that are near."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def repeats(rows, width=50):
    """(id, bytes, removed, spans, digest of the rest) per row."""
    first = {}
    for i, t in rows:
        body = (t or "").encode()
        for k in range(len(body) - width + 1) if i is not None else ():
            s = body[k:k + width]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        body = (t or "").encode()
        gone = bytearray(len(body))
        for k in range(len(body) - width + 1) if i is not None else ():
            if first[body[k:k + width]] < i:
                gone[k:k + width] = b"\1" * width
        spans = sum(1 for k in range(len(body)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(body), sum(gone), spans, sha(bytes(b for b, g in zip(body, gone) if not g))))
    return out


def contamination(rows, items, size=10):
    """(id, words, words hit, item ids) per row."""
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if items_here := windows.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    found |= items_here
        out.append((i, len(w), len(hit), sorted(map(str, found))))
    return out


def multiset(rows):
    return sorted(map(repr, rows))
