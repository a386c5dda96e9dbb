"""Rabin-Karp fingerprints of word n-grams by numpy prefix polynomials, and blocks of them.

A text is read as bytes: A-Z become small, ``.,;:!?`` and line breaks end a piece,
blanks and tabs end a word. The words of a stretch of texts are laid out with one
blank between them, so an n-gram is a run of bytes. With prefix polynomials modulo
three primes, the value of any run is a difference of two prefixes times a power:
two of the values are the fingerprint, the third is a check that tells most
different n-grams of one fingerprint apart.

Blocks hold sorted fingerprints with their counts, checks and the key of one
document each, compressed: fingerprints as differences, by byte planes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

# below 2^31 each, so that products fit 64 bits
MODULI = ((1 << 31) - 1, (1 << 31) - 19, (1 << 31) - 61)
BASES = (1_000_003, 77_777_777, 1_234_577)
DIFFER = 0xFFFFFFFF
"""In place of a check: n-grams with different checks have this fingerprint."""
TABLE = 1 << 20
"""Powers that a worker keeps; a longer stretch has its own."""

_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[ord("A"):ord("Z") + 1] += 32


@dataclass
class Words:
    """The words of some texts of one language, laid out with single blanks."""

    line: np.ndarray    # bytes
    start: np.ndarray   # of each word in ``line``
    end: np.ndarray
    piece: np.ndarray   # number of its piece
    text: np.ndarray    # number of its text

    def grams(self, n: int) -> np.ndarray:
        """First words of all n-grams within pieces."""
        if len(self.piece) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[n - 1:] == self.piece[:len(self.piece) - n + 1])

    def phrase(self, first: int, n: int) -> bytes:
        return self.line[self.start[first]:self.end[first + n - 1]].tobytes()


def read_words(texts: list[bytes]) -> Words:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    raw, kind = _SMALL[raw], _KIND[raw]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, after = edge[::2], edge[1::2]
    piece = np.cumsum(kind == 2, dtype=np.int32)[first]
    ends = np.cumsum([len(t) + 1 for t in texts])
    # the byte after a word becomes its blank
    kept = inside.copy()
    kept[after] = True
    line = raw[kept]
    line[~inside[kept]] = 32
    size = after - first
    start = np.cumsum(size + 1) - size - 1
    return Words(line, start, start + size, piece, np.searchsorted(ends, first, "right"))


def _powers(base: int, p: int, n: int) -> np.ndarray:
    out, done = np.ones(n, np.uint64), 1
    while done < n:
        more = min(n, 2 * done)
        out[done:more] = out[:more - done] * np.uint64(pow(base, done, p)) % np.uint64(p)
        done = more
    return out.astype(np.uint32)


@dataclass
class Prints:
    """Fingerprints for one choice of primes; keeps tables of powers of bounded size."""

    moduli: tuple[int, int, int] = MODULI
    tables: dict = field(default_factory=dict)

    @property
    def span(self) -> int:
        """Fingerprints lie below it."""
        return self.moduli[0] * self.moduli[1]

    def _table(self, base: int, p: int, n: int) -> np.ndarray:
        if n > TABLE:
            return _powers(base, p, n)
        if (base, p) not in self.tables:
            self.tables[base, p] = _powers(base, p, TABLE)
        return self.tables[base, p]

    def _values(self, words: Words, first: dict[int, np.ndarray], base: int, p: int) -> dict[int, np.ndarray]:
        size, mod = len(words.line), np.uint64(p)
        up, down = self._table(base, p, size + 2), self._table(pow(base, -1, p), p, size + 1)
        prefix = np.zeros(size + 1, np.uint64)
        np.cumsum((words.line.astype(np.uint64) + np.uint64(1)) * up[1:size + 1] % mod, out=prefix[1:])
        prefix %= mod
        low, shift = prefix[words.start], down[words.start]
        high = prefix[words.end] + mod
        return {n: (high[i + n - 1] - low[i]) % mod * shift[i] % mod for n, i in first.items()}

    def of(self, words: Words, sizes: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """n -> (first words, fingerprints, checks) of all n-grams."""
        first = {n: words.grams(n) for n in sizes}
        a, b, c = (self._values(words, first, base, p) for base, p in zip(BASES, self.moduli, strict=True))
        return {n: (first[n], a[n] * np.uint64(self.moduli[1]) + b[n], c[n].astype(np.uint32)) for n in sizes}


@dataclass
class Block:
    """Fingerprints with a count, a check and the least key of a document that holds them."""

    prints: np.ndarray
    checks: np.ndarray
    keys: np.ndarray
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.prints)

    def slice(self, a: int, b: int) -> "Block":
        return Block(self.prints[a:b], self.checks[a:b], self.keys[a:b], self.counts[a:b])

    def take(self, chosen: np.ndarray) -> "Block":
        return Block(self.prints[chosen], self.checks[chosen], self.keys[chosen], self.counts[chosen])

    def pack(self) -> bytes:
        steps = np.diff(self.prints, prepend=np.uint64(0))
        planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) for x in (steps, self.counts.astype(np.uint64))]
        raw = b"".join([planes[0].tobytes(), planes[1].tobytes(), self.checks.tobytes(), self.keys.tobytes()])
        return pa.Codec("zstd", 1).compress(raw, asbytes=True)

    @staticmethod
    def unpack(data: bytes, size: int) -> "Block":
        raw = np.frombuffer(pa.Codec("zstd").decompress(data, 24 * size, asbytes=True), np.uint8)
        whole = lambda at: np.ascontiguousarray(raw[at:at + 8 * size].reshape(8, size).T).view(np.uint64).ravel()
        rest = raw[16 * size:].view(np.uint32)
        return Block(np.cumsum(whole(0), dtype=np.uint64), rest[:size], rest[size:], whole(8 * size))


def combine(blocks: list[Block]) -> Block:
    """One sorted block with every fingerprint once."""
    prints = np.concatenate([b.prints for b in blocks])
    if not len(prints):
        return blocks[0]
    order = np.argsort(prints)
    prints = prints[order]
    at = np.flatnonzero(np.diff(prints, prepend=prints[0] + np.uint64(1)))
    prints = prints[at]
    # one column after the other, so that one is held twice at a time
    column = lambda c: np.concatenate([getattr(b, c) for b in blocks])[order]
    checks = column("checks")
    least, most = np.minimum.reduceat(checks, at), np.maximum.reduceat(checks, at)
    checks = np.where(least == most, least, np.uint32(DIFFER))
    keys = np.minimum.reduceat(column("keys"), at)
    # counts of single n-grams come as bytes
    return Block(prints, checks, keys, np.add.reduceat(column("counts"), at, dtype=np.uint64))
