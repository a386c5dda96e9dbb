"""Re-Pair grammars of token ids: a compact block with random access.

Frequent pairs of neighbouring symbols are replaced by new symbols, round after
round, until no pair pays or no symbol is free. A round takes the most frequent
pairs and a share of the symbols that are left, so that later rounds can join what
earlier ones made: the depth of a rule has no limit of its own. No pair starts at a document's end id, so documents
begin at symbols. A block stores its rules with the length of what they expand
to, the symbols in 16 bits, and where each document begins.

Layout (little-endian): magic ``RPR1``; unsigned 32-bit counts of rules, symbols
and documents, first free symbol; rule left halves, right halves (16 bits each)
and lengths (32 bits); symbols (16 bits); per document its id (64 bits), first
symbol and first token (32 bits each), and a last pair of both that closes the
table; crc32 of all that.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RPR1"
END = 1
# a round takes this part of the symbols that are left, or so many
SHARE, FEWEST = 5, 256
# a rule takes eight bytes, so a pair pays from this many places
LEAST = 8
_BITS = 18
# rules up to this length are expanded by a table
SHORT = 32


def _frequent(pairs: np.ndarray, closes: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` pairs that stand at ``LEAST`` places and begin with no closing symbol, from the most frequent down."""
    ordered = np.sort(pairs)
    starts = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
    counts = np.diff(np.append(starts, len(ordered)))
    often = counts >= LEAST
    codes, counts = ordered[starts[often]], counts[often]
    able = ~closes[codes >> np.uint32(16)]
    codes, counts = codes[able], counts[able]
    return codes[np.argsort(-counts, kind="stable")[:most]]


def _slots(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(2654435769)) >> np.uint32(32 - _BITS)


def compress(ids: np.ndarray, first_free: int, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): symbols of 16 bits; rule k of (left, right) makes symbol ``first_free + k``."""
    if len(ids) and int(ids.max()) >= first_free or first_free > 1 << 16:
        raise ValueError("ids must lie below the first free symbol, and both below 65536")
    seq, rules = ids.astype(np.uint32), []
    closes = np.zeros(1 << 16, bool)  # symbols whose last id is the end
    closes[end] = True
    free = first_free
    while len(seq) > 1 and free < 1 << 16:
        pairs = (seq[:-1] << np.uint32(16)) | seq[1:]
        codes = _frequent(pairs, closes, min((1 << 16) - free, max(FEWEST, ((1 << 16) - free) // SHARE)))
        if not len(codes):
            break
        # the most frequent pair of a slot is taken this round, others may be in the next
        _, best = np.unique(_slots(codes), return_index=True)
        codes = codes[np.sort(best)]
        table = np.full(1 << _BITS, -1, dtype=np.int16)
        table[_slots(codes)] = np.arange(len(codes))
        rule = table[_slots(pairs)]
        at = np.flatnonzero(rule >= 0)
        rule = rule[at].astype(np.int64)
        same = codes[rule] == pairs[at]
        at, rule = at[same], rule[same]
        # of pairs that overlap in a row, every second is taken from the left
        begins = np.concatenate([[True], np.diff(at) > 1])
        inside = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        at, rule = at[inside % 2 == 0], rule[inside % 2 == 0]
        taken = np.bincount(rule, minlength=len(codes)) > 0
        used, rule = np.flatnonzero(taken), (np.cumsum(taken) - 1)[rule]
        seq[at] = free + rule.astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        rules.append(codes[used])
        closes[free:free + len(used)] = closes[codes[used] & np.uint32(0xFFFF)]
        free += len(used)
        seq = seq[keep]
    made = np.concatenate(rules) if rules else np.zeros(0, np.uint32)
    return seq.astype("<u2"), np.stack([made >> np.uint32(16), made & np.uint32(0xFFFF)]).astype("<u2")


def lengths_of(rules: np.ndarray, first_free: int) -> np.ndarray:
    """How many ids each rule expands to."""
    out = np.ones(first_free + rules.shape[1], dtype=np.int64)
    todo = np.arange(rules.shape[1])
    out[first_free:] = 0
    while len(todo):  # a rule's halves are ids or earlier rules
        left, right = out[rules[0, todo]], out[rules[1, todo]]
        ready = (left > 0) & (right > 0)
        out[first_free + todo[ready]] = left[ready] + right[ready]
        todo = todo[~ready]
    return out


def _opened(seq: np.ndarray, rules: np.ndarray, first_free: int, long: np.ndarray) -> np.ndarray:
    """Replace the symbols that are ``long`` by their halves until none is left."""
    while (big := long[seq]).any():
        at = np.arange(len(seq)) + np.cumsum(big) - big
        out = np.empty(len(seq) + int(big.sum()), dtype=np.int64)
        out[at] = seq
        out[at[big]] = rules[0, seq[big] - first_free]
        out[at[big] + 1] = rules[1, seq[big] - first_free]
        seq = out
    return seq


def expand(symbols: np.ndarray, rules: np.ndarray, first_free: int) -> np.ndarray:
    """The ids of a run of symbols; long rules are opened step by step, short ones read from a table."""
    length = lengths_of(rules, first_free)
    seq = _opened(symbols.astype(np.int64), rules, first_free, length > SHORT)
    short = np.flatnonzero(length <= SHORT)
    flat = _opened(short, rules, first_free, np.arange(len(length)) >= first_free).astype("<u4")
    begin = np.zeros(len(length), dtype=np.int64)
    begin[short] = np.cumsum(length[short]) - length[short]
    size = length[seq]
    shift = begin[seq] - (np.cumsum(size) - size)
    return flat[np.arange(int(size.sum())) + np.repeat(shift, size)]


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, first_free: int) -> bytes:
    """One block from the ids of whole documents, each closed by the end id."""
    symbols, rules = compress(ids, first_free)
    length = lengths_of(rules, first_free)
    token_at = np.concatenate([[0], np.cumsum(counts)])
    reach = np.concatenate([[0], np.cumsum(length[symbols])])
    symbol_at = np.searchsorted(reach, token_at)
    if not np.array_equal(reach[symbol_at], token_at):
        raise AssertionError("a document begins inside a symbol")
    body = b"".join([
        MAGIC, struct.pack("<4I", rules.shape[1], len(symbols), len(doc_ids), first_free), rules[0].tobytes(), rules[1].tobytes(),
        length[first_free:].astype("<u4").tobytes(), symbols.tobytes(), doc_ids.astype("<i8").tobytes(),
        symbol_at.astype("<u4").tobytes(), token_at.astype("<u4").tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A block as it was written; documents can be read one by one."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("not a block, or damaged")
        n_rules, n_symbols, n_docs, self.first_free = struct.unpack_from("<4I", data, 4)
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.rules = np.stack([take("<u2", n_rules), take("<u2", n_rules)])
        self.lengths, self.symbols = take("<u4", n_rules), take("<u2", n_symbols)
        self.doc_ids, self.symbol_at, self.token_at = take("<i8", n_docs), take("<u4", n_docs + 1), take("<u4", n_docs + 1)

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.first_free)

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the k-th document, expanding only the symbols that hold them."""
        symbols = self.symbols[self.symbol_at[k]:self.symbol_at[k + 1]]
        n = int(self.token_at[k + 1] - self.token_at[k])
        stop = n if stop is None else min(stop, n)
        size = np.ones(len(symbols), dtype=np.int64)
        big = symbols >= self.first_free
        size[big] = self.lengths[symbols[big] - np.uint16(self.first_free)]
        reach = np.concatenate([[0], np.cumsum(size)])
        a, b = np.searchsorted(reach, start, "right") - 1, np.searchsorted(reach, stop, "left")
        return expand(symbols[a:b], self.rules, self.first_free)[start - reach[a]:stop - reach[a]]
