"""Byte-pair encoding by dynamic programming over byte prefixes.

The encoding of a prefix is determined by its last token: every prefix has
exactly one token that may stand last, and what precedes it is the encoding of
a shorter prefix. ``last[i]`` (token that ends at byte i) is therefore the whole
state: appending continues the table, and after an edit only the positions near
it are computed again. Which tokens end at a byte is told by an automaton over the
tokens' prefixes (Aho-Corasick), whose steps are made when they are first taken.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import regex

INFINITE = 1 << 40
# pieces that a process remembers of late, and as many from before
CACHE_ENTRIES = 150_000
# token pairs and automaton steps that a process remembers
PAIR_ENTRIES = 400_000
# texts below this code point (Latin scripts) are cut by the faster expression
NARROW = 0x250


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def spelled_out(pattern: str, below: int) -> str:
    """The pattern with its Unicode classes written as ranges of code points under ``below``.

    The standard ``re`` matches such short classes faster, in texts that go no higher.
    """
    for name, inside in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\s"), (r"\S", r"\s")):
        member, ranges = regex.compile(inside), []
        if name not in pattern:
            continue
        for c in range(below):
            if member.match(chr(c)):
                if ranges and ranges[-1][1] == c - 1:
                    ranges[-1][1] = c
                else:
                    ranges.append([c, c])
        spelled = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ranges)
        # inside brackets the bare ranges, elsewhere a class of their own
        out, depth = [], 0
        for part in re.split(r"(\[|\]|" + re.escape(name) + ")", pattern):
            if part == name:
                out.append(spelled if depth and name != r"\S" else f"[^{spelled}]" if name == r"\S" else f"[{spelled}]")
            else:
                depth += (part == "[") - (part == "]")
                out.append(part)
        pattern = "".join(out)
    return pattern


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class PrefixEncoder:
    """Encoder for one rank table; ``pattern`` cuts a text into pieces that are encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.pattern = regex.compile(pattern)
        self._narrow = re.compile(spelled_out(pattern, NARROW))
        self._wide = re.compile(f"[^\0-{chr(NARROW - 1)}]")
        self._spines: dict[int, tuple | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._size = {v: len(k) for k, v in ranks.items()}
        # states of the automaton: the longest end of what was read that begins a token
        self._prefixes = {k[:n] for k in ranks for n in range(len(k) + 1)} | {b""}
        self._read, self._ends, self._states, self._steps = [b""], [()], {b"": 0}, {}
        # all tokens' bytes in one run, and where each begins
        order = sorted(self.bytes_of)
        self._flat = np.frombuffer(b"".join(map(self.bytes_of.__getitem__, order)), dtype=np.uint8)
        self._sizes = np.zeros(order[-1] + 1 if order else 0, dtype=np.int64)
        self._sizes[order] = [self._size[t] for t in order]
        self._begins = np.cumsum(self._sizes) - self._sizes

    # --- tokens and their derivations -------------------------------------------------

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None if merging its bytes never gives it."""
        parts = [bytes([b]) for b in self.bytes_of[token]]
        ranks = self.ranks
        while len(parts) > 2:
            best, at = min(((ranks.get(a + b, INFINITE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best >= token:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def _spine(self, token: int) -> tuple[list, list] | None:
        """What stands at the left and right edge of a token while its bytes merge: (bytes, rank at which it is absorbed), from byte to token."""
        known = self._spines.get(token, 0)
        if known != 0:
            return known
        own = self.bytes_of[token]
        if len(own) == 1:
            made = ([(own, INFINITE)], [(own, INFINITE)])
        else:
            halves = self._halves(token)
            below = halves and (self._spine(halves[0]), self._spine(halves[1]))
            if not halves or None in below:
                made = None
            else:
                left, right = below[0][0], below[1][1]
                made = ([*left[:-1], (left[-1][0], token), (own, INFINITE)], [*right[:-1], (right[-1][0], token), (own, INFINITE)])
        self._spines[token] = made
        return made

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` together leaves just these two tokens."""
        key = (a, b)
        known = self._fits.get(key)
        if known is not None:
            return known
        spines = self._spine(a), self._spine(b)
        good = spines[0] is not None and spines[1] is not None
        left, right = (spines[0][1], spines[1][0]) if good else ((), ())
        i = j = 0
        while good:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.ranks.get(x + y, INFINITE)
            # a merge over the border happens before x goes; among equal ranks the left place comes first
            if rank < x_until and rank <= y_until and rank < INFINITE:
                good = False
                break
            if x_until == y_until == INFINITE:
                break
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        if len(self._fits) > PAIR_ENTRIES:
            self._fits.clear()
        self._fits[key] = good
        return good

    # --- pieces -------------------------------------------------------------------------

    def _step(self, key: int) -> int:
        """The state after a byte, from ``state << 8 | byte``."""
        read = self._read[key >> 8] + bytes([key & 255])
        while read not in self._prefixes:
            read = read[1:]
        state = self._states.get(read)
        if state is None:
            state = self._states[read] = len(self._read)
            self._read.append(read)
            self._ends.append(tuple((self.ranks[read[i:]], len(read) - i) for i in range(len(read)) if read[i:] in self.ranks))
        if len(self._steps) > PAIR_ENTRIES:
            self._steps.clear()
        self._steps[key] = state
        return state

    def _state(self, read: bytes) -> int:
        state = 0
        for byte in read:
            state = self._steps.get(state << 8 | byte) or self._step(state << 8 | byte)
        return state

    def extend(self, piece: bytes, last: list[int], until: int | None = None, states: list[int] | None = None) -> list[int]:
        """Continue ``last`` (tokens that end at byte 1, 2, ...) up to byte ``until`` of ``piece``, and with it ``states``, if given."""
        steps, ends, fits, known = self._steps, self._ends, self.fits, self._fits
        done = len(last)
        if states is None:
            state, keep = self._state(piece[max(0, done - self.longest):done]), None
        else:
            state, keep = states[-1] if states else 0, states.append
        for at in range(done, len(piece) if until is None else until):
            key = state << 8 | piece[at]
            state = steps.get(key)
            if state is None:
                state = self._step(key)
            for token, size in ends[state]:
                if size > at:
                    good = self._spine(token) is not None
                else:
                    pair = (last[at - size], token)
                    good = known.get(pair)
                    if good is None:
                        good = fits(*pair)
                if good:
                    last.append(token)
                    break
            else:
                raise ValueError("the rank table lacks a single byte")
            if keep:
                keep(state)
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """Read the encoding off the table, from the end."""
        out, end, size = [], len(last), self._size
        while end:
            token = last[end - 1]
            out.append(token)
            end -= size[token]
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tokens(self.extend(piece, []))

    def edit(self, piece: bytes, last: list[int], start: int, end: int, put: bytes) -> tuple[bytes, list[int]]:
        """Replace bytes ``start`` to ``end`` of a piece and mend its table.

        A position depends on the ``longest`` bytes and table entries before it,
        so once that many entries behind the edit are what they were, the rest stays.
        """
        new, shift = piece[:start] + put + piece[end:], len(put) - (end - start)
        table, same = last[:start], 0
        while len(table) < len(new) and same < self.longest:
            self.extend(new, table, len(table) + 1)
            old = len(table) - shift
            same = same + 1 if old > end and table[-1] == last[old - 1] else 0
        return new, table + last[len(table) - shift:]

    # --- texts ----------------------------------------------------------------------------

    def pack_all(self, texts: list[str]) -> list[bytes]:
        """All ids of each text as little-endian unsigned 32-bit integers.

        New pieces are taken in sorted order, so that each continues the table of
        the prefix it has in common with the one before.
        """
        if len(self._pieces) > CACHE_ENTRIES:
            self._older, self._pieces = self._pieces, {}
        known, older, wide, narrow, full = self._pieces, self._older, self._wide.search, self._narrow.findall, self.pattern.findall
        cut = [full(t) if not t.isascii() and wide(t) else narrow(t) for t in texts]
        fresh, longs, before, table, states = [], {}, b"", [], []
        for name in set().union(*cut).difference(known):
            packed = older.get(name)
            if packed is None:
                fresh.append((name.encode(), name))
            else:
                known[name] = packed
        for p, name in sorted(fresh):
            whole = self.ranks.get(p)
            if whole is None:
                same = 0
                for x, y in zip(before, p):
                    if x != y:
                        break
                    same += 1
                del table[same:], states[same:]
                ids, before = self.tokens(self.extend(p, table, None, states)), p
            else:
                ids = [whole]
            (known if len(p) <= 64 else longs)[name] = packed_ids(ids)
        get = (known | longs if longs else known).__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def unpack(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4")
        if not len(ids):
            return b""
        if int(ids.max()) >= len(self._sizes) or not (size := self._sizes[ids]).all():
            raise KeyError("an id is not in the table")
        shift = self._begins[ids] - (np.cumsum(size) - size)
        return self._flat[np.arange(int(size.sum())) + np.repeat(shift, size)].tobytes()


class EncodedText:
    """A text with the tables of its pieces, for appends and edits."""

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.starts, self.tables = self._cut(text, 0, None)

    def _cut(self, text: str, start: int, stop_at: set[int] | None) -> tuple[list[int], list[list[int]]]:
        starts, tables = [], []
        for m in self.encoder.pattern.finditer(text, start):
            if stop_at is not None and m.start() in stop_at:
                break
            starts.append(m.start())
            tables.append(self.encoder.extend(m[0].encode(), []))
        return starts, tables

    def ids(self) -> list[int]:
        out = []
        for k, table in enumerate(self.tables):
            end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
            whole = self.encoder.ranks.get(self.text[self.starts[k]:end].encode())
            out += [whole] if whole is not None else self.encoder.tokens(table)
        return out

    def append(self, more: str) -> None:
        """Only the last two pieces can change; the last one's table is continued if it just grows."""
        self.splice(len(self.text), len(self.text), more)

    def splice(self, start: int, end: int, put: str) -> None:
        """Replace a range of the text; pieces before it and behind the next common border stay."""
        shift = len(put) - (end - start)
        text = self.text[:start] + put + self.text[end:]
        keep = max(0, bisect_right(self.starts, start) - 3)  # a run of blanks may be two pieces
        begin = self.starts[keep] if self.starts else 0
        borders = {s + shift: k for k, s in enumerate(self.starts) if s >= end and k > keep}
        starts, tables, rest = [], [], len(self.starts)
        for m in self.encoder.pattern.finditer(text, begin):
            if m.start() in borders:
                rest = borders[m.start()]
                break
            k = bisect_right(self.starts, m.start()) - 1
            table, piece = [], m[0].encode()
            if 0 <= k < len(self.starts) and self.starts[k] == m.start() and m.start() <= start:
                stop = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
                old = self.text[self.starts[k]:stop].encode()
                same = 0
                while same < min(len(old), len(piece)) and old[same] == piece[same]:
                    same += 1
                table = self.tables[k][:same]  # the table of a common prefix is common
            starts.append(m.start())
            tables.append(self.encoder.extend(piece, table))
        self.starts = self.starts[:keep] + starts + [s + shift for s in self.starts[rest:]]
        self.tables = self.tables[:keep] + tables + self.tables[rest:]
        self.text = text


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> PrefixEncoder:
    """One encoder per process: its memory of pieces serves all tasks that run there."""
    return PrefixEncoder(load_ranks(path), pattern)
