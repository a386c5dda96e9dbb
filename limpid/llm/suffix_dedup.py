"""Removal of byte strings that also start in a document with a smaller id.

Every string of ``width`` bytes is judged; none crosses a document. Four steps:

1. *Seeds.* In each string the rolling hashes of 16 bytes have a smallest one, so
   equal strings share a seed wherever they stand. A text falls into runs of
   strings with one seed, of about 18; the seeds are packed into blocks per hash
   bucket, and a bucket keeps those that stand in two rows at least.
2. *Stretches.* The bytes of a run with a shared seed form a stretch. Stretches are
   dealt to shards by their seed, so that all equal strings are in one shard,
   whatever documents they are from.
3. *Suffix arrays.* A shard's distinct stretches are put behind each other and
   sorted by external induced sorting (``induced.py``); neighbours that agree in
   ``width`` bytes are one string, and the smallest document of a string decides
   for all its places.
4. *Removal.* Covered ranges are gathered per row and cut out. What buckets and
   shards say of rows travels in packed blocks per range of rows, and one record
   per row comes out.

Work follows the text: a passage that a million documents hold is one stretch in
its shard, with one small record per place. Buckets and shards grow in number,
not in size, with the input.

Defined cases: null and empty texts, and those shorter than ``width``, keep all
their bytes; rows with a null id keep all and decide nothing; ids are integers, and equal
ones do not remove from each other; rows that repeat both id and text are judged alike; an
empty table gives an empty result; columns called like an output are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from limpid.llm.common import byte_slices, fresh_name, tidy
from limpid.llm.induced import suffix_order, words_at
from limpid.session import stage

WIDTH = 50
SEED_BYTES = 16
# text bytes per hash bucket and stretch bytes per shard, about
BUCKET_TEXT = 16 << 20
SHARD_BYTES = 3 << 19
# text bytes whose seeds and ranges a task brings together by row, about
PART_TEXT = 64 << 20
# bytes of text for which a task holds rolling hashes at a time
SLICE = 3 << 19
# strings whose places are judged at a time
CHUNK = 1 << 18
ROW = "_row"
MOST_PARTS = 1 << 15

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _rolling(text: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from every position; 1 at least."""
    w = words_at(text)
    h = w[:-8] * _MIX[0]
    h ^= h >> np.uint64(29)
    h += w[8:] * _MIX[1]
    h ^= h >> np.uint64(32)
    h *= _MIX[2]
    h ^= h >> np.uint64(31)
    h |= np.uint64(1)
    return h


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i:i + width] for every i."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[:len(x) - (width - span)], x[width - span:]) if width > span else x


class Runs:
    """Texts that lie behind each other in ``body``, cut into runs of strings with the same smallest hash."""

    def __init__(self, texts: list[bytes], width: int):
        self.width, reach = width, width - SEED_BYTES  # a string holds hashes at reach + 1 places
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.body = np.frombuffer(b"".join(texts) + bytes(width + 8), dtype=np.uint8)
        total = int(sizes.sum())
        least = _sliding(_rolling(self.body)[:total + reach], reach + 1, np.minimum)[:total]
        # strings that reach over the end of their text belong to no run
        for end, size in zip((self.starts + sizes).tolist(), sizes.tolist()):
            least[end - min(size, width - 1):end] = 0
        change = np.concatenate([[True], least[1:] != least[:-1]]) if total else np.zeros(0, bool)
        change[self.starts[sizes > 0]] = True
        first = np.flatnonzero(change)
        last = np.append(first[1:], total) - 1
        kept = least[first] > 0
        self.first, self.last = first[kept], last[kept]
        self.hash = least[self.first]
        self.owner = np.searchsorted(self.starts, self.first, "right") - 1
        if (sizes == 0).any():  # empty texts share their start with the next one
            full = np.flatnonzero(sizes > 0)
            self.owner = full[np.searchsorted(self.starts[full], self.first, "right") - 1]


def _texts(batch: pa.RecordBatch, text: str) -> list[bytes]:
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


def _grouping(ids: np.ndarray) -> np.ndarray:
    """Order that brings equal ids together; numbers of two bytes are sorted by their digits."""
    return np.argsort(ids.astype(np.uint16) if len(ids) and 0 <= ids.min() and ids.max() < 1 << 16 else ids, kind="stable")


def _blocks(ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows grouped by an id: (id, packed column, ...)."""
    order = _grouping(ids)
    ids = ids[order]
    cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    columns = [c[order] for c in columns]
    for a, b in zip(cuts, np.append(cuts[1:], len(ids))):
        yield (int(ids[a]), *(c[a:b].tobytes() for c in columns))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _plain(blocks: list[dict], name: str, kind: type) -> np.ndarray:
    """A packed column of several blocks."""
    unpack = zstandard.ZstdDecompressor().decompress
    return np.frombuffer(b"".join(unpack(b[name]) for b in blocks), kind)


def _seed_blocks(width: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("rows", pa.binary()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                runs = Runs(_texts(part, "text"), width)
                if not len(runs.first):
                    continue
                h = runs.hash
                rows = part.column(ROW).to_numpy()[runs.owner]
                # five bytes of the hash beside the bucket: what is taken for equal too often is told apart later
                short = np.ascontiguousarray((h >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5])
                places = (runs.first - runs.starts[runs.owner]).astype(np.int32)
                out = [
                    (k, hashes, _packed(own), _packed(at))
                    for k, hashes, own, at in _blocks((h % np.uint64(buckets)).astype(np.int32), short, rows, places)
                ]
                yield _batch(out, schema)

    return run


def _by_row(rows: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch | None:
    """One record per row id with lists of its values."""
    if not len(rows):
        return None
    order = np.argsort(rows)
    rows = rows[order]
    cuts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    offsets = pa.array(np.append(cuts, len(rows)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order].astype(np.int32))) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(rows[cuts]), *lists], names=[ROW, "first", "last"][:1 + len(columns)])


def _by_part(rows: np.ndarray, parts: int, *columns: np.ndarray) -> pa.RecordBatch | None:
    """One packed record per part of the rows, so that records do not grow as rows times groups."""
    if not len(rows):
        return None
    part = (rows.view(np.uint64) % np.uint64(parts)).astype(np.int32)
    blocks = [(k, *map(_packed, packed)) for k, *packed in _blocks(part, rows, *(c.astype(np.int32) for c in columns))]
    names = ["part", "rows", "first", "last"][:2 + len(columns)]
    return _batch(blocks, pa.schema([(n, pa.int32() if n == "part" else pa.binary()) for n in names]))


def _to_rows(*names: str):
    """Blocks of a part to one record per row, with all that any group found of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _grouped(batches, "part"):
            made = _by_row(_plain(blocks, "rows", np.int64), *(_plain(blocks, n, np.int32) for n in names))
            if made is not None:
                yield made

    return run


def _gathered(blocks: DataFrame, parts: int, *names: str) -> DataFrame:
    """(row, lists): the blocks of all groups brought together by row."""
    met = blocks.repartition(min(parts, MOST_PARTS), "part").sortWithinPartitions("part")
    return met.mapInArrow(tidy(_to_rows(*names)), ", ".join([f"{ROW} long", *(f"{n} array<int>" for n in names)]))


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Blocks of one key after the other, from rows sorted by it."""
    held, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now:
                if held:
                    yield now, held
                held, now = [], row[key]
            held.append(row)
    if held:
        yield now, held


def _shared_seeds(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _grouped(batches, "bucket"):
            raw = np.frombuffer(b"".join(b["hashes"] for b in blocks), np.uint8).reshape(-1, 5)
            h = np.zeros((len(raw), 8), np.uint8)
            h[:, :5] = raw
            h = h.view(np.uint64)[:, 0]
            rows, places = _plain(blocks, "rows", np.int64), _plain(blocks, "places", np.int32)
            order = np.argsort(h)
            h, rows, places = h[order], rows[order], places[order]
            cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            shared = np.minimum.reduceat(rows, cuts) != np.maximum.reduceat(rows, cuts)
            keep = np.repeat(shared, np.diff(np.append(cuts, len(h))))
            made = _by_part(rows[keep], parts, places[keep])
            if made is not None:
                yield made

    return run


def _stretch_blocks(width: int, shards: int):
    schema = pa.schema([(n, pa.int32() if n == "shard" else pa.binary()) for n in ("shard", "sizes", "ids", "rows", "at", "body")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                runs = Runs(_texts(part, "text"), width)
                lists = part.column("places")
                at = np.repeat(runs.starts, pc.list_value_length(lists).to_numpy()) + lists.flatten().to_numpy()
                # a place of another row that got the same number begins no run here
                k = np.flatnonzero(np.isin(runs.first, at))
                if not len(k):
                    continue
                shard = (_mixed(runs.hash[k]) % np.uint64(shards)).astype(np.int32)
                order = _grouping(shard)
                k, shard = k[order], shard[order]
                first, sizes, owner = runs.first[k], (runs.last[k] - runs.first[k] + width).astype(np.int32), runs.owner[k]
                ids, rows = part.column("id").to_numpy()[owner], part.column(ROW).to_numpy()[owner]
                cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                memory, out = memoryview(runs.body), []
                for a, b in zip(cuts, np.append(cuts[1:], len(shard))):
                    body = b"".join(memory[f:f + n] for f, n in zip(first[a:b].tolist(), sizes[a:b].tolist()))
                    start = (first[a:b] - runs.starts[owner[a:b]]).astype(np.int32)
                    out.append((int(shard[a]), *(_packed(x) for x in (sizes[a:b].tobytes(), ids[a:b].tobytes(), rows[a:b].tobytes(), start.tobytes(), body))))
                yield _batch(out, schema)

    return run


def _mixed(h: np.ndarray) -> np.ndarray:
    """Seeds are small numbers of their neighbourhood; shards need even ones."""
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    return h ^ (h >> np.uint64(29))


def string_owners(stretches: list[bytes], least_id: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every string of ``width`` bytes of every stretch, the smallest id that holds it; and where each stretch's begin."""
    sizes = np.fromiter(map(len, stretches), dtype=np.int64, count=len(stretches))
    # bytes of UTF-8 stay below 255, so one more leaves zero for the borders
    text = np.frombuffer(b"\xff".join(stretches) + b"\xff", dtype=np.uint8) + np.uint8(1)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    owner = np.repeat(np.arange(len(stretches)), sizes + 1)
    left = np.repeat(starts + sizes, sizes + 1) - np.arange(len(text))
    order = suffix_order(text, width)
    order = order[left[order] >= width].astype(np.int64)
    words = words_at(np.concatenate([text, np.zeros(8, np.uint8)]))
    new = np.zeros(len(order), bool)
    new[0] = True
    for offset in [*range(0, width - 7, 8), width - 8]:  # common prefix of neighbours, word by word
        own = words[order + offset]
        new[1:] |= own[1:] != own[:-1]
    cuts = np.flatnonzero(new)
    least = np.minimum.reduceat(least_id[owner[order]], cuts)
    of_place = np.empty(len(text), dtype=np.int64)
    of_place[order] = np.repeat(least, np.diff(np.append(cuts, len(order))))
    return of_place, starts


def _covered(width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _grouped(batches, "shard"):
            known: dict[bytes, int] = {}
            which, least_id = [], []
            unpack = zstandard.ZstdDecompressor().decompress
            for b in blocks:
                ends = np.cumsum(_plain([b], "sizes", np.int32)).tolist()
                body, begin = unpack(b["body"]), 0
                for end, i in zip(ends, _plain([b], "ids", np.int64).tolist()):
                    k = known.setdefault(body[begin:end], len(known))
                    if k == len(least_id):
                        least_id.append(i)
                    elif i < least_id[k]:
                        least_id[k] = i
                    which.append(k)
                    begin = end
                b["body"] = None
            stretches = list(known)
            known.clear()
            of_place, starts = string_owners(stretches, np.array(least_id, dtype=np.int64), width)
            counts = np.fromiter(map(len, stretches), dtype=np.int64, count=len(stretches)) - width + 1
            ids, rows, at = _plain(blocks, "ids", np.int64), _plain(blocks, "rows", np.int64), _plain(blocks, "at", np.int32)
            which = np.array(which, dtype=np.int64)
            reach = np.cumsum(counts[which])
            begin_at = 0
            while begin_at < len(which):  # places of about ``CHUNK`` strings at a time
                end_at = max(begin_at + 1, int(np.searchsorted(reach, (reach[begin_at - 1] if begin_at else 0) + CHUNK, "right")))
                here = slice(begin_at, end_at)
                begin_at = end_at
                w = which[here]
                n = counts[w]
                stretch = np.repeat(np.arange(len(w)), n)
                inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                gone = of_place[starts[w][stretch] + inside] < ids[here][stretch]
                # runs of removed strings inside a stretch
                before = np.concatenate([[False], gone[:-1]]) & (inside > 0)
                after = np.concatenate([gone[1:], [False]]) & (inside + 1 < n[stretch])
                begin, end = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
                own = at[here].astype(np.int64)
                made = _by_part(rows[here][stretch[begin]], parts, own[stretch[begin]] + inside[begin], own[stretch[end]] + inside[end] + width)
                if made is not None:
                    yield made

    return run


def covered_ranges(docs: DataFrame, id_column: str, text: str, row: str, width: int = WIDTH) -> DataFrame:
    """(row, first, last): lists of removed byte ranges, end exclusive, per row number of ``docs``."""
    if width < SEED_BYTES + 8:
        raise ValueError(f"strings of {SEED_BYTES + 8} bytes at least")
    able = docs.where(F.col(id_column).isNotNull() & (F.octet_length(text) >= width))
    held_bytes = able.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, parts = (max(1, -(-held_bytes // size)) for size in (BUCKET_TEXT, PART_TEXT))
    blocks = able.select(F.col(text).alias("text"), F.col(row).alias(ROW)).mapInArrow(tidy(_seed_blocks(width, buckets)), "bucket int, hashes binary, rows binary, places binary"
    )
    seeds = blocks.repartition(min(buckets, MOST_PARTS), "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_shared_seeds(parts)), "part int, rows binary, first binary")
    shared = stage(_gathered(seeds, parts, "first").withColumnRenamed("first", "places"), "dedup-seeds")
    stretch = (shared.agg(F.sum(F.size("places"))).first()[0] or 0) * (width + 18)
    shards = max(1, -(-stretch // SHARD_BYTES))
    # all rows in the caller's form, so that this shuffle of the texts also serves the join with the ranges
    met = docs.join(shared.withColumnRenamed(ROW, row), row).select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(row).alias(ROW), "places")
    held = met.mapInArrow(tidy(_stretch_blocks(width, shards)), "shard int, sizes binary, ids binary, rows binary, at binary, body binary")
    found = held.repartition(min(shards, MOST_PARTS), "shard").sortWithinPartitions("shard").mapInArrow(
        tidy(_covered(width, parts)), "part int, rows binary, first binary, last binary")
    return _gathered(found, parts, "first", "last").withColumnRenamed(ROW, row)


def _merged(first: list[int], last: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first, last)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _with_ranges(docs: DataFrame, id_column: str, text: str, width: int, first: str, last: str) -> DataFrame:
    """``docs`` and two columns of removed ranges; null where nothing goes."""
    row = fresh_name(ROW, docs.columns)
    numbered = docs.withColumn(row, F.xxhash64(F.col(id_column).cast("string"), F.col(text), F.octet_length(text)))
    ranges = covered_ranges(numbered.select(id_column, text, row), id_column, text, row, width)
    return numbered.join(ranges.select(row, F.col("first").alias(first), F.col("last").alias(last)), row, "left").drop(row)


def remove(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    schema = StructType([docs.schema[id_column]] + [StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [StructField("kept_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                sizes, removed, spans, digests = [], [], [], []
                for body, first, last in zip(_texts(part, text), part.column("first").to_pylist(), part.column("last").to_pylist()):
                    gone = _merged(first or [], last or [])
                    kept, at = hashlib.sha256(), 0
                    for a, b in gone:
                        kept.update(body[at:a])
                        at = b
                    kept.update(body[at:])
                    sizes.append(len(body))
                    removed.append(sum(b - a for a, b in gone))
                    spans.append(len(gone))
                    digests.append(kept.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                    names=[id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_ranges(docs.select(id_column, text), id_column, text, width, "first", "last").select(id_column, text, "first", "last").mapInArrow(tidy(run), schema)


def cut_text(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the characters whose bytes are all inside the ranges; a character cut in two stays."""
    body, out, at = text.encode(), [], 0
    for a, b in ranges:
        while a < len(body) and a > at and 0x80 <= body[a] < 0xC0:
            a += 1
        while b > a and b < len(body) and 0x80 <= body[b] < 0xC0:
            b -= 1
        if b > a:
            out.append(body[at:a])
            at = b
    out.append(body[at:])
    return b"".join(out).decode()


def cut(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with every repeated passage cut out of its text; all rows and other columns stay."""
    first, last = (fresh_name(n, docs.columns) for n in ("_first", "_last"))
    ranged, names = _with_ranges(docs, id_column, text, width, first, last), docs.columns
    schema = StructType([docs.schema[c] for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                made = [
                    t if not a else cut_text(t, _merged(a, b))
                    for t, a, b in zip(part.column(text).to_pylist(), part.column(first).to_pylist(), part.column(last).to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if n == text else part.column(n) for n in names], names=names)

    return ranged.select(*(f"`{c}`" for c in names), first, last).mapInArrow(tidy(run), schema)
