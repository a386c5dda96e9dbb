"""SimHash fingerprints of whole texts, and their groups at Hamming distance 3 or less.

Fingerprints: XXH64 of word shingles, a bit is set if more than half of the
shingles set it. Groups are found on distinct fingerprints by balls that meet in
the middle. Two fingerprints that differ in three bits differ in at most one bit
of one half (32 bits). Every fingerprint therefore emits, for either half, all
variants of that half within half the radius (rounded down: one bit, 33 variants).
Variants are shuffled, and a pair that meets at a variant which one of the two
holds unchanged is verified on all 64 bits.

A bucket never emits its pairs: it links each member to the smallest member that
it reaches inside the bucket, so its output grows with its members. Buckets with
more than ``HOT`` members are split exactly: the other half differs in three bits
at most, so one of its four bytes is equal, and members meet again per byte.

Defined cases: null and empty texts have fingerprint zero and are linked like any
other; fewer words than a shingle make one shingle of all words; repeated rows and
equal texts share a fingerprint and group; an empty table gives an empty result;
columns that are called like an output are replaced. A null ``doc_id`` is kept; it
names a group only if the group has no other id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from limpid.llm.common import fresh_name, map_texts, tidy
from limpid.llm.components import FEWEST_TASKS, components, tasks_for
from limpid.session import stage

SHINGLE = 3
SEED = 42
RADIUS = 3
# members of a bucket beyond which it is split by the bytes of the other half
HOT = 20_000
# pairs of a bucket that are compared at a time
BLOCK = 1 << 22


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; ``bytes.lower`` changes only A to Z and ``bytes.split`` cuts at blank, tab, LF, VT, FF, CR."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())], dtype=np.uint64)
    set_in = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) >> 16)):
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_in > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", output: str = "fp") -> DataFrame:
    """Append the fingerprint as a signed long. A map; no shuffle."""

    def start():
        return lambda texts: [np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)]

    return map_texts(docs, text, [StructField(output, LongType())], start)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _bucket_links(fps: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a bucket: (member, smallest member reached), for pairs with a member that holds the variant unchanged."""
    parent = np.arange(len(fps))
    centres = np.flatnonzero(own)
    step = max(1, BLOCK // len(fps))
    for k in range(0, len(centres), step):
        part = centres[k:k + step]
        a, b = np.nonzero(_popcount(fps[part][:, None] ^ fps[None, :]) <= radius)
        a = part[a]
        while True:  # the smallest root wins; each pass joins what still lies apart
            low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
            apart = low != high
            if not apart.any():
                break
            np.minimum.at(parent, high[apart], low[apart])
            while (parent != parent[parent]).any():
                parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[moved], fps[parent[moved]]


def _links_of_buckets(radius: int):
    """Streams rows sorted by bucket key; a bucket that reaches into the next batch is carried along."""

    def flush(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        us, vs = [], []
        two = starts[ends - starts == 2]  # most buckets that matter hold two
        good = (own[two] | own[two + 1]) & (_popcount(fp[two] ^ fp[two + 1]) <= radius)
        us.append(fp[two[good]])
        vs.append(fp[two[good] + 1])
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            if own[s:e].any():
                u, v = _bucket_links(fp[s:e], own[s:e], radius)
                us.append(u)
                vs.append(v)
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            key = np.stack([get("part").astype(np.int64), get("variant").astype(np.int64)], axis=1)
            now = (key, get("fp").view(np.uint64), get("own"))
            if rest is not None:
                now = tuple(np.concatenate([x, y]) for x, y in zip(rest, now))
            last = np.flatnonzero(np.any(now[0] != now[0][-1], axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield flush(*(x[:cut] for x in now))
            rest = tuple(x[cut:] for x in now)
        if rest is not None:
            yield flush(*rest)

    return run


def _met(distinct: DataFrame, fp: str = "fp", radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links (u > v) that join the distinct fingerprints within ``radius`` into their groups; some more than once."""
    if radius > RADIUS:
        raise ValueError("halves with one changed bit cover a radius of three")
    halves = distinct.select(F.col(fp).alias("fp"), F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.shiftrightunsigned(fp, 32).alias("value")),
        F.struct(F.lit(1).alias("part"), F.col(fp).bitwiseAND(0xFFFFFFFF).alias("value")),
    )).alias("half")).select("fp", "half.part", "half.value")
    flip = F.explode(F.array(F.lit(0).cast("long"), *(F.lit(1 << k).cast("long") for k in range(32)))).alias("flip")
    variant = F.col("value").bitwiseXOR(F.col("flip")).alias("variant")
    variants = halves.select("fp", "part", "value", flip).select("fp", "part", variant, (F.col("flip") == 0).alias("own"))
    # a bucket gathers 33 values, so one above the limit has a value above its 33rd part
    crowded = halves.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot / 33)
    crowded = stage(crowded.select("part", "value").coalesce(FEWEST_TASKS), "simhash-hot")
    # other half of a member, one key per byte: part 0 kept the high half, so the low bytes, and the other way round
    byte = F.posexplode(F.array(*(
        F.when(F.col("part") == 0, F.shiftrightunsigned("fp", 8 * k)).otherwise(F.shiftrightunsigned("fp", 32 + 8 * k)).bitwiseAND(255)
        for k in range(4)
    )))
    if crowded.isEmpty():
        meeting = variants
    else:
        hot_keys = crowded.select("part", "value", flip).select("part", variant).distinct()
        plain = variants.join(hot_keys, ["part", "variant"], "left_anti")
        split = variants.join(hot_keys, ["part", "variant"], "left_semi").select("fp", "part", "variant", "own", byte.alias("at", "byte")).select(
            "fp", (F.col("part") + 2 + 2 * (F.col("at") * 256 + F.col("byte"))).cast("int").alias("part"), "variant", "own"
        )
        meeting = plain.select("fp", "part", "variant", "own").unionByName(split)
    sorted_ = meeting.repartition("part", "variant").sortWithinPartitions("part", "variant", "fp")
    return sorted_.mapInArrow(tidy(_links_of_buckets(radius)), "u long, v long")


def links(distinct: DataFrame, fp: str = "fp", radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links (u > v) that join the distinct fingerprints within ``radius`` into their groups."""
    return _met(distinct, fp, radius, hot).distinct()


def _grouped(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, digest, fp, root, component_id) of every row; the root is the group's smallest fingerprint."""
    named = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    held = stage(fingerprints(named, "text").select("id", "digest", "fp"), "simhash-fingerprints")
    # a file costs a task more than small rows do
    tasks = tasks_for(held.count())
    distinct = stage(held.groupBy("fp").agg(F.min("id").alias("least")).coalesce(tasks), "simhash-distinct")
    member = components(_met(distinct), tasks)
    rooted = distinct.join(member, distinct.fp == member.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return held.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row; the smallest id that the row reaches."""
    return _grouped(docs, id_column, text).select(F.col("id").alias(id_column), "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group the row with the smallest id stays; null ids come last, equal ids are ordered by their text's digest.

    Of rows that repeat id and text the one with the smallest other columns stays.
    """
    place = F.struct(F.col("id").isNull().alias("none"), "id", "digest", F.col("count").alias("n"))
    chosen = _grouped(docs, id_column, text).groupBy("root", "id", "digest").count().groupBy("root").agg(F.min(place).alias("place"))
    kept = stage(chosen.select("place.id", "place.digest", "place.n"), "simhash-kept")
    own_id, own_digest = (fresh_name(c, docs.columns) for c in ("_kept_id", "_kept_digest"))
    same = F.col(id_column).eqNullSafe(F.col(own_id)) & (F.md5(F.coalesce(F.col(text), F.lit(""))) == F.col(own_digest))
    alone, many = (kept.where(w).select(F.col("id").alias(own_id), F.col("digest").alias(own_digest)) for w in ("n = 1", "n > 1"))
    first = docs.join(many, same, "left_semi")
    others = [c for c in docs.columns if c not in (id_column, text)]
    one = first.groupBy(id_column, text).agg(F.min(F.struct(F.lit(0).alias("_all"), *others)).alias("_first")).select(id_column, text, *(F.col("_first")[c].alias(c) for c in others))
    return docs.join(alone, same, "left_semi").unionByName(one.select(*docs.columns))
