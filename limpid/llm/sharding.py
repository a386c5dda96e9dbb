"""Weighted rendezvous sharding of records by a stable key.

Every shard draws a number for a key from a hash of key and shard; the shard with
the smallest ``-log(u) / weight`` takes the record. A further shard can only take
records for itself, the others keep theirs in place. Only functions of Spark SQL.

Slots number the records of a shard from 0 without gaps: equal records are
counted first, a hash of the record spreads each shard over ``buckets`` runs, runs
are numbered side by side, and running counts of whole runs (one row each) give the offsets.

Defined cases: a null key is a key of its own; null and empty texts have size 1;
repeated rows go to one shard and get a slot each; an empty table gives an empty
result; only the key and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# records of one run of slot numbers, about
RUN_ROWS = 50_000
SEED = "shard"


def _draw(key: Column, shard: int, weight: float) -> Column:
    """Exponential with the given rate: 52 bits of the hash, shifted off zero."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), key, F.lit(shard)), 12)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / F.lit(float(weight))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Index of the shard that takes ``key``; equal draws go to the smaller index."""
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("shards need weights, one of them above zero")
    drawn = [F.struct(_draw(key, i, w).alias("at"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (drawn[0] if len(drawn) == 1 else F.least(*drawn))["shard"]


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0) -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard): the last with one more shard of weight ``grown_weight``."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    k = F.col(key).cast("string")
    return docs.select(
        F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        shard_of(k, weights).alias("shard"), shard_of(k, [*weights, grown_weight]).alias("grown_shard"),
    )


def with_slots(assigned: DataFrame, key: str = "doc_id", run_rows: int = RUN_ROWS) -> DataFrame:
    """Append ``slot``; records of a shard stand in the order of run, key, size and checksum."""
    record = assigned.columns
    counted = assigned.groupBy(*record).agg(F.count(F.lit(1)).alias("_copies"))
    total = assigned.count()
    shards = assigned.select("shard").distinct().count()
    runs = max(1, -(-total // (run_rows * max(shards, 1))))
    placed = counted.withColumn("_run", F.pmod(F.xxhash64(*record), F.lit(runs)))
    sizes = placed.groupBy("shard", "_run").agg(F.sum("_copies").alias("_size"))
    # one row per run, so a shard's running count is over few rows
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = Window.partitionBy("shard", "_run").orderBy(key, "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.withColumn("_first", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(offsets, ["shard", "_run"])
    slot = F.explode(F.sequence(F.col("_offset") + F.col("_first"), F.col("_offset") + F.col("_first") + F.col("_copies") - 1))
    return first.select(*record, slot.alias("slot"))
