"""Controlled corruption: the same rows are hit on every run and any cluster.

Rows are chosen in the order of a digest of seed and row identity, exactly
``round(n * rate)`` of them (half to even), per batch. The identity must tell
rows apart; where copies exist, add ``sources.batches.row_position``.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from limpid import schemas
from limpid.functions import ranks
from limpid.session import stage

Rate = float | DataFrame


def _columns_must_exist(df: DataFrame, *columns: str) -> None:
    have = {c.lower() for c in df.columns}
    for c in columns:
        if c.lower() not in have:
            raise ValueError(f"column {c!r} is not in the table")


def _wanted(candidates: DataFrame, batch: str, rate: Rate) -> tuple[DataFrame, int]:
    """Rows to take per batch, and the size of the largest batch.

    ``rate`` may differ by batch (batch, rate). The driver reads one number; the
    counts themselves stay a table.
    """
    counted = candidates.groupBy(batch).agg(F.count(F.lit(1)).alias("_total"))
    if isinstance(rate, DataFrame):
        counted = counted.join(rate.select(batch, F.col("rate").alias("_rate")), batch)
    else:
        counted = counted.withColumn("_rate", F.lit(float(rate)))
    counted = stage(counted, "batch-sizes")
    share = F.bround(F.col("_total") * F.col("_rate"), 0).cast("long")
    largest = counted.agg(F.max("_total").alias("m")).first()["m"]
    return counted.select(batch, share.alias("_rank")), largest or 0


def _digest(seed: int | str, identity: list[str]) -> Column:
    return ranks.sampling_key(seed, *[F.col(c) for c in identity])


def rename_column(df: DataFrame, column: str, new_name: str) -> DataFrame:
    _columns_must_exist(df, column)
    return df.withColumnRenamed(column, new_name)


def inject_nulls(
    df: DataFrame, column: str, rate: Rate, batch: str, identity: list[str], seed: int | str = 42
) -> DataFrame:
    _columns_must_exist(df, column, batch, *identity)
    wanted, largest = _wanted(df, batch, rate)
    hit = ranks.mark_sample(df, [batch], wanted, _digest(seed, identity), "_hit", largest)
    emptied = F.when(~F.col("_hit"), F.col(column)).alias(column)
    return hit.select(*[emptied if c == column else F.col(f"`{c}`") for c in df.columns])


def duplicate_rows(
    df: DataFrame, rate: Rate, batch: str, identity: list[str], seed: int | str = 42
) -> DataFrame:
    """Append chosen rows a second time, like a job that ran twice."""
    _columns_must_exist(df, batch, *identity)
    wanted, largest = _wanted(df, batch, rate)
    hit = ranks.mark_sample(df, [batch], wanted, _digest(seed, identity), "_hit", largest)
    times = F.when(F.col("_hit"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.withColumn("_copy", F.explode(times)).select(*[F.col(f"`{c}`") for c in df.columns])


def truncate_rows(
    df: DataFrame, keep: Rate, batch: str, order: Column, identity: list[str], seed: int | str = 42
) -> DataFrame:
    """Keep the first rows of every batch in the order of a number."""
    _columns_must_exist(df, batch, *identity)
    wanted, largest = _wanted(df, batch, keep)
    hit = ranks.mark_first(
        df, [batch], wanted, order.cast("double"), _digest(seed, identity), "_hit", largest
    )
    return hit.where("_hit").select(*[F.col(f"`{c}`") for c in df.columns])


def semantic_variants(
    df: DataFrame, column: str, variants: dict[str, str], rate: Rate, batch: str,
    identity: list[str], seed: int | str = 42,
) -> DataFrame:
    """Rewrite a share of the rows that carry a listed value as its variant.

    The rate applies to those rows only, so the amount is what was declared
    whatever else the batch holds.
    """
    _columns_must_exist(df, column, batch, *identity)
    candidate = F.coalesce(F.col(column).isin(list(variants)), F.lit(False))
    rest, inside = df.where(~candidate), df.where(candidate)
    wanted, largest = _wanted(inside, batch, rate)
    hit = ranks.mark_sample(inside, [batch], wanted, _digest(seed, identity), "_hit", largest)
    table = F.create_map(*[F.lit(x) for kv in variants.items() for x in kv])
    changed = F.when(F.col("_hit"), F.element_at(table, F.col(column))).otherwise(F.col(column)).alias(column)
    return rest.unionByName(
        hit.select(*[changed if c == column else F.col(f"`{c}`") for c in df.columns])
    )


CORRUPTIONS: dict[str, Callable[..., DataFrame]] = {
    "rename_column": rename_column,
    "inject_nulls": inject_nulls,
    "duplicate_rows": duplicate_rows,
    "truncate_rows": truncate_rows,
    "semantic_variants": semantic_variants,
}


def _date_of(anomaly: dict, day: int, declared: str, start: str) -> datetime.date:
    date = datetime.date.fromisoformat(str(declared))
    if date != datetime.date.fromisoformat(start) + datetime.timedelta(days=day - 1):
        raise ValueError(f"{anomaly['id']}: day {day} is not {declared}")
    return date


def spread(spark: SparkSession, declared: list[dict], start: str) -> DataFrame:
    """Declared anomalies as one row per day; a step of a ramp holds until the next.

    The first step must open the range and the last must lie inside it.
    """
    rows = []
    for a in declared:
        params = a.get("params") or {}
        head = (a["id"], a["table"], params.get("column"), a["type"])
        if "from_day" not in a:
            d = _date_of(a, a["day"], a["date"], start)
            rows.append((*head, d, d, [], float(params["rate"]) if "rate" in params else params.get("keep_rate")))
            continue
        first = _date_of(a, a["from_day"], a["from_date"], start)
        last = _date_of(a, a["to_day"], a["to_date"], start)
        steps = {int(k): float(v) for k, v in params["rate_schedule"].items()}
        if max(steps) > a["to_day"]:
            raise ValueError(f"{a['id']}: a step lies after the end of the range")
        if min(steps) != a["from_day"]:
            raise ValueError(f"{a['id']}: the first step must open the range")
        origin = datetime.date.fromisoformat(start)
        rows.append((
            *head, first, last,
            [(origin + datetime.timedelta(days=d - 1), r) for d, r in sorted(steps.items())], None,
        ))
    frame = spark.createDataFrame(
        rows,
        "anomaly_id string, table_name string, column_name string, type string, first date, "
        "last date, steps array<struct<day:date,rate:double>>, rate double",
    )
    daily = frame.select(
        "*", F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("day")
    )
    step = F.element_at(F.filter("steps", lambda s: s["day"] <= F.col("day")), -1)
    return daily.select(
        "anomaly_id", "table_name", "column_name", "type",
        F.date_format("day", "yyyy-MM-dd").alias("batch_id"),
        F.when(F.size("steps") > 0, step["rate"]).otherwise(F.col("rate")).alias("rate"),
    ).select(*schemas.EXPECTED_ANOMALY.fieldNames())


def not_yet_corrupted(wanted: DataFrame, markers: DataFrame) -> DataFrame:
    """Declared anomalies of batches that bear no marker yet."""
    return wanted.join(markers.select("batch_id").distinct(), "batch_id", "left_anti")
