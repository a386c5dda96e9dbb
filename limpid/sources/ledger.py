"""Tables of batches that are replaced as a whole, by versions and a ledger of deliveries.

Data files lie under ``data/_version=<v>/<batch columns>/``. Nothing is ever
overwritten in place: a write adds a version, and one small file in ``_ledger``
then says which batches it delivers, with how many rows and which columns. That
file is the switch: until it is there, readers see the batches as they were, and
a failed or repeated write leaves no trace. Of a batch, the latest delivery counts
and all versions of that delivery do, so that a stream may deliver a batch in
several micro-batches while a shorter, longer or empty redelivery replaces it.

The columns of a table are those its deliveries had, in order of appearance, as
the ledger lists them; no footer is read to merge schemas. ``upto`` gives the
table as it was known at a batch. The driver reads the ledger: one row per batch
and version, never data.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

VERSION = "_version"
NOTHING = "\x00"
"""Stands for a NULL batch value within a key."""

ENTRY = "key array<string>, by array<string>, delivery string, version string, rows bigint, columns array<struct<name:string,type:string>>, at bigint"


@dataclass(frozen=True)
class Delivered:
    """What a write has committed: rows per batch."""

    version: str
    rows: dict[tuple, int]


def new_version() -> str:
    """Later versions sort after earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _data(path: str) -> str:
    return f"{path}/data"


def _book(path: str) -> str:
    return f"{path}/_ledger"


def entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(_book(path))


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, _book(path))
    return fs.exists(p)


def deliver(
    df: DataFrame, path: str, by: Iterable[str], replaced: Iterable[tuple] = (),
    delivery: str | None = None, version: str | None = None,
) -> Delivered:
    """Add a version that holds ``df`` and switch its batches to it.

    ``replaced`` names batches that are delivered even if ``df`` has no row of
    them. Writes of one ``delivery`` add to each other; without a name every write
    is a delivery of its own. A write that is repeated under its ``version`` counts
    once. The rebalance keeps files of a sensible size: small batches share a task,
    adaptive execution splits one that holds most of the rows.
    """
    spark, by = df.sparkSession, tuple(by)
    version = version or new_version()
    folder = f"{_data(path)}/{VERSION}={version}"
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(folder)
    fields = [T.StructField(c, T.StringType()) for c in by]
    # one row per batch; counts come from the footers
    found = spark.read.schema(T.StructType(fields)).parquet(folder).groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).collect()
    rows = {tuple(k): 0 for k in replaced} | {tuple(r[c] for c in by): r["rows"] for r in found}
    columns = [(f.name, f.dataType.json()) for f in df.schema.fields]
    now = time.time_ns()
    lines = [(list(k), list(by), delivery or version, version, n, columns, now) for k, n in rows.items()]
    if lines:
        spark.createDataFrame(lines, ENTRY).coalesce(1).write.mode("append").parquet(_book(path))
    return Delivered(version, rows)


def _batch_part() -> Column:
    """The part of a key that names the batch: the first column called so, else the last."""
    named = F.array_position(F.transform("by", lambda c: F.endswith(F.lower(c), F.lit("batch_id"))), True).cast("int")
    return F.element_at("key", F.when(named > 0, named).otherwise(F.lit(-1)))


def current(spark: SparkSession, path: str, upto: str | None = None) -> DataFrame:
    """(key, version, rows) of what counts now; ``upto`` leaves out later batches."""
    book = entries(spark, path)
    if upto is not None:
        book = book.where(_batch_part() <= upto)
    latest = book.groupBy("key").agg(F.max_by("delivery", F.struct("at", "version")).alias("delivery"))
    return book.join(latest, ["key", "delivery"]).groupBy("key", "version").agg(F.max_by("rows", "at").alias("rows"))


def _columns(book: list) -> tuple[list[str], list[T.StructField]]:
    """Batch columns, and all columns ever delivered in order of appearance."""
    by, found = [], {}
    for r in sorted(book, key=lambda r: (r["at"], r["version"])):
        by = by or list(r["by"])
        for c in r["columns"]:
            kind = T._parse_datatype_json_string(c["type"])
            known = found.setdefault(c["name"].lower(), T.StructField(c["name"], kind))
            if known.dataType != kind and c["name"].lower() not in {x.lower() for x in by}:
                raise ValueError(f"column {c['name']!r} is {known.dataType.simpleString()} in one delivery and {kind.simpleString()} in another")
    return by, list(found.values())


def _key(by: list[str]) -> Column:
    return F.concat_ws("\x1f", VERSION, *[F.coalesce(F.col(f"`{c}`"), F.lit(NOTHING)) for c in by])


def read(spark: SparkSession, path: str, upto: str | None = None) -> DataFrame:
    """The table as its latest deliveries left it, with the columns known by then.

    Batches that were delivered empty are batches without rows. Which folders are
    read is decided by partition values alone.
    """
    book = entries(spark, path)
    if upto is not None:
        book = book.where(_batch_part() <= upto)
    by, fields = _columns(book.select("by", "columns", "at", "version").distinct().collect())
    live = current(spark, path, upto).where(F.col("rows") > 0).collect()
    keys = ["\x1f".join([r["version"], *[NOTHING if k is None else k for k in r["key"]]]) for r in live]
    parts = {c.lower() for c in by}
    stored = [f for f in fields if f.name.lower() not in parts]
    schema = T.StructType([*stored, T.StructField(VERSION, T.StringType()), *[T.StructField(c, T.StringType()) for c in by]])
    if not by:
        raise ValueError(f"nothing was delivered to {path}" + (f" up to {upto}" if upto else ""))
    rows = spark.read.schema(schema).parquet(_data(path)).where(_key(by).isin(keys) if keys else F.lit(False))
    return rows.select(*[f"`{f.name}`" for f in stored], *[f"`{c}`" for c in by])


def drop(spark: SparkSession, path: str, *keys: tuple) -> None:
    """Batches delivered without rows: what an empty delivery asks for."""
    r = entries(spark, path).select("by", "columns").first()
    version, now = new_version(), time.time_ns()
    lines = [(list(k), r["by"], version, version, 0, [], now) for k in keys]
    spark.createDataFrame(lines, ENTRY).coalesce(1).write.mode("append").parquet(_book(path))


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete versions of which no batch counts any more; returns how many.

    For quiet times: a reader that began before may still need them.
    """
    live = {r["version"] for r in current(spark, path).where(F.col("rows") > 0).select("version").distinct().collect()}
    fs, folder = _hadoop(spark, _data(path))
    gone = 0
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith(f"{VERSION}=") and name.split("=", 1)[1] not in live:
            fs.delete(status.getPath(), True)
            gone += 1
    return gone
