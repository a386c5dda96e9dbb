"""Daily batches in and out: text files to a raw layer that tolerates drift."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from limpid import vocabulary as V
from limpid.session import stage
from limpid.sources import ledger, quoted

META = ("_batch_id", "_source", "_ingested_at")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def child_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def null_tokens_to_null(df: DataFrame, tokens: tuple[str, ...] = V.NULL_TOKENS) -> DataFrame:
    """Text columns with the listed spellings of "missing" emptied."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(*tokens), c).alias(f.name)
        out.append(c)
    return df.select(*out)


def read_text_table(spark: SparkSession, path: str, schema: T.StructType | None = None, keep_tokens: bool = False) -> DataFrame:
    """CSV with a header, every column a string, missing tokens NULL.

    Quoted line breaks are honoured, and a file is read in as many tasks as it has
    ranges all the same (``quoted``). A first pass, whose result is written, decides
    whether the lines are the records.
    """
    head = spark.read.option("header", True).option("escape", '"')
    # only the first record is read for the names
    columns = schema.fieldNames() if schema is not None else head.option("multiLine", True).csv(path).columns
    ranges = stage(quoted.range_maps(spark, path), "text-ranges")
    if ranges.agg(quoted.needs_records().alias("needed")).first()["needed"]:
        df = quoted.read_records(spark, path, columns, ranges)
    else:
        texts = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        df = head.option("multiLine", False).schema(texts).csv(path)
    return df if keep_tokens else null_tokens_to_null(df)


def stamp(df: DataFrame, batch_id: Column | str, source: Column | str) -> DataFrame:
    """Add the technical columns every raw row carries."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return (
        df.withColumn("_batch_id", as_col(batch_id))
        .withColumn("_source", as_col(source))
        .withColumn("_ingested_at", F.current_timestamp().cast("timestamp_ntz"))
    )


def write_batches(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace exactly the batches present in ``df``; other batches stay.

    Loading a batch twice leaves the same rows. New columns appear in the table as
    soon as a batch has them. See ``ledger`` for how a batch is switched at once.
    """
    ledger.deliver(df, path, partitions or ("_batch_id",))


def drop_batch(spark: SparkSession, path: str, batch_id: str) -> None:
    """Remove the rows of one batch, as an empty delivery asks for."""
    ledger.drop(spark, path, (batch_id,))


def read_batches(spark: SparkSession, path: str, upto: str | None = None) -> DataFrame:
    """The raw table with the union of all columns its batches ever had; ``upto`` a batch, if given."""
    return ledger.read(spark, path, upto)


def schema_rows(
    spark: SparkSession, batch_id: str, table_name: str, columns: list[str]
) -> DataFrame:
    """The observed columns of one table and batch, positions from 1."""
    return spark.range(1).select(
        F.lit(batch_id).alias("batch_id"),
        F.lit(table_name).alias("table_name"),
        F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("p", "column_name"),
    ).select(
        "batch_id", "table_name", F.upper("column_name").alias("column_name"),
        (F.col("p") + 1).cast("int").alias("ordinal_position"),
        F.current_timestamp().cast("timestamp_ntz").alias("captured_at"),
    )


def write_schema_history(rows: DataFrame, path: str) -> None:
    """Replace the columns noted for a batch and table."""
    ledger.deliver(rows, path, ("batch_id", "table_name"))


def load_batch(spark: SparkSession, incoming: str, batch_id: str, bronze: str) -> DataFrame:
    """Load every file of one batch folder; returns rows loaded per table.

    The file stem names the table. A missing folder is an error.
    """
    folder = f"{incoming}/{batch_id}"
    if not path_exists(spark, folder):
        raise FileNotFoundError(f"no batch folder {folder}")
    counts = []
    for name in child_names(spark, folder):
        if not name.endswith(".csv"):
            continue
        table = name[: -len(".csv")]
        raw = read_text_table(spark, f"{folder}/{name}")
        write_schema_history(schema_rows(spark, batch_id, table, raw.columns), f"{bronze}/_schema_history")
        # an empty file is a delivery too
        made = ledger.deliver(stamp(raw, batch_id, F.lit(name)), f"{bronze}/{table}", ("_batch_id",), [(batch_id,)])
        rows = made.rows[batch_id,]
        counts.append(spark.range(1).select(
            F.lit(table).alias("table_name"), F.lit(batch_id).alias("batch_id"), F.lit(rows).cast("long").alias("rows")))
    if not counts:
        raise FileNotFoundError(f"no file in {folder}")
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def day_window(
    spark: SparkSession, first: str, last: str, window: tuple[str, str]
) -> DataFrame:
    """Days from ``first`` to ``last``, both included; refuses days outside."""
    low, high = (datetime.date.fromisoformat(d) for d in window)
    a, b = datetime.date.fromisoformat(first), datetime.date.fromisoformat(last)
    if a > b or a < low or b > high:
        raise ValueError(f"{first}..{last} is outside {window[0]}..{window[1]}")
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(a), F.lit(b), F.expr("interval 1 day"))).alias("day")
    ).select(F.date_format("day", "yyyy-MM-dd").alias("batch_id"))


def daily_slices(
    orders: DataFrame, day: Column, key: str, children: dict[str, tuple[DataFrame, str]]
) -> dict[str, DataFrame]:
    """All days at once: orders with their ``_batch_id``, children by the key.

    A child row goes to every day its order belongs to, as a per-day semi join
    would send it.
    """
    dated = orders.withColumn("_batch_id", F.date_format(day, "yyyy-MM-dd")).where(
        F.col("_batch_id").isNotNull()
    )
    days = dated.select(F.col(key).alias("_key"), "_batch_id").distinct()
    out = {"orders": dated}
    for name, (child, child_key) in children.items():
        out[name] = child.join(days, child[child_key] == days["_key"]).drop("_key")
    return out


def slice_of_day(
    orders: DataFrame, day: Column, wanted: str, key: str,
    children: dict[str, tuple[DataFrame, str]], parents: dict[str, tuple[DataFrame, str, str]],
    reference: dict[str, DataFrame], first_day: str,
) -> dict[str, DataFrame]:
    """One day: its orders, the rows they refer to, reference tables on day one."""
    todays = orders.where(F.date_format(day, "yyyy-MM-dd") == wanted)
    out = {"orders": todays}
    for name, (child, child_key) in children.items():
        out[name] = child.join(todays, child[child_key] == todays[key], "left_semi")
    for name, (parent, parent_key, order_key) in parents.items():
        out[name] = parent.join(todays, parent[parent_key] == todays[order_key], "left_semi")
    if wanted == first_day:
        out.update(reference)
    return out


def write_days(df: DataFrame, path: str, day: str = "_batch_id", parts: int = 16) -> None:
    """Files per day, sorted by the first two columns, the same on every run.

    A day is cut into ``parts`` by its leading column, so that a heavy day is
    sorted by that many tasks; choose it by the volume of a day.
    """
    first, second = [c for c in df.columns if c != day][:2]
    (
        df.repartition(F.col(day), F.pmod(F.xxhash64(first), F.lit(parts)))
        .sortWithinPartitions(day, first, second, *[c for c in df.columns if c not in (day, first, second)])
        .write.mode("overwrite")
        .partitionBy(day)
        .parquet(path)
    )


def row_position() -> Column:
    """Where a row of a Parquet table lies: tells exact copies apart."""
    return F.concat_ws(
        ":", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string")
    )


def latest_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(order.desc())
    return df.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


TableResolver = Callable[[str], DataFrame]
