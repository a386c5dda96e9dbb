"""What is declared, what is present, and bounded looks at it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from limpid import schemas, vocabulary as V


def qualified(name: str) -> str:
    """A table name must be ``SCHEMA.TABLE`` made of plain identifiers."""
    parts = name.split(".")
    if len(parts) != 2 or not all(re.match(V.TABLE_NAME_PATTERN, p) for p in parts):
        raise ValueError(f"expected SCHEMA.TABLE, got {name!r}")
    return name


def registry(spark: SparkSession, dataset: str, tables: list[dict]) -> DataFrame:
    """Declared tables as a frame; unknown fields, duplicates, bad layers raise."""
    seen, rows = set(), []
    for t in tables:
        unknown = set(t) - {"name", "layer", "batch_column"}
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        name = qualified(t["name"])
        if name.upper() in seen:
            raise ValueError(f"{name} is declared twice")
        if t.get("layer") not in V.LAYERS:
            raise ValueError(f"{name}: layer {t.get('layer')!r} is not one of {V.LAYERS}")
        seen.add(name.upper())
        rows.append((dataset, name, t["layer"], t.get("batch_column")))
    if not rows:
        raise ValueError("a dataset declares at least one table")
    return spark.createDataFrame(rows, schemas.REGISTRY)


def registry_errors(reg: DataFrame) -> DataFrame:
    """The same rules on a registry that is already a table, one row per fault."""
    per_table = reg.groupBy("dataset", F.upper("table_name").alias("table_name")).agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_if(~F.col("layer").isin(*V.LAYERS) | F.col("layer").isNull()).alias("bad_layers"),
    )
    fault = F.filter(
        F.array(
            F.when(F.col("copies") > 1, F.lit("duplicate_table")),
            F.when(F.col("bad_layers") > 0, F.lit("bad_layer")),
            F.when(F.size(F.split("table_name", r"\.")) != 2, F.lit("unqualified_name")),
        ),
        lambda x: x.isNotNull(),
    )
    return per_table.select("dataset", "table_name", F.explode(fault).alias("fault"))


def tables_of(reg: DataFrame, layer: str) -> DataFrame:
    if layer not in V.LAYERS:
        raise ValueError(f"unknown layer {layer!r}")
    return reg.where(F.col("layer") == layer).orderBy("table_name")


def present_tables(spark: SparkSession, databases: list[str], internal: tuple[str, ...] = ("ops", "information_schema")) -> DataFrame:
    """Tables and views of the given databases, internal ones left out."""
    names = [
        (f"{db}.{t.name}".upper(),)
        for db in databases
        if db.lower() not in internal
        for t in spark.catalog.listTables(db)
        if not t.isTemporary
    ]
    return spark.createDataFrame(names, "table_name string").orderBy("table_name")


def columns_of(df: DataFrame, table_name: str) -> DataFrame:
    """Name, type and position of every column, as rows."""
    spark = df.sparkSession
    rows = [(table_name, f.name, f.dataType.simpleString(), i + 1) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, type string, position int"
    )


def get_schema(spark: SparkSession, table_name: str) -> DataFrame | None:
    """Like ``columns_of`` for a catalogue table; ``None`` when it is absent."""
    if not spark.catalog.tableExists(table_name):
        return None
    return columns_of(spark.table(table_name), table_name)


def present_columns(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [columns_of(df, t) for t, df in tables.items()])


def bounded_rows(df: DataFrame, limit: int = V.RAW_ROW_CAP) -> tuple[DataFrame, bool]:
    """At most ``limit`` rows, and whether there were more."""
    more = df.limit(limit + 1).count() > limit
    return df.limit(limit), more


def gold_view(
    reg: DataFrame, table_name: str, resolve, limit: int = 200
) -> tuple[DataFrame, bool]:
    """A bounded look at one declared gold table; other layers are refused."""
    declared = reg.where(
        (F.upper("table_name") == table_name.upper()) & (F.col("layer") == "gold")
    )
    if declared.isEmpty():
        raise ValueError(f"{table_name} is not a declared gold table")
    return bounded_rows(resolve(table_name), limit)
