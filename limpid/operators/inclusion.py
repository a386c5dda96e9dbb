"""Inclusions between the columns of any number of tables, found by values in one plan.

The inverted structure: for every value, the set of columns that hold it, as bits
of a few whole numbers. It is gathered by ``bit_or``, whose partial aggregates
leave one row per value and task, so that a value in a third of all rows costs
nothing extra. Values with equal sets are then counted together, which leaves few
rows: how many values two columns share follows from these, and a column is
included in another if they share all its values. The number of jobs and scans
does not depend on the number of pairs.

Values meet as what they are: whole numbers of any width with each other, texts
with texts, days with days, moments with moments. Fractions, booleans and nested
values refer to nothing and are left out. Columns whose bounds lie within those of
no other column of their kind, and which contain no other, cannot be part of an
inclusion; their values are not read (``bounded=False`` reads them all the same).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

WORD_BITS = 63
LONG_TEXT = 256
"""Length from which the digest of a text, with its length, stands for it."""

INCLUSION = "table_name string, column_name string, parent_table string, parent_column string, values bigint, parent_values bigint"


def _kind(dtype: T.DataType) -> str | None:
    if isinstance(dtype, T.IntegralType) or (isinstance(dtype, T.DecimalType) and dtype.scale == 0):
        return "whole"
    for kind, types in (("text", (T.StringType, T.CharType, T.VarcharType)), ("day", T.DateType),
                        ("moment", T.TimestampType), ("clock", T.TimestampNTZType)):
        if isinstance(dtype, types):
            return kind
    return None


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _value(name: str, kind: str, wide: bool) -> Column:
    value = _column(name)
    if kind == "whole":
        return value.cast("decimal(38,0)" if wide else "bigint")
    if kind == "text":
        text = value.cast("string")
        digest = F.concat(F.lit("sha256:"), F.length(text).cast("string"), F.lit(":"), F.sha2(text, 256))
        return F.when(F.length(text) > LONG_TEXT, digest).otherwise(text)
    return value


def _ordered(name: str, kind: str) -> Column:
    value = _column(name)
    if kind == "day":
        return F.unix_date(value)
    if kind == "moment":
        return F.unix_micros(value)
    if kind == "clock":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value)
    return value.cast("decimal(38,0)" if kind == "whole" else "string")


def bounds(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, kind, low, high, short, long, filled, n) of every comparable column; one scan a table.

    Days and moments are counted from 1970, so that all but texts are whole numbers.
    """
    out = []
    for table, df in tables.items():
        kinds = {f.name: k for f in df.schema.fields if (k := _kind(f.dataType))}
        if not kinds:
            continue
        measures = [F.count(F.lit(1)).alias("n")]
        for i, (c, kind) in enumerate(kinds.items()):
            v = _ordered(c, kind)
            size = F.octet_length(v) if kind == "text" else F.lit(0)
            measures += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.min(size).alias(f"s{i}"), F.max(size).alias(f"l{i}"), F.count(v).alias(f"c{i}")]
        entries = [
            F.struct(
                F.lit(c).alias("column_name"), F.lit(kind).alias("kind"),
                *(F.col(f"{x}{i}").cast("string").alias(y) for x, y in (("lo", "low"), ("hi", "high"))),
                F.col(f"s{i}").alias("short"), F.col(f"l{i}").alias("long"), F.col(f"c{i}").alias("filled"),
            )
            for i, (c, kind) in enumerate(kinds.items())
        ]
        out.append(df.agg(*measures).select(F.lit(table).alias("table_name"), F.inline(F.array(*entries)), "n"))
    if not out:
        nothing = "table_name string, column_name string, kind string, low string, high string, short int, long int, filled bigint, n bigint"
        return next(iter(tables.values())).sparkSession.createDataFrame([], nothing)
    return reduce(DataFrame.unionByName, out)


def _candidates(facts: list) -> set[tuple[str, str]]:
    """Columns that lie within another's bounds, or the other way round. One entry per column, never per row."""
    keyed = []
    for r in facts:
        if r["filled"]:
            read = str.encode if r["kind"] == "text" else int
            keyed.append((r["kind"], read(r["low"]), read(r["high"]), r["short"], r["long"], (r["table_name"], r["column_name"])))
    found = set()
    for kind, low, high, short, long, name in keyed:
        for other, lo, hi, least, most, parent in keyed:
            if kind == other and name != parent and lo <= low and high <= hi and least <= short and long <= most:
                found |= {name, parent}
    return found


def _masks(tables: dict[str, DataFrame], numbers: dict[tuple[str, str], int], kind: str, words: int) -> DataFrame | None:
    """(m0, m1, ..., n): how many values of one kind stand in exactly these columns."""
    wide = any(
        isinstance(f.dataType, T.DecimalType) for t, df in tables.items() for f in df.schema.fields
        if (t, f.name) in numbers and _kind(f.dataType) == kind
    )
    cells = []
    for table, df in tables.items():
        own = [f.name for f in df.schema.fields if _kind(f.dataType) == kind and (table, f.name) in numbers]
        if not own:
            continue
        entries = []
        for c in own:
            at = numbers[table, c]
            bits = [F.lit(1 << at % WORD_BITS if at // WORD_BITS == w else 0).cast("bigint").alias(f"m{w}") for w in range(words)]
            entries.append(F.struct(_value(c, kind, wide).alias("v"), *bits))
        cells.append(df.select(F.inline(F.array(*entries))).where("v IS NOT NULL"))
    if not cells:
        return None
    masks = [f"m{w}" for w in range(words)]
    held = reduce(DataFrame.unionByName, cells).groupBy("v").agg(*[F.bit_or(m).alias(m) for m in masks])
    return held.groupBy(*masks).agg(F.count(F.lit(1)).alias("n"))


def inclusions(spark: SparkSession, tables: dict[str, DataFrame], bounded: bool = True, facts: list | None = None) -> DataFrame:
    """Every pair of columns (child, parent) of which all values of the child stand in the parent.

    Equal columns include each other; a column without values is included in none.
    ``facts`` are collected ``bounds``, if they are at hand.
    """
    listed = [(t, f.name, _kind(f.dataType)) for t, df in tables.items() for f in df.schema.fields if _kind(f.dataType)]
    kept = {(t, c) for t, c, _ in listed}
    if bounded and listed:
        kept = _candidates(bounds(tables).collect() if facts is None else facts)
    names = [(t, c) for t, c, _ in listed if (t, c) in kept]
    if not names:
        return spark.createDataFrame([], INCLUSION)
    numbers = {name: i for i, name in enumerate(names)}
    words = len(names) // WORD_BITS + 1
    kinds = sorted({k for _, _, k in listed})
    counted = reduce(DataFrame.unionByName, [m for k in kinds if (m := _masks(tables, numbers, k, words)) is not None])
    member = lambda i: F.col(f"m{i // WORD_BITS}").bitwiseAND(F.lit(1 << i % WORD_BITS)) != 0
    inside = F.array_compact(F.array(*[F.when(member(i), F.lit(i)) for i in range(len(names))]))
    sets = counted.select("n", inside.alias("columns"))
    # one row per set of columns that share values, never per value
    shared = sets.select("n", "columns", F.explode("columns").alias("a")).select("n", "a", F.explode("columns").alias("b"))
    shared = shared.groupBy("a", "b").agg(F.sum("n").alias("shared"))
    sizes = shared.where("a = b")
    named = spark.createDataFrame([(i, t, c) for (t, c), i in numbers.items()], "i int, t string, c string")
    child = sizes.select(F.col("a"), F.col("shared").alias("values"))
    parent = sizes.select(F.col("b"), F.col("shared").alias("parent_values"))
    found = shared.where("a <> b").join(child, "a").where(F.col("shared") == F.col("values")).join(parent, "b")
    return (
        found.join(named.select(F.col("i").alias("a"), F.col("t").alias("table_name"), F.col("c").alias("column_name")), "a")
        .join(named.select(F.col("i").alias("b"), F.col("t").alias("parent_table"), F.col("c").alias("parent_column")), "b")
        .select("table_name", "column_name", "parent_table", "parent_column", "values", "parent_values")
    )


def foreign_keys(spark: SparkSession, tables: dict[str, DataFrame], uniqueness: float = 0.99) -> DataFrame:
    """Inclusions in the identifiers of another table: a role that only two tables together show.

    An identifier has a value in every row, and as many values as rows but for a
    hundredth; ``values`` and the row counts of the same pass decide.
    """
    facts = bounds(tables).collect()
    rows = spark.createDataFrame([(r["table_name"], r["column_name"], r["n"], r["filled"]) for r in facts],
                                 "parent_table string, parent_column string, n bigint, filled bigint")
    found = inclusions(spark, tables, facts=facts).where(F.col("table_name") != F.col("parent_table"))
    identifier = (F.col("n") == F.col("filled")) & (F.col("parent_values") >= F.col("n") * uniqueness)
    return found.join(rows, ["parent_table", "parent_column"]).where(identifier).select(
        "table_name", "column_name", "parent_table", "parent_column", F.lit("foreign_key").alias("role"))
