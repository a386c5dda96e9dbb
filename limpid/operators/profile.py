"""Measuring tables: counts, bounds, frequent values, robust statistics, roles.

All batches of a table are profiled together. Two passes over the data feed
everything: one plain aggregate for counts and bounds, and one frequency table
``(batch, column, value) -> rows`` from which distinct counts, frequent values,
coverage, medians and spelling collisions all follow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from limpid import vocabulary as V
from limpid.functions import ranks, text
from limpid.session import stage

WHOLE = "*"
"""Batch id standing for a table profiled in one piece."""

UNDATED = "(none)"
"""Batch id of rows that carry none."""

DIGEST_OVER = 256
"""Length from which counting shuffles a digest of a text instead of the text."""

MAP_LIMIT = 200_000
"""Distinct values per group up to which ``percentile`` may keep its map; both ways give the same median."""


def type_class(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "other"


def batch_filter(df: DataFrame, batch_column: str | None, batch_id: str | None) -> DataFrame:
    """Rows of one batch; everything when either part is not given."""
    if not batch_column or not batch_id:
        return df
    if batch_column.lower() not in [c.lower() for c in df.columns]:
        raise ValueError(f"declared batch column {batch_column!r} is not in the table")
    return df.where(F.col(batch_column) == F.lit(batch_id))


def _batch(df: DataFrame, batch_column: str | None) -> Column:
    """Rows without a batch form one of their own, so that joins by batch keep them."""
    return F.coalesce(F.col(batch_column).cast("string"), F.lit(UNDATED)) if batch_column else F.lit(WHOLE)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def frequency_table(
    df: DataFrame, columns: list[str] | None = None, batch_column: str | None = None,
    digest_over: int | None = None,
) -> DataFrame:
    """``(batch_id, column_name, value, n)`` for all non-null values, as text.

    Partial aggregation leaves one row per distinct value and task before the
    shuffle, so a value held by a third of all rows costs nothing extra. With
    ``digest_over`` longer texts appear as their length and SHA-256 digest (of
    the whole text): enough to count them, and a fraction of the bytes.

    Values are told apart by what they are, not by how they print: both zeros
    are one value, instants that print alike are two, and a short text that
    reads like a digest is not one.
    """
    columns = columns or list(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    classes = {c: type_class(kind) for c, kind in types.items()}

    def shown(c: str) -> str:
        name = _sql_name(c)
        if isinstance(types[c], (T.DoubleType, T.FloatType)):
            name = f"IF({name} = 0, CAST(0 AS {types[c].simpleString()}), {name})"
        if digest_over is None or classes[c] in ("number", "date"):
            return f"CAST({name} AS STRING)"
        whole = f"CAST({name} AS STRING)"
        return (
            f"CASE WHEN length({whole}) > {int(digest_over)} "
            f"THEN concat('sha256:', length({whole}), ':', sha2({whole}, 256)) ELSE {whole} END"
        )

    def apart(c: str) -> str:
        if isinstance(types[c], T.TimestampType):
            return f"unix_micros({_sql_name(c)})"
        if digest_over is None or classes[c] in ("number", "date"):
            return "CAST(NULL AS BIGINT)"
        return f"IF(length(CAST({_sql_name(c)} AS STRING)) > {int(digest_over)}, 1L, CAST(NULL AS BIGINT))"

    # one SQL text instead of several driver calls per column
    entries = ", ".join(f"struct({_sql_text(c)} AS column_name, {shown(c)} AS value, {apart(c)} AS _apart)" for c in columns)
    cells = df.select(_batch(df, batch_column).alias("batch_id"), F.expr(f"inline(array({entries}))"))
    return (
        cells.where("value IS NOT NULL")
        .groupBy("batch_id", "column_name", "value", "_apart")
        .agg(F.expr("count(1) AS n"))
        .drop("_apart")
    )


def column_bounds(
    df: DataFrame, columns: list[str] | None = None, batch_column: str | None = None
) -> DataFrame:
    """Row and null counts and native-order bounds of every column, one scan.

    Bounds follow the type of the column: text compares as text.
    """
    columns = columns or list(df.columns)
    schema = {f.name: f.dataType for f in df.schema.fields}
    # bounds of texts alone would have every task sort its rows by batch; beside an
    # aggregate that is an object (an empty set) a few batches are kept by hash instead
    sorts = batch_column and any(type_class(schema[c]) not in ("number", "date") for c in columns)
    rows = "count(1) + size(collect_set(CAST(NULL AS INT)))" if sorts else "count(1)"
    aggregates, entries = [f"{rows} AS row_count"], []
    for i, c in enumerate(columns):
        value, kind = _sql_name(c), type_class(schema[c])
        if not isinstance(schema[c], T.AtomicType):
            value = f"CAST({value} AS STRING)"
        aggregates += [
            f"count({value}) AS _n{i}", f"min({value}) AS _lo{i}", f"max({value}) AS _hi{i}"
        ]
        if kind not in ("number", "date"):
            aggregates.append(f"max(length(CAST({value} AS STRING))) AS _len{i}")
        low, high = (
            (f"CAST(_lo{i} AS DOUBLE)", f"CAST(_hi{i} AS DOUBLE)") if kind == "number"
            else ("CAST(NULL AS DOUBLE)",) * 2
        )
        entries.append(
            f"struct({_sql_text(c)} AS column_name, {_sql_text(schema[c].simpleString())} AS type, "
            f"'{kind}' AS type_class, {i + 1} AS position, _n{i} AS non_null_count, "
            f"CAST(_lo{i} AS STRING) AS min, CAST(_hi{i} AS STRING) AS max, "
            f"{low} AS min_number, {high} AS max_number, "
            + (f"_len{i}" if kind not in ("number", "date") else "CAST(NULL AS INT)") + " AS max_length)"
        )
    if batch_column:
        keyed = df.select("*", _batch(df, batch_column).alias("_batch"))
        wide = keyed.groupBy(F.col("_batch").alias("batch_id")).agg(*map(F.expr, aggregates))
    else:
        # a global aggregate keeps one row for an empty table
        wide = df.selectExpr(*aggregates).select(F.lit(WHOLE).alias("batch_id"), "*")
    return (
        wide.select("batch_id", "row_count", F.expr(f"inline(array({', '.join(entries)}))"))
        .withColumn("null_count", F.col("row_count") - F.col("non_null_count"))
        .withColumn("null_rate", text.rate(F.col("null_count"), F.col("row_count")))
    )


def with_distinct(bounds: DataFrame, freq: DataFrame, keys: tuple[str, ...] = ("batch_id", "column_name")) -> DataFrame:
    counted = freq.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct"))
    return bounds.join(counted, list(keys), "left").withColumn(
        "distinct", F.coalesce("distinct", F.lit(0).cast("long"))
    )


def distinct_counts(df: DataFrame, columns: list[str] | None = None, batch_column: str | None = None) -> DataFrame:
    """``(batch_id, column_name, distinct)`` of all columns, by 128 bits of hash per value.

    Where only the number of values counts, as for keys and free texts, no value is
    spelled out or shuffled: a value is two whole numbers, whatever its length, and
    one row per distinct value and task. Both zeros are one value.
    """
    columns = columns or list(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}

    def value(c: str) -> str:
        name = _sql_name(c)
        if isinstance(types[c], (T.DoubleType, T.FloatType)):
            return f"IF({name} = 0, CAST(0 AS {types[c].simpleString()}), {name})"
        return name if isinstance(types[c], T.AtomicType) else f"CAST({name} AS STRING)"

    entries = ", ".join(
        f"struct({i + 1} AS _c, {_sql_name(c)} IS NOT NULL AS _filled, xxhash64({value(c)}) AS _h1, xxhash64(1L, {value(c)}) AS _h2)"
        for i, c in enumerate(columns))
    cells = df.select(_batch(df, batch_column).alias("batch_id"), F.expr(f"inline(array({entries}))")).where("_filled")
    names = F.array(*[F.lit(c) for c in columns])
    found = cells.select("batch_id", "_c", "_h1", "_h2").distinct().groupBy("batch_id", "_c").agg(F.count(F.lit(1)).alias("distinct"))
    return found.select("batch_id", F.element_at(names, F.col("_c")).alias("column_name"), "distinct")


def measured(df: DataFrame, columns: list[str] | None = None, batch_column: str | None = None) -> DataFrame:
    """Counts, bounds and exact distinct counts of columns: all that their roles need."""
    counted = distinct_counts(df, columns, batch_column)
    return column_bounds(df, columns, batch_column).join(counted, ["batch_id", "column_name"], "left").withColumn(
        "distinct", F.coalesce("distinct", F.lit(0).cast("long")))


def approximate_distinct(
    df: DataFrame, columns: list[str] | None = None, batch_column: str | None = None,
    error: float = 0.05,
) -> DataFrame:
    """Sketched distinct counts: no shuffle of values, but not exact."""
    columns = columns or list(df.columns)
    wide = df.groupBy(_batch(df, batch_column).alias("batch_id")).agg(
        *[F.approx_count_distinct(_quoted(c), error).alias(c) for c in columns]
    )
    return wide.unpivot("batch_id", columns, "column_name", "approx_distinct")


def classify(stats: DataFrame) -> DataFrame:
    """Add ``role``, from measured facts only. The order of the tests decides."""
    kind = F.col("type_class")
    as_date = (kind == "date") | (
        (kind == "text") & text.reads_as_date(F.col("min")) & text.reads_as_date(F.col("max"))
    )
    as_number = (kind == "number") | (
        (kind == "text") & text.reads_as_number(F.col("min")) & text.reads_as_number(F.col("max"))
    )
    continuous = kind.isin("number", "text") & (
        text.has_fraction(F.col("min")) | text.has_fraction(F.col("max"))
    )
    uniqueness = F.col("distinct") / F.col("row_count")
    role = (
        F.when((F.col("row_count") == 0) | (F.col("distinct") == 0), "unknown")
        .when(as_date, "temporal")
        .when(
            (uniqueness >= V.UNIQUENESS_MIN) & (F.col("null_count") == 0) & ~continuous,
            "identifier",
        )
        .when(as_number, "numeric")
        .when(uniqueness <= V.CATEGORICAL_MAX, "categorical")
        .otherwise("free_text")
    )
    return stats.withColumn("role", role)


def freshness(stats: DataFrame) -> DataFrame:
    """Span, lag and future flag of temporal columns, read off their bounds."""
    temporal = F.col("role") == "temporal"
    first = text.day_or_null(F.col("min"))
    last = text.day_or_null(F.col("max"))
    batch = text.day_or_null(F.col("batch_id"))
    readable = temporal & first.isNotNull() & last.isNotNull()
    return (
        stats.withColumn("amplitude_jours", F.when(readable, F.datediff(last, first)).cast("long"))
        .withColumn("retard_jours", F.when(readable, F.datediff(batch, last)).cast("long"))
        .withColumn(
            "dates_futures",
            F.when(readable & batch.isNotNull(), (last > batch).cast("long")),
        )
    )


def category_values(
    rows: DataFrame, profile: DataFrame, table_name: str, batch_column: str | None = None,
    also: DataFrame | None = None,
) -> DataFrame:
    """``(table_name, batch_id, column_name, value, n)``: every value, however many there are.

    Of the categorical columns of a profile and of the columns that ``also``
    names; the driver reads column names only.
    """
    wanted = profile.where(F.col("role") == "categorical").select(F.upper("column_name").alias("c"))
    if also is not None:
        wanted = wanted.unionByName(also.select(F.upper("column_name").alias("c")))
    names = {r["c"] for r in wanted.distinct().collect()}
    present = [c for c in rows.columns if c.upper() in names]
    if not present:
        empty = "table_name string, batch_id string, column_name string, value string, n bigint"
        return rows.sparkSession.createDataFrame([], empty)
    return frequency_table(rows, present, batch_column).select(
        F.lit(table_name).alias("table_name"), "batch_id", "column_name", "value", "n"
    )


def adaptive_k(distinct: Column) -> Column:
    """All values of an enumerable column, the default head of any other."""
    return F.when(distinct.between(1, V.ENUMERABLE_MAX), distinct).otherwise(V.TOP_K_DEFAULT)


def ranked_values(freq: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The ``limit`` most frequent values per key, with their rank.

    The literal limit lets Spark keep only that many rows per key and task
    before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("value"))
    return freq.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def top_values(
    df: DataFrame, column: str, k: int, batch_column: str | None = None,
    batch_id: str | None = None,
) -> DataFrame | None:
    """Most frequent values of one column per batch, with their coverage.

    ``None`` when the column is not there. An empty column gives coverage 0.0.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k!r}")
    actual = next((c for c in df.columns if c.lower() == column.lower()), None)
    if actual is None:
        return None
    rows = batch_filter(df, batch_column, batch_id)
    freq = frequency_table(rows, [actual], batch_column)
    totals = column_bounds(rows, [actual], batch_column).select(
        "batch_id", "column_name", F.col("non_null_count")
    )
    return totals.join(
        _collected_top(ranked_values(freq, ["batch_id", "column_name"], k), F.lit(k)),
        ["batch_id", "column_name"], "left",
    ).select(
        "batch_id", "column_name", F.lit(k).alias("k"), "non_null_count",
        text.rate(F.coalesce("covered", F.lit(0)), F.col("non_null_count")).alias("coverage"),
        F.coalesce("top", F.array().cast("array<struct<value:string,count:bigint>>")).alias("top"),
    )


def _collected_top(ranked: DataFrame, k: Column, keys: tuple[str, ...] = ("batch_id", "column_name")) -> DataFrame:
    kept = ranked.where(F.col("rank") <= k)
    return kept.groupBy(*keys).agg(
        F.sum("n").alias("covered"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "value", "n"))),
            lambda e: F.struct(e["value"].alias("value"), e["n"].alias("count")),
        ).alias("top"),
    )


def _written_numbers(freq: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Numeric reading of the frequency table; typed columns need no pattern."""
    typed = F.col("value").try_cast("double")
    read = F.when(F.col("type_class") == "number", typed).otherwise(
        text.number_or_null(F.col("value"))
    )
    return (
        freq.join(
            stats.where(F.col("type_class").isin("number", "text")).select(*keys, "type_class"),
            keys,
        )
        .withColumn("v", F.when(~F.isnan(read), read))
        .drop("type_class")
    )


def numeric_frequency(
    df: DataFrame, columns: list[str], batch_column: str | None = None
) -> DataFrame:
    """``(batch_id, column_name, v, n)``: values read as doubles, never as text.

    Typed columns are cast; text is read where it is a number, and its other
    values are counted together under a NULL ``v``.
    """
    classes = {f.name: type_class(f.dataType) for f in df.schema.fields}
    letters = _sql_text(text.NUMBER_LETTERS)

    def reading(c: str) -> str:
        name = _sql_name(c)
        if classes[c] == "number":
            return f"CAST({name} AS DOUBLE)"
        return f"CASE WHEN translate(trim({name}), {letters}, '') = '' THEN try_cast(trim({name}) AS DOUBLE) END"

    entries = ", ".join(
        f"struct({_sql_text(c)} AS column_name, {reading(c)} AS v, {_sql_name(c)} IS NOT NULL AS filled)"
        for c in columns
    )
    cells = df.select(_batch(df, batch_column).alias("batch_id"), F.expr(f"inline(array({entries}))"))
    return (
        cells.where("filled")
        .select("batch_id", "column_name", F.expr("CASE WHEN NOT isnan(v) THEN v END AS v"))
        .groupBy("batch_id", "column_name", "v")
        .agg(F.expr("count(1) AS n"))
    )


def robust_frame(numbers: DataFrame, keys: list[str], bounded: bool) -> DataFrame:
    """Median, MAD, bounds and readable share from ``(keys, v, n)``.

    ``v`` is NULL for a value that does not read as a number. ``bounded`` says
    that no group has more than ``MAP_LIMIT`` distinct values.
    """
    median = ranks.median_by_map if bounded else ranks.median_by_rank
    readable = numbers.where(F.col("v").isNotNull()).select(*keys, "v", "n")
    middle = median(readable, keys, "v", "n")
    if not bounded:
        middle = stage(middle, "medians")
    deviation = (
        readable.join(middle, keys)
        .select(*keys, F.abs(F.col("v") - F.col("median")).alias("v"), "n")
    )
    spread = median(deviation, keys, "v", "n").withColumnRenamed("median", "mad")
    counts = numbers.groupBy(*keys).agg(
        F.sum("n").alias("non_null_count"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("numeric_count"),
        F.min("v").alias("numeric_min"),
        F.max("v").alias("numeric_max"),
    )
    return (
        counts.join(middle, keys, "left")
        .join(spread, keys, "left")
        .withColumn("numeric_rate", text.rate(F.col("numeric_count"), F.col("non_null_count")))
    )


def _bounded(freq_stats: DataFrame) -> bool:
    """One number read by the driver: the widest measured group."""
    widest = freq_stats.agg(F.max("distinct").alias("d")).first()["d"]
    return (widest or 0) <= MAP_LIMIT


def robust_stats(
    df: DataFrame, columns: list[str], batch_column: str | None = None,
    batch_id: str | None = None,
) -> DataFrame:
    """Median and MAD of several columns per batch.

    Text is read as numbers where it is one, and the share that could be read
    is reported. Columns that cannot hold numbers come back with NULL measures
    and are never scanned.
    """
    schema = {f.name: type_class(f.dataType) for f in df.schema.fields}
    present = [c for c in df.columns if c.lower() in {x.lower() for x in columns}]
    measurable = [c for c in present if schema[c] in ("number", "text")]
    rows = batch_filter(df, batch_column, batch_id)
    bounds = column_bounds(rows, present, batch_column)
    frame = bounds.select("batch_id", "column_name", "type", F.col("non_null_count").alias("filled"), "type_class")
    if measurable:
        numbers = stage(numeric_frequency(rows, measurable, batch_column), "frequency")
        sizes = numbers.groupBy("batch_id", "column_name").agg(F.count(F.lit(1)).alias("distinct"))
        stats = robust_frame(numbers, ["batch_id", "column_name"], _bounded(sizes))
    else:
        stats = frame.select("batch_id", "column_name").limit(0)
        for c in ("median", "mad", "numeric_min", "numeric_max", "numeric_rate"):
            stats = stats.withColumn(c, F.lit(None).cast("double"))
        stats = stats.withColumn("numeric_count", F.lit(None).cast("long"))
    can = F.col("type_class").isin("number", "text")
    return frame.join(stats.drop("non_null_count"), ["batch_id", "column_name"], "left").select(
        "batch_id", "column_name", "type",
        F.when(can, F.col("filled")).alias("non_null_count"),
        F.when(can, F.coalesce("numeric_count", F.lit(0))).alias("numeric_count"),
        F.when(can, F.coalesce("numeric_rate", F.lit(0.0))).alias("numeric_rate"),
        "median", "mad", "numeric_min", "numeric_max",
    )


def profile_table(
    df: DataFrame, table_name: str = "", dataset: str = "", batch_column: str | None = None,
    batch_id: str | None = None,
) -> DataFrame:
    """The full record of every column and batch (schema ``PROFILE_COLUMN``)."""
    return profile_tables({table_name: (batch_filter(df, batch_column, batch_id), batch_column)}, dataset)[0]


def profile_tables(
    tables: dict[str, tuple[DataFrame, str | None]], dataset: str = "", also: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The records of any number of tables from one frequency table, and that table's values.

    ``tables`` gives rows and batch column by name. Roles are found and written
    once for all of them, so the number of jobs does not depend on the number of
    tables; values are then counted of categorical and numeric columns only, for
    frequent values and robust statistics. The second frame holds
    ``(table_name, batch_id, column_name, value, n)`` of the categorical columns
    and of those that ``also`` (``table_name, column_name``) names.
    """
    keys = ["table_name", "batch_id", "column_name"]
    tagged = lambda df, name: df.withColumn("table_name", F.lit(name))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    facts = union([tagged(measured(rows, None, by), n) for n, (rows, by) in tables.items()])
    facts = stage(freshness(classify(facts)), "facts")

    judged = facts.where(F.col("role") == "categorical").select(*keys)
    if also is not None:
        listed = also.select(F.upper("table_name").alias("_t"), F.upper("column_name").alias("_c")).distinct()
        named = (F.upper("table_name") == F.col("_t")) & (F.upper("column_name") == F.col("_c"))
        judged = judged.unionByName(facts.join(listed, named, "left_semi").select(*keys)).distinct()
    # the driver reads column names; keys, moments and free texts are never spelled out
    spelled = judged.select("table_name", "column_name").unionByName(
        facts.where(F.col("role") == "numeric").select("table_name", "column_name")).distinct()
    wanted: dict[str, list[str]] = {}
    for r in spelled.collect():
        wanted.setdefault(r["table_name"], []).append(r["column_name"])
    counted = [tagged(frequency_table(tables[n][0], sorted(c), tables[n][1]), n) for n, c in wanted.items()]
    nothing = facts.sparkSession.createDataFrame([], "batch_id string, column_name string, value string, n bigint, table_name string")
    freq = stage(union(counted), "frequency") if counted else nothing

    categorical = facts.where(F.col("role") == "categorical").select(
        *keys, adaptive_k(F.col("distinct")).cast("int").alias("k")
    )
    ranked = ranked_values(
        freq.join(categorical.select(*keys), keys, "left_semi"), keys, V.ENUMERABLE_MAX
    )
    top = _collected_top(ranked.join(categorical, keys), F.col("k"), tuple(keys))

    numeric = facts.where(F.col("role") == "numeric")
    numbers = _written_numbers(freq, numeric, keys)
    robust = robust_frame(numbers, keys, _bounded(numeric)).drop("non_null_count")

    measure = F.when(F.col("role") == "categorical", "top_values").when(
        F.col("role") == "numeric", "robust_stats"
    )
    profile = (
        facts.join(categorical, keys, "left")
        .join(top, keys, "left")
        .join(robust, keys, "left")
        .select(
            F.lit(dataset).alias("dataset"), "table_name", "batch_id",
            "column_name", "type", "position", "row_count", "null_count", "null_rate",
            "distinct", "min", "max", "role", measure.alias("measure"), "k",
            F.when(F.col("role") == "categorical", text.rate(F.col("covered"), F.col("non_null_count")))
            .alias("coverage"),
            "top", "numeric_count", "numeric_rate", "median", "mad", "numeric_min",
            "numeric_max", "amplitude_jours", "retard_jours", "dates_futures",
        )
    )
    return profile, freq.join(judged, keys, "left_semi").select(*keys, "value", "n")


def profile_metrics(profile: DataFrame, run_batch: Column | None = None) -> DataFrame:
    """Long form of the archived metrics, keyed by the batch of the run.

    Table metrics have a NULL column name. A table without batches is archived
    under ``run_batch`` so that it builds a history too.
    """
    batch = run_batch if run_batch is not None else F.col("batch_id")
    keyed = profile.withColumn("batch_id", batch)
    table_rows = keyed.groupBy("dataset", "table_name", "batch_id").agg(
        F.max("row_count").cast("double").alias("value")
    ).select(
        "dataset", "table_name", "batch_id", F.lit(None).cast("string").alias("column_name"),
        F.lit("row_count").alias("metric"), "value",
    )
    ids = ["dataset", "table_name", "batch_id", "column_name"]
    wide = keyed.select(*ids, *[F.col(m).cast("double").alias(m) for m in V.COLUMN_METRICS])
    long = wide.unpivot(ids, list(V.COLUMN_METRICS), "metric", "value").where(
        F.col("value").isNotNull()
    )
    return table_rows.unionByName(long)


def as_profile(facts: DataFrame, table_name: str, dataset: str = "") -> DataFrame:
    """Measured facts in the profile schema; what was not measured is NULL."""
    from limpid import schemas

    have = set(facts.columns)
    fixed = {"table_name": F.lit(table_name), "dataset": F.lit(dataset)}
    return facts.select(*[
        (fixed.get(f.name) if f.name in fixed else F.col(f.name) if f.name in have else F.lit(None))
        .cast(f.dataType).alias(f.name)
        for f in schemas.PROFILE_COLUMN.fields
    ])
