"""Anomalies as joins of measured tables with what they are compared to.

Every family is a function of frames to a frame of schema ``ANOMALY``; none
reads or writes anything else. Profiles of all batches may be passed at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from limpid import schemas, vocabulary as V
from limpid.functions import text
from limpid.functions.text import fold
from limpid.session import stage


def _text(c: Column | str | None) -> Column:
    if c is None:
        return F.lit(None).cast("string")
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _num(c: Column | str | None) -> Column:
    if c is None:
        return F.lit(None).cast("double")
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def anomaly(
    df: DataFrame, family: str, kind: str | Column, dama: str | Column, *,
    column: Column | None = None, observed: Column | None = None, reference: Column | None = None,
    observed_num: Column | None = None, reference_num: Column | None = None,
    observed_values: Column | None = None, magnitude: Column | None = None,
    details: dict[str, Column] | None = None,
) -> DataFrame:
    """Shape rows that carry ``table_name`` and ``batch_id`` into anomalies."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    pairs = [x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string"))]
    empty = F.create_map().cast("map<string,string>")
    values = observed_values if observed_values is not None else F.lit(None)
    return df.select(
        F.lit(family).alias("family"), "table_name", "batch_id",
        _text(column).alias("column_name"), as_col(kind).alias("type"),
        _text(observed).alias("observed"), _text(reference).alias("reference"),
        _num(observed_num).alias("observed_num"), _num(reference_num).alias("reference_num"),
        values.cast("array<string>").alias("observed_values"),
        _num(magnitude).alias("magnitude"), as_col(dama).alias("dama"),
        (F.create_map(*pairs) if pairs else empty).alias("details"),
    )


# --- inventory ---------------------------------------------------------------

def inventory(
    registry: DataFrame, present: DataFrame | None, batch_id: str,
    known_columns: DataFrame | None = None, present_columns: DataFrame | None = None,
) -> DataFrame | None:
    """Declared tables that are gone, present ones nobody declared, renames.

    ``present`` None means that no inventory was taken: nothing is concluded.
    """
    if present is None:
        return None
    declared = registry.select(F.upper("table_name").alias("table_name")).distinct()
    there = present.select(F.upper("table_name").alias("table_name")).distinct()
    batch = F.lit(batch_id).alias("batch_id")
    gone = declared.join(there, "table_name", "left_anti").withColumn("batch_id", batch)
    strange = there.join(declared, "table_name", "left_anti").withColumn("batch_id", batch)
    out = anomaly(
        gone, "inventory", "table_absente", "completude", reference=F.col("table_name")
    ).unionByName(
        anomaly(strange, "inventory", "table_non_declaree", "coherence", observed=F.col("table_name"))
    )
    if known_columns is None or present_columns is None:
        return out

    def column_set(df: DataFrame) -> DataFrame:
        return df.groupBy(F.upper("table_name").alias("table_name")).agg(
            F.sort_array(F.collect_set(F.upper("column_name"))).alias("columns")
        )

    before = gone.join(column_set(known_columns), "table_name")
    after = strange.select(F.col("table_name").alias("candidate")).join(
        column_set(present_columns).withColumnRenamed("table_name", "candidate"), "candidate"
    )
    renamed = before.join(after, "columns")
    return out.unionByName(
        anomaly(
            renamed, "inventory", "renommage_probable", "coherence",
            observed=F.col("candidate"), reference=F.col("table_name"),
            details={"common_columns": F.to_json("columns")},
        )
    )


# --- schema ------------------------------------------------------------------

def schema_drift(today: DataFrame, known: DataFrame) -> DataFrame:
    """Columns gone and columns new, per table and batch.

    ``today``: ``table_name, batch_id, column_name``; ``known``: the same plus
    ``origin``. A table without a reference says nothing.
    """
    keys = ["table_name", "batch_id", "column_name"]
    upper = lambda df: df.withColumn("column_name", F.upper("column_name"))
    t, k = upper(today).select(*keys), upper(known).select(*keys, "origin")
    # only batches observed today, and only where a reference exists
    k = k.join(t.select("table_name", "batch_id").distinct(), ["table_name", "batch_id"], "left_semi")
    origin = k.select("table_name", "batch_id", "origin").distinct()
    gone = k.join(t, keys, "left_anti")
    new = t.join(k, keys, "left_anti").join(origin, ["table_name", "batch_id"])
    return anomaly(
        gone, "schema", "colonne_disparue", "coherence",
        column=F.col("column_name"), reference=F.col("origin"),
    ).unionByName(
        anomaly(
            new, "schema", "colonne_nouvelle", "coherence", column=F.col("column_name"),
            observed=F.col("column_name"), reference=F.col("origin"),
        )
    )


def schema_reference(history: DataFrame, contract: DataFrame | None, batches: DataFrame) -> DataFrame:
    """Known columns per table and batch: the observed history, else the contract.

    ``history`` is the outcome of ``previous_schemas``; ``batches`` lists the
    ``table_name, batch_id`` to judge.
    """
    seen = history.select("table_name", "batch_id", "column_name").withColumn(
        "origin", F.lit("_SCHEMA_HISTORY")
    )
    if contract is None:
        return seen
    rest = batches.join(seen, ["table_name", "batch_id"], "left_anti")
    signed = rest.join(contract.select("table_name", "column_name").distinct(), "table_name")
    return seen.unionByName(signed.withColumn("origin", F.lit("contrat")).select(*seen.columns))


# --- contract ----------------------------------------------------------------

def contract_violations(profile: DataFrame, clauses: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Signed clauses that a profile does not meet.

    A contract column missing from the profile is a schema matter and is
    dropped by the join. Accepted values are judged on ``values`` (all values of
    a column, see ``category_values``); without it on those a profile carries,
    which is all of them only while the column's coverage is complete.
    """
    c = clauses.select(
        "table_name", F.upper("column_name").alias("_column"), "clause", "lo", "hi", "values"
    )
    p = profile.withColumn("_column", F.upper("column_name"))
    j = p.join(c, ["table_name", "_column"])
    col = F.col("column_name")

    nulls = anomaly(
        j.where((F.col("clause") == "not_null") & (F.col("null_count") > 0)),
        "contract", "nulls_interdits", "completude", column=col,
        observed=F.col("null_count"), reference=F.lit(0),
        observed_num=F.col("null_count"), reference_num=F.lit(0), magnitude=F.col("null_rate"),
        details={"clause": F.lit("not_null"), "rate": F.col("null_rate")},
    )
    expected = F.col("row_count") - F.col("null_count")
    missing = expected - F.col("distinct")
    copies = anomaly(
        j.where((F.col("clause") == "unique") & (F.col("row_count") > 0) & (missing > 0)),
        "contract", "doublons", "unicite", column=col,
        observed=F.col("distinct"), reference=expected,
        observed_num=F.col("distinct"), reference_num=expected,
        magnitude=F.when(expected > 0, missing / expected),
        details={"clause": F.lit("unique"), "duplicates": missing},
    )
    below = F.greatest(F.col("lo") - F.col("numeric_min"), F.lit(0.0))
    above = F.greatest(F.col("numeric_max") - F.col("hi"), F.lit(0.0))
    # both ends of the batch may lie beyond the same bound
    low_max = F.greatest(F.col("lo") - F.col("numeric_max"), F.lit(0.0))
    high_min = F.greatest(F.col("numeric_min") - F.col("hi"), F.lit(0.0))
    beyond = F.greatest(below, above, low_max, high_min)
    width = F.abs(F.col("hi") - F.col("lo"))
    bounds = anomaly(
        j.where((F.col("clause") == "between") & (beyond > 0)),
        "contract", "hors_bornes", "exactitude", column=col,
        observed=F.to_json(F.array("numeric_min", "numeric_max")),
        reference=F.to_json(F.array("lo", "hi")),
        magnitude=beyond / F.when(width > 0, width).otherwise(F.lit(1.0)),
        details={"clause": F.lit("between"), "low": F.col("numeric_min"), "high": F.col("numeric_max")},
    )
    listed = j.where((F.col("clause") == "accepted_values") & (F.size("values") > 0))
    strange = _intruders_in_profile(listed) if values is None else _intruders(listed, values)
    return nulls.unionByName(copies).unionByName(bounds).unionByName(_not_accepted(strange))


def _intruders_in_profile(listed: DataFrame) -> DataFrame:
    inside = F.filter("top", lambda e: ~F.array_contains(F.col("values"), e["value"]))
    return listed.withColumn("_in", inside).where(F.size(F.coalesce("_in", F.array())) > 0).select(
        "table_name", "batch_id", "column_name", "values", "coverage",
        F.transform("_in", lambda e: e["value"]).alias("shown"), F.size("_in").alias("kinds"),
        F.aggregate("_in", F.lit(0).cast("long"), lambda a, e: a + e["count"]).alias("rows"),
    )


def _intruders(listed: DataFrame, values: DataFrame) -> DataFrame:
    """Values beside the accepted ones: all are counted, the most frequent hundred are shown."""
    keys = ["table_name", "batch_id", "column_name"]
    accepted = listed.select(*keys, F.explode("values").alias("value")).distinct()
    strange = values.join(listed.select(*keys).distinct(), keys, "left_semi").join(accepted, [*keys, "value"], "left_anti")
    counted = strange.groupBy(*keys).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("rows"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("value"))
    head = strange.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= V.ENUMERABLE_MAX)
    shown = head.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda e: e["value"]).alias("shown")
    )
    return listed.select(*keys, "values", F.lit(1.0).alias("coverage")).join(counted, keys).join(shown, keys)


def _not_accepted(strange: DataFrame) -> DataFrame:
    return anomaly(
        strange, "contract", "valeur_non_admise", "validite", column=F.col("column_name"),
        observed=F.to_json("shown"), reference=F.to_json(F.sort_array(F.array_distinct("values"))),
        observed_values=F.col("shown"), magnitude=F.col("kinds"),
        details={"clause": F.lit("accepted_values"), "coverage": F.col("coverage"), "rows": F.col("rows")},
    )


# --- statistical -------------------------------------------------------------

def _middle(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    at = lambda i: F.element_at(values, i.cast("int"))
    return F.when(
        n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2
    )


def with_references(metrics: DataFrame, window: int = V.HISTORY_WINDOW) -> DataFrame:
    """For every batch at once: median and MAD over the batches before it.

    The reference holds the previous ``window`` batches of the table that exist,
    so batches are numbered first; the range then never includes the batch
    itself, which keeps reruns out of their own reference. Windows run over one
    value per batch, not over data rows.
    """
    table = ["dataset", "table_name"]
    numbers = (
        metrics.select(*table, "batch_id").distinct()
        .withColumn("_no", F.row_number().over(Window.partitionBy(*table).orderBy("batch_id")))
    )
    past = (
        Window.partitionBy(*table, "column_name", "metric").orderBy("_no")
        .rangeBetween(-window, -1)
    )
    return (
        metrics.join(numbers, [*table, "batch_id"])
        .withColumn("_series", F.sort_array(F.collect_list("value").over(past)))
        .withColumn("batches", F.size("_series"))
        .withColumn("median", _middle(F.col("_series")))
        .withColumn(
            "mad",
            _middle(F.sort_array(F.transform("_series", lambda v: F.abs(v - F.col("median"))))),
        )
        .drop("_series", "_no")
    )


def compare_to_series(today: DataFrame, history: DataFrame) -> DataFrame:
    """Today's metrics with median and MAD of given series (``metric_history``).

    The join is null-safe: table metrics have no column name.
    """
    h = history.withColumn("_s", F.sort_array("series"))
    h = h.withColumn("median", _middle(F.col("_s"))).withColumn(
        "mad", _middle(F.sort_array(F.transform("_s", lambda v: F.abs(v - F.col("median")))))
    ).select(
        F.col("dataset").alias("_d"), F.col("table_name").alias("_t"),
        F.col("column_name").alias("_c"), F.col("metric").alias("_m"),
        F.size("series").alias("batches"), "median", "mad",
    )
    return today.join(
        h,
        (F.col("dataset") == F.col("_d")) & (F.col("table_name") == F.col("_t"))
        & F.col("column_name").eqNullSafe(F.col("_c")) & (F.col("metric") == F.col("_m")),
    ).drop("_d", "_t", "_c", "_m")


def statistical(
    compared: DataFrame, minimum: int = V.HISTORY_MINIMUM, threshold: float = V.Z_THRESHOLD
) -> DataFrame:
    """Metrics away from their own past; short series are not judged."""
    judged = compared.where(F.col("batches") >= minimum)
    gap = F.col("value") - F.col("median")
    z = F.lit(V.Z_CONSTANT) * gap / F.col("mad")
    dama = F.coalesce(
        F.try_element_at(
            F.create_map(*[F.lit(x) for kv in V.DIMENSION_BY_METRIC.items() for x in kv]),
            F.col("metric"),
        ),
        F.lit("exactitude"),
    )
    constant = F.col("mad") == 0
    flagged = judged.where(F.when(constant, gap != 0).otherwise(F.abs(z) > threshold))
    kind = F.when(constant, "rupture_de_constante").otherwise("derive_statistique")
    return anomaly(
        flagged, "statistical", kind, dama, column=F.col("column_name"),
        observed=F.col("value"), reference=F.col("median"),
        observed_num=F.col("value"), reference_num=F.col("median"),
        magnitude=F.when(constant, F.abs(gap)).otherwise(F.abs(z)),
        details={
            "metric": F.col("metric"), "reference_batches": F.col("batches"),
            "z": F.when(~constant, F.round(z, 2)), "mad": F.col("mad"), "gap": gap,
        },
    )


# --- semantic ----------------------------------------------------------------

def semantic(profile: DataFrame) -> DataFrame:
    """Frequent values of categorical columns that fold to one form.

    Works on the at most hundred frequent values a profile carries; the check
    ``no_semantic_collisions`` looks at all values.
    """
    entries = (
        profile.where(F.col("role") == "categorical")
        .select("table_name", "batch_id", "column_name", "coverage", F.explode("top").alias("e"))
        .select("table_name", "batch_id", "column_name", "coverage", "e.value", "e.count")
        .withColumn("form", fold(F.col("value")))
    )
    clusters = (
        entries.groupBy("table_name", "batch_id", "column_name", "coverage", "form")
        .agg(F.sort_array(F.collect_set("value")).alias("spellings"), F.sum("count").alias("rows"))
        .where(F.size("spellings") > 1)
    )
    return anomaly(
        clusters, "semantic", "collision_semantique", "coherence", column=F.col("column_name"),
        observed=F.to_json("spellings"), reference=F.col("form"),
        observed_values=F.col("spellings"), magnitude=F.col("rows"),
        details={"coverage": F.col("coverage"), "rows": F.col("rows")},
    )


def semantic_full(frequencies: DataFrame, facts: DataFrame, table_name: str | None = None) -> DataFrame:
    """The same over all values, from the frequency table of the profile.

    All spellings of a cluster are counted, the most frequent hundred are shown.
    Without a ``table_name`` both frames carry it, for any number of tables.
    """
    from limpid.operators.collisions import collision_clusters, spellings

    if table_name is not None:
        frequencies, facts = (df.withColumn("table_name", F.lit(table_name)) for df in (frequencies, facts))
    keys = ["table_name", "batch_id", "column_name"]
    scope = facts.where(F.col("role") == "categorical").select(*keys)
    counts = frequencies.join(scope, keys, "left_semi")
    order = Window.partitionBy(*keys, "form").orderBy(F.desc("n"), F.asc("value"))
    head = spellings(counts, keys).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= V.ENUMERABLE_MAX)
    shown = head.groupBy(*keys, "form").agg(F.sort_array(F.collect_list("value")).alias("shown"))
    clusters = collision_clusters(counts, keys).join(shown, [*keys, "form"])
    return anomaly(
        clusters, "semantic", "collision_semantique", "coherence", column=F.col("column_name"),
        observed=F.to_json("shown"), reference=F.col("form"),
        observed_values=F.col("shown"), magnitude=F.col("rows"),
        details={"coverage": F.lit(1.0), "rows": F.col("rows"), "spellings": F.col("spellings")},
    )


# --- external verdicts -------------------------------------------------------

def external(verdicts: DataFrame, batch_id: str, *tables: str) -> DataFrame:
    """Failing verdicts of another tool in the common form, of some tables if any are named.

    A verdict that names no table is one about each of them.
    """
    rows = verdicts
    if tables:
        own = F.when(F.col("table_name").isNull(), F.array(*map(F.lit, tables))).otherwise(F.array("table_name"))
        rows = rows.withColumn("table_name", F.explode(own)).where(F.col("table_name").isin(*tables))
    return anomaly(
        rows.withColumn("batch_id", F.lit(batch_id)), "external", "test_dbt_echoue",
        F.coalesce("dama", F.lit("exactitude")), column=F.col("column_name"),
        observed=F.col("failures"), reference=F.lit(0),
        observed_num=F.col("failures"), reference_num=F.lit(0), magnitude=F.col("failures"),
        details={"test": F.col("test"), "kind": F.col("kind"), "status": F.col("status")},
    )


# --- all families ------------------------------------------------------------

def detect(families: list[tuple[str, Callable[[], DataFrame | None]]], spark) -> tuple[DataFrame, list[str]]:
    """Union of all families; one that fails does not lose the others.

    Every family is computed and written on its own, so that an error in the
    data of one is reported like an error in its plan. Returns the anomalies and
    what went wrong, by family.
    """
    frames, failures = [], []
    for name, build in families:
        try:
            frame = build()
            frame = frame if frame is None else stage(frame, f"family-{name}")
        except Exception as exc:  # noqa: BLE001 - reported, not swallowed
            failures.append(f"{name}: {type(exc).__name__}: {exc}")
            continue
        if frame is not None:
            frames.append(frame)
    if not frames:
        return spark.createDataFrame([], schemas.ANOMALY), failures
    return reduce(DataFrame.unionByName, frames), failures


def with_signature(anomalies: DataFrame) -> DataFrame:
    return anomalies.withColumn(
        "signature",
        text.signature(F.col("table_name"), F.col("column_name"), F.col("type"), F.col("magnitude")),
    )


def sentence() -> Column:
    """An anomaly in words: what, where, and the number or the first values."""
    number = F.regexp_replace(F.col("observed_num").cast("string"), r"\.0$", "")
    seen = F.array_join(F.slice("observed_values", 1, 3), ", ")
    amount = F.when(F.col("observed_num").isNotNull(), F.concat(F.lit(" — "), number)).when(
        F.size("observed_values") > 0, F.concat(F.lit(" — "), seen)
    )
    return F.concat(
        F.coalesce("dama", "type"), F.lit(" on "), F.coalesce("column_name", "table_name"),
        F.coalesce(amount, F.lit("")),
    )


def count_by_family(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("family").agg(F.count(F.lit(1)).alias("anomalies"))


def reference_depth(metrics: DataFrame, before: str | None = None) -> DataFrame:
    """Longest series per table: why the statistical family may be silent."""
    rows = metrics if before is None else metrics.where(F.col("batch_id") < before)
    return (
        rows.groupBy("dataset", "table_name", "column_name", "metric")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("dataset", "table_name")
        .agg(F.max("n").alias("depth"))
    )
