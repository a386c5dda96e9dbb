"""Row checks as data: a table of tests in, a table of results out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from limpid import schemas, vocabulary as V
from limpid.operators.collisions import collision_clusters, value_counts


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values carried by more than one row."""
    return value_counts(df, column).where(F.col("n") > 1)


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Values outside the closed list, with their rows."""
    return value_counts(df.where(~F.col(column).isin(list(values))), column)


def relationships(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose key the parent does not hold."""
    return df.where(F.col(column).isNotNull()).join(
        parent.select(F.col(parent_column).alias("_parent")),
        F.col(column) == F.col("_parent"), "left_anti",
    )


def no_semantic_collisions(df: DataFrame, column: str) -> DataFrame:
    """Folded forms with several spellings, over all values of the column."""
    return collision_clusters(value_counts(df, column))


def duplicated_rows(df: DataFrame) -> DataFrame:
    """How many rows are later copies of a full row.

    A row is known by 128 bits of hash over its plain columns and which of them
    are null, so that wide rows are neither kept nor shuffled; nested columns
    are compared as they are. Both zeros are one value, as in a grouping.
    """
    plain, nested = [], []
    for f in df.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if not isinstance(f.dataType, T.AtomicType):
            nested.append(c.alias(f"_c{len(nested)}"))
            continue
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(c == 0, F.lit(0).cast(f.dataType)).otherwise(c)
        plain += [c, c.isNull()]
    hashes = [F.xxhash64(F.lit(0), *plain).alias("_h1"), F.xxhash64(F.lit(1), *plain).alias("_h2")]
    told = df.select(*hashes, *nested)
    copies = told.groupBy(*told.columns).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicated"))


def failing_rows(check: dict, resolve: Callable[[str], DataFrame]) -> DataFrame:
    df, column, kind = resolve(check["table_name"]), check["column_name"], check["kind"]
    if kind == "not_null":
        return not_null(df, column)
    if kind == "unique":
        return unique(df, column)
    if kind == "accepted_values":
        return accepted_values(df, column, check["values"])
    if kind == "relationships":
        return relationships(df, column, resolve(check["parent_table"]), check["parent_column"])
    if kind == "no_semantic_collisions":
        return no_semantic_collisions(df, column)
    raise ValueError(f"unknown check {kind!r}")


def run_checks(
    checks: list[dict], resolve: Callable[[str], DataFrame], exclude_tags: tuple[str, ...] = ()
) -> DataFrame:
    """Status and number of failures per check; checks with excluded tags rest.

    The null checks of one table share a single scan; the others are one small
    aggregate each.
    """
    kept = [c for c in checks if not set(c.get("tags") or ()) & set(exclude_tags)]
    if not kept:
        raise ValueError("no check left to run")

    def labels(c: dict) -> list:
        name = "_".join([c["kind"], c["table_name"].split(".")[-1].lower(), c["column_name"].lower()])
        dama = V.DIMENSION_BY_CHECK.get(c["kind"], "exactitude")
        tags = F.array(*[F.lit(t) for t in c.get("tags") or ()]).cast("array<string>")
        return [
            F.lit(name).alias("test"), F.lit(c["table_name"]).alias("table_name"),
            F.lit(c["column_name"]).alias("column_name"), F.lit(c["kind"]).alias("kind"),
            F.lit(dama).alias("dama"), tags.alias("tags"),
        ]

    results = []
    by_table: dict[str, list[dict]] = {}
    for c in kept:
        if c["kind"] == "not_null":
            by_table.setdefault(c["table_name"], []).append(c)
        else:
            counted = failing_rows(c, resolve).agg(F.count(F.lit(1)).alias("failures"))
            results.append(counted.select(*labels(c), "failures"))
    for table, group in by_table.items():
        wide = resolve(table).agg(
            *[F.count_if(F.col(c["column_name"]).isNull()).alias(f"f{i}") for i, c in enumerate(group)]
        )
        entries = [F.struct(*labels(c), F.col(f"f{i}").alias("failures")) for i, c in enumerate(group)]
        results.append(wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*"))
    return (
        reduce(DataFrame.unionByName, results)
        .withColumn("status", F.when(F.col("failures") > 0, "fail").otherwise("pass"))
        .select(*schemas.CHECK_RESULT.fieldNames())
    )


def rules_from_anomalies(anomalies: DataFrame) -> DataFrame:
    """The check that would have caught each anomaly, where there is one.

    A closed list is taken from the signed contract (the reference of the
    anomaly), never from the values observed. Volume drifts, missing tables
    and missing columns translate into no check.
    """
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    by_type = F.try_element_at(pairs(V.CHECK_BY_ANOMALY), F.col("type"))
    by_metric = F.when(
        F.col("family") == "statistical",
        F.try_element_at(pairs(V.CHECK_BY_METRIC), F.coalesce(F.col("details")["metric"], F.lit(""))),
    )
    kind = F.coalesce(by_type, by_metric)
    return (
        anomalies.where(F.col("column_name").isNotNull())
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            "table_name", F.lower("column_name").alias("column_name"), "kind",
            F.try_element_at(pairs(V.DIMENSION_BY_CHECK), F.col("kind")).alias("dama"),
            F.when(
                F.col("kind") == "accepted_values",
                F.from_json("reference", "array<string>"),
            ).alias("values"),
            F.concat(
                F.lit("from "), "family", F.lit("/"), "type", F.lit(" in batch "),
                F.coalesce("batch_id", F.lit("(unknown)")),
            ).alias("origin"),
        )
    )


def rule_sets(rules: DataFrame) -> DataFrame:
    """Rules per table and column in a fixed order, tagged as generated."""
    tagged = rules.withColumn(
        "tags", F.array(F.lit("generated"), F.concat(F.lit("dama:"), F.col("dama")))
    )
    # one row per kind: a rule is not repeated because its anomaly is
    once = tagged.groupBy("table_name", "column_name", "kind").agg(
        F.min_by(F.struct("values", "tags", "origin"), "origin").alias("rule")
    )
    return once.groupBy("table_name", "column_name").agg(
        F.sort_array(F.collect_list(F.struct("kind", "rule.values", "rule.tags", "rule.origin"))).alias("rules")
    )


def checks_of(rules: DataFrame) -> list[dict]:
    """Rules (one row per check, metadata only) in the form ``run_checks`` takes."""
    return [
        {
            "table_name": r["table_name"], "column_name": r["column_name"], "kind": r["kind"],
            "values": r["values"], "tags": ["generated", f"dama:{r['dama']}"],
        }
        for r in rules.select("table_name", "column_name", "kind", "values", "dama").distinct().collect()
    ]
