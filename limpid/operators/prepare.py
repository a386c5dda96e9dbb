"""Declared clean-ups of a column before it becomes a reference."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from limpid.functions.text import fold
from limpid.operators.collisions import blank_majority, replace_values, value_counts


def fold_column(df: DataFrame, column: str, _rule: dict | None = None) -> DataFrame:
    return df.withColumn(column, fold(F.col(column)))


def fold_blanks_on_majority(df: DataFrame, column: str, _rule: dict | None = None) -> DataFrame:
    return replace_values(df, column, blank_majority(value_counts(df, column)))


def unmatched_entries(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Entries of a declared map whose value does not occur."""
    return mapping.select("value").join(
        df.select(F.col(column).alias("value")), "value", "left_anti"
    )


def repair_declared(df: DataFrame, column: str, rule: dict) -> DataFrame:
    """Replace listed values; an entry that matches nothing is an error."""
    pairs = list((rule.get("mapping") or {}).items())
    mapping = df.sparkSession.createDataFrame(pairs, "value string, canonical string")
    unknown = [r["value"] for r in unmatched_entries(df, column, mapping).collect()]
    if unknown:
        raise ValueError(f"declared values that do not occur: {sorted(unknown)}")
    return replace_values(df, column, mapping)


RULES: dict[str, Callable[..., DataFrame]] = {
    # fixed values: names under which rules are declared
    "strip_accents_lower_collapse_spaces": fold_column,
    "fold_space_variants_on_majority": fold_blanks_on_majority,
    "repair_declared_mojibake": repair_declared,
}


def day_number(day: str, start: str) -> int:
    return (datetime.date.fromisoformat(day) - datetime.date.fromisoformat(start)).days + 1


def check_declared(rules: list[dict], start: str) -> None:
    """Day and date must name the same instant, and the rule must exist."""
    for r in rules:
        if day_number(str(r["date"]), start) != r["day"]:
            raise ValueError(f"{r['id']}: day {r['day']} is not {r['date']}")
        if r["rule"] not in RULES:
            raise ValueError(f"{r['id']}: unknown rule {r['rule']!r}")


def apply_rules(
    tables: dict[str, DataFrame], rules: list[dict], day: str, start: str
) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Apply the rules of one day; report distinct values before and after.

    A table the batch does not deliver is skipped, a missing column raises.
    """
    check_declared(rules, start)
    out, report = dict(tables), None
    for r in rules:
        if r["day"] != day_number(day, start) or r["table"] not in out:
            continue
        df, column = out[r["table"]], r["column"]
        if column not in df.columns:
            raise ValueError(f"{r['id']}: column {column!r} is not in {r['table']}")
        after = RULES[r["rule"]](df, column, r)
        out[r["table"]] = after
        line = distinct_change(df, after, column).select(
            F.lit(r["id"]).alias("rule_id"), F.lit(r["table"]).alias("table_name"),
            F.lit(column).alias("column_name"), "distinct_before", "distinct_after",
        )
        report = line if report is None else report.unionByName(line)
    return out, report


def distinct_change(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    b = before.agg(F.count_distinct(column).alias("distinct_before")).withColumn("_one", F.lit(1))
    a = after.agg(F.count_distinct(column).alias("distinct_after")).withColumn("_one", F.lit(1))
    return b.join(a, "_one").drop("_one")
