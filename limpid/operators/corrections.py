"""The four permitted corrections, what they may write, and their effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limpid import vocabulary as V
from limpid.functions.text import fold, number_or_null
from limpid.operators.collisions import fold_majority, replace_values, value_counts

FLAG = "_quarantined"


def isolate(df: DataFrame, condition: Column, flag: str = FLAG) -> DataFrame:
    """Mark matching rows; the data stays as it is."""
    marked = F.coalesce(condition, F.lit(False))
    if flag in df.columns:
        # a batch written before the flag existed reads it as NULL
        marked = F.coalesce(F.col(flag), F.lit(False)) | marked
    return df.withColumn(flag, marked)


def split_quarantine(df: DataFrame, flag: str = FLAG) -> tuple[DataFrame, DataFrame]:
    held = F.coalesce(F.col(flag), F.lit(False))
    return df.where(~held).drop(flag), df.where(held).drop(flag)


def nullify(df: DataFrame, column: str, condition: Column) -> DataFrame:
    """Empty the value of matching rows; nothing is invented."""
    return df.withColumn(
        column, F.when(F.coalesce(condition, F.lit(False)), F.lit(None)).otherwise(F.col(column))
    )


def unobserved_targets(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Target values of a map that the column does not hold."""
    return mapping.select(F.col("canonical").alias("value")).distinct().join(
        df.select(F.col(column).alias("value")), "value", "left_anti"
    )


def normalise(
    df: DataFrame, column: str, mapping: DataFrame | None = None, by_person: bool = False
) -> DataFrame:
    """Replace spellings by one that the column already holds.

    Without a map, colliding spellings go to the most frequent of them. A map
    with an unseen target is refused unless a person takes responsibility.
    """
    if mapping is None:
        mapping = fold_majority(value_counts(df, column))
    elif not by_person:
        strange = unobserved_targets(df, column, mapping)
        if not strange.isEmpty():
            raise ValueError(f"a correction would write values {column} never held")
    return replace_values(df, column, mapping)


def exclude(df: DataFrame, condition: Column) -> DataFrame:
    """Leave matching rows out of an aggregate; the table is not touched."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def default_corrections(anomalies: DataFrame) -> DataFrame:
    """The safe gestures per anomaly, none of which guesses a value."""
    by_type = F.create_map(*[
        x for k, g in V.DEFAULT_GESTURES.items()
        for x in (F.lit(k), F.array(*[F.lit(v) for v in g]))
    ])
    return anomalies.withColumn(
        "gestures", F.coalesce(F.try_element_at(by_type, F.col("type")), F.array(F.lit("isoler")))
    )


def refusals(corrections: DataFrame, anomalies: DataFrame, observed: DataFrame) -> DataFrame:
    """Typed corrections that would invent a value, with the reason.

    ``corrections``: ``table_name, column_name, gesture, target, whole_column,
    by_person``; ``observed``: ``table_name, column_name, value`` really held.
    Writing to a column no anomaly names is marking a row and is allowed.
    """
    named = anomalies.where(F.col("column_name").isNotNull()).select(
        "table_name", F.upper("column_name").alias("_c")
    ).distinct()
    c = corrections.where(~F.coalesce("by_person", F.lit(False))).withColumn("_c", F.upper("column_name"))
    c = c.join(named, ["table_name", "_c"], "left_semi")
    known = observed.select(
        "table_name", F.upper("column_name").alias("_c"), F.col("value").alias("target")
    )
    writes = F.col("gesture") == "normaliser"
    unknown_gesture = c.where(~F.col("gesture").isin(*V.GESTURES)).withColumn(
        "reason", F.lit("not one of the permitted gestures")
    )
    whole = c.where(F.col("gesture").isin(*V.GESTURES) & F.coalesce("whole_column", F.lit(False))).withColumn(
        "reason", F.lit("a correction acts on rows; a column is transformed in its model")
    )
    invented = (
        c.where(writes & ~F.coalesce("whole_column", F.lit(False)))
        .join(known, ["table_name", "_c", "target"], "left_anti")
        .withColumn("reason", F.lit("the value was never observed in the column"))
    )
    names = [*corrections.columns, "reason"]
    return (
        unknown_gesture.select(*names).unionByName(whole.select(*names)).unionByName(invented.select(*names))
    )


def approved_only(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """The only door to a write: rows a person approved."""
    return proposals.join(
        decisions.where(F.col("human_decision") == "approved"), ["table_name", "batch_id"], "left_semi"
    )


def route(decision: Column) -> Column:
    """Where a decided run goes next."""
    return (
        F.when(decision == "approved", "apply")
        .when(decision == "amend_contract", "amend")
        .otherwise("log")
    )


def matching(column: str, match: str, lo=None, hi=None, values=None) -> Column:
    """Rows a typed correction is about."""
    c = F.col(column)
    if match == "null":
        return c.isNull()
    if match == "outside":
        number = number_or_null(c.cast("string"))
        return (number < F.lit(lo)) | (number > F.lit(hi))
    if match == "values":
        return c.isin(list(values))
    if match == "not_in":
        return c.isNotNull() & ~c.isin(list(values))
    raise ValueError(f"unknown match {match!r}")


def isolate_copies(df: DataFrame, column: str, flag: str = FLAG) -> DataFrame:
    """Flag every row whose value is carried by more than one row.

    Which of the copies is the right one is not ours to say, so all are held.
    """
    repeated = value_counts(df, column).where(F.col("n") > 1).select(
        F.col("value").alias("_repeated")
    )
    joined = df.join(repeated, F.col(column) == F.col("_repeated"), "left")
    return isolate(joined, F.col("_repeated").isNotNull(), flag).drop("_repeated")


def correct(df: DataFrame, corrections: list) -> DataFrame:
    """Apply typed corrections to a batch. Excluding rows leaves the data alone:
    they are flagged for the aggregates, like isolated ones."""
    for c in corrections:
        column, gesture = c["column_name"], c["gesture"]
        if gesture not in V.GESTURES:
            raise ValueError(f"{gesture!r} is not one of the permitted gestures")
        if c["match"] == "copies":
            if gesture not in ("isoler", "exclure_de_l_agregat"):
                raise ValueError("copies may be isolated or excluded only")
            df = isolate_copies(df, column)
            continue
        rows = None
        if c["match"] is not None:
            rows = matching(column, c["match"], c["lo"], c["hi"], c["values"])
        if gesture == "normaliser":
            if c["target"] is None:
                df = normalise(df, column)
            else:
                mapping = value_counts(df.where(rows), column).select(
                    "value", F.lit(c["target"]).alias("canonical")
                )
                df = normalise(df, column, mapping, bool(c["by_person"]))
        elif gesture == "mettre_a_null":
            df = nullify(df, column, rows)
        else:
            df = isolate(df, rows)
    return df


def change_counts(before: DataFrame, after: DataFrame, batch_column: str, column: str) -> DataFrame:
    """Rows before and after per batch, and rows whose value disappeared or came.

    Compared as value counts, so neither side is matched row by row.
    """
    b = before.groupBy(batch_column, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("b"))
    a = after.groupBy(batch_column, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("a"))
    both = b.withColumn("side", F.lit("b")).withColumnRenamed("b", "n").unionByName(
        a.withColumn("side", F.lit("a")).withColumnRenamed("a", "n")
    )
    per_value = both.groupBy(batch_column, "value").agg(
        F.sum(F.when(F.col("side") == "b", F.col("n")).otherwise(0)).alias("b"),
        F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("a"),
    )
    return per_value.groupBy(batch_column).agg(
        F.sum("b").alias("rows_before"), F.sum("a").alias("rows_after"),
        F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("affected"),
    )


def verify(before: DataFrame, after: DataFrame) -> DataFrame:
    """Did the anomalies of each run survive the correction?

    Both frames carry ``signature``; the second comes from profiling and
    detecting again with the same references. One survivor fails the run.
    """
    keys = ["table_name", "batch_id"]
    left = after.select(*keys, "signature").distinct().withColumn("_still", F.lit(1))
    return (
        before.select(*keys, "signature").distinct()
        .join(left, [*keys, "signature"], "left")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("anomalies"), F.count("_still").alias("remaining"))
        .withColumn(
            "validation_status",
            F.when(F.col("remaining") == 0, "success").otherwise("failed_manual_review"),
        )
    )


def colliding(df: DataFrame, column: str, form: str) -> Column:
    """Condition for rows whose value folds to ``form``."""
    return fold(F.col(column)) == F.lit(form)
