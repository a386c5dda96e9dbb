"""Different spellings of one value, and the forms they fold to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limpid.functions.text import ascii_only, fold, has_non_ascii, without_blanks


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )


def collision_clusters(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Folded forms carried by at least two spellings, from distinct values.

    ``counts`` holds ``keys``, ``value`` and ``n``. Spellings are counted, and
    the first and last are shown; ``spellings`` lists them all as rows.
    """
    keys = keys or []
    return (
        counts.where(F.trim("value") != "")
        .withColumn("form", fold(F.col("value")))
        .groupBy(*keys, "form")
        .agg(
            F.count(F.lit(1)).alias("spellings"),
            F.min("value").alias("first_spelling"),
            F.max("value").alias("last_spelling"),
            F.sum("n").alias("rows"),
        )
        .where(F.col("spellings") > 1)
    )


def spellings(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every spelling that collides with another one."""
    keys = keys or []
    folded = counts.where(F.trim("value") != "").withColumn("form", fold(F.col("value")))
    clusters = collision_clusters(counts, keys).select(*keys, "form")
    return folded.join(clusters, [*keys, "form"], "left_semi")


def majority(counts: DataFrame, key: Column) -> DataFrame:
    """Map of every value to the most frequent value of its key, ties by order.

    A spelling is chosen by aggregation, so no group is ever collected.
    """
    keyed = counts.withColumn("_key", key)
    best = keyed.groupBy("_key").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("less"), F.col("value").alias("v"))).alias("canonical"),
        F.count(F.lit(1)).alias("members"),
    )
    return keyed.join(best, "_key").select(
        F.col("value"), "canonical", F.col("members"), F.col("n")
    )


def fold_majority(counts: DataFrame) -> DataFrame:
    """Canonical spelling of collision clusters: the most frequent one."""
    return majority(counts, fold(F.col("value")))


def blank_majority(counts: DataFrame) -> DataFrame:
    """Canonical spelling among values that differ by blanks only."""
    return majority(counts, without_blanks(F.col("value")))


def replace_values(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Rewrite ``column`` by ``mapping(value, canonical)``; other values stay.

    The map holds only values that change. Spark broadcasts it when it turns
    out small; otherwise the join shuffles and adaptive execution splits a
    value held by many rows.
    """
    changes = mapping.where(F.col("value") != F.col("canonical")).select(
        F.col("value").alias("_from"), F.col("canonical").alias("_to")
    )
    out = F.coalesce("_to", F.col(column)).alias(column)
    joined = df.join(changes, F.col(column) == F.col("_from"), "left")
    return joined.select(*[out if c == column else F.col(f"`{c}`") for c in df.columns])


def hidden_duplicates(counts: DataFrame) -> DataFrame:
    """Values with non-ASCII letters whose stripped form is itself a value."""
    odd = counts.where(has_non_ascii(F.col("value"))).withColumn(
        "stripped", F.trim(ascii_only(F.col("value")))
    )
    plain = counts.select(F.col("value").alias("stripped"))
    return odd.join(plain, "stripped", "left_semi").select("value", "stripped", "n")


def colliding_texts(df: DataFrame, column: str) -> DataFrame:
    """Collision clusters of long texts, by digests of the whole texts.

    Only digests are shuffled; the cluster is named by the digest of its form.
    """
    spelled = df.where(F.trim(column) != "").groupBy(
        F.md5(fold(F.col(column))).alias("form"), F.sha2(column, 256).alias("_spelling")
    ).agg(F.count(F.lit(1)).alias("n"))
    return spelled.groupBy("form").agg(
        F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("rows")
    ).where(F.col("spellings") > 1)
