"""How many rows an anomaly touches, how sure that is, and what it moves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

EXACT, MINIMUM, UNKNOWN = "exact", "minimum", "inconnu"


def _detail(key: str) -> Column:
    return F.try_element_at("details", F.lit(key)).try_cast("long")


def per_anomaly(anomalies: DataFrame, profile: DataFrame) -> DataFrame:
    """Rows touched with the certainty of the count, share of the batch, change.

    Nothing is scanned: everything comes from what the profile measured.
    """
    kind = F.col("type")
    table = profile.groupBy("table_name", "batch_id").agg(F.max("row_count").alias("row_count"))
    rows = (
        F.when(kind == "nulls_interdits", F.col("observed_num").cast("long"))
        .when(kind == "doublons", _detail("duplicates"))
        .when(kind == "collision_semantique", _detail("rows"))
        .when(kind == "test_dbt_echoue", F.col("observed_num").cast("long"))
        .when(kind == "valeur_non_admise", F.nullif(_detail("rows"), F.lit(0).cast("long")))
        # bounds say that a value lies outside, never on how many rows
        .when(kind == "hors_bornes", F.lit(1).cast("long"))
        .when(kind.isin("table_absente", "colonne_disparue"), F.col("row_count"))
    )
    certainty = (
        F.when(kind.isin("nulls_interdits", "doublons", "collision_semantique", "valeur_non_admise"), EXACT)
        .when((kind == "test_dbt_echoue") & F.col("observed_num").isNotNull(), EXACT)
        .when(kind == "hors_bornes", MINIMUM)
        .otherwise(UNKNOWN)
    )
    change = F.when(
        F.col("observed_num").isNotNull() & F.col("reference_num").isNotNull(),
        F.col("observed_num") - F.col("reference_num"),
    )
    return (
        anomalies.join(table, ["table_name", "batch_id"], "left")
        .withColumn("rows", rows)
        .withColumn("certainty", certainty)
        .withColumn("share", F.when((F.col("rows") > 0) & (F.col("row_count") > 0), F.col("rows") / F.col("row_count")))
        .withColumn("change", change)
        .withColumn(
            "relative_change",
            F.when(F.col("reference_num") != 0, change / F.abs("reference_num")),
        )
    )


def headline(impacts: DataFrame) -> DataFrame:
    """Per run the widest anomaly. Rows are never added up: they may overlap."""
    keys = ["table_name", "batch_id"]
    counted = F.when(F.col("rows") > 0, F.col("rows"))
    order = F.struct(
        counted.alias("rows"), F.col("type").alias("t"), F.coalesce("column_name", F.lit("")).alias("c")
    )
    pick = F.struct("rows", "certainty", "share", "column_name", "type", "dama")
    return impacts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("anomalies"),
        F.max("row_count").alias("row_count"),
        F.max_by(F.when(counted.isNotNull(), pick), F.when(counted.isNotNull(), order)).alias("w"),
        F.min_by(
            F.struct("type", "reference_num", "observed_num", "relative_change"),
            F.when(F.col("change").isNotNull(), F.struct("type", F.coalesce("column_name", F.lit("")))),
        ).alias("v"),
    ).select(
        *keys, "anomalies", "row_count", "w.rows", "w.certainty", "w.share", "w.column_name",
        "w.type", "w.dama", F.col("v").alias("variation"),
    )


def sentence() -> Column:
    """The headline in words: numbers, no adjectives."""
    short = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    percent = lambda c: F.format_string("%.1f%%", c * 100)
    more = F.when(
        F.col("anomalies") > 1,
        F.concat(F.lit(" · +"), (F.col("anomalies") - 1).cast("string"), F.lit(" other anomalies")),
    ).otherwise(F.lit(""))
    counted = F.concat(
        F.when(F.col("certainty") == MINIMUM, "at least ").otherwise(""),
        F.col("rows").cast("string"), F.lit(" rows of "), F.col("row_count").cast("string"),
        F.lit(" ("), percent(F.col("share")), F.lit(")"),
        F.coalesce(F.concat(F.lit(" · "), F.col("column_name")), F.lit("")),
        F.lit(" — "), F.col("dama"), more,
    )
    moved = F.concat(
        F.col("variation.type"), F.lit(": "), short(F.col("variation.reference_num")), F.lit(" → "),
        short(F.col("variation.observed_num")),
        F.coalesce(F.concat(F.lit(" ("), percent(F.col("variation.relative_change")), F.lit(")")), F.lit("")),
    )
    return (
        F.when(F.col("rows").isNotNull(), counted)
        .when(F.col("variation").isNotNull(), moved)
        .otherwise(F.concat(F.col("anomalies").cast("string"), F.lit(" anomalies — rows not countable")))
    )


def downstream(before: DataFrame, after: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """What a correction moves in a mart: the same mart built from both sides."""
    b = before.select(*keys, *[F.col(m).alias(f"{m}_before") for m in measures])
    a = after.select(*keys, *[F.col(m).alias(f"{m}_after") for m in measures])
    joined = b.join(a, keys, "full")
    moved = reduce(
        lambda x, y: x | y,
        [~F.col(f"{m}_before").eqNullSafe(F.col(f"{m}_after")) for m in measures],
    )
    return joined.where(moved)


def widest(impacts: DataFrame) -> DataFrame:
    """Full row of the widest anomaly per run (bounded number per run)."""
    order = Window.partitionBy("table_name", "batch_id").orderBy(
        F.desc_nulls_last("rows"), "type", "column_name"
    )
    return impacts.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
