"""Expected against found."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def score(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row per expected or found key with its outcome."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    f = found.select(*keys).distinct().withColumn("_f", F.lit(True))
    return e.join(f, keys, "full").select(
        *keys,
        F.when(F.col("_e") & F.col("_f"), "true_positive")
        .when(F.col("_e"), "false_negative")
        .otherwise("false_positive").alias("outcome"),
    )


def precision_recall(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    count = lambda o: F.count_if(F.col("outcome") == o)
    out = scored.groupBy(*(by or [])).agg(
        count("true_positive").alias("tp"), count("false_positive").alias("fp"),
        count("false_negative").alias("fn"),
    )
    share = lambda whole: F.when(whole > 0, F.col("tp") / whole)
    return out.withColumn("precision", share(F.col("tp") + F.col("fp"))).withColumn(
        "recall", share(F.col("tp") + F.col("fn"))
    )
