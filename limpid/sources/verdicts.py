"""Failing verdicts of an external test runner, tied to declared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from limpid import vocabulary as V
from limpid.functions import text
from limpid.sources.batches import path_exists

RESULTS = T.StructType().add(
    "results",
    T.ArrayType(
        T.StructType().add("unique_id", "string").add("status", "string").add("failures", "long")
    ),
)
NODE = (
    T.StructType()
    .add("name", "string")
    .add("column_name", "string")
    .add("attached_node", "string")
    .add("test_metadata", T.StructType().add("name", "string"))
)
MANIFEST = T.StructType().add("nodes", T.MapType(T.StringType(), NODE))
VERDICT = (
    "table_name string, column_name string, test string, kind string, dama string, "
    "failures bigint, status string"
)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    if not path_exists(spark, path):
        return None
    return spark.read.schema(schema).option("multiLine", True).json(path)


def failing_verdicts(results: DataFrame, nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """``results(unique_id, status, failures)`` with what the nodes say of them."""
    failed = results.where(
        F.col("unique_id").startswith("test.") & F.col("status").isin("fail", "error")
    )
    model = F.element_at(F.split("attached_node", r"\."), -1)
    declared = registry.select(
        text.last_segment(F.col("table_name")).alias("_model"), F.col("table_name").alias("_declared")
    ).dropDuplicates(["_model"])
    dama = F.create_map(*[F.lit(x) for kv in V.DIMENSION_BY_CHECK.items() for x in kv])
    return (
        failed.join(nodes, "unique_id", "left")
        .withColumn("_model", F.lower(F.nullif(model, F.lit(""))))
        .join(declared, "_model", "left")
        .select(
            F.coalesce("_declared", F.upper("_model")).alias("table_name"),
            F.nullif(F.upper("column_name"), F.lit("")).alias("column_name"),
            F.coalesce("name", F.regexp_replace("unique_id", r"\.[^.]*$", "")).alias("test"),
            "kind",
            F.coalesce(F.try_element_at(dama, F.coalesce("kind", F.lit(""))), F.lit("exactitude")).alias("dama"),
            "failures", "status",
        )
    )


def read_verdicts(
    spark: SparkSession, results_path: str, manifest_path: str, registry: DataFrame
) -> DataFrame:
    """Read the two artefacts; a missing or unreadable one gives no verdicts."""
    raw = _read(spark, results_path, RESULTS)
    if raw is None:
        return spark.createDataFrame([], VERDICT)
    results = raw.select(F.explode("results").alias("r")).select("r.*")
    manifest = _read(spark, manifest_path, MANIFEST)
    if manifest is None:
        manifest = spark.createDataFrame([], MANIFEST)
    nodes = manifest.select(F.explode("nodes").alias("unique_id", "n")).select(
        "unique_id", F.col("n.name").alias("name"), F.col("n.column_name").alias("column_name"),
        F.col("n.attached_node").alias("attached_node"), F.col("n.test_metadata.name").alias("kind"),
    )
    return failing_verdicts(results, nodes, registry)
