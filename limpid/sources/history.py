"""Past schemas, past metrics and past incidents, read as of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from limpid import schemas, vocabulary as V
from limpid.functions import text
from limpid.sources.batches import write_batches


def read_schema(
    history: DataFrame, table_name: str, batch_id: str | None = None, before: str | None = None
) -> DataFrame:
    """Columns of a batch, of the latest batch, or of the latest one before."""
    wanted = text.last_segment(F.col("table_name")) == text.last_segment(F.lit(table_name))
    rows = history.where(wanted)
    if batch_id is not None:
        rows = rows.where(F.col("batch_id") == batch_id)
    elif before is not None:
        rows = rows.where(F.col("batch_id") < before)
    if batch_id is None:
        latest = rows.agg(F.max("batch_id").alias("batch_id"))
        rows = rows.join(latest, "batch_id", "left_semi")
    return rows.select(
        "batch_id", text.last_segment(F.col("table_name")).alias("table_name"),
        F.upper("column_name").alias("column_name"), "ordinal_position",
    ).orderBy("ordinal_position")


def previous_schemas(history: DataFrame) -> DataFrame:
    """For every table and batch at once: the columns of the batch before it.

    The window runs over batches of a table, not over rows of data.
    """
    batches = history.select("table_name", "batch_id").distinct()
    order = Window.partitionBy("table_name").orderBy("batch_id")
    steps = batches.withColumn("reference_batch", F.lag("batch_id").over(order))
    known = history.select(
        "table_name", F.col("batch_id").alias("reference_batch"),
        F.upper("column_name").alias("column_name"),
    )
    return steps.where(F.col("reference_batch").isNotNull()).join(
        known, ["table_name", "reference_batch"]
    ).select("table_name", "batch_id", "reference_batch", "column_name")


def metric_history(
    metrics: DataFrame, dataset: str, table_name: str, before: str | None = None,
    batches: int | None = V.HISTORY_WINDOW,
) -> DataFrame:
    """Series per column and metric, oldest first, strictly before a batch.

    ``batches`` limits the reference to that many existing batches, whatever
    the calendar gaps between them. A series holds one value per batch.
    """
    rows = metrics.where((F.col("dataset") == dataset) & (F.col("table_name") == table_name))
    if before is not None:
        rows = rows.where(F.col("batch_id") < before)
    if batches:
        kept = rows.select("batch_id").distinct().orderBy(F.desc("batch_id")).limit(batches)
        rows = rows.join(kept, "batch_id", "left_semi")
    return rows.groupBy("dataset", "table_name", "column_name", "metric").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("batch_id", "value"))), lambda s: s["value"]
        ).alias("series")
    )


def latest_series(metrics: DataFrame, dataset: str, before: str, batches: int = V.HISTORY_WINDOW) -> DataFrame:
    """``metric_history`` of all tables at once: each by its own latest batches before one.

    The window runs over the batches of a table, one row each.
    """
    rows = metrics.where((F.col("dataset") == dataset) & (F.col("batch_id") < before))
    newest = F.row_number().over(Window.partitionBy("table_name").orderBy(F.desc("batch_id")))
    kept = rows.select("table_name", "batch_id").distinct().withColumn("no", newest).where(F.col("no") <= batches).drop("no")
    return rows.join(kept, ["table_name", "batch_id"], "left_semi").groupBy("dataset", "table_name", "column_name", "metric").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("batch_id", "value"))), lambda s: s["value"]).alias("series"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Replace the metrics of the batches written, never append to them."""
    write_batches(metrics, path, "dataset", "table_name", "batch_id")


def append_incidents(incidents: DataFrame, path: str) -> None:
    incidents.select(*schemas.INCIDENT.fieldNames()).write.mode("append").parquet(path)


def decided_incidents(
    incidents: DataFrame, dataset: str, table_name: str, limit: int | None = None
) -> DataFrame:
    """What a person has decided about a table, newest first; all of it unless a limit is asked for."""
    rows = (
        incidents.where(
            (F.col("dataset") == dataset) & (F.col("table_name") == table_name)
            & F.col("human_decision").isNotNull()
        )
        .orderBy(F.desc("run_ts"), F.desc("incident_id"))
    )
    return rows if limit is None else rows.limit(limit)


def journal(
    incidents: DataFrame, dataset: str, table_name: str | None = None, layer: str | None = None,
    since: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Incidents newest first; all of them unless a limit is asked for."""
    rows = incidents.where(F.col("dataset") == dataset)
    if table_name is not None:
        rows = rows.where(F.col("table_name") == table_name)
    if layer is not None:
        rows = rows.where(F.col("layer") == layer)
    if since is not None:
        rows = rows.where(F.col("batch_id") >= since)
    rows = rows.orderBy(F.desc("run_ts"), F.desc("incident_id"))
    return rows if limit is None else rows.limit(limit)


def decode_json(column: str, schema) -> "F.Column":
    """Structured reading of a JSON text; unreadable text gives NULL."""
    options = {"mode": "PERMISSIVE"}
    return F.from_json(F.col(column), schema, options)
