"""Profile metrics of an event stream per time window, judged as windows close."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from limpid import vocabulary as V
from limpid.operators import detect
from limpid.session import stage
from limpid.sources import ledger


def windowed_metrics(
    events: DataFrame, time: str, columns: list[str], late: str = "1 day", width: str = "1 day"
) -> DataFrame:
    """Row, null and approximate distinct counts per window.

    Works on batch and streaming frames alike; the watermark bounds the state
    and drops events later than ``late``. Windows are cut in UTC; a time without
    zone counts as UTC whatever the zone of the session.
    """
    moment = F.col(time).cast("timestamp")
    if isinstance(events.schema[time].dataType, T.TimestampNTZType):
        moment = F.concat(F.col(time).cast("string"), F.lit("Z")).cast("timestamp")
    stamped = events.withColumn("_t", moment)
    if events.isStreaming:
        stamped = stamped.withWatermark("_t", late)
    aggregates = [F.count(F.lit(1)).alias("row_count")]
    for c in columns:
        aggregates += [
            F.count_if(F.col(c).isNull()).alias(f"null_count__{c}"),
            F.approx_count_distinct(c).alias(f"distinct__{c}"),
        ]
    return stamped.groupBy(F.window("_t", width).alias("w")).agg(*aggregates).select(
        F.date_format(
            F.convert_timezone(None, F.lit("UTC"), F.col("w.start").cast("timestamp_ntz")), "yyyy-MM-dd"
        ).alias("batch_id"),
        "row_count", *[f"{m}__{c}" for c in columns for m in ("null_count", "distinct")],
    )


def as_metric_rows(windowed: DataFrame, dataset: str, table_name: str, columns: list[str]) -> DataFrame:
    """Long form, ready to be compared with earlier batches."""
    entries = [F.struct(F.lit(None).cast("string").alias("column_name"), F.lit("row_count").alias("metric"),
                        F.col("row_count").cast("double").alias("value"))]
    for c in columns:
        for metric in ("null_count", "distinct"):
            entries.append(F.struct(F.lit(c).alias("column_name"), F.lit(metric).alias("metric"),
                                    F.col(f"{metric}__{c}").cast("double").alias("value")))
    return windowed.select(
        F.lit(dataset).alias("dataset"), F.lit(table_name).alias("table_name"), "batch_id",
        F.explode(F.array(*entries)).alias("m"),
    ).select("dataset", "table_name", "batch_id", "m.*")


METRIC_KEY = ("dataset", "table_name", "batch_id")


def _with_past(metrics: str, rows: DataFrame, window: int) -> DataFrame:
    """The stored metrics of the batches of ``rows`` and of as many batches before them as a reference holds."""
    spark = rows.sparkSession
    new = {r["batch_id"] for r in rows.select("batch_id").distinct().collect()}
    known = sorted({r["key"][2] for r in ledger.current(spark, metrics).select("key").distinct().collect()})
    first = known[max(0, known.index(min(new)) - window)]
    return ledger.read(spark, metrics).where(F.col("batch_id") >= first)


def judge_closed(metrics: str, found: str, dataset: str, table_name: str, columns: list[str], checkpoint: str, window: int = V.HISTORY_WINDOW):
    """A ``foreachBatch`` sink for windows that are closed: store their metrics, compare them with the past.

    The reference of a window is the stored series of the windows before it, so it
    outlives the stream; state holds open windows only. A repeated micro-batch
    replaces what it stored.
    """
    def write(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        rows = stage(as_metric_rows(df, dataset, table_name, columns), "closed-windows")
        closed = [r["batch_id"] for r in rows.select("batch_id").distinct().collect()]
        if not closed:
            return
        stream = spark.read.text(f"{checkpoint}/metadata").agg(F.md5(F.max("value")).alias("id")).first()["id"]
        version = f"{stream}-{epoch:010d}"
        ledger.deliver(rows, metrics, METRIC_KEY, version=version)
        judged = detect.statistical(detect.with_references(_with_past(metrics, rows, window), window))
        ledger.deliver(judged.where(F.col("batch_id").isin(closed)), found, ("batch_id",), [(b,) for b in closed], version=version)

    return write


def watch(
    events: DataFrame, time: str, columns: list[str], dataset: str, table_name: str, metrics: str, found: str,
    checkpoint: str, late: str = "1 day", width: str = "1 day",
) -> StreamingQuery:
    """Measure every window of a stream once, when no more rows of it can come, and judge it.

    The watermark closes windows: rows later than ``late`` are dropped, and the state
    holds the windows of that span only, whatever the length of the stream.
    """
    return (
        windowed_metrics(events, time, columns, late, width)
        .writeStream.outputMode("append")
        .foreachBatch(judge_closed(metrics, found, dataset, table_name, columns, checkpoint))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
