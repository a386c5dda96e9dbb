"""Batches as they arrive, into the same tables and by the same rule as the daily load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from limpid.sources import ledger
from limpid.sources.batches import null_tokens_to_null

DELIVERY = "_delivery"
HEADER = "_header"


def _depth(spark: SparkSession, folder: str) -> int:
    """How many parts the path of a folder has."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len([p for p in fs.makeQualified(path).toUri().getPath().split("/") if p])


def incoming(spark: SparkSession, folder: str, table: str, columns: list[str]) -> DataFrame:
    """Files ``<folder>/<batch>/[<delivery>/]<table>.csv`` as a stream of text rows.

    The first line of each file comes along, marked, so that a file without rows is
    seen too.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = (
        spark.readStream.schema(schema).option("header", False).option("escape", '"')
        .option("pathGlobFilter", f"{table}.csv").option("recursiveFileLookup", True)
        .csv(folder)
    )
    parts = F.filter(F.split(F.regexp_replace("_metadata.file_path", "^[a-zA-Z0-9+.-]+:(//[^/]*)?", ""), "/"), lambda p: p != "")
    depth = _depth(spark, folder)
    below = F.slice(parts, F.lit(depth + 2), F.greatest(F.size(parts) - (depth + 2), F.lit(0)))
    named = [F.lower(F.col(f"`{c}`")) == c.lower() for c in columns]
    header: Column = F.col("_metadata.file_block_start") == 0
    for same in named:
        header = header & F.coalesce(same, F.lit(False))
    return rows.select(
        "*", F.get(parts, F.lit(depth)).alias("_batch_id"), F.col("_metadata.file_name").alias("_source"),
        F.array_join(below, "/").alias(DELIVERY), header.alias(HEADER),
    )


def replace_delivered(bronze: str, checkpoint: str):
    """A ``foreachBatch`` sink with the rule of the daily load: a delivery replaces its batch.

    Files of one delivery add to each other, also over several micro-batches; files
    of another delivery folder replace what the batch held, be they shorter or
    without rows. A repeated micro-batch writes its own version again.
    """
    def write(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        # tells this stream from any other that writes the table
        stream = spark.read.text(f"{checkpoint}/metadata").agg(F.md5(F.max("value")).alias("id")).first()["id"]
        told = df.select("_batch_id", DELIVERY).distinct().collect()
        for i, delivery in enumerate(sorted({r[DELIVERY] for r in told})):
            keys = [(r["_batch_id"],) for r in told if r[DELIVERY] == delivery]
            rows = null_tokens_to_null(df.where((F.col(DELIVERY) == delivery) & ~F.col(HEADER)).drop(DELIVERY, HEADER))
            stamped = rows.withColumn("_ingested_at", F.current_timestamp().cast("timestamp_ntz"))
            ledger.deliver(stamped, bronze, ("_batch_id",), keys, f"stream/{delivery}", f"{stream}-{epoch:010d}-{i}")

    return write


def ingest(
    spark: SparkSession, folder: str, table: str, columns: list[str], bronze: str, checkpoint: str
) -> StreamingQuery:
    """Load what is new and stop."""
    return (
        incoming(spark, folder, table, columns)
        .writeStream.foreachBatch(replace_delivered(bronze, checkpoint))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
