"""Session defaults and the staging of intermediate frames."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# folder for sessions whose settings name none; see use_folder
_FOLDER: str | None = None


def build_session(app: str = "limpid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (adaptive plans, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # building plans needs no call sites; each costs several driver calls
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configured_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def use_folder(path: str) -> None:
    """Name the folder for local sessions that are started without ``spark.checkpoint.dir``, as tests are.

    A cluster's session is never given one: it has to name a folder that all executors reach.
    """
    global _FOLDER
    _FOLDER = path


def staging_root(spark: SparkSession) -> str:
    """Folder shared by all executors: the cluster's setting, else, within one machine, what ``use_folder`` named."""
    local = spark.sparkContext.master.startswith("local")
    shared = configured_folder(spark) or (_FOLDER if local else None)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return os.path.join(shared, "limpid", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(staging_root(spark), f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back.

    Used where several later plans read the same shuffled result. The written
    table survives lost executors, cuts the lineage, is pruned by column when
    read, and has a known size, so that Spark itself decides about broadcasting.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_stages(spark: SparkSession) -> None:
    """Delete what ``stage`` wrote for this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
