"""Incident memory: what was found, what people decided, what stays silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from limpid import schemas
from limpid.functions.text import shorten, split_signature


def rejected_signatures(incidents: DataFrame) -> DataFrame:
    """Signatures a person explicitly rejected; undecided runs count for nothing."""
    return (
        incidents.where(F.col("human_decision") == "rejected")
        .select(F.explode("signatures").alias("signature"))
        .distinct()
    )


def split_silenced(anomalies: DataFrame, incidents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anomalies to submit and anomalies a past decision silences.

    ``anomalies`` carries ``signature``. Nothing is dropped: the two results
    together are the input. A changed order of magnitude is a new signature.
    """
    refused = rejected_signatures(incidents)
    return (
        anomalies.join(refused, "signature", "left_anti"),
        anomalies.join(refused, "signature", "left_semi"),
    )


def flag_silenced(anomalies: DataFrame, incidents: DataFrame) -> DataFrame:
    """The same as one frame with a flag, in one pass."""
    refused = rejected_signatures(incidents).withColumn("silenced", F.lit(True))
    return anomalies.join(refused, "signature", "left").withColumn(
        "silenced", F.coalesce("silenced", F.lit(False))
    )


def similar_incidents(incidents: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Incidents that share a signature with the given anomalies."""
    wanted = anomalies.select("signature").distinct()
    hits = (
        incidents.select("incident_id", F.explode("signatures").alias("signature"))
        .join(wanted, "signature", "left_semi")
        .select("incident_id").distinct()
    )
    return incidents.join(hits, "incident_id", "left_semi")


def summaries(incidents: DataFrame, maximum: int = 3, keys: tuple[str, ...] = ("dataset", "table_name")) -> DataFrame:
    """A bounded extract per table, field by field, newest first."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("run_ts"), F.desc("incident_id"))
    cause = F.get_json_object("diagnosis", "$.root_cause")
    return (
        incidents.withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") <= maximum)
        .select(
            *keys, "batch_id", shorten(cause).alias("root_cause"),
            shorten(F.col("proposed_fix")).alias("proposed_fix"), "human_decision", "decided_by",
        )
    )


def run_incidents(
    runs: DataFrame, anomalies: DataFrame, decisions: DataFrame | None = None
) -> DataFrame:
    """One incident per run, also when nothing was found or all was refused.

    ``runs``: ``dataset, layer, table_name, batch_id, run_ts``. ``anomalies``
    carries ``signature``; a run has a bounded number of them (columns times
    clauses and metrics). ``decisions``: ``table_name, batch_id,
    human_decision, decided_by, decided_at, applied_fix, validation_status``.
    """
    keys = ["table_name", "batch_id"]
    entry = F.struct(
        "family", "table_name", "column_name", "type", "observed", "reference", "magnitude",
        "dama", "details",
    )
    # map columns do not sort: the list is ordered by signature and text
    found = anomalies.withColumn("_json", F.to_json(entry)).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("signature", "_json"))).alias("_a")
    ).select(
        *keys,
        F.concat(F.lit("["), F.array_join(F.transform("_a", lambda a: a["_json"]), ","), F.lit("]")).alias("anomalies"),
        F.transform("_a", lambda a: a["signature"]).alias("signatures"),
    )
    out = runs.join(found, keys, "left")
    if decisions is not None:
        out = out.join(decisions, keys, "left")
    have = set(out.columns)
    wanted = []
    for f in schemas.INCIDENT.fields:
        if f.name == "incident_id":
            # rebuilt from the run itself, so that a rerun finds its own row
            c = F.sha2(F.concat_ws("|", "dataset", "table_name", "batch_id", F.col("run_ts").cast("string")), 256)
        elif f.name == "anomalies":
            c = F.coalesce("anomalies", F.lit("[]"))
        elif f.name == "signatures":
            c = F.coalesce("signatures", F.array().cast("array<string>"))
        else:
            c = F.col(f.name) if f.name in have else F.lit(None)
        wanted.append(c.cast(f.dataType).alias(f.name))
    return out.select(*wanted)


def silences(incidents: DataFrame, table_name: str | None = None) -> DataFrame:
    """What is no longer submitted, by whose decision, since when.

    A signature that does not split into four terms is still listed.
    """
    rows = incidents.where(F.col("human_decision") == "rejected")
    if table_name is not None:
        rows = rows.where(F.col("table_name") == table_name)
    return rows.select(
        F.explode("signatures").alias("signature"), "decided_by",
        F.coalesce("decided_at", "run_ts").alias("decided_at"), "batch_id", "incident_id",
    ).select(
        "signature", split_signature(F.col("signature")).alias("s"), "decided_by", "decided_at",
        "batch_id", "incident_id",
    ).select("signature", "s.*", "decided_by", "decided_at", "batch_id", "incident_id")


def anomaly_count() -> Column:
    return F.size(F.coalesce(F.from_json("anomalies", "array<string>"), F.array()))


def status() -> Column:
    """Derived, never stored: a decision, or nothing found, or still waiting."""
    return (
        F.when(F.col("human_decision").isNotNull(), F.col("human_decision"))
        .when(anomaly_count() == 0, F.lit("rien d'anormal"))
        .otherwise(F.lit("en attente"))
    )


def journal_lines(incidents: DataFrame) -> DataFrame:
    return incidents.select(
        "incident_id", "batch_id", "layer", "table_name", anomaly_count().alias("anomalies"),
        status().alias("status"), "decided_by", F.col("applied_fix").isNotNull().alias("applied"),
    )


def status_counts(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy(status().alias("status")).agg(F.count(F.lit(1)).alias("runs"))


def pending(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals without a decision, oldest first."""
    return proposals.join(decisions, ["table_name", "batch_id"], "left_anti").orderBy(
        "batch_id", "table_name"
    )


def overview(
    registry: DataFrame, contracts: DataFrame, proposals: DataFrame, decisions: DataFrame,
    incidents: DataFrame,
) -> DataFrame:
    """The state of the system in one row; each part is its own aggregate."""
    versions = contracts.select("dataset", "table_name", "version", "status").distinct()
    # one-row sides: joining them is a concatenation, not a product
    parts = [
        registry.agg(F.count(F.lit(1)).alias("tables")),
        versions.agg(
            F.count_if(F.col("status") == "approved").alias("contracts_in_force"),
            F.count_if(F.col("status") != "approved").alias("contracts_to_sign"),
        ),
        pending(proposals, decisions).agg(F.count(F.lit(1)).alias("decisions_pending")),
        incidents.agg(
            F.count(F.lit(1)).alias("runs"),
            F.count_if(anomaly_count() > 0).alias("runs_with_anomalies"),
        ),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one").withColumn(
        "to_do", F.col("decisions_pending") + F.col("contracts_to_sign")
    )


def past_of_runs(anomalies: DataFrame, incidents: DataFrame, maximum: int = 3) -> DataFrame:
    """(table_name, batch_id, similar): per run the newest decided incidents before it that share a signature.

    The join is by signature, each once per run and once per incident; of the
    incidents of a run no more than ``maximum`` are kept before they are collected.
    """
    keys = ["table_name", "batch_id"]
    decided = incidents.where(F.col("human_decision").isNotNull())
    said = decided.select(
        "incident_id", "run_ts", F.col("batch_id").alias("_past"), "human_decision", "decided_by",
        shorten(F.get_json_object("diagnosis", "$.root_cause")).alias("root_cause"), shorten(F.col("proposed_fix")).alias("proposed_fix"),
    )
    shared = anomalies.select(*keys, "signature").distinct().join(
        decided.select("incident_id", F.col("batch_id").alias("_past"), F.explode(F.array_distinct("signatures")).alias("signature")), "signature"
    ).where(F.col("_past") < F.col("batch_id")).select(*keys, "incident_id").distinct()
    newest = Window.partitionBy(*keys).orderBy(F.desc("run_ts"), F.desc("incident_id"))
    ranked = shared.join(said, "incident_id").withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= maximum)
    one = F.struct("_rn", F.col("_past").alias("batch_id"), "root_cause", "proposed_fix", "human_decision", "decided_by")
    return ranked.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(one)), lambda s: s.dropFields("_rn")).alias("similar"))


def evidence(
    anomalies: DataFrame, profile: DataFrame, contracts: DataFrame, layer: str = "bronze", incidents: DataFrame | None = None,
) -> DataFrame:
    """What a reader of one run gets: aggregates only, chosen field by field.

    With ``incidents`` also what was decided before about the same signatures.
    """
    keys = ["table_name", "batch_id"]
    shape = profile.groupBy(*keys).agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("columns"),
        F.sort_array(F.collect_set("column_name")).alias("column_names"),
    )
    found = anomalies.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("signature", "family", "observed", "reference", "dama"))).alias("anomalies")
    )
    version = contracts.where(F.col("status") == "approved").groupBy("table_name").agg(
        F.max("version").alias("contract_version")
    )
    out = found.join(shape, keys).join(version, "table_name", "left").withColumn("layer", F.lit(layer))
    return out if incidents is None else out.join(past_of_runs(anomalies, incidents), keys, "left")
