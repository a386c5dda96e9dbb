"""The daily round: measure, compare, propose, correct, verify."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from limpid import schemas, vocabulary as V
from limpid.functions import text
from limpid.operators import contracts as C, corrections, detect as D, impact, memory
from limpid.operators.profile import batch_filter, profile_metrics, profile_tables
from limpid.session import stage
from limpid.sources.batches import read_batches, write_batches
from limpid.sources.history import latest_series

APPLIED = "batch_id string, rows_before bigint, rows_after bigint, changed bigint, quarantined bigint"


@dataclass
class References:
    """What a round is compared to. Parts left out silence their family."""

    metrics: DataFrame | None = None
    schema_history: DataFrame | None = None
    contracts: DataFrame | None = None
    incidents: DataFrame | None = None
    verdicts: DataFrame | None = None
    present: DataFrame | None = None
    present_columns: DataFrame | None = None


def discover(
    dataset: str, registry: DataFrame, resolve: Callable[[str], DataFrame]
) -> tuple[DataFrame | None, DataFrame | None, list[str]]:
    """Propose a contract for every declared table from its whole content.

    A table that cannot be read is reported and does not stop the others.
    """
    clauses, warnings, failures = [], [], []
    for r in registry.where(F.col("dataset") == dataset).collect():
        name = r["table_name"]
        try:
            facts, values = profile_tables({name: (resolve(name), None)}, dataset)
            c, w = C.propose(stage(facts, "profile"), values=values)
        except Exception as exc:  # noqa: BLE001 - reported
            failures.append(f"{name}: {type(exc).__name__}: {exc}")
            continue
        clauses.append(c)
        warnings.append(w)
    if not clauses:
        return None, None, failures
    union = lambda fs: reduce(DataFrame.unionByName, fs)
    return union(clauses), union(warnings), failures


def _signed(refs: References) -> DataFrame | None:
    return C.in_force(refs.contracts) if refs.contracts is not None else None


def profile_batch(
    tables: dict[str, tuple[DataFrame, str | None]], dataset: str, batch_id: str, refs: References | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Profiles of one batch of some tables, keyed by the batch of the run, and their values.

    ``tables`` gives rows and batch column; a table without batches is profiled as
    a whole. Values are those of the columns that the profile or a signed clause
    judges by values, from the frequency table of the profile.
    """
    rows = {n: (batch_filter(df, by, batch_id if by else None), by) for n, (df, by) in tables.items()}
    signed = _signed(refs) if refs is not None else None
    also = signed.where(F.col("clause") == "accepted_values") if signed is not None else None
    found, values = profile_tables(rows, dataset, also)
    keyed = lambda df: df.withColumn("batch_id", F.lit(batch_id))
    return stage(keyed(found), "profile"), stage(keyed(values), "values")


def families(
    spark: SparkSession, profile: DataFrame, values: DataFrame, names: list[str], dataset: str, batch_id: str, refs: References,
) -> list[tuple[str, Callable[[], DataFrame | None]]]:
    """The families that look at profiles, for all tables of ``names`` at once."""
    def schema():
        today = profile.select("table_name", "batch_id", "column_name")
        batches = today.select("table_name", "batch_id").distinct()
        history = spark.createDataFrame([], "table_name string, batch_id string, column_name string")
        if refs.schema_history is not None:
            # the history names tables by their last segment
            last = lambda df: df.withColumn("_last", text.last_segment(F.col("table_name")))
            past = last(refs.schema_history.where(F.col("batch_id") < batch_id)).drop("table_name")
            latest = past.groupBy("_last").agg(F.max("batch_id").alias("batch_id"))
            history = past.join(latest, ["_last", "batch_id"], "left_semi").join(last(batches).select("table_name", "_last"), "_last").select(
                "table_name", F.lit(batch_id).alias("batch_id"), "column_name")
        return D.schema_drift(today, D.schema_reference(history, _signed(refs), batches))

    def contract():
        return D.contract_violations(profile, _signed(refs), values) if refs.contracts is not None else None

    def statistical():
        if refs.metrics is None:
            return None
        return D.statistical(D.compare_to_series(profile_metrics(profile), latest_series(refs.metrics, dataset, batch_id)))

    def semantic():
        return D.semantic_full(values, profile)

    def external():
        return D.external(refs.verdicts, batch_id, *names) if refs.verdicts is not None else None

    return [("schema", schema), ("contract", contract), ("statistical", statistical), ("semantic", semantic), ("external", external)]


def detect_batch(
    spark: SparkSession, profile: DataFrame, values: DataFrame, names: list[str], dataset: str, batch_id: str,
    registry: DataFrame, refs: References,
) -> tuple[DataFrame, list[str]]:
    """All families on one profiled batch of some tables, with signatures.

    A family that fails is tried again table by table, so that one table's data
    cost no other table its judgement.
    """
    found, failures = D.detect([
        ("inventory", lambda: sweep_inventory(registry, batch_id, refs)),
        *families(spark, profile, values, names, dataset, batch_id, refs),
    ], spark)
    failed = {f.split(":", 1)[0] for f in failures} - {"inventory"}
    if failed and len(names) > 1:
        failures = [f for f in failures if f.startswith("inventory:")]
        for name in names:
            own = F.col("table_name") == name
            one = families(spark, profile.where(own), values.where(own), [name], dataset, batch_id, refs)
            more, wrong = D.detect([f for f in one if f[0] in failed], spark)
            found, failures = found.unionByName(more), failures + [f"{name}: {w}" for w in wrong]
    return D.with_signature(found), failures


def sweep_inventory(registry: DataFrame, batch_id: str, refs: References) -> DataFrame | None:
    """Declared against present tables, once for all of them.

    What a missing table looked like is known from the last columns that were
    observed of it (the history names tables by their last segment), else from
    its signed contract.
    """
    if refs.present is None:
        return None
    declared = registry.select("table_name").distinct().withColumn("_last", text.last_segment(F.col("table_name")))
    known = None
    if refs.schema_history is not None:
        past = refs.schema_history.where(F.col("batch_id") < batch_id).withColumn("_last", text.last_segment(F.col("table_name"))).drop("table_name")
        latest = past.groupBy("_last").agg(F.max("batch_id").alias("batch_id"))
        known = past.join(latest, ["_last", "batch_id"], "left_semi").join(declared, "_last").select("table_name", "column_name")
    if refs.contracts is not None:
        signed = C.in_force(refs.contracts).select("table_name", "column_name").distinct()
        known = signed if known is None else known.unionByName(signed.join(known, "table_name", "left_anti"))
    return D.inventory(registry, refs.present, batch_id, known, refs.present_columns)


def check_layer(
    spark: SparkSession, dataset: str, layer: str, batch_id: str, registry: DataFrame,
    resolve: Callable[[str], DataFrame], refs: References,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Profile and judge every declared table of a layer, all of them in one plan.

    Returns profiles, anomalies and failures. The inventory is taken once and
    speaks for tables that are not there; a table that fails is reported and the
    sweep goes on; a layer without tables is an error. If the common plan fails,
    the tables are profiled one by one to find out which of them does.
    """
    tables = registry.where((F.col("dataset") == dataset) & (F.col("layer") == layer)).collect()
    if not tables:
        raise ValueError(f"no table declared in layer {layer!r} of {dataset!r}")
    failures, rows = [], {}
    for t in tables:
        try:
            df = resolve(t["table_name"])
            batch_filter(df, t["batch_column"], batch_id)
            rows[t["table_name"]] = df, t["batch_column"]
        except Exception as exc:  # noqa: BLE001 - reported
            failures.append(f"{t['table_name']}: {type(exc).__name__}: {exc}")
    profiled = []
    try:
        profiled = [profile_batch(rows, dataset, batch_id, refs)] if rows else []
    except Exception:  # noqa: BLE001 - found and reported below
        for name, one in list(rows.items()):
            try:
                profiled.append(profile_batch({name: one}, dataset, batch_id, refs))
            except Exception as exc:  # noqa: BLE001 - reported
                del rows[name]
                failures.append(f"{name}: {type(exc).__name__}: {exc}")
    own = registry.where(F.col("dataset") == dataset)
    if not profiled:
        found, wrong = D.detect([("inventory", lambda: sweep_inventory(own, batch_id, refs))], spark)
        return spark.createDataFrame([], schemas.PROFILE_COLUMN), D.with_signature(found), failures + wrong
    profiles, values = (reduce(DataFrame.unionByName, frames) for frames in zip(*profiled))
    anomalies, wrong = detect_batch(spark, profiles, values, list(rows), dataset, batch_id, own, refs)
    return profiles, anomalies, failures + wrong


def proposals(
    anomalies: DataFrame, profile: DataFrame, incidents: DataFrame | None = None
) -> DataFrame:
    """One row per run that waits for a decision: facts, impact, gestures.

    A run has a bounded number of anomalies, so they fit one row.
    """
    keys = ["table_name", "batch_id"]
    submitted = anomalies
    if incidents is not None:
        submitted, _ = memory.split_silenced(anomalies, incidents)
    impacts = impact.per_anomaly(corrections.default_corrections(submitted), profile)
    head = impact.headline(impacts)
    listed = impacts.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("signature", "rows", "certainty", "gestures"))).alias("anomaly_list")
    )
    out = head.withColumn("summary", impact.sentence()).join(listed, keys)
    allowed = F.array(*[F.lit(g) for g in V.GESTURES])
    out = out.withColumn("allowed_gestures", allowed).withColumn(
        "choices", F.array(*[F.lit(d) for d in V.DECISIONS])
    )
    if incidents is not None:
        decided = incidents.where(F.col("human_decision").isNotNull()).select(
            F.explode("signatures").alias("signature"), "incident_id"
        )
        past = submitted.select(*keys, "signature").distinct().join(decided, "signature").groupBy(*keys).agg(
            F.count_distinct("incident_id").alias("past_incidents")
        )
        out = out.join(past, keys, "left").withColumn(
            "past_incidents", F.coalesce("past_incidents", F.lit(0))
        )
    return out


def _steps_by_batches(todo: list) -> list[tuple[list, list[str]]]:
    """Step lists with the batches they are for.

    Batches with the same steps are corrected in one plan, unless a step looks at
    the other rows of its batch (spellings, copies).
    """
    per_batch: dict[str, list] = {}
    for r in todo:
        per_batch.setdefault(r["batch_id"], []).append(r)
    groups: dict[tuple, tuple[list, list[str]]] = {}
    for batch_id, steps in sorted(per_batch.items()):
        steps = sorted(steps, key=str)
        alone = any(r["gesture"] == "normaliser" or r["match"] == "copies" for r in steps)
        same = tuple(str({**r.asDict(), "batch_id": batch_id if alone else None}) for r in steps)
        groups.setdefault(same, (steps, []))[1].append(batch_id)
    return list(groups.values())


def apply_corrections(
    spark: SparkSession, path: str, table_name: str, batch_column: str, planned: DataFrame,
    decisions: DataFrame, anomalies: DataFrame,
) -> DataFrame:
    """Write the approved corrections of a raw table.

    Only rows a person approved are read. A correction that would invent a value
    is refused before anything is written. Batches are corrected from a staged
    copy and replace their own partitions, so a failure leaves the old ones. The
    report counts rows before, after, changed and flagged, per batch.
    """
    mine = planned.where(F.upper("table_name") == table_name.upper())
    # typed corrections of approved batches: a short list a person has read
    todo = corrections.approved_only(mine, decisions).collect()
    if not todo:
        return spark.createDataFrame([], APPLIED)
    batch = F.col(batch_column)
    writing = [r for r in todo if r["target"] is not None or r["whole_column"] or r["gesture"] not in V.GESTURES]
    if writing:
        columns = sorted({r["column_name"] for r in writing})
        rows = read_batches(spark, path).where(batch.isin(sorted({r["batch_id"] for r in writing})))
        # looked up per batch: a value of another day was not observed in this one
        keyed = F.concat_ws("|", F.lit(table_name), batch)
        observed = reduce(DataFrame.unionByName, [
            rows.select(keyed.alias("table_name"), F.lit(c).alias("column_name"),
                        F.col(c).cast("string").alias("value")).distinct()
            for c in columns
        ])
        by_batch = F.concat_ws("|", "table_name", "batch_id")
        asked = spark.createDataFrame(writing, schemas.CORRECTION).withColumn("table_name", by_batch)
        named = anomalies.where(F.upper("table_name") == table_name.upper()).select(
            by_batch.alias("table_name"), "column_name"
        )
        refused = corrections.refusals(asked, named, observed)
        first = refused.first()
        if first is not None:
            raise ValueError(f"{first['table_name']}: {first['reason']}")
    reports = []
    for steps, batches in _steps_by_batches(todo):
        old = read_batches(spark, path).where(batch.isin(batches))
        new = stage(corrections.correct(old, steps), "corrected")
        touched = sorted({r["column_name"] for r in steps})
        changed = reduce(DataFrame.unionByName, [
            corrections.change_counts(old, new, batch_column, c) for c in touched
        ]).groupBy(batch_column).agg(
            F.max("rows_before").alias("rows_before"), F.max("rows_after").alias("rows_after"),
            F.sum("affected").alias("changed"),
        )
        flag = corrections.FLAG
        held = F.coalesce(F.col(flag), F.lit(False)) if flag in new.columns else F.lit(False)
        flagged = new.groupBy(batch_column).agg(F.count_if(held).alias("quarantined"))
        # counted before the write: the old partitions are gone afterwards
        reports.append(stage(changed.join(flagged, batch_column).select(
            batch.alias("batch_id"), "rows_before", "rows_after", "changed", "quarantined"
        ), "applied"))
        write_batches(new, path, batch_column)
    return reduce(DataFrame.unionByName, reports)


def verify_batch(
    spark: SparkSession, corrected: DataFrame, before: DataFrame, table_name: str, dataset: str,
    batch_column: str | None, batch_id: str, registry: DataFrame, refs: References,
) -> DataFrame:
    """Measure and judge the corrected batch again, against the same references."""
    p, values = profile_batch({table_name: (corrected, batch_column)}, dataset, batch_id, refs)
    after, _ = detect_batch(spark, p, values, [table_name], dataset, batch_id, registry, refs)
    return corrections.verify(before, after)
