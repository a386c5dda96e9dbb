"""Histories and the anomaly families on daily batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from limpid.catalogue import query
from limpid.catalogue import tables as t
from limpid.catalogue.corruption import (
    SQL_RAMPED, _sql_varied, ramped_events, varied_customers,
)
from limpid.operators import contracts as C, detect as D, profile as P
from limpid.sources import catalog, history


@t.shared
def ramped_metrics(spark, d) -> DataFrame:
    e = ramped_events(spark, d).select(t.BATCH, "event_type", "value")
    columns = ["event_type", "value"]
    facts = P.with_distinct(
        P.column_bounds(e, columns, t.BATCH), P.frequency_table(e, columns, t.BATCH)
    )
    return P.profile_metrics(P.as_profile(facts, "RAW.EVENTS", "shop"))


SQL_METRICS = f"""{SQL_RAMPED}, m AS (
  SELECT b, CAST(NULL AS VARCHAR) AS c, 'row_count' AS metric, CAST(count(*) AS DOUBLE) AS v FROM ramped GROUP BY b
  UNION ALL SELECT b, 'event_type', 'null_count', CAST(count(*) - count(event_type) AS DOUBLE) FROM ramped GROUP BY b
  UNION ALL SELECT b, 'event_type', 'null_rate', round((count(*) - count(event_type)) / count(*), 6) FROM ramped GROUP BY b
  UNION ALL SELECT b, 'event_type', 'distinct', CAST(count(DISTINCT event_type) AS DOUBLE) FROM ramped GROUP BY b
  UNION ALL SELECT b, 'value', 'null_count', CAST(count(*) - count(value) AS DOUBLE) FROM ramped GROUP BY b
  UNION ALL SELECT b, 'value', 'null_rate', round((count(*) - count(value)) / count(*), 6) FROM ramped GROUP BY b
  UNION ALL SELECT b, 'value', 'distinct', CAST(count(DISTINCT value) AS DOUBLE) FROM ramped GROUP BY b),
no AS (SELECT b, row_number() OVER (ORDER BY b) AS r FROM (SELECT DISTINCT b FROM m)),
mm AS (SELECT m.*, r FROM m JOIN no USING (b)),
p AS (SELECT x.b, x.c, x.metric, x.v, y.v AS past FROM mm x JOIN mm y
      ON x.c IS NOT DISTINCT FROM y.c AND x.metric = y.metric AND y.r BETWEEN x.r - 30 AND x.r - 1),
ref AS (SELECT b, c, metric, v, count(*) AS batches, median(past) AS med, mad(past) AS mad FROM p GROUP BY ALL)"""


@query("references_events", f"""
WITH {SQL_METRICS}
SELECT b AS batch_id, c AS column_name, metric, v AS value, CAST(batches AS INTEGER) AS batches,
       round(med, 6) AS median, round(mad, 6) AS mad FROM ref
""")
def references_events(spark, d):
    """For every batch at once: median and MAD of up to thirty batches before it."""
    refs = D.with_references(ramped_metrics(spark, d)).where(F.col("batches") > 0)
    return refs.select(
        "batch_id", "column_name", "metric", "value", "batches",
        F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"),
    )


@query("statistical_events", f"""
WITH {SQL_METRICS}
SELECT b AS batch_id, c AS column_name, metric, v AS observed,
       CASE WHEN mad = 0 THEN 'rupture_de_constante' ELSE 'derive_statistique' END AS type,
       round(CASE WHEN mad = 0 THEN abs(v - med) ELSE abs(0.6745::DOUBLE * (v - med) / mad) END, 6) AS magnitude,
       CASE metric WHEN 'distinct' THEN 'unicite' ELSE 'completude' END AS dama
FROM ref WHERE batches >= 15 AND CASE WHEN mad = 0 THEN v <> med ELSE abs(0.6745::DOUBLE * (v - med) / mad) > 3.5 END
""")
def statistical_events(spark, d):
    found = D.statistical(D.with_references(ramped_metrics(spark, d)))
    return found.select(
        "batch_id", "column_name", F.col("details")["metric"].alias("metric"),
        F.col("observed_num").alias("observed"), "type", F.round("magnitude", 6).alias("magnitude"), "dama",
    )


@query("metric_history_events", f"""
WITH {SQL_METRICS}, k AS (SELECT DISTINCT b FROM m WHERE b < '2024-01-25' ORDER BY b DESC LIMIT 10)
SELECT c AS column_name, metric, count(*) AS batches, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY b) AS series
FROM m JOIN k USING (b) WHERE metric <> 'null_rate' GROUP BY 1, 2
""")
def metric_history_events(spark, d):
    """The ten existing batches before a day, oldest first."""
    h = history.metric_history(ramped_metrics(spark, d), "shop", "RAW.EVENTS", "2024-01-25", 10)
    return h.where(F.col("metric") != "null_rate").select(
        "column_name", "metric", F.size("series").cast("long").alias("batches"),
        F.array_join(F.transform("series", lambda v: v.cast("long").cast("string")), ",").alias("series"),
    )


@query("statistical_one_day", f"""
WITH {SQL_METRICS}, k AS (SELECT DISTINCT b FROM m WHERE b < '2024-01-25' ORDER BY b DESC LIMIT 30),
h AS (SELECT c, metric, count(*) AS n, median(v) AS med, mad(v) AS mad FROM m JOIN k USING (b) GROUP BY 1, 2)
SELECT m.c AS column_name, m.metric, v AS observed, med AS reference FROM m JOIN h ON m.c IS NOT DISTINCT FROM h.c AND m.metric = h.metric
WHERE b = '2024-01-25' AND n >= 15 AND CASE WHEN mad = 0 THEN v <> med ELSE abs(0.6745::DOUBLE * (v - med) / mad) > 3.5 END
""")
def statistical_one_day(spark, d):
    """One batch against its stored history: a null-safe join on the series."""
    metrics = ramped_metrics(spark, d)
    past = history.metric_history(metrics, "shop", "RAW.EVENTS", "2024-01-25")
    today = metrics.where(F.col("batch_id") == "2024-01-25")
    found = D.statistical(D.compare_to_series(today, past))
    return found.select(
        "column_name", F.col("details")["metric"].alias("metric"),
        F.col("observed_num").alias("observed"), F.col("reference_num").alias("reference"),
    )


# --- schemas -----------------------------------------------------------------

def schema_log(spark, d) -> DataFrame:
    """Columns per daily batch; from the 20th on ``value`` arrives as ``amount``."""
    days = t.events_by_day(spark, d).groupBy(F.col(t.BATCH).alias("batch_id")).agg(F.count(F.lit(1)).alias("n"))
    late = F.col("batch_id") >= "2024-01-20"
    listed = F.array(
        F.lit("event_id"), F.lit("ts"), F.lit("event_type"), F.when(late, "amount").otherwise("value")
    )
    return days.select("batch_id", F.lit("events").alias("table_name"), F.posexplode(listed).alias("p", "column_name")).select(
        "batch_id", "table_name", "column_name", (F.col("p") + 1).alias("ordinal_position")
    )


_SQL_LOG = f"""{t.SQL_EVENTS}, log AS (
  SELECT b, unnest(['EVENT_ID', 'TS', 'EVENT_TYPE', CASE WHEN b >= '2024-01-20' THEN 'AMOUNT' ELSE 'VALUE' END]) AS c,
         unnest([1, 2, 3, 4]) AS p FROM (SELECT DISTINCT b FROM ev))"""


@query("schema_drift_events", f"""
WITH {_SQL_LOG}, o AS (SELECT b, lag(b) OVER (ORDER BY b) AS before FROM (SELECT DISTINCT b FROM log)),
k AS (SELECT o.b, l.c FROM o JOIN log l ON l.b = o.before)
SELECT b AS batch_id, c AS column_name, 'colonne_disparue' AS type FROM (SELECT b, c FROM k EXCEPT SELECT b, c FROM log)
UNION ALL
SELECT b, c, 'colonne_nouvelle' FROM (SELECT log.b, log.c FROM log JOIN o USING (b) WHERE before IS NOT NULL EXCEPT SELECT b, c FROM k)
""")
def schema_drift_events(spark, d):
    """Every batch against the one before it; the first one says nothing."""
    log = schema_log(spark, d)
    known = history.previous_schemas(log).withColumn("origin", F.lit("_SCHEMA_HISTORY"))
    return D.schema_drift(log, known).select("batch_id", "column_name", "type")


@query("schema_before_batch", f"""
WITH {_SQL_LOG} SELECT b AS batch_id, c AS column_name, p AS ordinal_position FROM log
WHERE b = (SELECT max(b) FROM log WHERE b < '2024-01-21')
""")
def schema_before_batch(spark, d):
    return history.read_schema(schema_log(spark, d), "RAW.EVENTS", before="2024-01-21").select(
        "batch_id", "column_name", "ordinal_position"
    )


@query("schema_latest", f"""
WITH {_SQL_LOG} SELECT b AS batch_id, c AS column_name, p AS ordinal_position FROM log WHERE b = (SELECT max(b) FROM log)
""")
def schema_latest(spark, d):
    return history.read_schema(schema_log(spark, d), "events").select(
        "batch_id", "column_name", "ordinal_position"
    )


_TABLES = """p AS (SELECT DISTINCT 'RAW.' || upper(event_type) AS table_name FROM events),
d AS (SELECT table_name FROM p WHERE table_name <> 'RAW.ERROR' UNION SELECT 'RAW.REFUND')"""


@query("inventory", f"""
WITH {_TABLES}
SELECT table_name, 'table_absente' AS type, 'completude' AS dama FROM d WHERE table_name NOT IN (SELECT table_name FROM p)
UNION ALL SELECT table_name, 'table_non_declaree', 'coherence' FROM p WHERE table_name NOT IN (SELECT table_name FROM d)
""")
def inventory(spark, d):
    """One table per event type: what is declared against what is there."""
    present = t.read(spark, d, "events").select(
        F.concat(F.lit("RAW."), F.upper("event_type")).alias("table_name")
    ).distinct()
    gone = catalog.registry(spark, "shop", [{"name": "RAW.REFUND", "layer": "bronze"}]).select("table_name")
    declared = present.where(F.col("table_name") != "RAW.ERROR").unionByName(gone)
    return D.inventory(declared, present, "2024-01-30").select("table_name", "type", "dama")


@query("probable_renames", """
WITH k AS (SELECT DISTINCT event_type, props FROM events WHERE event_type = 'click'),
p AS (SELECT 'RAW.' || upper(event_type) AS tn, list_sort(list(DISTINCT upper(props))) AS cols FROM events GROUP BY 1)
SELECT 'RAW.TAP' AS table_name, p.tn AS observed, 'renommage_probable' AS type FROM p
WHERE tn <> 'RAW.VIEW' AND cols = (SELECT list_sort(list(DISTINCT upper(props))) FROM k)
""")
def probable_renames(spark, d):
    """A missing table whose known columns are those of an undeclared one.

    The distinct property texts of an event type stand for its columns.
    """
    e = t.read(spark, d, "events").where(F.col("event_type").isNotNull())
    columns = e.select(
        F.concat(F.lit("RAW."), F.upper("event_type")).alias("table_name"), F.col("props").alias("column_name")
    ).distinct()
    known = columns.where(F.col("table_name") == "RAW.CLICK").withColumn("table_name", F.lit("RAW.TAP"))
    declared = catalog.registry(spark, "shop", [
        {"name": "RAW.TAP", "layer": "bronze"}, {"name": "RAW.VIEW", "layer": "bronze"}])
    present = columns.select("table_name").distinct()
    found = D.inventory(declared, present, "2024-01-30", known, columns)
    return found.where(F.col("type") == "renommage_probable").select("table_name", "observed", "type")


# --- contracts and spellings -------------------------------------------------

REFERENCE_END = "2024-01-10"


@t.shared
def event_contract(spark, d) -> DataFrame:
    """Proposed from the clean days before the ramp, signed as it stands."""
    e = t.events_by_day(spark, d).where(F.col(t.BATCH) < REFERENCE_END)
    clauses, _ = C.propose(P.profile_table(e.select("event_id", "user_id", "event_type", "value"), "RAW.EVENTS", "shop"))
    return clauses.withColumn("status", F.lit("approved")).withColumn("approved_by", F.lit("steward"))


@t.shared
def damaged_profile(spark, d) -> DataFrame:
    """Daily profiles of the ramped events, with clicks renamed on the last days."""
    late = (F.col(t.BATCH) >= "2024-01-28") & (F.col("event_type") == "click")
    e = ramped_events(spark, d).withColumn(
        "event_type", F.when(late, F.lit("CLICK ")).otherwise(F.col("event_type"))
    )
    e = e.select(t.BATCH, "event_id", "user_id", "event_type", "value")
    return P.profile_table(e, "RAW.EVENTS", "shop", t.BATCH)


SQL_DAMAGED = f"""{SQL_RAMPED}, dm AS (
  SELECT * REPLACE (CASE WHEN b >= '2024-01-28' AND event_type = 'click' THEN 'CLICK ' ELSE event_type END AS event_type) FROM ramped),
win AS (SELECT * FROM ev WHERE b < '{REFERENCE_END}'),
bd AS (SELECT min(value) AS lo, max(value) AS hi, min(user_id)::DOUBLE AS ulo, max(user_id)::DOUBLE AS uhi FROM win),
viol AS (
  SELECT b, 'event_type' AS c, 'nulls_interdits' AS type, round((count(*) - count(event_type)) / count(*), 6) AS magnitude,
         CAST(count(*) - count(event_type) AS BIGINT) AS touched, count(*) AS n
  FROM dm GROUP BY b HAVING count(*) > count(event_type)
  UNION ALL
  SELECT b, 'value', 'hors_bornes', greatest(lo - min(value), max(value) - hi) / (hi - lo), 1, count(*)
  FROM dm, bd GROUP BY b, lo, hi HAVING min(value) < lo OR max(value) > hi
  UNION ALL
  SELECT b, 'user_id', 'hors_bornes', greatest(ulo - min(user_id), max(user_id) - uhi) / (uhi - ulo), 1, count(*)
  FROM dm, bd GROUP BY b, ulo, uhi HAVING min(user_id) < ulo OR max(user_id) > uhi
  UNION ALL
  SELECT b, 'event_type', 'valeur_non_admise', CAST(count(DISTINCT event_type) FILTER (WHERE event_type NOT IN (SELECT event_type FROM win)) AS DOUBLE),
         count(*) FILTER (WHERE event_type NOT IN (SELECT event_type FROM win)), count(*)
  FROM dm GROUP BY b HAVING count(*) FILTER (WHERE event_type NOT IN (SELECT event_type FROM win)) > 0)"""


@query("contract_violations_events", f"""
WITH {SQL_DAMAGED} SELECT b AS batch_id, c AS column_name, type, round(magnitude, 6) AS magnitude FROM viol
""")
def contract_violations_events(spark, d):
    found = D.contract_violations(damaged_profile(spark, d), event_contract(spark, d))
    return found.select("batch_id", "column_name", "type", F.round("magnitude", 6).alias("magnitude"))


@query("duplicate_violation", """
WITH r AS (SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_orderstatus AS batch_id, 'doublons' AS type, CAST(count(DISTINCT o_orderkey) AS DOUBLE) AS observed,
       CAST(count(*) AS DOUBLE) AS reference, round((count(*) - count(DISTINCT o_orderkey)) / count(*), 6) AS magnitude
FROM r GROUP BY 1 HAVING count(DISTINCT o_orderkey) < count(*)
""")
def duplicate_violation(spark, d):
    """Urgent orders delivered twice break the unique key of every status."""
    o = t.read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    twice = o.unionByName(o.where(F.col("o_orderpriority") == "1-URGENT")).drop("o_orderpriority")
    facts = P.with_distinct(
        P.column_bounds(twice, ["o_orderkey"], "o_orderstatus"),
        P.frequency_table(twice, ["o_orderkey"], "o_orderstatus"),
    )
    clause = C.propose(P.as_profile(P.classify(P.with_distinct(
        P.column_bounds(o, ["o_orderkey"]), P.frequency_table(o, ["o_orderkey"]))), "RAW.ORDERS"))[0]
    found = D.contract_violations(P.as_profile(facts, "RAW.ORDERS"), clause)
    return found.select(
        "batch_id", "type", F.col("observed_num").alias("observed"),
        F.col("reference_num").alias("reference"), F.round("magnitude", 6).alias("magnitude"),
    )


@query("semantic_family_customers", f"""
WITH {_sql_varied()}, f AS (SELECT c_mktsegment AS v, count(*) AS n FROM varied GROUP BY 1)
SELECT 'c_mktsegment' AS column_name, {t.sql_fold('v')} AS reference, string_agg(v, ' / ' ORDER BY v) AS observed,
       CAST(sum(n) AS DOUBLE) AS magnitude FROM f GROUP BY 2 HAVING count(*) > 1
""")
def semantic_family_customers(spark, d):
    """Spellings among the frequent values of every categorical column."""
    p = P.profile_table(varied_customers(spark, d).select("c_custkey", "c_mktsegment"), "RAW.CUSTOMERS")
    return D.semantic(p).select(
        "column_name", "reference", F.array_join("observed_values", " / ").alias("observed"), "magnitude"
    )


@query("semantic_full_by_source", f"""
WITH f AS (SELECT source, lang || ' ' || source AS v, count(*) AS n FROM documents GROUP BY 1, 2
  UNION ALL SELECT source, upper(lang) || '  ' || source, count(*) FROM documents GROUP BY 1, 2)
SELECT source AS batch_id, {t.sql_fold('v')} AS reference, CAST(sum(n) AS DOUBLE) AS magnitude
FROM f GROUP BY 1, 2 HAVING count(DISTINCT v) > 1
""")
def semantic_full_by_source(spark, d):
    """The same over all values, from the frequency table, per batch."""
    docs = t.read(spark, d, "documents")
    clean = docs.select("source", F.concat_ws(" ", "lang", "source").alias("label"))
    loud = docs.select("source", F.concat_ws("  ", F.upper("lang"), "source").alias("label"))
    both = clean.unionByName(loud)
    freq = P.frequency_table(both, ["label"], "source")
    facts = P.classify(P.with_distinct(P.column_bounds(both, ["label"], "source"), freq))
    return D.semantic_full(freq, facts.withColumn("role", F.lit("categorical")), "RAW.DOCUMENTS").select(
        "batch_id", "reference", "magnitude"
    )
