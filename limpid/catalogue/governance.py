"""Contracts, memory of decisions, impact, corrections and their verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from limpid.catalogue import query
from limpid.catalogue import tables as t
from limpid.catalogue.corruption import _sql_varied, varied_customers
from limpid.catalogue.detection import SQL_DAMAGED, damaged_profile, event_contract
from limpid.catalogue.marts import SQL_PAID
from limpid.catalogue.profiles import SQL_ROLES
from limpid.functions import text
from limpid.operators import (
    checks, contracts as C, corrections as K, detect as D, impact, memory as M, profile as P,
)
from limpid.plans import gold, pipeline, silver
from limpid.session import stage

# --- proposing and amending contracts ----------------------------------------


PROFILED = {"RAW.ORDERS": "orders", "RAW.CUSTOMERS": "customer", "RAW.EVENTS": "events"}


@t.shared
def discovery_profiles(spark, d) -> DataFrame:
    """Whole-table profiles; the events get a column that is always empty."""
    out = []
    for name, source in PROFILED.items():
        df = t.read(spark, d, source)
        if source == "events":
            df = df.withColumn("note", F.lit(None).cast("string"))
        out.append(P.profile_table(df, name, "shop"))
    return reduce(DataFrame.unionByName, out)


def _proposed(spark, d) -> tuple[DataFrame, DataFrame]:
    return C.propose(discovery_profiles(spark, d))


def _sql_clauses() -> str:
    def flags(table, source, column, *clauses):
        return [
            f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{c}' AS clause, "
            f"CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, CAST(NULL AS VARCHAR) AS \"values\""
            for c in clauses
        ]

    def number(table, source, column):
        return flags(table, source, column, "not_null") + [
            f"SELECT '{table}', '{column}', 'between', CAST(min({column}) AS DOUBLE), "
            f"CAST(max({column}) AS DOUBLE), NULL FROM {source}"
        ]

    def category(table, source, column):
        return flags(table, source, column, "not_null", "no_semantic_collisions") + [
            f"SELECT '{table}', '{column}', 'accepted_values', NULL, NULL, string_agg(v, ',' ORDER BY v) "
            f"FROM (SELECT DISTINCT {column} AS v FROM {source} WHERE {column} IS NOT NULL)"
        ]

    rows = (
        flags("RAW.ORDERS", "orders", "o_orderkey", "unique", "not_null")
        + number("RAW.ORDERS", "orders", "o_custkey") + category("RAW.ORDERS", "orders", "o_orderstatus")
        + number("RAW.ORDERS", "orders", "o_totalprice") + flags("RAW.ORDERS", "orders", "o_orderdate", "not_null")
        + category("RAW.ORDERS", "orders", "o_orderpriority")
        + flags("RAW.CUSTOMERS", "customer", "c_custkey", "unique", "not_null")
        + flags("RAW.CUSTOMERS", "customer", "c_name", "unique", "not_null")
        + number("RAW.CUSTOMERS", "customer", "c_nationkey") + number("RAW.CUSTOMERS", "customer", "c_acctbal")
        + category("RAW.CUSTOMERS", "customer", "c_mktsegment")
        + flags("RAW.EVENTS", "events", "event_id", "unique", "not_null")
        + flags("RAW.EVENTS", "events", "ts", "not_null") + number("RAW.EVENTS", "events", "user_id")
        + category("RAW.EVENTS", "events", "event_type") + number("RAW.EVENTS", "events", "value")
        + category("RAW.EVENTS", "events", "props")
    )
    return " UNION ALL ".join(rows)


@query("proposed_clauses", _sql_clauses())
def proposed_clauses(spark, d):
    clauses, _ = _proposed(spark, d)
    return clauses.where(F.col("clause") != "role").select(
        "table_name", "column_name", "clause", "lo", "hi", F.array_join("values", ",").alias("values")
    )


@query("contract_overview", f"""
WITH c AS ({_sql_clauses()}), n AS (
  SELECT 'RAW.ORDERS' AS table_name, 6 AS columns, (SELECT count(*) FROM orders) AS reference_rows, 0 AS warnings
  UNION ALL SELECT 'RAW.CUSTOMERS', 5, (SELECT count(*) FROM customer), 0
  UNION ALL SELECT 'RAW.EVENTS', 7, (SELECT count(*) FROM events), 1),
p AS (SELECT table_name, count(*) FILTER (WHERE clause = 'unique') AS keys, count(*) AS clauses FROM c GROUP BY 1),
j AS (SELECT * FROM n JOIN p USING (table_name))
SELECT table_name, CAST(sum(columns) AS BIGINT) AS "columns", CAST(sum(reference_rows) AS BIGINT) AS reference_rows,
       CAST(sum(keys) AS BIGINT) AS "keys", CAST(sum(clauses) AS BIGINT) AS clauses,
       CAST(sum(warnings) AS BIGINT) AS warnings,
       CASE WHEN table_name IS NULL THEN 'total' ELSE 'proposed' END AS status
FROM j GROUP BY ROLLUP (table_name)
UNION ALL SELECT 'RAW.RETURNS', NULL, NULL, NULL, NULL, NULL, 'no contract'
""")
def contract_overview(spark, d):
    """Contracts in numbers with their total; a declared table without one shows."""
    from limpid.sources import catalog

    clauses, warnings = _proposed(spark, d)
    reg = catalog.registry(spark, "shop", [
        {"name": n, "layer": "bronze"} for n in ("RAW.ORDERS", "RAW.CUSTOMERS", "RAW.EVENTS", "RAW.RETURNS")])
    return C.overview(clauses, warnings, reg)


_SQL_ROLES = "SELECT 'RAW.' || CASE table_name WHEN 'customer' THEN 'CUSTOMERS' ELSE upper(table_name) END AS table_name, " \
    "column_name, role FROM (" + SQL_ROLES + ") WHERE table_name IN ('orders', 'customer', 'events') " \
    "UNION ALL SELECT 'RAW.EVENTS', 'note', 'unknown'"


@query("role_composition", f"""
WITH r AS ({_SQL_ROLES}), g AS (
  SELECT table_name, string_agg(column_name, ', ' ORDER BY column_name) AS grain FROM r WHERE role = 'identifier' GROUP BY 1)
SELECT table_name, role, count(*) AS "columns", any_value(grain) AS grain FROM r JOIN g USING (table_name) GROUP BY 1, 2
""")
def role_composition(spark, d):
    clauses, _ = _proposed(spark, d)
    return C.composition(clauses).select("table_name", "role", "columns", "grain")


@query("collision_withholds_list", f"""
WITH {_sql_varied()}
SELECT 'c_mktsegment' AS column_name, 'semantic_collision' AS kind, count(*) AS forms FROM (
  SELECT {t.sql_fold('c_mktsegment')} AS f FROM varied GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1)
""")
def collision_withholds_list(spark, d):
    """Colliding spellings cost a column its closed list and leave a warning."""
    p = P.profile_table(varied_customers(spark, d).select("c_mktsegment"), "RAW.CUSTOMERS")
    clauses, warnings = C.propose(stage(p, "profile"))
    listed = clauses.where(F.col("clause") == "accepted_values").select("column_name")
    return warnings.join(listed, "column_name", "left_anti").select(
        "column_name", "kind", F.regexp_extract("detail", r"^(\d+)", 1).cast("bigint").alias("forms")
    )


@query("amended_clauses", f"""
WITH {SQL_DAMAGED}, w AS (SELECT min(value) AS mn, max(value) AS mx, min(user_id) AS un, max(user_id) AS ux FROM dm)
SELECT 'value' AS column_name, 'between' AS clause, CAST(least(lo, mn) AS DOUBLE) AS lo, CAST(greatest(hi, mx) AS DOUBLE) AS hi,
       CAST(NULL AS VARCHAR) AS "values" FROM bd, w
UNION ALL SELECT 'user_id', 'between', least(ulo, un), greatest(uhi, ux), NULL FROM bd, w
UNION ALL SELECT 'event_type', 'accepted_values', NULL, NULL, string_agg(v, ',' ORDER BY v) FROM (
  SELECT DISTINCT event_type AS v FROM win UNION SELECT DISTINCT event_type FROM dm WHERE event_type IS NOT NULL)
""")
def amended_clauses(spark, d):
    """Bounds widened and the list extended; the null clause of the type is gone."""
    contract = event_contract(spark, d)
    found = stage(D.contract_violations(damaged_profile(spark, d), contract), "anomalies")
    new, _ = C.amend(contract, found, "steward")
    return new.where(F.col("clause").isin("between", "accepted_values") & (F.col("version") == 2)).select(
        "column_name", "clause", "lo", "hi", F.array_join("values", ",").alias("values")
    )


@query("loosened_clauses", f"""
WITH {SQL_DAMAGED}
SELECT c AS column_name, CASE type WHEN 'nulls_interdits' THEN 'not_null' WHEN 'hors_bornes' THEN 'between'
  ELSE 'accepted_values' END AS clause, type = 'nulls_interdits' AS dropped FROM viol GROUP BY 1, 2, 3
""")
def loosened_clauses(spark, d):
    contract = event_contract(spark, d)
    found = stage(D.contract_violations(damaged_profile(spark, d), contract), "anomalies")
    _, diff = C.amend(contract, found, "steward")
    return diff.select("column_name", "clause", "dropped")


@query("contract_in_force", """
SELECT c_mktsegment AS table_name, CAST(max(c_nationkey) AS INTEGER) AS version FROM customer
WHERE c_acctbal > 0 GROUP BY 1
""")
def contract_in_force(spark, d):
    """Latest approved version per key; newer unapproved ones do not count."""
    versions = t.read(spark, d, "customer").select(
        F.lit("shop").alias("dataset"), F.col("c_mktsegment").alias("table_name"),
        F.col("c_nationkey").alias("version"),
        F.when(F.col("c_acctbal") > 0, "approved").otherwise("proposed").alias("status"),
    )
    return C.in_force(versions).select("table_name", "version").distinct()


@query("generated_rules", f"""
WITH {SQL_DAMAGED}
SELECT c AS column_name, CASE type WHEN 'nulls_interdits' THEN 'not_null' ELSE 'accepted_values' END AS kind,
       CASE type WHEN 'nulls_interdits' THEN 'completude' ELSE 'validite' END AS dama,
       CASE WHEN type = 'valeur_non_admise' THEN (SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM win) END AS "values",
       min(b) AS first_batch
FROM viol WHERE type <> 'hors_bornes' GROUP BY 1, 2, 3, 4
""")
def generated_rules(spark, d):
    """Checks that would have caught the anomalies; lists come from the contract."""
    found = D.contract_violations(damaged_profile(spark, d), event_contract(spark, d))
    rules = checks.rules_from_anomalies(found)
    return rules.groupBy("column_name", "kind", "dama", F.array_join("values", ",").alias("values")).agg(
        F.min(F.element_at(F.split("origin", " batch "), -1)).alias("first_batch")
    )


# --- signatures and decisions ------------------------------------------------


@t.shared
def signed_anomalies(spark, d) -> DataFrame:
    found = D.contract_violations(damaged_profile(spark, d), event_contract(spark, d))
    return D.with_signature(found)


SQL_SIGNED = f"""{SQL_DAMAGED}, sg AS (SELECT *, 'RAW.EVENTS|' || c || '|' || type || '|' ||
  CASE WHEN abs(magnitude) < 1e-9 THEN '0' ELSE CAST(CAST(floor(log2(abs(magnitude))) AS BIGINT) AS VARCHAR) END AS signature FROM viol)"""

# decided on the first days; later days stay open
SQL_DECISION = (
    "CASE WHEN b < '2024-01-12' THEN 'rejected' WHEN b < '2024-01-17' THEN 'approved' "
    "WHEN b < '2024-01-18' THEN 'amend_contract' END"
)


def _decision(batch: str = "batch_id"):
    b = F.col(batch)
    return (
        F.when(b < "2024-01-12", "rejected").when(b < "2024-01-17", "approved")
        .when(b < "2024-01-18", "amend_contract")
    )


def event_runs(spark, d) -> DataFrame:
    return t.events_by_day(spark, d).groupBy(F.col(t.BATCH).alias("batch_id")).agg(
        F.max("ts").alias("run_ts")
    ).select(
        F.lit("shop").alias("dataset"), F.lit("bronze").alias("layer"),
        F.lit("RAW.EVENTS").alias("table_name"), "batch_id", "run_ts",
    )


def decisions(spark, d) -> DataFrame:
    runs = event_runs(spark, d).withColumn("human_decision", _decision())
    decided = runs.where(F.col("human_decision").isNotNull())
    return decided.select(
        "table_name", "batch_id", "human_decision", F.lit("steward").alias("decided_by"),
        (F.col("run_ts") + F.expr("interval 1 hour")).alias("decided_at"),
        F.when(F.col("human_decision") == "approved", "isoler").alias("applied_fix"),
        F.lit(None).cast("string").alias("validation_status"),
    )


def incidents(spark, d, anomalies: DataFrame) -> DataFrame:
    return stage(M.run_incidents(event_runs(spark, d), anomalies, decisions(spark, d)), "incidents")


@query("anomaly_signatures", f"WITH {SQL_SIGNED} SELECT b AS batch_id, signature FROM sg")
def anomaly_signatures(spark, d):
    return signed_anomalies(spark, d).select("batch_id", "signature")


@query("value_octaves", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 1e-9 THEN '0'
  ELSE CAST(CAST(floor(log2(l_discount)) AS BIGINT) AS VARCHAR) END AS octave FROM lineitem
""")
def value_octaves(spark, d):
    return t.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", text.octave(F.col("l_discount")).alias("octave")
    )


@query("silence_split", f"""
WITH {SQL_SIGNED} SELECT b AS batch_id, signature,
  signature IN (SELECT signature FROM sg WHERE b < '2024-01-12') AS silenced FROM sg
""")
def silence_split(spark, d):
    """What a rejection silences, and what speaks again in another octave."""
    a = signed_anomalies(spark, d)
    return M.flag_silenced(a, incidents(spark, d, a)).select("batch_id", "signature", "silenced")


@query("silenced_and_kept", f"""
WITH {SQL_SIGNED} SELECT 'silenced' AS side, count(*) AS n FROM sg WHERE signature IN (SELECT signature FROM sg WHERE b < '2024-01-12')
UNION ALL SELECT 'kept', count(*) FROM sg WHERE signature NOT IN (SELECT signature FROM sg WHERE b < '2024-01-12')
""")
def silenced_and_kept(spark, d):
    a = signed_anomalies(spark, d)
    kept, silenced = M.split_silenced(a, incidents(spark, d, a))
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count(kept, "kept").unionByName(count(silenced, "silenced"))


@query("similar_incidents", f"""
WITH {SQL_SIGNED} SELECT DISTINCT b AS batch_id FROM sg WHERE b < '2024-01-18'
  AND signature IN (SELECT signature FROM sg WHERE b >= '2024-01-25')
""")
def similar_incidents(spark, d):
    """Decided runs that share a signature with the anomalies of the last days."""
    a = signed_anomalies(spark, d)
    past = incidents(spark, d, a).where(F.col("human_decision").isNotNull())
    return M.similar_incidents(past, a.where(F.col("batch_id") >= "2024-01-25")).select("batch_id")


@query("silences", f"""
WITH {SQL_SIGNED} SELECT signature, c AS column_name, type, split_part(signature, '|', 4) AS octave,
  'steward' AS decided_by, b AS batch_id FROM sg WHERE b < '2024-01-12'
""")
def silences(spark, d):
    a = signed_anomalies(spark, d)
    return M.silences(incidents(spark, d, a), "RAW.EVENTS").select(
        "signature", "column_name", "type", "octave", "decided_by", "batch_id"
    )


_SQL_RUNS = f"""{SQL_SIGNED}, runs AS (SELECT e.b, coalesce(a.n, 0) AS n, {SQL_DECISION.replace('b <', 'e.b <')} AS decision
  FROM (SELECT DISTINCT b FROM ev) e LEFT JOIN (SELECT b, count(*) AS n FROM sg GROUP BY 1) a ON a.b = e.b)"""
_SQL_STATUS = "CASE WHEN decision IS NOT NULL THEN decision WHEN n = 0 THEN 'rien d''anormal' ELSE 'en attente' END"


@query("journal_lines", f"""
WITH {_SQL_RUNS} SELECT b AS batch_id, CAST(n AS INTEGER) AS anomalies, {_SQL_STATUS} AS status,
  coalesce(decision, '') = 'approved' AS applied FROM runs
""")
def journal_lines(spark, d):
    """One line per run, also for runs that found nothing."""
    lines = M.journal_lines(incidents(spark, d, signed_anomalies(spark, d)))
    return lines.select("batch_id", "anomalies", "status", "applied")


@query("journal_status_counts", f"""
WITH {_SQL_RUNS} SELECT {_SQL_STATUS} AS status, count(*) AS runs FROM runs GROUP BY 1
""")
def journal_status_counts(spark, d):
    return M.status_counts(incidents(spark, d, signed_anomalies(spark, d)))


@query("memory_view", f"""
WITH {_SQL_RUNS} SELECT b AS batch_id, decision AS human_decision FROM runs WHERE decision IS NOT NULL ORDER BY b DESC LIMIT 5
""")
def memory_view(spark, d):
    """The five newest decided runs."""
    from limpid.sources import history

    found = incidents(spark, d, signed_anomalies(spark, d))
    return history.decided_incidents(found, "shop", "RAW.EVENTS", 5).select("batch_id", "human_decision")


@query("journal_since", f"""
WITH {_SQL_RUNS} SELECT b AS batch_id, CAST(n AS INTEGER) AS anomalies FROM runs WHERE b >= '2024-01-20'
""")
def journal_since(spark, d):
    from limpid.sources import history

    found = incidents(spark, d, signed_anomalies(spark, d))
    rows = history.journal(found, "shop", layer="bronze", since="2024-01-20")
    return rows.select("batch_id", M.anomaly_count().alias("anomalies"))


@query("incident_summaries", f"""
WITH {_SQL_RUNS} SELECT 'RAW.EVENTS' AS table_name, b AS batch_id, decision AS human_decision FROM runs ORDER BY b DESC LIMIT 3
""")
def incident_summaries(spark, d):
    found = incidents(spark, d, signed_anomalies(spark, d))
    return M.summaries(found).select("table_name", "batch_id", "human_decision")


@query("pending_proposals", f"""
WITH {_SQL_RUNS} SELECT b AS batch_id, n AS anomalies FROM runs WHERE n > 0 AND decision IS NULL
""")
def pending_proposals(spark, d):
    p = damaged_profile(spark, d)
    a = D.with_signature(D.contract_violations(p, event_contract(spark, d)))
    waiting = pipeline.proposals(stage(a, "anomalies"), p)
    return M.pending(waiting, decisions(spark, d)).select("batch_id", "anomalies")


@query("system_overview", f"""
WITH {_SQL_RUNS}
SELECT CAST(3 AS BIGINT) AS tables, CAST(1 AS BIGINT) AS contracts_in_force, CAST(0 AS BIGINT) AS contracts_to_sign,
       count(*) FILTER (WHERE n > 0 AND decision IS NULL) AS decisions_pending, count(*) AS runs,
       count(*) FILTER (WHERE n > 0) AS runs_with_anomalies,
       count(*) FILTER (WHERE n > 0 AND decision IS NULL) AS to_do FROM runs
""")
def system_overview(spark, d):
    from limpid.sources import catalog

    reg = catalog.registry(spark, "shop", [
        {"name": n, "layer": "bronze"} for n in ("RAW.ORDERS", "RAW.CUSTOMERS", "RAW.EVENTS")])
    p = damaged_profile(spark, d)
    contract = event_contract(spark, d)
    a = stage(D.with_signature(D.contract_violations(p, contract)), "anomalies")
    waiting = a.select("table_name", "batch_id").distinct()
    return M.overview(reg, contract, waiting, decisions(spark, d), incidents(spark, d, a))


@query("run_evidence", f"""
WITH {SQL_SIGNED}, past AS (
  SELECT x.b, y.b AS p, {SQL_DECISION.replace("b <", "y.b <")} AS decision FROM (SELECT DISTINCT b, signature FROM sg) x
  JOIN (SELECT DISTINCT b, signature FROM sg) y ON x.signature = y.signature AND y.b < x.b),
near AS (SELECT DISTINCT b, p, decision FROM past WHERE decision IS NOT NULL),
three AS (SELECT b, string_agg(p || ':' || decision || ':steward', ',' ORDER BY p DESC) AS told FROM (
  SELECT *, row_number() OVER (PARTITION BY b ORDER BY p DESC) AS r FROM near) WHERE r <= 3 GROUP BY b)
SELECT sg.b AS batch_id, max(n) AS row_count, CAST(5 AS BIGINT) AS "columns", '_batch_id,event_id,event_type,user_id,value' AS column_names,
  string_agg(signature, ',' ORDER BY signature) AS anomalies, CAST(1 AS INTEGER) AS contract_version, any_value(told) AS past_decisions
FROM sg LEFT JOIN three ON three.b = sg.b GROUP BY 1
""")
def run_evidence(spark, d):
    """All that a reader of a run gets, with the newest decisions about the same signatures."""
    found = signed_anomalies(spark, d)
    told = M.evidence(found, damaged_profile(spark, d), event_contract(spark, d), incidents=incidents(spark, d, found))
    return told.select(
        "batch_id", "row_count", "columns", F.array_join("column_names", ",").alias("column_names"),
        F.array_join(F.transform("anomalies", lambda a: a["signature"]), ",").alias("anomalies"), "contract_version",
        F.array_join(F.transform("similar", lambda s: F.concat_ws(":", s["batch_id"], s["human_decision"], s["decided_by"])), ",").alias("past_decisions"))


# --- impact ------------------------------------------------------------------


@query("impact_per_anomaly", f"""
WITH {SQL_DAMAGED} SELECT b AS batch_id, c AS column_name, type, touched AS "rows",
  CASE type WHEN 'hors_bornes' THEN 'minimum' ELSE 'exact' END AS certainty, touched / n AS share FROM viol
""")
def impact_per_anomaly(spark, d):
    p = damaged_profile(spark, d)
    a = D.contract_violations(p, event_contract(spark, d))
    return impact.per_anomaly(a, p).select(
        "batch_id", "column_name", "type", "rows", "certainty", "share"
    )


@query("impact_widest", f"""
WITH {SQL_DAMAGED} SELECT b AS batch_id, count(*) AS anomalies, max(touched) AS "rows", max(n) AS row_count FROM viol GROUP BY 1
""")
def impact_widest(spark, d):
    """Per run the widest anomaly; rows of several anomalies are never added up."""
    p = damaged_profile(spark, d)
    a = D.contract_violations(p, event_contract(spark, d))
    return impact.headline(impact.per_anomaly(a, p)).select("batch_id", "anomalies", "rows", "row_count")


@query("downstream_effect", f"""
WITH {SQL_PAID}, {_sql_varied()},
base AS (SELECT v.c_mktsegment AS segment, count(DISTINCT o_orderkey) AS n_orders, sum(amount) AS revenue
  FROM orders JOIN varied v ON o_custkey = v.c_custkey LEFT JOIN paid ON o_orderkey = k GROUP BY 1),
good AS (SELECT u.c_mktsegment AS segment, count(DISTINCT o_orderkey) AS n_orders, sum(amount) AS revenue
  FROM orders JOIN customer u ON o_custkey = u.c_custkey LEFT JOIN paid ON o_orderkey = k GROUP BY 1)
SELECT coalesce(b.segment, g.segment) AS segment, b.n_orders AS n_orders_before, g.n_orders AS n_orders_after,
       CAST(b.revenue AS DOUBLE) AS revenue_before, CAST(g.revenue AS DOUBLE) AS revenue_after
FROM base b FULL JOIN good g ON b.segment = g.segment
WHERE b.n_orders IS DISTINCT FROM g.n_orders OR b.revenue IS DISTINCT FROM g.revenue
""")
def downstream_effect(spark, d):
    """What undoing the variants moves in the sales mart."""
    orders = silver.orders(t.raw_orders(spark, d))
    payments = silver.order_payments(t.raw_payments(spark, d))

    def mart(customers: DataFrame) -> DataFrame:
        shaped = customers.select(
            F.col("c_custkey").cast("string").alias("customer_id"),
            F.col("c_mktsegment").alias("customer_city"), F.lit("XX").alias("customer_state"),
        )
        m = gold.sales_by_city_state(orders, shaped, payments)
        return m.select(F.col("customer_city").alias("segment"), "n_orders", F.col("revenue").cast("double").alias("revenue"))

    before, after = mart(varied_customers(spark, d)), mart(t.read(spark, d, "customer"))
    return impact.downstream(before, after, ["segment"], ["n_orders", "revenue"])


# --- corrections -------------------------------------------------------------

_OUTSIDE = "l_quantity > 45"


@query("isolated_lines", f"""
SELECT l_returnflag, count(*) AS "rows", count(*) FILTER (WHERE {_OUTSIDE}) AS quarantined,
  CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM lineitem GROUP BY 1
""")
def isolated_lines(spark, d):
    """Rows beyond a bound are flagged; no value changes."""
    flagged = K.isolate(t.read(spark, d, "lineitem"), F.col("l_quantity") > 45)
    return flagged.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(K.FLAG).alias("quarantined"),
        F.sum("l_orderkey").alias("key_sum"),
    )


@query("excluded_from_mart", """
SELECT l_returnflag, count(*) AS "rows", CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue
FROM lineitem WHERE l_quantity <= 45 GROUP BY 1
""")
def excluded_from_mart(spark, d):
    kept = K.exclude(t.read(spark, d, "lineitem"), F.col("l_quantity") > 45)
    return kept.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double").alias("revenue"),
    )


@query("nullified_values", """
SELECT event_id, CASE WHEN value > 200 THEN NULL ELSE value END AS value FROM events
""")
def nullified_values(spark, d):
    return K.nullify(t.read(spark, d, "events"), "value", F.col("value") > 200).select("event_id", "value")


@query("normalised_segments", f"""
WITH {_sql_varied()}, f AS (SELECT c_mktsegment AS v, count(*) AS n, {t.sql_fold('c_mktsegment')} AS form FROM varied GROUP BY 1, 3),
r AS (SELECT v, first_value(v) OVER (PARTITION BY form ORDER BY n DESC, v) AS canonical FROM f)
SELECT c_custkey, canonical AS c_mktsegment FROM varied JOIN r ON c_mktsegment = v
""")
def normalised_segments(spark, d):
    """Variants go to the most frequent spelling the column already holds."""
    return K.normalise(varied_customers(spark, d), "c_mktsegment").select("c_custkey", "c_mktsegment")


@query("correction_counts", f"""
WITH {_sql_varied()}, f AS (SELECT c_mktsegment AS v, count(*) AS n, {t.sql_fold('c_mktsegment')} AS form FROM varied GROUP BY 1, 3),
r AS (SELECT v, first_value(v) OVER (PARTITION BY form ORDER BY n DESC, v) AS canonical FROM f),
j AS (SELECT * FROM varied JOIN r ON c_mktsegment = v)
SELECT c_nationkey, count(*) AS rows_before, count(*) AS rows_after, count(*) FILTER (WHERE v <> canonical) AS affected
FROM j GROUP BY 1
""")
def correction_counts(spark, d):
    before = varied_customers(spark, d)
    after = K.normalise(before, "c_mktsegment")
    return K.change_counts(before, after, "c_nationkey", "c_mktsegment")


@query("unobserved_targets", """
SELECT DISTINCT upper(lang) AS value FROM documents WHERE upper(lang) NOT IN (SELECT lang FROM documents)
""")
def unobserved_targets(spark, d):
    """Targets a correction may not write: the column never held them."""
    docs = t.read(spark, d, "documents")
    mapping = docs.select(F.col("lang").alias("value"), F.upper("lang").alias("canonical")).distinct()
    return K.unobserved_targets(docs, "lang", mapping)


@query("refused_corrections", """
WITH v AS (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)
SELECT upper(event_type) AS target, 'normaliser' AS gesture, 'the value was never observed in the column' AS reason FROM v
UNION ALL SELECT event_type, 'remplacer', 'not one of the permitted gestures' FROM v
UNION ALL SELECT event_type, 'mettre_a_null', 'a correction acts on rows; a column is transformed in its model' FROM v
""")
def refused_corrections(spark, d):
    """Per event type one correction of every kind that is refused, beside honest ones and one by a person."""
    found = signed_anomalies(spark, d)
    values = t.read(spark, d, "events").select("event_type").where(F.col("event_type").isNotNull()).distinct()
    honest = values.select(
        F.lit("RAW.EVENTS").alias("table_name"), F.lit("event_type").alias("column_name"),
        F.lit("normaliser").alias("gesture"), F.col("event_type").alias("target"),
        F.lit(False).alias("whole_column"), F.lit(False).alias("by_person"),
    )
    invented = honest.withColumn("target", F.upper("target"))
    wanted = honest
    for more in (
        invented, invented.withColumn("by_person", F.lit(True)), honest.withColumn("gesture", F.lit("remplacer")),
        honest.withColumn("gesture", F.lit("mettre_a_null")), honest.withColumn("gesture", F.lit("mettre_a_null")).withColumn("whole_column", F.lit(True)),
        # a column that no anomaly names is marked, not written
        invented.withColumn("column_name", F.lit("props")),
    ):
        wanted = wanted.unionByName(more)
    observed = honest.select("table_name", "column_name", F.col("target").alias("value"))
    return K.refusals(wanted, found, observed).select("target", "gesture", "reason")


@query("default_gestures", f"""
WITH {SQL_DAMAGED} SELECT DISTINCT type, CASE type WHEN 'hors_bornes' THEN 'isoler,exclure_de_l_agregat' ELSE 'isoler' END AS gestures FROM viol
""")
def default_gestures(spark, d):
    found = D.contract_violations(damaged_profile(spark, d), event_contract(spark, d))
    return K.default_corrections(found).select("type", F.array_join("gestures", ",").alias("gestures")).distinct()


@query("routed_runs", f"""
WITH {_SQL_RUNS} SELECT b AS batch_id, CASE decision WHEN 'approved' THEN 'apply' WHEN 'amend_contract' THEN 'amend' ELSE 'log' END AS next FROM runs
""")
def routed_runs(spark, d):
    return event_runs(spark, d).select("batch_id", K.route(_decision()).alias("next"))


@query("approved_proposals", f"""
WITH {SQL_SIGNED} SELECT DISTINCT b AS batch_id FROM sg WHERE b >= '2024-01-12' AND b < '2024-01-17'
""")
def approved_proposals(spark, d):
    """The only rows an application of corrections may read."""
    waiting = signed_anomalies(spark, d).select("table_name", "batch_id").distinct()
    return K.approved_only(waiting, decisions(spark, d)).select("batch_id")


@query("verified_corrections", f"""
WITH {SQL_SIGNED}, after AS (SELECT * FROM sg WHERE type <> 'valeur_non_admise')
SELECT sg.b AS batch_id, count(DISTINCT sg.signature) AS anomalies, count(DISTINCT a.signature) AS remaining,
  CASE WHEN count(DISTINCT a.signature) = 0 THEN 'success' ELSE 'failed_manual_review' END AS validation_status
FROM sg LEFT JOIN after a ON sg.b = a.b AND sg.signature = a.signature GROUP BY 1
""")
def verified_corrections(spark, d):
    """The renamed clicks are put right; the missing types are still missing."""
    from limpid.catalogue.corruption import ramped_events

    contract = event_contract(spark, d)
    before = D.with_signature(D.contract_violations(damaged_profile(spark, d), contract))
    late = (F.col(t.BATCH) >= "2024-01-28") & (F.col("event_type") == "click")
    damaged = ramped_events(spark, d).withColumn(
        "event_type", F.when(late, F.lit("CLICK ")).otherwise(F.col("event_type"))
    ).select(t.BATCH, "event_id", "user_id", "event_type", "value")
    fixed = K.normalise(damaged, "event_type")
    again = P.profile_table(fixed, "RAW.EVENTS", "shop", t.BATCH)
    after = D.with_signature(D.contract_violations(again, contract))
    return K.verify(before, after).select("batch_id", "anomalies", "remaining", "validation_status")


def _corrected_table(spark, d):
    """The damaged events as a raw table, corrected as approved and read back."""
    from limpid import schemas
    from limpid.catalogue.corruption import ramped_events
    from limpid.session import scratch_path
    from limpid.sources.batches import read_batches, write_batches

    path = scratch_path(spark, "bronze")
    e = ramped_events(spark, d).select(t.BATCH, "event_id", "user_id", "event_type", "value")
    write_batches(e, path)
    found = signed_anomalies(spark, d)
    days = found.where(F.col("type") == "nulls_interdits").select("table_name", "batch_id").distinct()
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.CORRECTION.fields}

    def planned(**given):
        return days.select(*[
            given[f.name].cast(f.dataType).alias(f.name) if f.name in given
            else F.col(f.name) if f.name in ("table_name", "batch_id") else none[f.name]
            for f in schemas.CORRECTION.fields
        ])

    gestures = planned(
        column_name=F.lit("event_type"), gesture=F.lit("isoler"), match=F.lit("null")
    ).unionByName(planned(
        column_name=F.lit("value"), gesture=F.lit("mettre_a_null"), match=F.lit("outside"),
        lo=F.lit(0.0), hi=F.lit(100.0),
    ))
    report = pipeline.apply_corrections(
        spark, path, "RAW.EVENTS", t.BATCH, gestures, decisions(spark, d), found
    )
    return report, read_batches(spark, path)


_APPROVED = "b >= '2024-01-12' AND b < '2024-01-17'"


@query("applied_corrections", f"""
WITH {SQL_DAMAGED}
SELECT b AS batch_id, count(*) AS rows_before, count(*) AS rows_after,
       CAST(count(*) FILTER (WHERE value > 100) AS BIGINT) AS changed,
       count(*) FILTER (WHERE event_type IS NULL) AS quarantined
FROM ramped WHERE {_APPROVED} GROUP BY 1
""")
def applied_corrections(spark, d):
    """Counts of what the approved corrections did; other days are not read."""
    report, _ = _corrected_table(spark, d)
    return report


@query("corrected_events", f"""
WITH {SQL_DAMAGED}
SELECT event_id, event_type, CASE WHEN {_APPROVED} AND value > 100 THEN NULL ELSE value END AS value,
       CASE WHEN {_APPROVED} THEN event_type IS NULL END AS quarantined FROM ramped
""")
def corrected_events(spark, d):
    """The raw table afterwards: approved days corrected, all others as they were."""
    _, table = _corrected_table(spark, d)
    return table.select("event_id", "event_type", "value", F.col(K.FLAG).alias("quarantined"))
