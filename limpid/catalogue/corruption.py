"""Controlled corruption of the tables, and the checks that should notice."""

from __future__ import annotations

from pyspark.sql import functions as F

from limpid.catalogue import query
from limpid.catalogue import tables as t
from limpid.functions import ranks
from limpid.operators import checks, collisions, corrupt, score
from limpid.plans import gold
from limpid.session import stage

RAMP = [
    {"id": "ramp", "table": "events", "type": "inject_nulls", "from_day": 10,
     "from_date": "2024-01-10", "to_day": 30, "to_date": "2024-01-30",
     "params": {"column": "event_type", "rate_schedule": {10: 0.1, 15: 0.3, 20: 0.4, 25: 0.85}}},
    {"id": "once", "table": "events", "type": "inject_nulls", "day": 5, "date": "2024-01-05",
     "params": {"column": "event_type", "rate": 0.5}},
]
SQL_RATE = (
    "CASE WHEN b >= '2024-01-25' THEN 0.85 WHEN b >= '2024-01-20' THEN 0.4 WHEN b >= '2024-01-15' THEN 0.3 "
    "WHEN b >= '2024-01-10' THEN 0.1 WHEN b = '2024-01-05' THEN 0.5 ELSE 0 END"
)


def sql_sample(source: str, batch: str, key: str, rate: str, seed: str = "42") -> str:
    """``source`` with ``hit``: is the row among the first of its batch by digest?"""
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {batch} ORDER BY md5('{seed}|' || {key})) "
        f"<= round_even(count(*) OVER (PARTITION BY {batch}) * CAST({rate} AS DOUBLE), 0) AS hit FROM {source}"
    )


SQL_RAMPED = (
    f"{t.SQL_EVENTS}, s AS ({sql_sample('ev', 'b', 'event_id', SQL_RATE)}), "
    "ramped AS (SELECT * REPLACE (CASE WHEN NOT hit THEN event_type END AS event_type) FROM s)"
)


@t.shared
def ramped_events(spark, d):
    """Events whose type goes missing on more and more rows."""
    rates = corrupt.spread(spark, RAMP, "2024-01-01").select(F.col("batch_id").alias(t.BATCH), "rate")
    # written, so that its size is known and no day of events is sorted in one task to meet it
    rates = stage(rates, "rates")
    e = t.events_by_day(spark, d)
    inside = e.join(rates, t.BATCH, "left_semi")
    rest = e.join(rates, t.BATCH, "left_anti")
    hit = corrupt.inject_nulls(inside, "event_type", rates, t.BATCH, ["event_id"])
    return rest.unionByName(hit)


@query("inject_nulls_events", f"""
WITH {SQL_RAMPED} SELECT event_id, b AS batch_id, event_type, value FROM ramped
""")
def inject_nulls_events(spark, d):
    return ramped_events(spark, d).select(
        "event_id", F.col(t.BATCH).alias("batch_id"), "event_type", "value"
    )


@query("expected_by_day", f"""
WITH {t.SQL_EVENTS} SELECT b AS batch_id, CASE WHEN b = '2024-01-05' THEN 'once' ELSE 'ramp' END AS anomaly_id,
  CAST({SQL_RATE} AS DOUBLE) AS rate, count(*) AS "rows" FROM ev WHERE {SQL_RATE} > 0 GROUP BY 1
""")
def expected_by_day(spark, d):
    """The declared ramp day by day, with the rows it may touch."""
    expected = corrupt.spread(spark, RAMP, "2024-01-01")
    sizes = t.events_by_day(spark, d).groupBy(F.col(t.BATCH).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return expected.join(sizes, "batch_id").select("batch_id", "anomaly_id", "rate", "rows")


_DUPLICATED = f"""li AS (SELECT *, strftime(l_shipdate, '%Y') AS b FROM lineitem),
s AS ({sql_sample('li', 'b', "l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || CAST(l_shipdate AS VARCHAR)", '0.15')}),
dup AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE hit)"""


@t.shared
def duplicated_lines(spark, d):
    li = t.read(spark, d, "lineitem").withColumn("year", F.date_format("l_shipdate", "yyyy"))
    identity = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    return corrupt.duplicate_rows(li, 0.15, "year", identity)


@query("duplicate_rows_lineitem", f"""
WITH {_DUPLICATED}
SELECT b AS year, count(*) AS "rows", CAST(sum(l_orderkey) AS BIGINT) AS key_sum,
       CAST(sum(l_linenumber * l_partkey) AS BIGINT) AS mix FROM dup GROUP BY 1
""")
def duplicate_rows_lineitem(spark, d):
    return duplicated_lines(spark, d).groupBy("year").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("key_sum"),
        F.sum(F.col("l_linenumber") * F.col("l_partkey")).alias("mix"),
    )


@query("sample_by_rank", f"""
WITH {_DUPLICATED} SELECT b AS year, count(*) AS "rows", CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM s WHERE hit GROUP BY 1
""")
def sample_by_rank(spark, d):
    """An exact sample of every year without ordering a year in one task."""
    li = t.read(spark, d, "lineitem").withColumn("year", F.date_format("l_shipdate", "yyyy"))
    sizes = li.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes.select("year", F.bround(F.col("n") * 0.15, 0).cast("long").alias("_rank"))
    names = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    digest = ranks.sampling_key(42, *[F.col(c) for c in names])
    return ranks.mark_sample(li, ["year"], wanted, digest, "hit").where("hit").groupBy("year").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("key_sum")
    )


@query("duplicated_row_count", f"""
WITH {_DUPLICATED}, g AS (
  SELECT count(*) AS n FROM dup GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicated FROM g
""")
def duplicated_row_count(spark, d):
    return checks.duplicated_rows(duplicated_lines(spark, d).drop("year"))


@query("truncate_rows_events", f"""
WITH {t.SQL_EVENTS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY b ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY b) AS n FROM ev)
SELECT event_id, b AS batch_id FROM r WHERE rn <= round_even(n * CAST(0.3 AS DOUBLE), 0)
""")
def truncate_rows_events(spark, d):
    e = t.events_by_day(spark, d)
    return corrupt.truncate_rows(e, 0.3, t.BATCH, F.col("event_id"), ["event_id"]).select(
        "event_id", F.col(t.BATCH).alias("batch_id")
    )


@query("truncate_rows_with_ties", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity,
    md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || l_extendedprice::VARCHAR)) AS rn,
  count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, count(*) AS "rows", CAST(sum(l_orderkey) AS BIGINT) AS key_sum, max(l_quantity) AS last
FROM r WHERE rn <= round_even(n * CAST(0.3 AS DOUBLE), 0) GROUP BY 1
""")
def truncate_rows_with_ties(spark, d):
    """Thousands of rows share the boundary value: their digests decide.

    Taken without ordering a key in one task, as for keys of any size.
    """
    li = t.read(spark, d, "lineitem")
    sizes = li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes.select("l_returnflag", F.bround(F.col("n") * 0.3, 0).cast("long").alias("_rank"))
    names = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    digest = ranks.sampling_key(42, *[F.col(c) for c in names])
    marked = ranks.mark_first(li, ["l_returnflag"], wanted, F.col("l_quantity"), digest, "hit")
    kept = marked.where("hit")
    return kept.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("key_sum"),
        F.max("l_quantity").alias("last"),
    )


VARIANTS = {"BUILDING": "Building", "MACHINERY": "MACHÍNERY", "HOUSEHOLD": "HOUSE HOLD"}
def _sql_varied(sample: str = "s") -> str:
    return f"""
c AS (SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN 'MACHÍNERY'
        WHEN 'HOUSEHOLD' THEN 'HOUSE HOLD' END AS variant FROM customer),
{sample} AS ({sql_sample("(SELECT * FROM c WHERE variant IS NOT NULL)", 'c_nationkey', 'c_custkey', '0.4')}),
varied AS (SELECT c_custkey, c_nationkey, CASE WHEN hit THEN variant ELSE c_mktsegment END AS c_mktsegment FROM {sample}
  UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment FROM c WHERE variant IS NULL)"""


_VARIED = _sql_varied()


@t.shared
def varied_customers(spark, d):
    return corrupt.semantic_variants(
        t.read(spark, d, "customer"), "c_mktsegment", VARIANTS, 0.4, "c_nationkey", ["c_custkey"]
    )


@query("semantic_variants_customer", f"WITH {_VARIED} SELECT * FROM varied")
def semantic_variants_customer(spark, d):
    return varied_customers(spark, d).select("c_custkey", "c_nationkey", "c_mktsegment")


@query("split_segments", f"""
WITH {_VARIED}, mart AS (SELECT c_mktsegment, count(*) AS n FROM varied GROUP BY 1)
SELECT {t.sql_fold('c_mktsegment')} AS folded, count(*) AS split_rows, max(n) AS largest_part,
       CAST(sum(n) AS BIGINT) AS whole, CAST(sum(n) - max(n) AS BIGINT) AS recovered
FROM mart GROUP BY 1 HAVING count(*) > 1
""")
def split_segments(spark, d):
    """One segment counted as two: what a naive aggregate loses."""
    mart = varied_customers(spark, d).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return gold.split_rows(mart, "c_mktsegment", "n")


@query("variant_rows", f"""
WITH {_VARIED}
SELECT c_mktsegment, count(*) AS n FROM varied
WHERE c_mktsegment IN ('MACHINERY') OR {t.sql_fold('c_mktsegment')} = 'machinery' GROUP BY 1
""")
def variant_rows(spark, d):
    mart = varied_customers(spark, d).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return gold.variant_rows(mart, "c_mktsegment", "MACHINERY", [])


@query("check_not_null", f"WITH {SQL_RAMPED} SELECT event_id, b AS batch_id FROM ramped WHERE event_type IS NULL")
def check_not_null(spark, d):
    return checks.not_null(ramped_events(spark, d), "event_type").select(
        "event_id", F.col(t.BATCH).alias("batch_id")
    )


_SK = "l_orderkey || '-' || l_linenumber"


@query("check_unique", f"""
WITH {_DUPLICATED} SELECT {_SK} AS value, count(*) AS n FROM dup GROUP BY 1 HAVING count(*) > 1
""")
def check_unique(spark, d):
    lines = duplicated_lines(spark, d).withColumn(
        "sk", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    )
    return checks.unique(lines, "sk")


@query("check_accepted_values", f"""
WITH {_VARIED} SELECT c_mktsegment AS value, count(*) AS n FROM varied
WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD') GROUP BY 1
""")
def check_accepted_values(spark, d):
    return checks.accepted_values(
        varied_customers(spark, d), "c_mktsegment",
        ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"],
    )


@query("check_relationships", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
""")
def check_relationships(spark, d):
    """Orders of customers that a filtered parent no longer holds."""
    parent = t.read(spark, d, "customer").where(F.col("c_mktsegment") != "BUILDING")
    return checks.relationships(t.read(spark, d, "orders"), "o_custkey", parent, "c_custkey").select(
        "o_orderkey", "o_custkey"
    )


@query("check_semantic_collisions", f"""
WITH {_VARIED}, c2 AS (SELECT c_mktsegment AS v, count(*) AS n FROM varied GROUP BY 1)
SELECT {t.sql_fold('v')} AS form, count(*) AS spellings, min(v) AS first_spelling, max(v) AS last_spelling,
       CAST(sum(n) AS BIGINT) AS "rows" FROM c2 GROUP BY 1 HAVING count(*) > 1
""")
def check_semantic_collisions(spark, d):
    return checks.no_semantic_collisions(varied_customers(spark, d), "c_mktsegment")


def _checks() -> list[dict]:
    none = {"values": None, "tags": ()}
    return [
        {**none, "table_name": "RAW.EVENTS", "column_name": "event_type", "kind": "not_null"},
        {**none, "table_name": "RAW.EVENTS", "column_name": "event_id", "kind": "not_null"},
        {**none, "table_name": "RAW.EVENTS", "column_name": "event_id", "kind": "unique"},
        {**none, "table_name": "RAW.ORDERS", "column_name": "o_custkey", "kind": "relationships",
         "parent_table": "RAW.CUSTOMERS", "parent_column": "c_custkey"},
        {**none, "table_name": "RAW.CUSTOMERS", "column_name": "c_mktsegment", "kind": "accepted_values",
         "values": ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]},
        {**none, "table_name": "RAW.CUSTOMERS", "column_name": "c_mktsegment",
         "kind": "no_semantic_collisions", "tags": ("generated", "dama:coherence")},
    ]


_RESULTS = f"""
WITH {SQL_RAMPED}, {_sql_varied("s2")},
r AS (
SELECT 'not_null_events_event_type' AS test, 'completude' AS dama, (SELECT count(*) FROM ramped WHERE event_type IS NULL) AS failures
UNION ALL SELECT 'not_null_events_event_id', 'completude', (SELECT count(*) FROM ramped WHERE event_id IS NULL)
UNION ALL SELECT 'unique_events_event_id', 'unicite', (SELECT count(*) FROM (SELECT event_id FROM ramped GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'relationships_orders_o_custkey', 'coherence', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'accepted_values_customers_c_mktsegment', 'validite', (SELECT count(DISTINCT c_mktsegment) FROM varied
   WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD')))
SELECT test, dama, failures, CASE WHEN failures > 0 THEN 'fail' ELSE 'pass' END AS status FROM r
"""


@query("check_results", _RESULTS)
def check_results(spark, d):
    """All checks but the generated ones, as one table of results."""
    frames = {
        "RAW.EVENTS": ramped_events(spark, d), "RAW.ORDERS": t.read(spark, d, "orders"),
        "RAW.CUSTOMERS": varied_customers(spark, d),
    }
    out = checks.run_checks(_checks(), frames.__getitem__, exclude_tags=("generated",))
    return out.select("test", "dama", "failures", "status")


@query("score_detections", f"""
WITH {SQL_RAMPED}, found AS (SELECT DISTINCT b FROM ramped WHERE event_type IS NULL),
expected AS (SELECT DISTINCT b FROM ev WHERE {SQL_RATE} > 0),
o AS (SELECT coalesce(f.b, e.b) AS b, f.b IS NOT NULL AS f, e.b IS NOT NULL AS e FROM found f FULL JOIN expected e ON f.b = e.b)
SELECT count(*) FILTER (WHERE e AND f) AS tp, count(*) FILTER (WHERE f AND NOT e) AS fp,
       count(*) FILTER (WHERE e AND NOT f) AS fn,
       count(*) FILTER (WHERE e AND f) / count(*) FILTER (WHERE f) AS "precision",
       count(*) FILTER (WHERE e AND f) / count(*) FILTER (WHERE e) AS recall FROM o
""")
def score_detections(spark, d):
    expected = corrupt.spread(spark, RAMP, "2024-01-01").select("batch_id", "type")
    found = checks.not_null(ramped_events(spark, d), "event_type").select(
        F.col(t.BATCH).alias("batch_id"), F.lit("inject_nulls").alias("type")
    )
    return score.precision_recall(score.score(expected, found, ["batch_id", "type"]))


@query("score_by_day", f"""
WITH {SQL_RAMPED}, found AS (SELECT DISTINCT b FROM ramped WHERE event_type IS NULL OR value > 300),
expected AS (SELECT DISTINCT b FROM ev WHERE {SQL_RATE} > 0)
SELECT coalesce(f.b, e.b) AS batch_id, CASE WHEN f.b IS NULL THEN 'false_negative' WHEN e.b IS NULL THEN 'false_positive'
  ELSE 'true_positive' END AS outcome FROM found f FULL JOIN expected e ON f.b = e.b
""")
def score_by_day(spark, d):
    """A detector that also cries on large values: its false alarms show."""
    expected = corrupt.spread(spark, RAMP, "2024-01-01").select("batch_id")
    found = ramped_events(spark, d).where(
        F.col("event_type").isNull() | (F.col("value") > 300)
    ).select(F.col(t.BATCH).alias("batch_id"))
    return score.score(expected, found, ["batch_id"])


@query("undamaged_values", f"""
WITH {_VARIED} SELECT v.c_mktsegment AS value, count(*) AS n FROM varied v GROUP BY 1
""")
def undamaged_values(spark, d):
    return collisions.value_counts(varied_customers(spark, d), "c_mktsegment")
