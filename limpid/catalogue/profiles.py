"""Profiles, frequent values, robust statistics, roles, freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from limpid.catalogue import query
from limpid.catalogue import tables as t
from limpid.functions import ranks, text
from limpid.operators import detect, inclusion, profile as P
from limpid.session import stage

TABLES = {
    "orders": ["o_orderkey:n", "o_custkey:n", "o_orderstatus:t", "o_totalprice:n", "o_orderdate:d",
               "o_orderpriority:t"],
    "lineitem": ["l_orderkey:n", "l_partkey:n", "l_suppkey:n", "l_linenumber:n", "l_quantity:n",
                 "l_extendedprice:n", "l_discount:n", "l_tax:n", "l_returnflag:t", "l_linestatus:t",
                 "l_shipdate:d"],
    "customer": ["c_custkey:n", "c_name:t", "c_nationkey:n", "c_acctbal:n", "c_mktsegment:t"],
    "part": ["p_partkey:n", "p_name:t", "p_brand:t", "p_type:t", "p_size:n", "p_retailprice:n"],
    "supplier": ["s_suppkey:n", "s_name:t", "s_nationkey:n", "s_acctbal:n"],
    "nation": ["n_nationkey:n", "n_name:t", "n_regionkey:n"],
    "events": ["event_id:n", "ts:d", "user_id:n", "event_type:t", "value:n", "props:t"],
    "documents": ["doc_id:n", "text:t", "lang:t", "source:t", "n_chars:n"],
}


def _sql_facts(table: str, batch: str = "'*'", source: str | None = None) -> str:
    """One row per column and batch: counts, distinct, native bounds."""
    parts = []
    for spec in TABLES[table]:
        c, kind = spec.split(":")
        number = kind == "n"
        as_text = f"min(CAST({c} AS VARCHAR))" if kind == "t" else f"CAST(min({c}) AS VARCHAR)"
        as_text_hi = f"max(CAST({c} AS VARCHAR))" if kind == "t" else f"CAST(max({c}) AS VARCHAR)"
        parts.append(
            f"SELECT '{table}' AS table_name, {batch} AS batch_id, '{c}' AS column_name, '{kind}' AS kind, "
            f"count(*) AS row_count, count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) / count(*), 6) AS null_rate, "
            f"count(DISTINCT {c}) AS distinct_values, "
            + (f"CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text, "
               f"CAST(min({c}) AS DOUBLE) AS min_number, CAST(max({c}) AS DOUBLE) AS max_number "
               if number else
               f"{as_text} AS min_text, {as_text_hi} AS max_text, "
               f"CAST(NULL AS DOUBLE) AS min_number, CAST(NULL AS DOUBLE) AS max_number ")
            + f"FROM {source or table} GROUP BY {batch}"
        )
    return " UNION ALL ".join(parts)


def _facts(df: DataFrame, table: str, batch_column: str | None = None) -> DataFrame:
    columns = [c.split(":")[0] for c in TABLES[table]]
    return P.measured(df, columns, batch_column).withColumn("table_name", F.lit(table))


def _shown(facts: DataFrame) -> DataFrame:
    number = F.col("type_class") == "number"
    return facts.select(
        "table_name", "batch_id", "column_name", "row_count", "null_count", "null_rate",
        F.col("distinct").alias("distinct_values"),
        F.when(~number, F.col("min")).alias("min_text"), F.when(~number, F.col("max")).alias("max_text"),
        "min_number", "max_number",
    )


_SHOWN = (
    "SELECT table_name, batch_id, column_name, row_count, null_count, null_rate, distinct_values, "
    "min_text, max_text, min_number, max_number FROM ({})"
)


def _register_profile(table: str) -> None:
    @query(f"profile_{table}", _SHOWN.format(_sql_facts(table)))
    def run(spark, d):
        return _shown(_facts(t.read(spark, d, table), table))


for _name in TABLES:
    _register_profile(_name)


@query("profile_events_by_batch", "WITH " + t.SQL_EVENTS + " " + _SHOWN.format(
    _sql_facts("events", "b", "ev")))
def profile_events_by_batch(spark, d):
    return _shown(_facts(t.events_by_day(spark, d), "events", t.BATCH))


@query("profile_raw_orders", """
WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id FROM orders)
SELECT 'order_id' AS column_name, count(*) AS row_count, count(DISTINCT order_id) AS distinct_values,
       min(order_id) AS min_text, max(order_id) AS max_text FROM r
UNION ALL
SELECT 'customer_id', count(*), count(DISTINCT customer_id), min(customer_id), max(customer_id) FROM r
""")
def profile_raw_orders(spark, d):
    """Bounds of text columns are lexicographic: "999" is above "1499"."""
    raw = t.raw_orders(spark, d).select("order_id", "customer_id")
    facts = P.with_distinct(P.column_bounds(raw), P.frequency_table(raw))
    return facts.select(
        "column_name", "row_count", F.col("distinct").alias("distinct_values"),
        F.col("min").alias("min_text"), F.col("max").alias("max_text"),
    )


@query("topk_event_type_by_day", f"""
WITH {t.SQL_EVENTS}, f AS (SELECT b, event_type, count(*) AS n FROM ev WHERE event_type IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, event_type) AS rank,
             sum(n) OVER (PARTITION BY b) AS total FROM f)
SELECT b AS batch_id, string_agg(event_type || ':' || n, ',' ORDER BY rank) AS top,
       CAST(max(total) AS BIGINT) AS non_null_count, round(sum(n) / max(total), 6) AS coverage
FROM r WHERE rank <= 3 GROUP BY 1
""")
def topk_event_type_by_day(spark, d):
    top = P.top_values(t.events_by_day(spark, d), "EVENT_TYPE", 3, t.BATCH)
    listed = F.transform("top", lambda e: F.concat(e["value"], F.lit(":"), e["count"].cast("string")))
    return top.select(
        "batch_id", F.array_join(listed, ",").alias("top"), "non_null_count", "coverage"
    )


def _sql_top(table: str, column: str) -> str:
    return f"""
SELECT * FROM (
SELECT '{table}' AS table_name, '{column}' AS column_name, value, n AS "count",
       CAST(rank AS INTEGER) AS rank, CAST(k AS INTEGER) AS k, round(covered / total, 6) AS coverage FROM (
  SELECT *, sum(CASE WHEN rank <= k THEN n END) OVER () AS covered FROM (
    SELECT *, CASE WHEN d BETWEEN 1 AND 100 THEN d ELSE 20 END AS k FROM (
      SELECT CAST({column} AS VARCHAR) AS value, count(*) AS n,
             row_number() OVER (ORDER BY count(*) DESC, CAST({column} AS VARCHAR)) AS rank,
             sum(count(*)) OVER () AS total, count(*) OVER () AS d
      FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}))) WHERE rank <= k)"""


@query("topk_adaptive", " UNION ALL ".join(_sql_top(*x) for x in (
    ("events", "event_type"), ("events", "props"), ("orders", "o_orderpriority"),
    ("orders", "o_orderstatus"), ("customer", "c_mktsegment"), ("documents", "lang"),
    ("documents", "source"))))
def topk_adaptive(spark, d):
    """Every value of an enumerable column, the head of a long one; one frequency table for all tables."""
    keys = ["table_name", "batch_id", "column_name"]
    freq = stage(reduce(DataFrame.unionByName, [
        P.frequency_table(t.read(spark, d, table), columns).withColumn("table_name", F.lit(table))
        for table, columns in {
            "events": ["event_type", "props"], "orders": ["o_orderpriority", "o_orderstatus"],
            "customer": ["c_mktsegment"], "documents": ["lang", "source"],
        }.items()]), "frequency")
    sizes = freq.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total")
    ).withColumn("k", P.adaptive_k(F.col("distinct")).cast("int"))
    kept = P.ranked_values(freq, keys, 100).join(sizes, keys).where(F.col("rank") <= F.col("k"))
    covered = F.sum("n").over(Window.partitionBy(*keys))
    return kept.select(
        "table_name", "column_name", "value", F.col("n").alias("count"), "rank", "k",
        text.rate(covered, F.col("total")).alias("coverage"))


def _sql_robust(table: str, column: str, batch: str = "'*'", source: str | None = None) -> str:
    src = source or table
    return f"""
SELECT {batch} AS batch_id, '{column}' AS column_name, count({column}) AS non_null_count,
       count({column}) AS numeric_count, CAST(1.0 AS DOUBLE) AS numeric_rate,
       round(median(CAST({column} AS DOUBLE)), 6) AS median, round(mad(CAST({column} AS DOUBLE)), 6) AS mad,
       CAST(min({column}) AS DOUBLE) AS numeric_min, CAST(max({column}) AS DOUBLE) AS numeric_max
FROM {src} GROUP BY {batch}"""


_LINE_NUMBERS = [c.split(":")[0] for c in TABLES["lineitem"] if c.endswith(":n")]


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.drop("type").withColumn("median", F.round("median", 6)).withColumn("mad", F.round("mad", 6))


@query("robust_stats_lineitem", " UNION ALL ".join(_sql_robust("lineitem", c) for c in _LINE_NUMBERS))
def robust_stats_lineitem(spark, d):
    return _rounded(P.robust_stats(t.read(spark, d, "lineitem"), _LINE_NUMBERS))


@query("robust_stats_events_by_day", "WITH " + t.SQL_EVENTS + " " + " UNION ALL ".join(
    _sql_robust("events", c, "b", "ev") for c in ("user_id", "value")))
def robust_stats_events_by_day(spark, d):
    return _rounded(P.robust_stats(t.events_by_day(spark, d), ["user_id", "value"], t.BATCH))


@query("medians_by_rank", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(median(CAST({c} AS DOUBLE)), 6) AS median, "
    f"round(mad(CAST({c} AS DOUBLE)), 6) AS mad FROM lineitem" for c in _LINE_NUMBERS))
def medians_by_rank(spark, d):
    """The way taken for columns of any cardinality: bucket counts, then one bucket."""
    numbers = stage(P.numeric_frequency(t.read(spark, d, "lineitem"), _LINE_NUMBERS), "frequency")
    stats = P.robust_frame(numbers, ["batch_id", "column_name"], bounded=False)
    return stats.select("column_name", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("robust_stats_written_numbers", """
WITH r AS (SELECT l_linestatus, CASE WHEN l_returnflag = 'R' THEN 'N/A' ELSE CAST(l_quantity AS VARCHAR) END AS q,
                  CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS v FROM lineitem)
SELECT l_linestatus AS batch_id, 'q' AS column_name, count(q) AS non_null_count, count(v) AS numeric_count,
       round(count(v) / count(q), 6) AS numeric_rate, median(v) AS median, mad(v) AS mad,
       min(v) AS numeric_min, max(v) AS numeric_max
FROM r GROUP BY 1
""")
def robust_stats_written_numbers(spark, d):
    """Numbers written as text, a third of them unreadable: counted, not fatal."""
    raw = t.read(spark, d, "lineitem").select(
        "l_linestatus",
        F.when(F.col("l_returnflag") == "R", "N/A").otherwise(F.col("l_quantity").cast("string")).alias("q"),
    )
    return P.robust_stats(raw, ["q"], "l_linestatus").drop("type")


def _sql_role() -> str:
    rows = " UNION ALL ".join(_sql_facts(x) for x in TABLES)
    number = lambda x: f"(translate({x}, '0123456789+-.eE', '') = '' AND TRY_CAST({x} AS DOUBLE) IS NOT NULL)"
    date = lambda x: f"(TRY_CAST({x} AS TIMESTAMP) IS NOT NULL AND {x}[5] = '-' AND length({x}) >= 10)"
    return f"""
SELECT table_name, column_name, CASE
  WHEN row_count = 0 OR distinct_values = 0 THEN 'unknown'
  WHEN kind = 'd' OR (kind = 't' AND {date('min_text')} AND {date('max_text')}) THEN 'temporal'
  WHEN distinct_values / row_count >= 0.99 AND null_count = 0
       AND NOT (kind = 'n' AND (min_number <> floor(min_number) OR max_number <> floor(max_number))) THEN 'identifier'
  WHEN kind = 'n' OR ({number('min_text')} AND {number('max_text')}) THEN 'numeric'
  WHEN distinct_values / row_count <= 0.5 THEN 'categorical' ELSE 'free_text' END AS role
FROM ({rows})"""


SQL_ROLES = _sql_role()


@query("roles", SQL_ROLES)
def roles(spark, d):
    facts = [_facts(t.read(spark, d, x), x) for x in TABLES]
    return P.classify(reduce(DataFrame.unionByName, facts)).select("table_name", "column_name", "role")


@query("freshness_events", f"""
WITH {t.SQL_EVENTS}
SELECT b AS batch_id, CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS BIGINT) AS amplitude_jours,
       CAST(date_diff('day', CAST(max(ts) AS DATE), CAST(b AS DATE)) AS BIGINT) AS retard_jours,
       CAST(CASE WHEN CAST(max(ts) AS DATE) > CAST(b AS DATE) THEN 1 ELSE 0 END AS BIGINT) AS dates_futures
FROM ev GROUP BY b
""")
def freshness_events(spark, d):
    e = t.events_by_day(spark, d)
    facts = P.with_distinct(P.column_bounds(e, ["ts"], t.BATCH), P.frequency_table(e, ["ts"], t.BATCH))
    return P.freshness(P.classify(facts)).select(
        "batch_id", "amplitude_jours", "retard_jours", "dates_futures"
    )


@query("freshness_lineitem_by_status", """
SELECT l_returnflag AS batch_id, CAST(date_diff('day', min(l_shipdate), max(l_shipdate)) AS BIGINT) AS amplitude_jours,
       CAST(NULL AS BIGINT) AS retard_jours, CAST(NULL AS BIGINT) AS dates_futures FROM lineitem GROUP BY 1
""")
def freshness_lineitem_by_status(spark, d):
    """A batch id that is not a date gives a span but no lag."""
    li = t.read(spark, d, "lineitem")
    facts = P.with_distinct(
        P.column_bounds(li, ["l_shipdate"], "l_returnflag"),
        P.frequency_table(li, ["l_shipdate"], "l_returnflag"),
    )
    return P.freshness(P.classify(facts)).select(
        "batch_id", "amplitude_jours", "retard_jours", "dates_futures"
    )


_METRIC_SQL = f"""
WITH {t.SQL_EVENTS}, m AS (
  SELECT b, NULL AS c, 'row_count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM ev GROUP BY b
  UNION ALL SELECT b, 'value', 'null_count', CAST(count(*) - count(value) AS DOUBLE) FROM ev GROUP BY b
  UNION ALL SELECT b, 'value', 'null_rate', (count(*) - count(value)) / count(*) FROM ev GROUP BY b
  UNION ALL SELECT b, 'value', 'distinct', CAST(count(DISTINCT value) AS DOUBLE) FROM ev GROUP BY b
  UNION ALL SELECT b, 'value', 'median', median(value) FROM ev GROUP BY b
  UNION ALL SELECT b, 'value', 'mad', mad(value) FROM ev GROUP BY b
  UNION ALL SELECT b, 'value', 'numeric_rate', 1.0 FROM ev GROUP BY b
  UNION ALL SELECT b, 'value', 'numeric_min', min(value) FROM ev GROUP BY b
  UNION ALL SELECT b, 'value', 'numeric_max', max(value) FROM ev GROUP BY b
  UNION ALL SELECT b, 'event_type', 'null_count', CAST(count(*) - count(event_type) AS DOUBLE) FROM ev GROUP BY b
  UNION ALL SELECT b, 'event_type', 'null_rate', (count(*) - count(event_type)) / count(*) FROM ev GROUP BY b
  UNION ALL SELECT b, 'event_type', 'distinct', CAST(count(DISTINCT event_type) AS DOUBLE) FROM ev GROUP BY b
  UNION ALL SELECT b, 'event_type', 'coverage', 1.0 FROM ev GROUP BY b)
SELECT b AS batch_id, c AS column_name, metric, round(value, 6) AS value FROM m
"""


def event_metrics(spark, d) -> DataFrame:
    e = t.events_by_day(spark, d).select(t.BATCH, "value", "event_type")
    return P.profile_metrics(P.profile_table(e, "RAW.EVENTS", "shop", t.BATCH)).where(
        F.col("column_name").isNull() | (F.col("column_name") != t.BATCH)
    )


@query("profile_metrics_events", _METRIC_SQL)
def profile_metrics_events(spark, d):
    return event_metrics(spark, d).select(
        "batch_id", "column_name", "metric", F.round("value", 6).alias("value")
    )


@query("reference_depth", f"""
WITH {t.SQL_EVENTS} SELECT 'RAW.EVENTS' AS table_name, count(DISTINCT b) AS depth FROM ev WHERE b < '2024-01-20'
""")
def reference_depth(spark, d):
    e = t.events_by_day(spark, d)
    facts = P.as_profile(P.column_bounds(e, ["value"], t.BATCH), "RAW.EVENTS", "shop")
    return detect.reference_depth(P.profile_metrics(facts), "2024-01-20").select("table_name", "depth")


# the comparable columns of every table: whole numbers, texts, moments
_COMPARABLE = {
    "w": "benchmark.item_id conversations.conv_id conversations.turn customer.c_custkey customer.c_nationkey documents.doc_id "
         "documents.n_chars embeddings.vec_id embeddings.label events.event_id events.user_id labels.doc_id labels.quality "
         "labels.toxic lineitem.l_orderkey lineitem.l_partkey lineitem.l_suppkey lineitem.l_linenumber nation.n_nationkey "
         "nation.n_regionkey orders.o_orderkey orders.o_custkey pages.page_id part.p_partkey part.p_size region.r_regionkey "
         "supplier.s_suppkey supplier.s_nationkey",
    "t": "benchmark.text conversations.role conversations.text customer.c_name customer.c_mktsegment documents.text documents.lang "
         "documents.source events.event_type events.props lineitem.l_returnflag lineitem.l_linestatus nation.n_name "
         "orders.o_orderstatus orders.o_orderpriority pages.url pages.html part.p_name part.p_brand part.p_type region.r_name "
         "supplier.s_name",
    "m": "events.ts lineitem.l_shipdate orders.o_orderdate",
}
_CELLS = [(k, *x.split(".")) for k, names in _COMPARABLE.items() for x in names.split()]
_SQL_SHARED = "WITH cell AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{t_}' AS t, '{c}' AS c, '{k}' AS k, CAST({c} AS VARCHAR) AS v FROM {t_} WHERE {c} IS NOT NULL" for k, t_, c in _CELLS
) + """), size AS (SELECT t, c, count(*) AS n FROM cell GROUP BY t, c),
shared AS (SELECT a.t, a.c, b.t AS pt, b.c AS pc, count(*) AS n FROM cell a JOIN cell b ON a.k = b.k AND a.v = b.v
    WHERE a.t <> b.t OR a.c <> b.c GROUP BY ALL),
held AS (SELECT shared.t AS table_name, shared.c AS column_name, pt AS parent_table, pc AS parent_column, s.n AS "values", p.n AS parent_values
    FROM shared JOIN size s ON s.t = shared.t AND s.c = shared.c JOIN size p ON p.t = pt AND p.c = pc WHERE shared.n = s.n)
"""
_EVERY_TABLE = sorted({t_ for _, t_, _ in _CELLS})


@query("inclusions", _SQL_SHARED + "SELECT * FROM held")
def inclusions(spark, d):
    """All inclusions between all comparable columns of all tables."""
    return inclusion.inclusions(spark, {x: t.read(spark, d, x) for x in _EVERY_TABLE})


@query("foreign_keys", _SQL_SHARED + ", fact AS (" + " UNION ALL ".join(
    f"SELECT '{t_}' AS t, '{c}' AS c, count(*) = count({c}) AND count(DISTINCT {c}) >= 0.99 * count(*) AS key FROM {t_}" for _, t_, c in _CELLS
) + """) SELECT table_name, column_name, parent_table, parent_column, 'foreign_key' AS role
FROM held JOIN fact ON fact.t = parent_table AND fact.c = parent_column WHERE key AND table_name <> parent_table""")
def foreign_keys(spark, d):
    """Which columns refer to identifiers of other tables, found by values among all tables."""
    return inclusion.foreign_keys(spark, {x: t.read(spark, d, x) for x in _EVERY_TABLE})


@query("percentile_ranks_lineitem", """
WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS v,
                  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn,
                  count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT g, CAST(rn AS BIGINT) AS rank, v AS value FROM r WHERE rn = (n + 9) // 10 OR rn = (n + 1) // 2
""")
def percentile_ranks_lineitem(spark, d):
    """Values at given ranks of hot groups, without sorting any group."""
    li = t.read(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"), F.lit(1).cast("long").alias("n")
    )
    sizes = li.groupBy("g").agg(F.sum("n").alias("total"))
    wanted = sizes.select(
        "g", F.explode(F.array(F.expr("(total + 9) div 10"), F.expr("(total + 1) div 2"))).alias("_rank")
    )
    found = ranks.value_at_rank(li, ["g"], wanted, "v", "n")
    return found.select("g", F.col("_rank").alias("rank"), F.col("v").alias("value"))
