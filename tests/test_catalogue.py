"""The registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from limpid import schemas
from oracle import connect, differences

ALL = entry.queries()
# the corpus queries have tests of their own beside their operators
CORPUS = entry._corpus()[0]
SQL = entry.oracle_sql()
# LIMPID_QUICK=1 runs a cross-section only
QUICK = [
    "silver_orders", "silver_payments_after_rename", "daily_sales", "avg_order_value", "sales_by_city_state",
    "delivery_delays", "split_word_rows", "profile_lineitem", "topk_adaptive", "robust_stats_lineitem",
    "medians_by_rank", "roles", "semantic_collisions_words", "majority_spelling_words", "inject_nulls_events",
    "truncate_rows_with_ties", "check_results", "references_events", "statistical_events", "schema_drift_events",
    "contract_violations_events", "proposed_clauses", "amended_clauses", "silence_split", "journal_lines",
    "impact_widest", "downstream_effect", "verified_corrections", "loaded_batches", "streamed_event_metrics",
]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUICK if os.environ.get("LIMPID_QUICK") else sorted(n for n in ALL if n not in CORPUS))
def test_query_equals_its_sql(spark, sf, con, name):
    df = ALL[name](spark, sf)
    if name in SQL:
        assert differences(df, con, SQL[name]) == []
    else:
        df.collect()


def test_entry_is_a_profile(spark):
    df = entry.entry(spark)
    assert df.schema.fieldNames() == schemas.PROFILE_COLUMN.fieldNames() and df.count() == 6


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(ALL) and set(QUICK) <= set(ALL)
