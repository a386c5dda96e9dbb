"""Inclusions between columns against all pairs in memory."""

import datetime as dt
import decimal

import pytest

from limpid.operators import inclusion

A = [(1, "x", dt.date(2024, 1, 1), decimal.Decimal(1), 0.5, True), (2, "y", dt.date(2024, 1, 2), decimal.Decimal(2), 1.0, False),
     (3, "z" * 300, None, decimal.Decimal(10**20), 2.0, None), (None, None, None, None, None, None)]
B = [(2, "y", "x", dt.date(2024, 1, 2)), (1, "x", "z" * 300, dt.date(2024, 1, 1)), (2, "x", None, dt.date(2024, 1, 2))]
C = [(None, "z" * 299)]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "a": spark.createDataFrame(A, "id int, name string, day date, `dot.ted` decimal(38,0), part double, flag boolean"),
        "b": spark.createDataFrame(B, "ref long, name string, other string, day date"),
        "c": spark.createDataFrame(C, "nothing int, near string"),
    }


def plain(tables):
    columns = {}
    for t, df in tables.items():
        for f in df.schema.fields:
            kind = inclusion._kind(f.dataType)
            if kind:
                i = df.columns.index(f.name)
                columns[t, f.name] = kind, {r[i] for r in df.collect() if r[i] is not None}
    return sorted(
        (*x, *y, len(vx), len(vy)) for x, (kx, vx) in columns.items() for y, (ky, vy) in columns.items()
        if x != y and kx == ky and vx and vx <= vy)


@pytest.mark.parametrize("bounded", [True, False])
def test_all_inclusions_equal_all_pairs(spark, tables, bounded):
    found = inclusion.inclusions(spark, tables, bounded)
    assert sorted(map(tuple, found.collect())) == plain(tables)
    assert ("b", "ref", "a", "id", 2, 3) in plain(tables) and ("b", "ref", "a", "dot.ted", 2, 3) in plain(tables)


def test_more_columns_than_one_number_has_bits(spark):
    wide = spark.range(4).select(*[(inclusion.F.col("id") % (i % 4 + 1)).alias(f"c{i}") for i in range(130)])
    found = inclusion.inclusions(spark, {"w": wide})
    assert sorted(map(tuple, found.collect())) == plain({"w": wide})


def test_foreign_keys_ask_for_identifiers_of_another_table(spark):
    keys = spark.range(100).selectExpr("id", "id % 10 AS group", "CAST(NULL AS INT) AS none")
    rows = spark.range(500).selectExpr("id AS row", "id % 100 AS key", "id % 101 AS nearly", "id % 5 AS small")
    found = inclusion.foreign_keys(spark, {"keys": keys, "rows": rows})
    assert sorted((r.table_name, r.column_name, r.parent_table, r.parent_column) for r in found.collect()) == [
        ("keys", "group", "rows", "row"), ("keys", "id", "rows", "row"), ("rows", "key", "keys", "id"), ("rows", "small", "keys", "id")]


def test_nothing_to_compare(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert inclusion.inclusions(spark, {"e": empty, "f": empty}).count() == 0
    part = {"e": empty.select(inclusion.F.lit(1.5).alias("x"))}
    assert inclusion.inclusions(spark, part).count() == 0 and inclusion.foreign_keys(spark, part).count() == 0


def test_jobs_do_not_grow_with_pairs(spark, tables):
    def jobs(some):
        group = f"inclusion-{len(some)}"
        spark.sparkContext.setJobGroup(group, "")
        inclusion.inclusions(spark, some).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    few, many = {"a": tables["a"], "b": tables["b"]}, {f"{n}{i}": tables[n] for n in "ab" for i in range(6)}
    # one stage per table is read more, but not one job per pair: 12 tables make about a thousand pairs
    assert jobs(many) <= jobs(few) + 12 * 5
