"""Quoted line breaks over byte ranges, against Spark's reader of whole files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from limpid.sources import batches, quoted

VALUES = ["", "a", "b c", "x,y", "line\nbreak", "\n", "a\n\n\nb", 'say ""hi""', '""', "é 数", "1.5", "long " * 30, 'q""\n""q', ",\n,", "NA"]


def put(path, rows, end="\n", last=True, quoted_always=False):
    def cell(v):
        return f'"{v}"' if quoted_always or any(c in v for c in ',\n"\r') else v
    body = end.join(",".join(map(cell, r)) for r in rows)
    path.write_bytes((body + (end if last else "")).encode())


@pytest.fixture
def ranges(spark):
    key = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    old = [spark.conf.get(k) for k in key]

    def cut(size):
        for k, v in zip(key, (str(size), "1"), strict=True):
            spark.conf.set(k, v)
    yield cut
    for k, v in zip(key, old, strict=True):
        spark.conf.set(k, v)


def by_whole_files(spark, path):
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def same(spark, path):
    mine = batches.read_text_table(spark, path, keep_tokens=True)
    other = by_whole_files(spark, path)
    assert mine.columns == other.columns
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(mine) == rows(other)
    return mine


@pytest.mark.parametrize("seed", range(4))
def test_ranges_of_any_size_give_the_records(spark, tmp_path, ranges, seed):
    rng = random.Random(seed)
    for f in range(2):
        rows = [["id", "one", "two"]] + [[str(i), rng.choice(VALUES), rng.choice(VALUES)] for i in range(rng.randrange(1, 120))]
        put(tmp_path / f"f{f}.csv", rows, last=rng.random() < 0.5, quoted_always=rng.random() < 0.3)
    ranges(rng.choice([100, 300, 10_000]))
    same(spark, str(tmp_path))


def test_a_value_over_many_ranges(spark, tmp_path, ranges):
    put(tmp_path / "f.csv", [["id", "text"], ["1", "x\n" * 3000], ["2", "plain"], ["3", "y,\n" * 500], ["4", "z"]])
    ranges(400)
    got = same(spark, str(tmp_path / "f.csv"))
    assert got.where("id = '1'").first()["text"] == "x\n" * 3000 and got.count() == 4
    # the file is read by many tasks
    assert quoted.range_maps(spark, str(tmp_path / "f.csv")).count() >= 10


def test_quotes_within_plain_values_open_nothing(spark, tmp_path, ranges):
    (tmp_path / "f.csv").write_text('id,t\n1,5" pipe\n2,a"b"\n3,"c""\nd"\n4,"e"x\n5,\n')
    ranges(40)
    got = same(spark, str(tmp_path / "f.csv"))
    assert {r["id"]: r["t"] for r in got.collect()} == {"1": '5" pipe', "2": 'a"b"', "3": 'c"\nd', "4": '"e"x', "5": None}


def test_blank_lines_and_carriage_returns(spark, tmp_path, ranges):
    put(tmp_path / "r.csv", [["id", "t"], ["1", "a\r\nb"], ["2", "c"], ["3", "d\ne"]], end="\r\n")
    (tmp_path / "b.csv").write_text('\n\nid,t\n\n1,"x\n\ny"\n\n\n2,z\n')
    ranges(40)
    same(spark, str(tmp_path / "b.csv"))
    # a break within quotes stays as it is written
    got = batches.read_text_table(spark, str(tmp_path / "r.csv"))
    assert {r["id"]: r["t"] for r in got.collect()} == {"1": "a\r\nb", "2": "c", "3": "d\ne"}


def test_files_without_open_lines_go_through_the_reader_of_lines(spark, tmp_path, ranges):
    put(tmp_path / "f.csv", [["id", "t"], ["1", "x,y"], ["2", 'a""b'], ["3", ""]])
    ranges(40)
    got = same(spark, str(tmp_path / "f.csv"))
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    put(tmp_path / "g.csv", [["id", "t"]])
    assert same(spark, str(tmp_path / "g.csv")).count() == 0


def test_states_are_those_of_a_walk():
    rng = np.random.default_rng(3)
    for _ in range(200):
        to = rng.integers(0, 2, (2, rng.integers(1, 30)))
        for entry in (0, 1):
            state, want = entry, []
            for a, b in to.T:
                state = int(b if state else a)
                want.append(state)
            assert list(quoted._states(to[0], to[1], entry)) == want
