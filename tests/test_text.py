"""Scalar functions against plain Python definitions of the same rules."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from limpid.functions import text


def plain_fold(value: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFD", value) if unicodedata.category(c) != "Mn")
    return re.sub(r"\s+", " ", bare).strip().lower()


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def results(df, expr):
    return [r["o"] for r in df.select("i", expr.alias("o")).orderBy("i").collect()]


def test_fold_cases(spark):
    cases = ["  São   PAULO ", "BRASÍLIA", "niterói", "sãopaulo", "são paulo", "arco verde", "arcoverde", "4º centenario"]
    got = results(column(spark, cases), text.fold(F.col("v")))
    assert got == ["sao paulo", "brasilia", "niteroi", "saopaulo", "sao paulo", "arco verde", "arcoverde", "4º centenario"]


def test_fold_equals_the_unicode_definition(spark):
    rng = random.Random(7)
    letters = [chr(c) for c in range(0x20, 0x250)] + [chr(c) for c in range(0x1E00, 0x1F00)]
    letters += ["\t", "\n", " ", " ", "\x1f", "́", "̧", "ß", "º", "İ"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    assert results(column(spark, words), text.fold(F.col("v"))) == [plain_fold(w) for w in words]


def test_number_and_date_readers(spark):
    values = ["1", "-1.5", "+.5", "1e3", " 7 ", "1.", "nan", "inf", "1_000", "1d", "", "2018-04-29", None, "N/A"]
    number = [True, True, True, True, True, True] + [False] * 8
    assert results(column(spark, values), text.reads_as_number(F.col("v"))) == number
    dates = ["2018-04-29", "2018-04-29 10:56:33", "2018-04-29T10:56", "2018-04-29T10:56:33.000Z",
             "2018-04-29 10:56:33+01:00", "20180429", "2018-04", "N/A", None, " 2018-04-29 "]
    assert results(column(spark, dates), text.reads_as_date(F.col("v"))) == [True] * 5 + [False] * 4 + [True]
    more = ["2018-04-29 10:56:33.5-0230", "2018-04-29 10:56Z", "2018-04-29 10", "2018-04-29T", "2018-4-29", "2018-13-01",
            "2018-04-29x10:56", "2018-04-29 25:00", "18-04-2018 ", "12018-04-29", "2018-04-29 10:56 tomorrow"]
    assert results(column(spark, more), text.reads_as_date(F.col("v"))) == [True, True] + [False] * 9


def test_fraction_looks_at_the_value(spark):
    values = ["18.00", "18.12", "18", "abc", None, "1e400", "-0.5"]
    assert results(column(spark, values), text.has_fraction(F.col("v"))) == [False, True, False, False, False, False, True]


def test_day(spark):
    values = ["2018-04-29", "2018-04-29T10:56:33Z", "2018-02-30", "N/A", None]
    got = results(column(spark, values), text.day_or_null(F.col("v")).cast("string"))
    assert got == ["2018-04-29", "2018-04-29", None, None, None]


def test_integers_round_and_money_keeps_cents(spark):
    values = ["1.5", "2.4", "7", "x", None, "1e2"]
    assert results(column(spark, values), text.integer_or_null(F.col("v"))) == [2, 2, 7, None, None, 100]
    got = results(column(spark, ["12.345", "n/a", "1e2"]), text.money_or_null(F.col("v")).cast("string"))
    assert got == ["12.35", None, "100.00"]


@pytest.mark.parametrize("value, label", [
    (0.30, "-2"), (0.35, "-2"), (0.85, "-1"), (0.0, "0"), (1e-12, "0"), (None, "n/a"), (-8.0, "3"), (160718.0, "17"),
])
def test_octave(spark, value, label):
    assert results(column(spark, [value], "double"), text.octave(F.col("v"))) == [label]


def test_octave_at_powers_of_two(spark):
    powers = [2.0 ** e for e in range(-29, 60)]
    below = [math.nextafter(p, 0) for p in powers]
    assert results(column(spark, powers, "double"), text.octave(F.col("v"))) == [str(e) for e in range(-29, 60)]
    assert results(column(spark, below, "double"), text.octave(F.col("v"))) == [str(e - 1) for e in range(-29, 60)]


def test_signature_and_back(spark):
    df = spark.createDataFrame(
        [("RAW.ORDERS", "CUSTOMER_ID", "nulls_interdits", 0.3), ("RAW.ORDERS", None, "table_absente", None)],
        "t string, c string, k string, m double",
    ).select(text.signature(F.col("t"), F.col("c"), F.col("k"), F.col("m")).alias("s"))
    got = sorted(r["s"] for r in df.collect())
    assert got == ["RAW.ORDERS|CUSTOMER_ID|nulls_interdits|-2", "RAW.ORDERS||table_absente|n/a"]
    back = df.select(text.split_signature(F.col("s")).alias("p")).select("p.*").collect()
    assert ("RAW.ORDERS", None, "table_absente", "n/a") in [tuple(r) for r in back]
    odd = column(spark, ["only"]).select(text.split_signature(F.col("v")).alias("p")).select("p.*").first()
    assert tuple(odd) == ("only", None, None, None)


def test_small_helpers(spark):
    df = column(spark, ["RAW.Orders", "x"])
    assert results(df, text.last_segment(F.col("v"))) == ["orders", "x"]
    long = column(spark, ["a" * 401, "b" * 400])
    assert results(long, F.length(text.shorten(F.col("v")))) == [401, 400]
    assert results(df, text.run_id(F.lit("shop"), F.col("v"), F.lit("2018-03-01")))[0] == "shop|RAW.Orders|2018-03-01"
    rates = spark.createDataFrame([(0, 1, 3), (1, 0, 0)], "i int, a int, b int")
    assert results(rates, text.rate(F.col("a"), F.col("b"))) == [0.333333, 0.0]
