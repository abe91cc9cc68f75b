import datetime as dt

import pytest
from pyspark.sql import functions as F

from dripline.functions import exprs
from dripline.operators.lookups import local_table


def one(spark, column, value=None, kind="string"):
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    return frame.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "places", "expected"),
    [
        (12.5, 0, 12.0), (13.5, 0, 14.0), (0.125, 2, 0.12), (0.375, 2, 0.38),
        (1.005, 2, 1.0), (2.5, 0, 2.0), (-2.5, 0, -2.0), (7.0, 4, 7.0),
    ],
)
def test_half_even(spark, value, places, expected):
    assert one(spark, exprs.half_even("v", places), value, "double") == expected


def test_unrounded(spark):
    assert one(spark, exprs.half_even("v", None), 1 / 3, "double") == 1 / 3


@pytest.mark.parametrize(("top", "bottom", "expected"), [(1, 3, 33.33), (1, 0, 0.0), (0, 5, 0.0)])
def test_guarded(spark, top, bottom, expected):
    frame = spark.createDataFrame([(top, bottom)], "a bigint, b bigint")
    assert frame.select(exprs.guarded("a", "b", 2, True).alias("r")).first()["r"] == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("1,234", 1234.0), ("1,234,567.5", 1234567.5), ("nan", 0.0), ("", 0.0), (None, 0.0),
        ("abc", 0.0), ("1d", 0.0), ("3f", 0.0), ("NaN", 0.0), ("inf", 0.0), (" 12.5 ", 12.5),
        ("1e3", 1000.0), ("-4", -4.0), (".5", 0.5), ("5.", 5.0), ("\t7\n", 7.0), ("1 2", 0.0),
    ],
)
def test_parse_number(spark, text, expected):
    assert one(spark, exprs.parse_number(F.col("v")), text) == expected


def test_parse_number_without_nan_step(spark):
    assert one(spark, exprs.parse_number(F.col("v"), strip_nan=False), "nan5") == 0.0
    assert one(spark, exprs.parse_number(F.col("v")), "nan5") == 5.0


@pytest.mark.parametrize(
    ("text", "expected"),
    [("  a b ", "a b"), (None, "0"), ("\tx\n", "x"), ("", "")],
)
def test_normalize_text(spark, text, expected):
    assert one(spark, exprs.normalize_text(F.col("v")), text) == expected


def test_normalize_text_options(spark):
    assert one(spark, exprs.normalize_text(F.col("v"), trim=False), " a ") == " a "
    assert one(spark, exprs.normalize_text(F.col("v"), missing_label="none"), None) == "none"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024-01-05", dt.datetime(2024, 1, 5)),
        ("2024-01-05 10:30:00", dt.datetime(2024, 1, 5, 10, 30)),
        ("1/5/2024", dt.datetime(2024, 1, 5)),
        ("01/05/2024 7:05", dt.datetime(2024, 1, 5, 7, 5)),
        ("5-Jan-2024", dt.datetime(2024, 1, 5)),
        ("Jan 5, 2024", dt.datetime(2024, 1, 5)),
        ("soon", None), ("0", None), ("2024-02-31", None), (None, None),
    ],
)
def test_parse_day(spark, text, expected):
    assert one(spark, exprs.parse_day(F.col("v")), text) == expected


def test_parse_day_strict(spark):
    strict = exprs.parse_day(F.col("v"), strict=True)
    assert one(spark, strict, "2024-01-05") == dt.datetime(2024, 1, 5)
    with pytest.raises(Exception, match="unreadable date: soon"):
        one(spark, strict, "soon")


@pytest.mark.parametrize(
    ("moment", "expected"),
    [
        (dt.datetime(2024, 1, 5), "2024-01-05"),
        (dt.datetime(2024, 1, 6, 10, 30), "2024-01-06 10:30:00"),
        (None, None),
    ],
)
def test_iso_date_text(spark, moment, expected):
    assert one(spark, exprs.iso_date_text(F.col("v")), moment, "timestamp") == expected


def test_missing_texts(spark):
    frame = spark.createDataFrame([("NA",), ("n/a",), ("Email",), ("na",)], "v string")
    found = [row["r"] for row in frame.select(exprs.missing_to_null(F.col("v")).alias("r")).collect()]
    assert found == [None, None, "Email", "na"]


def test_display_text(spark):
    frame = spark.createDataFrame([(1234567.875, 0.0)], "v double, z double")
    row = frame.select(
        exprs.count_text(F.col("v")).alias("count"),
        exprs.percent_text(F.col("v"), 2).alias("percent"),
        exprs.money_text(F.col("v"), 0).alias("money"),
        exprs.money_text(F.col("v"), 2, grouped=False).alias("plain"),
        exprs.multiplier_text(F.col("v"), 1).alias("times"),
        exprs.count_text_or_blank(F.col("z")).alias("blank"),
    ).first()
    assert row["count"] == "1,234,567"
    assert row["percent"] == "1234567.88%"
    assert row["money"] == "₹1,234,568"
    assert row["plain"] == "₹1234567.88"
    assert row["times"] == "1234567.9x"
    assert row["blank"] == ""


def test_weeks_against_calendar(spark):
    days = [dt.date(2019, 12, 20) + dt.timedelta(days=i) for i in range(2_300)]
    frame = spark.createDataFrame([(day,) for day in days], "d date")
    rows = frame.select(
        "d", exprs.week_label(F.col("d")).alias("w"), exprs.week_start(F.col("d")).alias("s")
    ).collect()
    for row in rows:
        assert row["w"] == row["d"].strftime("%Y-W%U")
        assert row["s"] == row["d"] - dt.timedelta(days=row["d"].weekday())


def test_local_table_keeps_order_of_many_values(spark):
    rows = [(f"k{i}", f"it's {i}") for i in range(300)]
    found = [tuple(row) for row in local_table(spark, rows, ("k", "v")).collect()]
    assert found == rows
    many = [(f"k{i}",) for i in range(1_500)]
    assert local_table(spark, many, ("k",)).count() == 1_500
    assert local_table(spark, [], ("k",)).count() == 0
