import datetime
import random
from decimal import Decimal

import pytest

from dripline.operators.filters import filter_table
from dripline.operators.ranking import cursor_after, page, page_after

SCHEMA = "name string, sent bigint, roi double, paid decimal(10,2), day date, at timestamp, tags array<string>"
DAY = datetime.date


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        ("Push one", 5, 1.5, Decimal("2.50"), DAY(2024, 1, 5), datetime.datetime(2024, 1, 5, 10), []),
        ("push TWO", 10, None, None, DAY(2024, 2, 5), None, None),
        (None, None, -3.0, Decimal("0.00"), None, datetime.datetime(2024, 1, 6), []),
        ("  ", 1000, 100.0, Decimal("9.99"), DAY(2024, 3, 5), None, []),
        ("> 5", 7, 5.0, Decimal("1.00"), DAY(2024, 1, 6), None, []),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    ("cells", "sents"),
    [
        ({}, [5, 10, None, 1000, 7]),
        ({"name": "  ", "sent": ""}, [5, 10, None, 1000, 7]),
        ({"sent": "> 5"}, [10, 1000, 7]),
        ({"sent": ">= 5.5"}, [10, 1000, 7]),
        ({"sent": "1,000"}, [1000]),
        ({"sent": "!= 5"}, [10, None, 1000, 7]),
        ({"sent": "<=7", "roi": ">1"}, [5, 7]),
        ({"roi": "= 1.5"}, [5]),
        ({"roi": "< -2"}, [None]),
        ({"paid": "2.5"}, [5]),
        ({"paid": "is blank"}, [10]),
        ({"name": "is blank"}, [None, 1000]),
        ({"name": "is not blank"}, [5, 10, 7]),
        ({"name": "push"}, [10]),
        ({"name": "icontains push"}, [5, 10]),
        ({"name": 'contains "> 5"'}, [7]),
        ({"name": "= 'Push one'"}, [5]),
        ({"day": "> 2024-01-05"}, [10, 1000, 7]),
        ({"day": "2024-01-05"}, [5]),
        ({"at": "< 2024-01-06"}, [5]),
        ({"at": "2024-01-05 10:00"}, [5]),
    ],
)
def test_filter_cells(table, cells, sents):
    assert [row["sent"] for row in filter_table(table, cells).collect()] == sents


@pytest.mark.parametrize(
    ("cells", "message"),
    [
        ({"gone": "1"}, "no such column"),
        ({"sent": "many"}, "does not fit a column of bigint"),
        ({"sent": "nan"}, "does not fit"),
        ({"sent": "contains 1"}, "needs a text column"),
        ({"day": "> soon"}, "does not fit a column of date"),
        ({"sent": ">"}, "needs a value"),
        ({"name": "is blank now"}, "nothing may follow"),
        ({"tags": "x"}, "are not filtered"),
    ],
)
def test_filter_cells_that_make_no_sense(table, cells, message):
    with pytest.raises(ValueError, match=message):
        filter_table(table, cells)


def test_filter_cells_reach_the_scan(spark, table, tmp_path):
    path = str(tmp_path / "table")
    table.write.parquet(path)
    chosen = filter_table(spark.read.parquet(path), {"sent": "> 5", "name": "= x", "day": "< 2024-02-01"})
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = chosen._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = text[text.index("PushedFilters") :]
    assert all(x in pushed for x in ("GreaterThan(sent,5)", "EqualTo(name,x)", "LessThan(day,2024-02-01)"))


@pytest.mark.parametrize("order", [
    [("a", "asc"), ("b", "desc")], [("b", "asc"), ("a", "desc")], [("a", "desc")], [("a", "asc"), ("b", "asc"), ("i", "asc")],
])
def test_pages_by_cursor_equal_pages_by_offset(spark, order):
    generator = random.Random(4)
    rows = [
        (generator.choice([None, 1, 2, 3]), generator.choice([None, "x", "y"]), i) for i in range(83)
    ]
    frame = spark.createDataFrame(rows, "a int, b string, i int").repartition(3)
    names = [name for name, _ in order]
    from dripline.operators.ranking import sort_columns

    columns = sort_columns(order, ())
    cursor, shown = None, []
    for number in range(1, 15):
        found = page_after(frame, order, 7, cursor).collect()
        by_offset = page(frame, columns, number, 7).collect()
        assert [[r[x] for x in names] for r in found] == [[r[x] for x in names] for r in by_offset]
        shown += [row["i"] for row in found]
        cursor = cursor_after(found, order, cursor)
    if len(order) == 3:
        assert sorted(shown) == list(range(83))
    assert len(shown) == 83 and page_after(frame, order, 7, cursor).isEmpty()


def test_a_far_page_keeps_one_page_per_task(spark):
    frame = spark.range(300_000, numPartitions=4).withColumnRenamed("id", "k")
    order = [("k", "asc")]
    first = page_after(frame, order, 25).collect()
    assert cursor_after([], order) is None and cursor_after(first, order).key == (24,)
    from dripline.operators.ranking import Cursor

    far = page_after(frame, order, 25, Cursor((249_999,), 1))
    assert [row["k"] for row in far.collect()] == list(range(250_000, 250_025))
    text = far._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=26" in text
