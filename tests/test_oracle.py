import pytest

import __spark_entry__ as contract
from verification.compare import differences
from verification.star_oracle import ORACLE_SQL as ORACLE
from verification.star_queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_the_contract_has_them_all():
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLE.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), sf_dir, ORACLE[name]) == []


@pytest.mark.parametrize(
    ("name", "columns", "descending"),
    [
        ("sort_performance", ["orders_per_sent", "ctr"], True),
        ("sort_roi", ["roi"], True),
        ("sort_volume", ["sent", "orders"], True),
        ("daily_trends", ["day"], False),
        ("top_roi_10", ["roi"], True),
        ("bottom_roi_5", ["roi"], False),
    ],
)
def test_order(spark, sf_dir, name, columns, descending):
    rows = [tuple(row[c] for c in columns) for row in QUERIES[name](spark, sf_dir).collect()]
    assert len(rows) > 1 and rows == sorted(rows, reverse=descending)
