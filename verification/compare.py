"""Order-insensitive comparison of a Spark result with the SQL result."""

from __future__ import annotations

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

TABLES = ("lineitem", "orders", "customer")


def sql_result(sf_dir: str, sql: str) -> pd.DataFrame:
    with duckdb.connect() as connection:
        for name in TABLES:
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        return connection.execute(sql).df()


def _canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [
        tuple(
            "null" if value is None or value is pd.NA or value != value else repr(_plain(value))
            for value in row
        )
        for row in frame.itertuples(index=False, name=None)
    ]
    return sorted(rows)


def _plain(value):
    value = value.item() if hasattr(value, "item") else value
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def differences(spark_result: DataFrame, sf_dir: str, sql: str) -> list[str]:
    """What differs in columns, row count or values; empty when the results agree."""
    ours, theirs = spark_result.toPandas(), sql_result(sf_dir, sql)
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"]
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows against {len(theirs)}"]
    pairs = zip(_canonical(ours), _canonical(theirs), strict=True)
    return [f"{a} against {b}" for a, b in pairs if a != b][:3]
