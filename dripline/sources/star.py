"""Campaign reports derived from an order star schema (lineitem, orders, customer)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dripline.config import MetricConfig

# Segment of each market the derived journeys start with. MACHINERY has none.
MARKET_SEGMENTS = {
    "AUTOMOBILE": ("NU", "ALL"),
    "BUILDING": ("RU", "OM"),
    "FURNITURE": ("RU", "OA"),
    "HOUSEHOLD": ("ALL", "ALL"),
}
# Order priorities, the second half of a derived journey name.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

# Channel by remainder of the supplier key; the last two have no price.
CHANNELS = ("Email", "Push", "SMS", "WhatsApp", "InApp", "RCS")

# Columns that tell apart rows of one campaign-day; together they are unique.
ROW_KEY = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    "l_quantity", "l_extendedprice", "l_shipdate",
)


def star_config() -> MetricConfig:
    """Default prices with the segments of the derived journeys."""
    return MetricConfig(
        segments={
            f"{market} / {priority}": segment
            for market, segment in MARKET_SEGMENTS.items()
            for priority in PRIORITIES
        }
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _by_remainder(key: str, labels: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(labels[:-1]))
    return f"CASE {key} % {len(labels)} {cases} ELSE '{labels[-1]}' END"


def campaign_fact(
    spark: SparkSession,
    sf_dir: str,
    keep_row_key: bool = False,
    arrange: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One report row per order line; ``keep_row_key`` adds the row key and a ``source`` flag.

    ``arrange`` lays out the joined lines before their columns are derived, so that a shuffle
    there moves the stored numbers and not the texts that follow from them.

    Orders meet customers before lines: that pair is narrow, so the wide line table is
    shuffled once, on the order key only. No side is hinted as broadcast, since all three
    tables grow with the data; adaptive execution picks the join and splits hot keys.
    """
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    context = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey",
        "concat(c_mktsegment, ' / ', o_orderpriority) AS journey_name",
        "CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Running' "
        "ELSE 'Paused' END AS status",
        "to_date(o_orderdate) AS day",
    )
    lines = table(spark, sf_dir, "lineitem").select(*ROW_KEY, "l_returnflag")
    joined = lines.join(context, F.col("l_orderkey") == F.col("o_orderkey"))
    if arrange is not None:
        joined = arrange(joined)
    # Lines numbered 7 sent nothing.
    active = F.when(F.col("l_linenumber") == 7, F.lit(0)).otherwise(F.col("l_quantity"))
    joined = joined.withColumn("active", active.cast("bigint"))
    columns = [
        "concat('C', l_partkey) AS campaign_id",
        "concat('Campaign ', l_partkey) AS campaign_name",
        "journey_name",
        f"{_by_remainder('l_suppkey', CHANNELS)} AS channel",
        "status",
        "day",
        "to_date(l_shipdate) AS start_date",
        "l_linenumber AS source_seq",
        "active * 100 AS sent",
        "active * (100 - l_partkey % 30) AS delivered",
        "active * (l_partkey % 50) AS unique_impressions",
        "active * (l_suppkey % 11) AS unique_clicks",
        "active * (l_partkey % 3) AS unique_conversions",
        "if(l_suppkey % 11 = 0, 0L, active * (l_partkey % 2)) AS ct_conversions",
        "cast(l_extendedprice AS decimal(18,2)) AS revenue_inr",
    ]
    if keep_row_key:
        columns += [*ROW_KEY, "l_returnflag AS source"]
    return joined.selectExpr(*columns)
