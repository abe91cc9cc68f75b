"""Exact quantiles of journey-level tables, by ranks inside value ranges at every size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Value ranges the ranking work is split into.
_BUCKETS = 128


def quantile_map(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> Column:
    """The quantiles of a table as a value for expressions: ``quantile_map(...)[column][i]``.

    A scalar subquery of one row, so nothing runs before the plan that uses it does. A column
    without values gives null. The plan reads ``df`` once more than the query around it.
    """
    return ranked_quantiles(df, columns, probabilities).scalar()


def with_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    build: Callable[[Column], dict[str, Column]],
) -> DataFrame:
    """Add the columns that ``build`` makes of the quantiles.

    The subquery stands in the plan once, however often the new columns refer to it.
    """
    held = "_quantiles"
    while held in df.columns:
        held += "_"
    limits = quantile_map(df, columns, probabilities)
    return df.withColumn(held, limits).withColumns(build(F.col(held))).drop(held)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    one_task_rows: int | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, in the order of ``probabilities``.

    Runs at once, like ``DataFrame.approxQuantile``; :func:`quantile_map` does not. A column
    without values gives ``None``. Tables of at most ``one_task_rows`` rows, if that is given, are
    left to one task.
    """
    if one_task_rows is not None and df.count() <= one_task_rows:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        row = df.agg(*[F.percentile(name, wanted).alias(name) for name in columns]).first()
        found = row.asDict()
    else:
        found = ranked_quantiles(df, columns, probabilities).first()["quantiles"]
    return {name: found.get(name) or [None] * len(probabilities) for name in columns}


def ranked_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """One row, one map: column name -> linearly interpolated quantiles, in the given order.

    Equal values are counted together first. An approximate histogram then only chooses the
    bucket limits; exact counts per bucket give each bucket its starting rank, and values are
    ranked inside their bucket. Every step is a grouped aggregate or a window over about one
    part in 128 of the distinct values, so the result is exact at any row count.
    """
    long = df.select(*[F.col(name).cast("double").alias(name) for name in columns]).unpivot(
        [], list(columns), "metric", "value"
    )
    counted = (
        long.where(F.col("value").isNotNull())
        .groupBy("metric", "value")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    steps = F.array(*[F.lit(i / _BUCKETS) for i in range(1, _BUCKETS)])
    # One row per column name: the broadcast is bounded by len(columns).
    limits = counted.groupBy("metric").agg(
        F.percentile_approx("value", steps, 1_000).alias("limits"),
        F.sum("weight").alias("total"),
    )
    bucketed = counted.join(F.broadcast(limits), "metric").select(
        "metric",
        "value",
        "weight",
        "total",
        F.size(F.filter("limits", lambda limit: limit < F.col("value"))).alias("bucket"),
    )
    # At most 128 rows per column name.
    starts = (
        bucketed.groupBy("metric", "bucket")
        .agg(F.sum("weight").alias("bucket_weight"))
        .withColumn(
            "start",
            F.sum("bucket_weight").over(Window.partitionBy("metric").orderBy("bucket"))
            - F.col("bucket_weight"),
        )
        .drop("bucket_weight")
    )
    in_bucket = Window.partitionBy("metric", "bucket").orderBy("value")
    ranked = bucketed.withColumn("upto", F.sum("weight").over(in_bucket)).join(
        F.broadcast(starts), ["metric", "bucket"]
    )
    reached = F.col("start") + F.col("upto")
    picks = []
    for i, probability in enumerate(probabilities):
        position = F.lit(float(probability)) * (F.col("total") - 1)
        for side, rank in (("low", F.floor(position)), ("high", F.ceil(position))):
            picks.append(F.min(F.when(reached > rank, F.col("value"))).alias(f"{side}_{i}"))
    picked = ranked.groupBy("metric").agg(F.first("total").alias("total"), *picks)
    quantiles = []
    for i, probability in enumerate(probabilities):
        position = F.lit(float(probability)) * (F.col("total") - 1)
        low, high = F.col(f"low_{i}"), F.col(f"high_{i}")
        quantiles.append(low + (high - low) * (position - F.floor(position)))
    per_metric = picked.select("metric", F.array(*quantiles).alias("quantiles"))
    return per_metric.agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "quantiles"))).alias("quantiles")
    )
