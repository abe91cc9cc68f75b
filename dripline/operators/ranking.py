"""Top-n lists, sorts and pages. Ties always fall back to journey name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

TIEBREAK = "journey_name"


def sort_columns(order: Sequence[tuple[str, str]], tiebreak: Sequence[str] = (TIEBREAK,)) -> list[Column]:
    """Sort columns of (column, "asc" | "desc") pairs, then the tiebreak columns."""
    named = [F.col(name).desc() if way == "desc" else F.col(name).asc() for name, way in order]
    taken = {name for name, _ in order}
    return named + [F.col(name).asc() for name in tiebreak if name not in taken]


def top_n(df: DataFrame, column: str, n: int, positive_only: bool = False) -> DataFrame:
    """The ``n`` largest rows of a journey table by one column."""
    kept = df.where(F.col(column) > 0) if positive_only else df
    return kept.orderBy(*sort_columns([(column, "desc")])).limit(n)


def bottom_n(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` smallest rows of a journey table by one column."""
    return df.orderBy(*sort_columns([(column, "asc")])).limit(n)


# Preset name -> sort order.
SORT_PRESETS = {
    "performance": [("orders_per_sent", "desc"), ("ctr", "desc")],
    "roi": [("roi", "desc")],
    "volume": [("sent", "desc"), ("orders", "desc")],
    "reset": [],
}


def sort_preset(summary: DataFrame, preset: str) -> DataFrame:
    return sort_custom(summary, SORT_PRESETS[preset])


def sort_custom(summary: DataFrame, order: Sequence[tuple[str, str]]) -> DataFrame:
    """Sort by any columns on their numeric values."""
    return summary.orderBy(*sort_columns(order))


def first_journeys(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` journeys by name."""
    return df.select("journey_name").distinct().orderBy("journey_name").limit(n)


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int = 25) -> DataFrame:
    """Page ``number`` (from 1) of a sorted table."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: its last sort key, and how many rows with that key were shown by then."""

    key: tuple
    seen: int


def _behind(column: Column, value: object, way: str) -> Column:
    """Rows behind a value in one sort column. Null is the smallest, as in Spark's sort."""
    if way == "desc":
        return F.lit(False) if value is None else (column < F.lit(value)) | column.isNull()
    return column.isNotNull() if value is None else column > F.lit(value)


def page_after(
    df: DataFrame, order: Sequence[tuple[str, str]], size: int = 25, cursor: Cursor | None = None
) -> DataFrame:
    """The page behind a cursor (the first without one) of a table sorted by (column, "asc" |
    "desc") pairs.

    Rows before the cursor are left out by a filter, so every task keeps about one page, however
    far on the page is. Pages agree with :func:`page` up to the order of rows with equal keys.
    """
    columns = [F.col(f"`{name}`") for name, _ in order]
    sort = [
        c.desc() if way == "desc" else c.asc()
        for c, (_, way) in zip(columns, order, strict=True)
    ]
    if cursor is None:
        return df.orderBy(*sort).limit(size)
    from_here, equal = F.lit(False), F.lit(True)
    for column, value, (_, way) in zip(columns, cursor.key, order, strict=True):
        from_here |= equal & _behind(column, value, way)
        equal &= column.eqNullSafe(F.lit(value))
    rows = df.where(from_here | equal).orderBy(*sort)
    return rows.limit(size + cursor.seen).offset(cursor.seen)


def cursor_after(
    rows: Sequence[Row], order: Sequence[tuple[str, str]], before: Cursor | None = None
) -> Cursor | None:
    """The cursor behind the rows of a page, given the cursor it was read with."""
    if not rows:
        return before
    keys = [tuple(row[name] for name, _ in order) for row in rows]
    seen = next((i for i, key in enumerate(reversed(keys)) if key != keys[-1]), len(keys))
    goes_on = before is not None and seen == len(keys) and before.key == keys[-1]
    return Cursor(keys[-1], seen + (before.seen if goes_on else 0))


def first_rows(summary: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a journey table by name, for tables without a ROI."""
    return summary.orderBy(TIEBREAK).limit(n)
