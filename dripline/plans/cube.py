"""A stored additive cube that answers dashboard tabs and report sections instead of report rows.

The cube holds the volume sums and the number of report rows per journey, channel, status and day.
Its columns have the names of the report rows, so every filter and every aggregate takes it in
place of them, with the same results: sums are sums of sums, and ``campaign_rows`` is counted in
place of rows. Days keep their time, so that date filters cut where they cut the rows. What needs
single campaigns (row metrics, campaign details) needs the report rows.

The cube is stored by months and switches versions like the combined table. :func:`refresh_cube`
reads only the months of a combined table whose folders have changed since the cube's version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dripline.operators.aggregates import CAMPAIGN_ROWS
from dripline.operators.rows import clean_numeric, clean_strings, parse_days
from dripline.schema import MONTH, VOLUME_NAMES
from dripline.sources import versions
from dripline.sources.combine import drop_provenance, render_dates
from dripline.sources.reports import standardize
from dripline.sources.sinks import with_month
from dripline.sources.versions import Version
from dripline.streaming.versioned import write_months

CUBE_KEYS = ("journey_name", "channel", "status", "day")


def cube_of(fact: DataFrame) -> DataFrame:
    """The cube of report rows; a volume that the reports lack counts as 0. The month, where the
    rows have one, stays."""
    keys = [*CUBE_KEYS, *([MONTH] if MONTH in fact.columns else [])]
    sums = [
        F.sum(name).alias(name) if name in fact.columns else F.lit(0.0).alias(name)
        for name in VOLUME_NAMES
    ]
    return fact.groupBy(*keys).agg(F.count(F.lit(1)).alias(CAMPAIGN_ROWS), *sums)


def store_cube(fact: DataFrame, root: str) -> Version:
    """The cube of a whole table of report rows, in place of the one below ``root``."""
    rows = with_month(fact)

    def build(_: Version) -> Version:
        return Version(0, write_months(cube_of(rows), root))

    return versions.change(fact.sparkSession, root, build)


def refresh_cube(spark: SparkSession, root: str, combined: str) -> Version:
    """Bring the cube to the latest version of the combined table at ``combined``.

    Returns the version that is there if nothing has changed.
    """
    source = versions.latest(spark, combined)

    def build(base: Version) -> Version | None:
        known = base.notes.get("source", {})
        changed = {x: y for x, y in source.folders.items() if known.get(x) != y}
        kept = {x: y for x, y in base.folders.items() if source.folders.get(x) == known.get(x, "")}
        if not changed and kept == base.folders:
            return None
        notes = {"source": source.folders}
        if not changed:
            return Version(0, kept, notes)
        rows = versions.read(spark, combined, Version(0, changed))
        texts = standardize(drop_provenance(render_dates(rows)))
        fact = parse_days(clean_strings(clean_numeric(texts)))
        return Version(0, {**kept, **write_months(cube_of(fact), root)}, notes)

    return versions.change(spark, root, build)


def current_cube(spark: SparkSession, root: str) -> DataFrame:
    """The cube as it was stored last; a date filter reads the months it needs only."""
    found = versions.read(spark, root)
    if found is None:
        raise FileNotFoundError(f"no cube was written to {root}")
    return found
