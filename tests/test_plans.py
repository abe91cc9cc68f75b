"""Physical plans keep the properties that matter on large tables."""

import contextlib
import io
import re

import pytest

from dripline.operators import aggregates as agg, filters
from dripline.operators.filters import FilterSpec
from dripline.sources import combine, sinks
from dripline.sources.star import campaign_fact
from verification import star_queries
from verification.star_queries import CONFIG, QUERIES, SELECTION, dedupe_latest

# These write and read their own files, so their last plan is only the read.
EAGER = {"write_combined", "incremental_combine"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_dedupe_drops_rows_before_the_shuffle(spark, sf_dir):
    text = plan(dedupe_latest(spark, sf_dir))
    partial = text.index("WindowGroupLimit", text.index("Final"))
    assert "Final" in text and "Partial" in text[partial:]
    assert text.index("Final") < text.index("hashpartitioning(campaign_id") < text.index("Partial")


def test_top_n_needs_no_full_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_roi_10"](spark, sf_dir))


def test_unused_columns_are_not_read(spark, sf_dir):
    text = plan(agg.channel_volume(campaign_fact(spark, sf_dir)))
    lines = next(schema for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "l_orderkey" in schema)
    assert "l_extendedprice" not in lines and "l_shipdate" not in lines
    assert "c_mktsegment" not in text


def test_filters_reach_the_scan(spark, sf_dir, tmp_path):
    path = str(tmp_path / "fact")
    sinks.write_by_month(campaign_fact(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    text = formatted(filters.apply_filters(stored, SELECTION, CONFIG))
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    for column in ("journey_name", "channel", "status", "day"):
        assert column in pushed
    assert "report_month" in re.search(r"PartitionFilters: (.*)", text).group(1)
    # The user-type filter is stated on the journey, so no join is left in the plan.
    assert "Join" not in text
    empty = filters.apply_filters(stored, FilterSpec(journeys=[]), CONFIG)
    assert "Scan parquet" not in plan(empty)
    assert filters.apply_filters(stored, SELECTION, CONFIG).count() == (
        filters.apply_filters(campaign_fact(spark, sf_dir), SELECTION, CONFIG).count()
    )


def test_totals_need_one_aggregate_and_no_price_join(spark, sf_dir):
    text = plan(agg.journey_summary(campaign_fact(spark, sf_dir), CONFIG))
    assert text.count("Scan parquet") == 3 and text.count("Join") == 2
    assert text.count("hashpartitioning(journey_name") == 1


def test_combined_sort_key_ends_in_row_position():
    names = ["Campaign ID", "Day", "_source_ts", "_source_rank", "_source_block", "_source_row"]
    assert len(combine.chronological(names)) == 5


def test_report_files_shuffle_stored_numbers(spark, sf_dir):
    reported = star_queries._reported(spark, sf_dir, lambda lines: lines.repartition("l_partkey", "day"))
    text = plan(reported.where("source = 'A'").select("campaign_id", "day", "sent", "delivered"))
    above, dealt = text.split("hashpartitioning(l_partkey", 1)
    assert "concat(C" in above and "concat(C" not in dealt
    assert "l_returnflag" in dealt and "IsNotNull(l_returnflag)" in dealt
