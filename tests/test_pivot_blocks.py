"""Pivots in blocks of channels: every cell, for any number of channels."""

import pytest

from dripline.config import MetricConfig
from dripline.operators import reshape
from dripline.operators.aggregates import journey_channel_totals
from dripline.plans import pivot_blocks as blocks

CONFIG = MetricConfig()

SCHEMA = """journey_name string, channel string, sent bigint, delivered bigint,
  unique_clicks bigint, ct_conversions bigint"""


def _rows(spark, data):
    return spark.createDataFrame([(j, c, n, n // 2, n // 4, n // 8) for j, c, n in data], SCHEMA)


def test_many_channels_give_all_cells(spark, tmp_path):
    data = [(f"j{i % 7}", f"channel {i % 5_000:05d}", i) for i in range(0, 30_000, 3)]
    data += [(f"hot {i % 2}", "Email", 5) for i in range(3_000)]
    fact = _rows(spark, data)
    root = str(tmp_path / "pivot")
    blocks.write_pivot_blocks(fact, CONFIG, root)
    assert blocks.block_count(spark, root) == 51
    wanted = {
        (r["journey_name"], r["channel"]): tuple(r[m] for m in reshape.PIVOT_METRICS)
        for r in journey_channel_totals(fact, CONFIG).collect()
    }
    found = {}
    for row in blocks.pivot_cells(spark, root).collect():
        key = row["journey_name"], row["channel"]
        assert key not in found
        found[key] = tuple(row[m] for m in reshape.PIVOT_METRICS)
    assert {k: v for k, v in found.items() if any(v)} == {k: v for k, v in wanted.items() if any(v)}
    # Names are in order over the blocks.
    names = [blocks.pivot_block(spark, root, "sent", b).columns[1:-1] for b in (0, 1, 50)]
    assert [len(x) for x in names] == [100, 100, 1]
    assert names[0] + names[1] == sorted(names[0] + names[1]) and names[0][0] == "Email"


@pytest.mark.parametrize("width", [1, 2, 100])
def test_blocks_equal_the_wide_table(spark, tmp_path, width):
    data = [("a", "Email", 8), ("a", "SMS", 16), ("b", "Push", 24), ("b", None, 40), (None, "SMS", 8)]
    fact = _rows(spark, [*data, *data])
    root = str(tmp_path / "pivot")
    blocks.write_pivot_blocks(fact, CONFIG, root, width)
    wide = reshape.channel_pivots(fact, CONFIG, ["Email", "Push", "SMS"])
    for metric in reshape.PIVOT_METRICS:
        joined = {}
        for block in range(blocks.block_count(spark, root)):
            for row in blocks.pivot_block(spark, root, metric, block).collect():
                joined.setdefault(row["journey_name"], {}).update(row.asDict())
        assert joined == {r["journey_name"]: r.asDict() for r in wide[metric].collect()}


def test_names_that_differ_by_case_and_tables_without_rows(spark, tmp_path):
    root = str(tmp_path / "pivot")
    blocks.write_pivot_blocks(_rows(spark, [("a", "email", 8), ("a", "EMAIL", 16)]), CONFIG, root)
    cells = {r["channel"]: r["sent"] for r in blocks.pivot_cells(spark, root).collect()}
    assert cells == {"email": 8.0, "EMAIL": 16.0}
    blocks.write_pivot_blocks(_rows(spark, []), CONFIG, root)
    assert blocks.block_count(spark, root) == 0
    assert blocks.pivot_cells(spark, root).count() == 0
    with pytest.raises(ValueError, match="at least one"):
        blocks.write_pivot_blocks(_rows(spark, []), CONFIG, root, 0)
    with pytest.raises(ValueError, match="unknown metric"):
        blocks.pivot_block(spark, root, "roi", 0)
