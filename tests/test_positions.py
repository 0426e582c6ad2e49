"""An index of positions against a sorted list, and how much of it a slice opens."""

import random
import re

import pytest

from emberlint.operators.positions import MOST_RANGES, OrderIndex
from emberlint.sources.tables import scratch_path


def _table(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(n // 2)]), k) for k in range(n)]
    return rows, spark.createDataFrame(rows, "key long, id long").repartition(5)


def test_slices(spark):
    rows, df = _table(spark, 400)
    index = OrderIndex.build(df, scratch_path(spark, "positions"), "key", "id", ranges=16)
    want = [r[1] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    for start, end in ((0, 1), (0, 400), (37, 120), (395, 500), (10, 10), (500, 600)):
        got = sorted((r.position, r.id) for r in index.slice(start, end).collect())
        assert got == [(k, want[k]) for k in range(start, min(end, 400))]
    assert sorted((r.position, r.id) for r in index.at([3, 399, 3, 1000]).collect()) == [(3, want[3]), (399, want[399])]
    assert sorted((r.batch, r.position, r.id) for r in index.batches(150).collect()) == [(k // 150, k, want[k]) for k in range(400)]


def test_a_slice_opens_few_files(spark):
    """The same slice of a table ten times as large, kept in ten times as many ranges, opens no more files."""
    opened = []
    for n, ranges in ((500, 10), (5000, 100)):
        index = OrderIndex.build(_table(spark, n)[1], scratch_path(spark, "positions"), "key", "id", ranges=ranges)
        plan = index.slice(200, 220)
        assert plan.count() == 20
        scan = plan._jdf.queryExecution().executedPlan().toString()
        opened.append(len({r[0] for r in plan.selectExpr("input_file_name()").collect()}))
        assert re.search(r"PartitionFilters: \[[^\]]*_range", scan)
    assert opened[1] <= opened[0] + 1 <= 4


def test_equal_keys_and_empty(spark):
    df = spark.createDataFrame([(1, k) for k in range(50)], "key long, id long")
    index = OrderIndex.build(df, scratch_path(spark, "positions"), "key", ranges=4)
    whole = [r.id for r in index.slice(0, 50).orderBy("position").collect()]
    assert sorted(whole) == list(range(50)) and [r.id for r in index.slice(7, 9).orderBy("position").collect()] == whole[7:9]
    with pytest.raises(ValueError, match="ranges"):
        OrderIndex.build(df, "nowhere", "key", ranges=MOST_RANGES + 1)
