import random

import pytest
from pyspark.sql import Window, functions as F

from ordermill.operators import runs


@pytest.fixture
def skewed(spark):
    source = random.Random(11)
    rows = []
    for i in range(3000):
        key = None if i % 50 == 0 else ("hot" if source.random() < 0.5 else f"k{source.randrange(40)}")
        rows.append((key, source.randrange(200), i, source.choice(("x", "y", None))))
    return spark.createDataFrame(rows, "k string, at int, id long, v string").repartition(6)


@pytest.mark.parametrize("backwards", [False, True])
@pytest.mark.parametrize("batch", [10_000, 7])
def test_runs_equal_a_window(spark, many_partitions, skewed, backwards, batch, rows):
    wanted = {"other_v": "v", "other_at": "at"}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        split = runs.previous_values(skewed, ["k"], ["at", "id"], wanted, backwards=backwards)
        found = rows(split)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = [F.col(c).desc_nulls_last() if backwards else F.col(c).asc_nulls_first() for c in ("at", "id")]
    window = Window.partitionBy("k").orderBy(*order)
    expected = skewed.withColumns({new: F.lag(old).over(window) for new, old in wanted.items()})
    assert split.columns == expected.columns
    assert found == rows(expected)


def test_rows_before_need_no_second_exchange(skewed):
    split = runs.previous_values(skewed, ["k"], ["at", "id"], {"other_v": "v"})
    plan = split._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # Only the borders are combined: one row per run.
    assert all(runs.RUN in line and "k#" not in line for line in wide)


def test_runs_split_a_large_key(spark, many_partitions, skewed):
    split = runs.range_runs(skewed, ["k"], ["at", "id"])
    sizes = {r[runs.RUN]: r["count"] for r in split.groupBy(runs.RUN).count().collect()}
    assert len(sizes) == 4 and max(sizes.values()) < 1500
    assert split.where("k = 'hot'").select(runs.RUN).distinct().count() > 1


def test_numbers_are_dense_and_ordered(spark, many_partitions, skewed):
    numbered = runs.numbered_rows(skewed, ["at", "id"], "n", start=10)
    found = sorted((r.n, r.at, r.id) for r in numbered.collect())
    assert [n for n, _, _ in found] == list(range(11, 3011))
    assert [(at, id) for _, at, id in found] == sorted((at, id) for _, at, id in found)
