"""The search for weights with several groups and blocks, against sorting all rows per weighting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from backtrail.operators import weights as w


def _plain(rows, weights):
    s = np.array([sum(x * k for x, k in zip(r[1:], weights)) for r in rows])
    y = np.array([r[0] for r in rows])
    return float(np.mean([(y[s >= v].sum()) / (s >= v).sum() for v in s[y == 1]])) if y.any() else None


@pytest.mark.parametrize("good", [True, False])
def test_counts_stay_in_their_task(spark, monkeypatch, good):
    monkeypatch.setattr(w, "BLOCK_ROWS", 20)
    monkeypatch.setattr(w, "TOGETHER", 50)
    monkeypatch.setattr(w, "HELD_BYTES", 4 * 40)  # one weighting a task
    monkeypatch.setattr(w, "MOST_UINT32", 100)
    rows = [(int(good and i % 9 == 0), (i * 37 % 101) / 101, (i * 11 % 7) / 7) for i in range(300)]
    grid = np.array([[k / 40, 1 - k / 40] for k in range(41)])
    df = spark.createDataFrame(rows, "y int, a double, b double")
    found = w.search_blocks(df.repartition(3), ["a", "b"], "y", grid)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "InPandas" not in plan  # the rows' own and one copy per group: no counts
    got = {r["id"]: r["ap"] for r in found.collect()}
    assert sorted(got) == list(range(41))
    for i, weights in enumerate(grid):
        want = _plain(rows, weights)
        assert got[i] is None if want is None else got[i] == pytest.approx(want, abs=1e-9)


def test_groups_grow_with_the_counts(spark, monkeypatch):
    df = spark.createDataFrame([(1, float(i)) for i in range(100)], "y int, a double").withColumn("b", F.lit(0.5))
    grid = np.array([[k / 200, 1 - k / 200] for k in range(201)])
    partitions = lambda: w.search_blocks(df, ["a", "b"], "y", grid).rdd.getNumPartitions()
    assert partitions() == 4 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(w, "HELD_BYTES", 4 * 100 * 3)  # three weightings a task
    assert partitions() == 67
