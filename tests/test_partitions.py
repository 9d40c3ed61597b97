"""Tasks of histories hold a bounded number of rows, however many there are."""

import pytest
from pyspark.sql import functions as F

from backtrail.operators import labels as y
from backtrail.operators.history import History, Past
from backtrail.operators.sequences import pool_vector_context


@pytest.fixture
def small(spark):
    bounds = {"backtrail.rows.per.partition": 20, "backtrail.rows.per.global.task": 40, "backtrail.rows.per.range.task": 60}
    for name, value in bounds.items():
        spark.conf.set(name, str(value))
    yield spark
    for name in bounds:
        spark.conf.unset(name)


def test_partitions_of_entities_grow_with_the_rows(small):
    for rows in (200, 800):
        h = History.of(small.range(rows).selectExpr("id", "id % 50 AS k"), "k", ["id"])
        assert h.heavy is None and h.light.rdd.getNumPartitions() == rows // 20
        got = {r["id"]: r["n"] for r in h.past(n=Past.count()).frame().collect()}
        assert got == {i: i // 50 for i in range(rows)}


def test_empty_and_null_keys(small):
    none = small.range(0).selectExpr("id", "id AS k")
    assert History.of(none, "k", ["id"]).past(n=Past.count()).frame().count() == 0
    nulls = small.range(300).selectExpr("id", "CAST(NULL AS bigint) AS k")
    h = History.of(nulls, "k", ["id"], 100)
    assert h.light is not None and h.blocks == 3
    assert sorted(r["n"] for r in h.past(n=Past.count()).frame().collect()) == list(range(300))


def test_running_priors_take_one_block_a_task(small):
    df = small.range(1000).selectExpr("id AS event_id", "id AS sec", "id % 7 AS k", "CAST(id % 5 = 0 AS int) AS is_red_lbl", "CAST(id % 5 < 2 AS int) AS is_labeled_fb")
    found = y.running_priors(df, ["sec", "event_id"], ("k",))
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert found.rdd.getNumPartitions() == 25 and max(r["count"] for r in sizes) <= 80
    for r in found.collect():
        past = [i for i in range(r["event_id"]) if i % 7 == r["k"]]
        want = (sum(i % 5 == 0 for i in past) + 0.25) / (sum(i % 5 < 2 for i in past) + 2.0)
        assert r["prior_k_red_rate"] == pytest.approx(want)


def test_devices_are_cut_at_the_lower_bound(small, monkeypatch):
    made, of = [], History.of
    monkeypatch.setattr(y.History, "of", staticmethod(lambda *a: made.append(of(*a)) or made[-1]))
    df = small.range(200).selectExpr(
        "id AS event_id", "id AS sec", "CAST(id % 10 = 0 AS bigint) AS device_fp_i", "id % 9 AS customer_id", "id % 11 AS session_id",
        "id % 2 AS event_desc", "id % 3 AS mcc_code_i", "1 AS timezone", "id % 4 AS channel_indicator_sub_type")
    got = {r["event_id"]: r for r in y.device_history(df, ["sec", "event_id"]).collect()}
    assert made[0].heavy is not None and made[0].blocks == 3
    for i, r in got.items():
        past = [k for k in range(i) if (k % 10 == 0) == (i % 10 == 0)]
        assert r["device_prev_ops"] == len(past)
        assert r["device_prev_unique_customers"] == len({k % 9 for k in past})
        assert r["device_prev_unique_sessions"] == len({k % 11 for k in past})
        assert r["device_prev_same_mcc"] == sum(k % 3 == i % 3 for k in past)


def test_pooled_vectors_are_not_sorted(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, [1.0, 2.0])], "event_id long, customer_id long, sec long, session_id long, v array<double>")
    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    try:
        out = pool_vector_context(History.of(df, "customer_id", ["sec", "event_id"]), "v", 2, {"past": F.lit(True)}, (2, 5)).frame()
        lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    first = next(i for i, line in enumerate(lines) if "Window [" in line)
    assert "v_past_2_mean" in "".join(lines[:first]) and "_mean" not in "".join(lines[first:])
