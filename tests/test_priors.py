"""Priors of several keys from one scan, and running priors whose keys share one shuffle."""

import pytest
from pyspark.sql import functions as F

from backtrail.operators import labels as y

SETS = [("a",), ("b",), ("a", "b")]


@pytest.fixture
def rows(spark):
    """Three values of a, two of b with nulls; every fifth row labelled, some of them red."""
    made = [(i, "train", i % 3, None if i % 4 == 0 else i % 2, i * 7 % 40, int(i % 5 == 0), int(i % 15 == 0)) for i in range(160)]
    schema = "event_id long, period string, a int, b int, sec long, is_labeled_fb int, is_red_lbl int"
    return spark.createDataFrame(made, schema).withColumn("event_ts", F.timestamp_seconds("sec"))


def _labels(rows):
    return rows.filter("is_labeled_fb = 1").select("event_id", F.col("is_red_lbl").alias("target"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_one_scan_equal_single_tables(rows):
    together = y.prior_tables(rows, _labels(rows), SETS)
    for keys in SETS:
        single = y.prior_table(rows, _labels(rows), list(keys))
        assert together[keys].columns == single.columns
        assert sorted(map(str, together[keys].collect())) == sorted(map(str, single.collect()))


@pytest.mark.parametrize("heavy", [False, True])
def test_attached_together_equal_attached_singly(rows, request, heavy):
    if heavy:
        request.getfixturevalue("tight")
    labels = _labels(rows)
    got = y.attach_all_priors(rows, rows, labels, SETS)
    want = y.attach_priors(rows, {k: y.prior_table(rows, labels, list(k)) for k in SETS})
    names = ["event_id", *[c for c in want.columns if c.startswith("prior_")]]
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect()))


def test_empty_events_give_empty_priors(rows):
    none = rows.limit(0)
    assert all(t.isEmpty() for t in y.prior_tables(none, _labels(none), SETS).values())


@pytest.mark.parametrize("heavy", [False, True])
def test_running_priors_equal_their_definition(rows, request, heavy):
    if heavy:
        request.getfixturevalue("tight")
    data = sorted((r.asDict() for r in rows.collect()), key=lambda r: (r["sec"], r["event_id"]))
    got = {r["event_id"]: r for r in y.running_priors(rows, ["sec", "event_id"], ("a", "b")).collect()}
    assert len(got) == len(data)
    for i, r in enumerate(data):
        for key in ("a", "b"):
            earlier = [e for e in data[:i] if e[key] == r[key]]
            want = (sum(e["is_red_lbl"] for e in earlier) + 0.25) / (sum(e["is_labeled_fb"] for e in earlier) + 2.0)
            assert got[r["event_id"]][f"prior_{key}_red_rate"] == pytest.approx(want)


def test_keys_share_one_shuffle_of_whole_rows(tight, rows):
    wide = rows.withColumn("payload", F.repeat(F.lit("x"), 20))
    one = _plan(y.running_priors(wide, ["sec", "event_id"], ("a",)))
    two = _plan(y.running_priors(wide, ["sec", "event_id"], ("a", "b")))
    assert two.count("Exchange ") == one.count("Exchange ")
    assert two.count("Exchange hashpartitioning(_block") == one.count("Exchange hashpartitioning(_block")
