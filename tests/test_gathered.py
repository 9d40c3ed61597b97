"""Features of many steps in one pass over a partition: the same values as the windows of the steps, for odd rows too."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from backtrail.functions import fields
from backtrail.operators import features as x
from backtrail.operators import labels as y
from backtrail.operators.gathered import together
from backtrail.operators.history import History, Past, Within

STEPS = [
    x.amount_moments, x.amount_positions, x.event_gap, x.account_age, x.active_days, x.previous_values, x.signed_velocity,
    y.label_gaps, x.session_position, x.today_counts, x.same_counts, y.label_counts, y.label_rates, lambda h: x.same_gaps(h, ("type", "desc")),
]


@pytest.fixture(scope="module")
def rows(spark):
    """400 events of seven customers, the null one among them, with ties in time and nulls in every column that a step reads."""
    random = np.random.default_rng(8)
    n = 400
    null = lambda v, share: None if random.random() < share else v
    data = [
        (i, null(int(random.integers(6)), 0.1), null(int(1704067200 + random.integers(0, 400_000) // 50 * 50), 0.05), null(int(random.integers(-(10**9), 10**9)), 0.2),
         *[null(int(random.integers(3)), 0.1) for _ in range(7)], int(random.integers(2)), int(random.integers(2)))
        for i in range(n)
    ]
    codes = ["event_type_nm", "event_desc", "mcc_code_i", "channel_indicator_sub_type", "channel_indicator_type", "currency_iso_cd", "device_fp_i"]
    schema = "event_id long, customer_id long, sec long, cents long, " + ", ".join(f"{c} int" for c in codes) + ", is_red_lbl int, is_yellow_lbl int"
    df = spark.createDataFrame(data, schema)
    return df.withColumns({
        "event_ts": F.timestamp_seconds("sec"), "amt": F.col("cents") / 100.0, "session_id": F.col("event_desc").cast("long"),
        "is_labeled_fb": F.col("is_red_lbl") + F.col("is_yellow_lbl"), "wanted": F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 2 == 0),
    }).repartition(3).cache()


def plain(df):
    frame = df.toPandas().sort_values("event_id")[sorted(df.columns)]
    text = lambda v: "null" if v is None or v != v else f"{v:.12g}" if isinstance(v, float) else str(v)
    return [[text(v) for v in r] for r in frame.itertuples(index=False)]


@pytest.mark.parametrize("limit", [10_000, 40])
def test_values_are_those_of_the_windows(rows, limit):
    h = History.of(rows, "customer_id", ["sec", "event_id"], limit)
    want = h
    for step in STEPS:
        want = step(want)
    got, want = together(h, STEPS, F.col("wanted")).frame(), want.frame().filter("wanted")
    assert sorted(f"{f.name} {f.dataType.simpleString()}" for f in got.schema) == sorted(f"{f.name} {f.dataType.simpleString()}" for f in want.schema)
    assert plain(got) == plain(want)


def test_active_days_by_the_two_ways(rows):
    h = History.of(rows, "customer_id", ["sec", "event_id"])
    found = x.active_days(h).frame().filter("sec IS NOT NULL AND customer_id = 1").toPandas().sort_values(["sec", "event_id"])
    days, seen = found["event_ts"].dt.date, set()
    for day, n in zip(days, found["cust_active_days"]):
        seen.add(day)
        assert n == len(seen) - 1


def test_a_value_made_of_features_takes_a_second_pass(rows):
    steps = [lambda h: h.past(before=Past.count()), lambda h: h.past(total=Past.sum(F.col("before")), top=Past.max("before", "event_desc", current=True))]
    h = History.of(rows, "customer_id", ["sec", "event_id"])
    want = steps[1](steps[0](h)).frame()
    assert plain(together(h, steps, F.lit(True)).frame()) == plain(want)


def test_one_shuffle_and_no_sort(rows):
    h = History.of(rows, "customer_id", ["sec", "event_id"])
    plan = together(h, STEPS, F.col("wanted")).frame()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan and plan.count("MapInArrow") == 1


def test_large_amounts_are_summed_exactly(spark):
    rows = spark.createDataFrame([(i, 1, 3 * 10**17 + i) for i in range(6)], "event_id long, customer_id long, cents long").withColumn("sec", F.col("event_id"))
    square = lambda h: h.past(squares=Past.sum(F.col("cents").cast("decimal(18,0)") * F.col("cents").cast("decimal(18,0)")))
    found = together(History.of(rows, "customer_id", ["sec", "event_id"]), [square], F.lit(True)).frame().orderBy("event_id").collect()
    assert [int(r["squares"]) for r in found] == [sum((3 * 10**17 + k) ** 2 for k in range(i)) for i in range(6)]


def test_windows_reach_back_as_far_as_their_seconds(spark):
    rows = spark.createDataFrame([(i, c, t, v) for c in (1, 2) for i, (t, v) in enumerate([(0, 5), (10, 7), (10, 1), (20, None), (3600, 2)])], "event_id long, customer_id long, sec long, v long")
    step = lambda h: h.within(n=Within.count(10), s=Within.sum("v", 10), m=Within.max("v", 3600))
    for r in together(History.of(rows, "customer_id", ["sec", "event_id"]), [step], F.lit(True)).frame().collect():
        want = {0: (0, 0, None), 10: (1, 5, 5), 20: (2, 8, 7), 3600: (0, 0, 7)}[r["sec"]]
        assert (r["n"], r["s"], r["m"]) == want


def test_texts_that_are_no_numbers_are_told_without_a_cast(spark):
    texts = ["12", " 7 ", "+5", "-3", "", "ru-RU,ru;q=0.9", "en-US", "1.5", "*", "99999999999", None, "4\n", "1e3", "٣", "true"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(fields.int_or("t").alias("got"), F.coalesce(F.col("t").try_cast("int"), F.lit(-1)).alias("want")).collect()
    assert [r["got"] for r in found] == [r["want"] for r in found]
    assert spark.sql("SELECT true AS b, CAST('NaN' AS DOUBLE) AS d, 3 AS i").select(fields.int_or("b"), fields.int_or("i"), fields.int_or(F.lit(None).cast("string"))).first()[:] == (1, 3, -1)
    assert spark.createDataFrame([("x7",), ("a",), ("99999999999",)], "t string").select(fields.extract_int("t", r"(\d+)")).collect() == [(7,), (-1,), (-1,)]
    assert not math.isnan(spark.sql("SELECT '5%' AS b").select(fields.battery_percent("b")).first()[0])
