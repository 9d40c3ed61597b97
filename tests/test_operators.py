"""Scores, percentiles, priors, codes, folds and heads on small hand-checked tables."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from backtrail.functions import fields as f
from backtrail.functions import measures as m
from backtrail.operators import folds as fd
from backtrail.operators import joins as j
from backtrail.operators import labels as y
from backtrail.operators import quality as q
from backtrail.operators import rows as rw
from backtrail.operators import scoring as s


@pytest.fixture
def five(spark):
    return spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.9), (3, 1, 0.5), (4, 0, 0.4), (5, 1, 0.4)], "event_id long, y int, p double")


def test_average_precision_with_ties(five):
    assert s.average_precision(five, "y", "p").first()["ap"] == pytest.approx(1 / 6 + 2 / 9 + 1 / 5)


def test_average_precision_without_positives(five):
    assert s.average_precision(five.withColumn("y", F.lit(0)), "y", "p").first()["ap"] is None


def test_average_precision_equals_its_definition(spark):
    rows = [(i, int(i * 7 % 5 == 0), (i * 37 % 23) / 23.0) for i in range(80)]
    got = s.average_precision(spark.createDataFrame(rows, "event_id long, y int, p double"), "y", "p").first()["ap"]
    total, want = sum(r[1] for r in rows), 0.0
    for _, hit, score in rows:
        above = [r for r in rows if r[2] >= score]
        want += hit * sum(r[1] for r in above) / len(above) / total
    assert got == pytest.approx(want)


def test_rank_normalised(five):
    got = {r["event_id"]: r["p_rank"] for r in s.rank_normalised(five, ["p"]).collect()}
    assert got == pytest.approx({1: 0.75, 2: 0.75, 3: 0.5, 4: 0.25, 5: 0.25})


def test_weight_grid_covers_the_simplex(five):
    grid = s.weight_grid(five.withColumn("a", F.col("p")).withColumn("b", F.col("p")), ["p", "a", "b"], 4)
    assert grid.count() == 5 * 15
    assert grid.filter("abs(w_p + w_a + w_b - 1) > 1e-9 or abs(blend - p) > 1e-9").count() == 0


@pytest.mark.parametrize("heavy", [False, True])
def test_percentiles_are_exact(spark, request, heavy):
    if heavy:
        request.getfixturevalue("tight")
    rows = [(i % 3, float(i * 31 % 101)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: (r["mid"], r["p95"]) for r in q.percentiles(df, ["k"], "v", {"mid": 0.5, "p95": 0.95}).collect()}
    for k in range(3):
        v = sorted(b for a, b in rows if a == k)
        place = 0.95 * (len(v) - 1)
        low = int(place)
        p95 = v[low] + (v[low + 1] - v[low]) * (place - low)
        assert got[k] == pytest.approx((statistics.median(v), p95))


def test_prior_smoothing(spark):
    events = spark.range(100).selectExpr("id as event_id", "'train' as period", "timestamp'2025-01-01' as event_ts", "5 as k")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 0)], "event_id long, target int")
    row = y.prior_table(events, labels, ["k"]).first()
    assert tuple(row)[2:] == pytest.approx((4 / 300, 5 / 300, 4 / 6))


def test_codes(spark):
    one = spark.range(1)
    def value(column):
        return one.select(column.alias("v")).first()["v"]

    assert [value(m.amount_bucket(F.lit(a))) for a in (0.0, 100.0, 1e9)] == [0, 18, 63]
    codes = [value(f.battery_code(F.lit(t).cast("string"))) for t in (None, "NaN%", "not available", ":57%", "57%")]
    assert math.isnan(codes[0]) and codes[1:] == [-2, -1, 57, 57]
    versions = [(value(f.version_number(F.lit(t).cast("string"))), value(f.version_parts(F.lit(t).cast("string")))) for t in (None, "9", "12.3", "12.3.4")]
    assert versions == [(0, 0), (90000, 1), (120300, 2), (120304, 3)]
    assert value(f.device_number(F.lit(1), F.lit(2), F.lit(3), F.lit(-1))) == 100_203_999
    assert value(m.weekend(F.lit("2025-04-04").cast("timestamp"))) == 1


def test_category_codes(spark):
    fit = spark.createDataFrame([(3,), (7,), (9,)], "c int")
    rows = spark.createDataFrame([(7,), (4,), (9,)], "c int")
    assert [r["c_code"] for r in fd.encode(rows, fit, ["c"]).orderBy("c").collect()] == [1, 3, 4]


def test_month_spans():
    spans = fd.month_spans("2025-02-01", "2025-04-15", "2024-12-01", 1)
    assert spans == [("f0", "2025-01-01", "2025-02-01", "2025-03-01"), ("f1", "2025-02-01", "2025-03-01", "2025-04-01"), ("f2", "2025-03-01", "2025-04-01", "2025-04-15")]


def test_one_day_per_customer(spark):
    df = spark.range(200).selectExpr("id as event_id", "id % 7 as customer_id", "timestamp_seconds(1735689600 + id * 3600) as event_ts")
    got = fd.one_day_per_customer(df, "2025-01-02", "2025-01-08")
    days = got.groupBy("customer_id").agg(F.countDistinct(F.to_date("event_ts")).alias("n")).collect()
    assert len(days) == 7 and all(r["n"] == 1 for r in days)


def test_template_gaps_take_the_median(spark, five):
    out = {r["event_id"]: r["predict"] for r in j.fill_template(spark.range(1, 8).withColumnRenamed("id", "event_id"), five.withColumnRenamed("p", "predict")).collect()}
    assert len(out) == 7 and out[7] == pytest.approx(0.5)


def test_kept_row_knows_it_had_copies(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "event_id long, n int, t string")
    got = {r["event_id"]: (r["t"], r["duplicated_event"]) for r in rw.keep_last_and_flag(df, "event_id", ["n"]).collect()}
    assert got == {1: ("b", 1), 2: ("c", 0)}


def test_missing_positions_are_an_error(spark):
    with pytest.raises(ValueError):
        j.require_all(spark.range(5).withColumnRenamed("id", "event_id"), spark.range(3).withColumnRenamed("id", "event_id"))


def test_boosted_head_beats_the_positive_rate(spark):
    from conftest import FOLDER

    from __spark_entry__ import queries

    row = queries()["head_quality"](spark, FOLDER.replace("0.001", "0.01")).first()
    assert row["ap"] > row["positive_rate"]


def test_feature_table_has_the_sampled_rows_and_all_columns(spark):
    from conftest import FOLDER

    from __spark_entry__ import queries
    from backtrail.operators.feature_table import FEATURE_COLUMNS, META_COLUMNS

    table = queries()["feature_table"](spark, FOLDER)
    assert table.columns == [*META_COLUMNS, *FEATURE_COLUMNS] and len(FEATURE_COLUMNS) == 119
    rows = {r["event_id"]: r for r in table.collect()}
    assert set(rows) == {r["event_id"] for r in queries()["sampled_rows"](spark, FOLDER).collect()}
    for name, column in (("gap_since_same_value", "sec_since_prev_same_desc"), ("label_history_counts", "cust_prev_red_lbl_cnt"),
                         ("signed_velocity_windows", "amt_sum_last_24h"), ("past_amount_moments", "cust_prev_amt_mean")):
        for r in queries()[name](spark, FOLDER).collect():
            if r["event_id"] in rows:
                assert rows[r["event_id"]][column] == pytest.approx(r[column], abs=1e-5)


def test_ranks_read_the_rows_as_often_for_five_scores_as_for_one(spark):
    def parts(k):
        rows = spark.range(50).select("id", *[(F.xxhash64("id", F.lit(i)) % 7).cast("double").alias(f"s{i}") for i in range(k)])
        plan = s.rank_normalised(rows, [f"s{i}" for i in range(k)])._jdf.queryExecution().executedPlan().toString()
        return plan.count("Range ("), plan.count("Exchange")

    assert parts(5) == parts(1)


def test_ranks_with_null_scores_and_groups(spark):
    rows = [(1, "a", 0.5, None), (2, "a", 0.5, 2.0), (3, "a", None, 1.0), (4, "b", 0.1, 2.0), (5, None, 0.3, 9.0)]
    got = {r.id: (r.s_rank, r.t_rank) for r in s.rank_normalised(spark.createDataFrame(rows, "id int, g string, s double, t double"), ["s", "t"], by=["g"], extra=0).collect()}
    # nulls have no rank, but come first in the order of the others
    assert got == {1: (2.5 / 3, None), 2: (2.5 / 3, 1.0), 3: (None, 2 / 3), 4: (1.0, 1.0), 5: (None, None)}
