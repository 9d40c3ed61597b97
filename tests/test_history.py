"""Hand-worked rows, causality, and both ways of a history on random tables."""

import random

import pytest
from pyspark.sql import functions as F

from backtrail.operators import features as x
from backtrail.operators import labels as y
from backtrail.operators.history import History, Past, Within
from backtrail.operators.joins import asof_join
from backtrail.operators.lookups import heavy_keys, spread_join

ORDER = ["sec", "event_id"]


def values(df, *names):
    return {r["event_id"]: tuple(r[n] for n in names) for r in df.select("event_id", *names).collect()}


def test_seven_rows(seven):
    h = x.signed_velocity(x.same_counts(x.event_gap(x.amount_moments(x.event_count(History.of(seven, "customer_id", ORDER)))), {"desc": "event_desc"}))
    h = x.as_of_velocity(h, {"60min": 3600})
    found = values(h.frame(), "cust_prev_events", "cust_prev_max_amt", "sec_since_prev_event", "cnt_prev_same_desc",
                   "amt_sum_last_1h", "cnt_last_1h", "cnt_last_24h", "max_amt_last_24h", "events_last_60min")
    assert found == {
        1: (0, 0.0, -1, 0, 0.0, 0, 0, 0.0, 0), 2: (1, 100.0, 1800, 1, 100.0, 1, 1, 100.0, 1),
        3: (2, 100.0, 1800, 0, 50.0, 2, 2, 100.0, 1), 4: (3, 100.0, 0, 2, 50.0, 2, 2, 100.0, 2),
        5: (4, 200.0, 1800, 1, 220.0, 3, 4, 200.0, 2), 6: (5, 1000.0, 82800, 3, 0.0, 0, 4, 1000.0, 0),
        7: (6, 1000.0, 214200, 0, 0.0, 0, 0, 0.0, 0),
    }
    means = {k: v[0] for k, v in values(h.frame(), "cust_prev_amt_mean").items()}
    assert means == pytest.approx({1: 0, 2: 100, 3: 25, 4: 40, 5: 80, 6: None, 7: 220})


def random_events(spark, n=300, seed=3):
    rng = random.Random(seed)
    # one customer holds about a third of the rows and has many rows in one second
    rows = []
    for i in range(n):
        who = 0 if rng.random() < 0.35 else rng.randrange(1, 12)
        sec = rng.choice([1000, rng.randrange(0, 20_000)])
        rows.append((who, i, sec, rng.choice([None, rng.randrange(-500, 500)]), rng.randrange(4), rng.randrange(3), int(rng.random() < 0.2)))
    return spark.createDataFrame(rows, "customer_id long, event_id long, sec long, cents long, kind int, session_id long, red int")


def all_features(h):
    h = h.past(
        n=Past.count(), s=Past.sum("cents"), mx=Past.max("cents"), mn=Past.min("sec", current=True), pv=Past.previous("cents"),
        la=Past.latest("cents"), nk=Past.count("kind"), sk=Past.sum("cents", "kind"), pk=Past.previous("sec", "kind"), lk=Past.latest(F.when(F.col("red") == 1, F.col("sec")), "kind"),
    )
    h = h.within(c1=Within.count(100), c2=Within.count(5000, F.col("kind") == 1), s1=Within.sum("cents", 700), m1=Within.max("cents", 5000))
    return h.neighbours(lambda w: {"r3": F.sum("cents").over(w.rowsBetween(-3, -1)), "f2": F.count("cents").over(w.rowsBetween(1, 2))}, before=3, after=2)


@pytest.mark.parametrize("limit", [7, 40])
def test_heavy_keys_give_the_same_values(tight, limit):
    tight.conf.set("backtrail.rows.per.task", str(limit))
    df = random_events(tight)
    plain = all_features(History.of(df, "customer_id", ORDER, rows_per_task=10**6))
    cut = all_features(History.of(df, "customer_id", ORDER, rows_per_task=limit))
    assert plain.heavy is None and cut.heavy is not None
    key = lambda r: r["event_id"]
    columns = plain.frame().columns
    assert sorted(plain.frame().collect(), key=key) == sorted(cut.frame().select(columns).collect(), key=key)


def test_blocks_are_bounded(tight):
    df = random_events(tight)
    cut = History.of(df, "customer_id", ORDER, rows_per_task=20)
    sizes = [r["count"] for r in cut.heavy.groupBy("customer_id", "_block").count().collect()]
    assert max(sizes) <= 40
    assert cut.frame().count() == df.count()


@pytest.mark.parametrize("beside", [False, True])
def test_heavy_null_entities_are_cut_like_others(tight, beside):
    """Half the rows have no customer: alone above the limit, or beside another heavy one."""
    who = "when event_id % 3 = 1 then 0 else event_id" if beside else "else event_id"
    df = random_events(tight).withColumn("customer_id", F.expr(f"case when event_id % 2 = 0 then null {who} end"))
    plain = all_features(History.of(df, "customer_id", ORDER, rows_per_task=10**6))
    cut = History.of(df, "customer_id", ORDER, rows_per_task=20)
    assert cut.heavy.filter("customer_id IS NULL").count() == 150
    assert max(r["count"] for r in cut.heavy.groupBy("customer_id", "_block").count().collect()) <= 40
    key = lambda r: r["event_id"]
    columns = plain.frame().columns
    assert sorted(plain.frame().collect(), key=key) == sorted(all_features(cut).frame().select(columns).collect(), key=key)


def test_later_rows_and_the_own_label_change_nothing(spark):
    df = random_events(spark).withColumn("is_red_lbl", F.col("red")).withColumn("is_yellow_lbl", F.lit(0)).withColumn("is_labeled_fb", F.col("red"))
    df = df.withColumn("event_desc", F.col("kind")).withColumn("channel_indicator_type", F.col("kind")).withColumn("event_type_nm", F.col("kind"))

    def run(rows):
        h = y.label_gaps(y.label_rates(y.label_counts(History.of(rows, "customer_id", ORDER))))
        h = x.event_gap(h).within(c=Within.count(3600), m=Within.max("cents", 3600))
        drop = ["red", "is_red_lbl", "is_labeled_fb"]
        return {r["event_id"]: r.asDict() for r in h.frame().drop(*drop).collect()}

    base = run(df)
    later = df.filter("sec > 9000").withColumn("sec", F.col("sec") + 100_000).withColumn("event_id", F.col("event_id") + 10_000)
    more = run(df.unionByName(later))
    assert all(more[k] == v for k, v in base.items())
    for event in (5, 77, 150):
        flipped = df.withColumn("is_red_lbl", F.when(F.col("event_id") == event, 1 - F.col("is_red_lbl")).otherwise(F.col("is_red_lbl")))
        assert run(flipped)[event] == base[event]


def test_distinct_within_counts_by_definition(spark):
    df = random_events(spark)
    rows = df.collect()
    got = values(x.distinct_within(df, "kind", {"u": 900, "v": 6000}), "u", "v")
    for r in rows:
        near = lambda w: {o["kind"] for o in rows if o["customer_id"] == r["customer_id"] and r["sec"] - w <= o["sec"] < r["sec"]}
        assert got[r["event_id"]] == (len(near(900)), len(near(6000)))


def test_asof_join_takes_the_last_row_at_or_before(tight):
    left = tight.createDataFrame([(k, i * 7 % 100, i) for i in range(60) for k in (1, 2)], "k int, at long, id long")
    right = tight.createDataFrame([(k, i * 11 % 100, i) for i in range(40) for k in (1, 3)], "k int, t long, v long")
    got = {(r["k"], r["id"]): r["v"] for r in asof_join(left, right, "k", "at", "t", tie="v").collect()}
    marks = right.collect()
    for r in left.collect():
        known = [(m["t"], m["v"]) for m in marks if m["k"] == r["k"] and m["t"] <= r["at"]]
        assert got[(r["k"], r["id"])] == (max(known)[1] if known else None)


def test_spread_join_keeps_every_row(tight):
    tight.conf.set("backtrail.rows.per.task", "50")
    left = tight.range(500).selectExpr("id", "case when id % 3 = 0 then 7 else id % 90 end as k")
    right = tight.range(80).selectExpr("id as k", "id * 2 as v")
    assert heavy_keys(left, ["k"], 50).count() == 1
    got = {r["id"]: r["v"] for r in spread_join(left, right, ["k"]).collect()}
    want = {r["id"]: (r["k"] * 2 if r["k"] < 80 else None) for r in left.collect()}
    assert got == want


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_of_null_keys(tight, how):
    left = tight.range(300).selectExpr("id", "case when id % 2 = 0 then null when id % 3 = 0 then 7 else id end as k")
    right = tight.range(80).selectExpr("case when id = 5 then null else id end as k", "id * 2 as v")
    got = sorted(map(tuple, spread_join(left, right, ["k"], how).select("id").collect()))
    assert got == sorted(map(tuple, left.join(right, "k", how).select("id").collect()))


def test_lookup_is_broadcast_by_bytes_as_well(spark):
    from backtrail.operators.lookups import fits_broadcast

    wide = spark.range(10).selectExpr("id as k", "array_repeat(1.0D, 1000) as v")
    assert fits_broadcast(wide)
    spark.conf.set("backtrail.broadcast.bytes", "50000")
    assert not fits_broadcast(wide) and fits_broadcast(wide.select("k"))
    spark.conf.unset("backtrail.broadcast.bytes")


def test_checkpoint_folder_of_the_session_is_used(spark, tmp_path):
    from backtrail.settings import ensure_checkpoint_folder

    ensure_checkpoint_folder(spark)
    first = spark.sparkContext.getCheckpointDir()
    ensure_checkpoint_folder(spark)
    assert first == spark.sparkContext.getCheckpointDir()
