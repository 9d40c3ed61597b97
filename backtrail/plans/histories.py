"""Queries of the customer histories: counts, amounts, gaps, sessions, changes, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from backtrail.functions import measures as m
from backtrail.operators import features as x
from backtrail.operators.history import History, Past, Within
from backtrail.operators.joins import asof_join
from backtrail.plans.base import bank_events, clocked, customer_times, customers, events, fixed, query

def r6(*names):
    """Columns rounded alike on both sides."""
    return [fixed(n).alias(n) for n in names]


def seen(name, by=None):
    extra = f", {by}" if by else ""
    return f"row_number() OVER (PARTITION BY customer_id{extra} ORDER BY sec, event_id) - 1 AS {name}"


@query("flagship_test_features", "W1", "W2", "W5", "W10", "W19", sql=f"""
    SELECT * FROM (SELECT event_id, customer_id, {seen('cust_prev_events')},
      {seen('cnt_prev_same_desc', 'event_desc')},
      COALESCE(CAST(sum(cents) OVER ({{c}} {{past}}) AS BIGINT), 0) AS past_cents,
      COALESCE(sec - lag(sec) OVER ({{c}}), -1) AS sec_since_prev_event,
      count(*) OVER (PARTITION BY customer_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS cnt_24h,
      COALESCE(CAST(sum(abs(cents)) OVER (PARTITION BY customer_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS cents_24h,
      max(cents) OVER (PARTITION BY customer_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS max_cents_24h,
      period FROM ev) WHERE period = 'test'""")
def _flagship(spark, folder):
    day = 86400
    h = customer_times(events(spark, folder))
    # the windows in time order come first, so that they share one sort
    h = h.past(cust_prev_events=Past.count(), past_cents=Past.sum("cents"), _before=Past.previous("sec"))
    h = h.within(
        cnt_24h=Within.count(day), cents_24h=Within.sum(F.abs("cents"), day), max_cents_24h=Within.max("cents", day)
    )
    h = h.past(cnt_prev_same_desc=Past.count("event_desc"))
    h = h.with_columns({"sec_since_prev_event": F.coalesce(F.col("sec") - F.col("_before"), F.lit(-1))})
    return h.frame().filter("period = 'test'").select(
        "event_id", "customer_id", "cust_prev_events", "cnt_prev_same_desc", "past_cents", "sec_since_prev_event",
        "cnt_24h", "cents_24h", "max_cents_24h", "period",
    )


@query("past_event_count", "W1", sql=f"SELECT event_id, {seen('cust_prev_events')} FROM ev")
def _count(spark, folder):
    return x.event_count(customers(events(spark, folder))).frame().select("event_id", "cust_prev_events")


_MORE_SAME = {**x.SAME, "timezone": "timezone", "os": "operating_system_type"}


@query("past_same_value_counts", "W2", sql="SELECT event_id, " + ", ".join(
    seen(f"cnt_prev_same_{n}", c) for n, c in _MORE_SAME.items()) + " FROM ev")
def _same(spark, folder):
    h = x.same_counts(customers(events(spark, folder)), _MORE_SAME)
    return h.frame().select("event_id", *[f"cnt_prev_same_{n}" for n in _MORE_SAME])


@query("past_log_counts", "W3", sql="SELECT event_id, " + ", ".join(
    f"round(ln(1 + row_number() OVER (PARTITION BY customer_id, {c} ORDER BY sec, event_id) - 1), 6) AS {c}_log_cnt"
    for c in x.LOG_COUNT_COLUMNS) + """,
    round(ln(1 + row_number() OVER (PARTITION BY customer_id, channel_indicator_sub_type, operating_system_type ORDER BY sec, event_id) - 1), 6)
      AS ch_dev_combo_log_cnt FROM ev""")
def _logs(spark, folder):
    names = [f"{c}_log_cnt" for c in x.LOG_COUNT_COLUMNS] + ["ch_dev_combo_log_cnt"]
    return x.log_counts(customers(events(spark, folder))).frame().select("event_id", *r6(*names))


@query("first_time_flags", "W4", sql="SELECT event_id, " + ", ".join(
    f"CAST(row_number() OVER (PARTITION BY customer_id, {c} ORDER BY sec, event_id) = 1 AS INT) AS {flag}"
    for flag, c in x.FIRST_TIME.items()) + " FROM ev")
def _first(spark, folder):
    return x.first_time_flags(customers(events(spark, folder))).frame().select("event_id", *x.FIRST_TIME)


_MOMENTS = """m AS (SELECT *, row_number() OVER ({c}) - 1 AS n, COALESCE(CAST(sum(cents) OVER ({c} {past}) AS DOUBLE), 0) AS s,
    COALESCE(CAST(sum(cents * cents) OVER ({c} {past}) AS DOUBLE), 0) AS q, max(cents) OVER ({c} {past}) AS top FROM ev),
  mm AS (SELECT *, CASE WHEN n > 0 THEN CASE WHEN cents IS NOT NULL THEN s / n / 100.0 END ELSE 0.0 END AS mean,
    CASE WHEN n > 1 THEN CASE WHEN cents IS NOT NULL THEN sqrt(greatest(q / n - (s / n) * (s / n), 0.0)) / 100.0 END ELSE 0.0 END AS std,
    COALESCE(CAST(top AS DOUBLE) / 100.0, 0.0) AS maxi FROM m)"""


@query("past_amount_moments", "W5", "W6", "W7", "W21", sql=f"""WITH {_MOMENTS}
    SELECT event_id, round(mean, 6) AS cust_prev_amt_mean, round(std, 5) AS cust_prev_amt_std,
      maxi AS cust_prev_max_amt FROM mm""")
def _moments(spark, folder):
    h = x.amount_moments(customers(events(spark, folder)))
    return h.frame().select("event_id", *r6("cust_prev_amt_mean"), fixed("cust_prev_amt_std", 5).alias("cust_prev_amt_std"), "cust_prev_max_amt")


@query("past_amount_moments_null_as_zero", "W5", "W6", "W7", sql="""WITH z AS (SELECT event_id, row_number() OVER ({c}) - 1 AS n,
      COALESCE(CAST(sum(COALESCE(cents, 0)) OVER ({c} {past}) AS DOUBLE), 0) AS s,
      max(COALESCE(cents, 0)) OVER ({c} {past}) AS top FROM ev)
    SELECT event_id, CASE WHEN n > 0 THEN round(s / n / 100.0, 6) ELSE 0.0 END AS cust_prev_amt_mean,
      COALESCE(CAST(top AS DOUBLE) / 100.0, 0.0) AS cust_prev_max_amt FROM z""")
def _moments_zero(spark, folder):
    h = x.amount_moments(customers(events(spark, folder)), null_as_zero=True)
    return h.frame().select("event_id", *r6("cust_prev_amt_mean"), "cust_prev_max_amt")


@query("amount_against_past", "W8", sql=f"""WITH {_MOMENTS}
    SELECT event_id, CASE WHEN std > 0 THEN round((amt - mean) / (std + 1.0), 5) ELSE 0.0 END AS amt_zscore,
      CASE WHEN std > 1.0 THEN round((amt - mean) / std, 5) ELSE 0.0 END AS amt_zscore_raw,
      CASE WHEN abs(maxi) > 1.0 THEN round(amt / (abs(maxi) + 1.0), 6) ELSE 0.0 END AS amt_vs_personal_max,
      CASE WHEN abs(maxi) > 1e-6 THEN round(amt / (maxi + 1e-6), 5) ELSE 0.0 END AS amt_vs_prev_max,
      CASE WHEN abs(mean) > 0.01 THEN round(amt / mean, 5) ELSE 0.0 END AS amt_to_prev_mean FROM mm""")
def _against(spark, folder):
    h = x.amount_positions(x.amount_moments(customers(events(spark, folder))))
    fives = ["amt_zscore", "amt_zscore_raw", "amt_vs_prev_max", "amt_to_prev_mean"]
    return h.frame().select("event_id", *r6("amt_vs_personal_max"), *[fixed(c, 5).alias(c) for c in fives])


@query("previous_row_values", "W9", sql="""
    SELECT event_id, lag(event_ts) OVER ({c}) AS prev_event_ts, strftime(lag(event_date) OVER ({c}), '%Y-%m-%d') AS prev_event_date,
      lag(cents) OVER ({c}) AS prev_cents, COALESCE(lag(mcc_code_i) OVER ({c}), -1) AS prev_mcc_code_i,
      COALESCE(lag(session_id) OVER ({c}), -1) AS prev_session_id,
      CAST(cents - COALESCE(lag(cents) OVER ({c}), 0) AS DOUBLE) / 100.0 AS amt_delta_prev FROM ev""")
def _previous(spark, folder):
    return x.previous_values(customers(events(spark, folder))).frame().select(
        "event_id", "prev_event_ts", F.date_format("prev_event_date", "yyyy-MM-dd").alias("prev_event_date"),
        "prev_cents", "prev_mcc_code_i", "prev_session_id", "amt_delta_prev",
    )


@query("gap_since_previous", "W10", "W12", "W25", sql="""WITH g AS (SELECT event_id, sec - lag(sec) OVER ({c}) AS gap FROM ev)
    SELECT event_id, COALESCE(gap, -1) AS sec_since_prev_event, COALESCE(round(gap / 86400.0, 6), -1.0) AS days_since_prev_event,
      round(ln(1 + CAST(CASE WHEN gap IS NULL OR gap < 0 THEN 2592000 ELSE least(gap, 31536000) END AS DOUBLE)), 6) AS delta_time_log,
      CAST(COALESCE(gap > 0 AND gap < 300, false) AS INT) AS is_burst_5min,
      CAST(COALESCE(gap > 0 AND gap < 60, false) AS INT) AS is_rapid_1min FROM g""")
def _gap(spark, folder):
    h = x.burst_flags(x.log_gap(x.event_gap(customers(events(spark, folder)))))
    return h.frame().select("event_id", "sec_since_prev_event", *r6("days_since_prev_event", "delta_time_log"), "is_burst_5min", "is_rapid_1min")


@query("gap_since_same_value", "W11", sql="SELECT event_id, " + ", ".join(
    f"COALESCE(sec - lag(sec) OVER (PARTITION BY customer_id, {x.SAME[n]} ORDER BY sec, event_id), -1) AS sec_since_prev_same_{n}"
    for n in x.GAP_SAME) + " FROM ev")
def _same_gap(spark, folder):
    return x.same_gaps(customers(events(spark, folder))).frame().select("event_id", *[f"sec_since_prev_same_{n}" for n in x.GAP_SAME])


@query("account_age", "W13", sql="""WITH a AS (SELECT event_id, sec - min(sec) OVER (PARTITION BY customer_id) AS age, row_number() OVER ({c}) AS idx FROM ev)
    SELECT event_id, CAST(floor(age / 86400.0) AS INT) AS days_since_first_event, round(age / 86400.0, 6) AS days_since_first_event_exact,
      CASE WHEN floor(age / 86400.0) > 0 THEN round(idx / floor(age / 86400.0), 6) ELSE 1.0 END AS cust_events_per_day FROM a""")
def _age(spark, folder):
    return x.account_age(customers(events(spark, folder))).frame().select(
        "event_id", "days_since_first_event", *r6("days_since_first_event_exact", "cust_events_per_day"))


@query("active_days_so_far", "W14", sql="""WITH d AS (SELECT *, row_number() OVER ({c}) - 1 AS n,
      CASE WHEN event_date IS DISTINCT FROM lag(event_date) OVER ({c}) THEN 1 ELSE 0 END AS fresh FROM ev),
    e AS (SELECT event_id, n, CAST(sum(fresh) OVER ({c}) AS BIGINT) - 1 AS days FROM d)
    SELECT event_id, days AS cust_active_days, round(n / (days + 1.0), 6) AS avg_prev_events_per_active_day FROM e""")
def _days(spark, folder):
    return x.active_days(customers(events(spark, folder))).frame().select(
        "event_id", "cust_active_days", *r6("avg_prev_events_per_active_day"))


@query("active_days_looking_ahead", "W15", sql="""SELECT event_id, d.n AS cust_active_days_all FROM ev
    JOIN (SELECT customer_id, count(DISTINCT event_date) AS n FROM ev GROUP BY 1) d USING (customer_id)""")
def _days_all(spark, folder):
    return x.active_days_looking_ahead(events(spark, folder)).select("event_id", "cust_active_days_all")


@query("session_position", "W16", sql="""WITH s AS (SELECT event_id, session_id, cents, sec,
      min(sec) OVER (PARTITION BY customer_id, session_id) AS start, min(sec) OVER (PARTITION BY session_id) AS anyone,
      COALESCE(CAST(sum(cents) OVER (PARTITION BY customer_id, session_id ORDER BY sec, event_id {past}) AS BIGINT), 0) AS past_cents,
      row_number() OVER (PARTITION BY customer_id, session_id ORDER BY sec, event_id) - 1 AS idx FROM ev)
    SELECT event_id, sec - start AS sec_since_session_start,
      CASE WHEN cents IS NOT NULL THEN CAST(past_cents AS DOUBLE) / 100.0 END AS session_amt_before, idx AS session_event_idx,
      CASE WHEN session_id <> -1 THEN CAST(floor((sec - anyone) / 60.0) AS DOUBLE) ELSE -1.0 END AS minutes_from_session_start FROM s""")
def _session(spark, folder):
    return x.minutes_in_session(x.session_position(customers(events(spark, folder))).frame()).select(
        "event_id", "sec_since_session_start", "session_amt_before", "session_event_idx", "minutes_from_session_start")


@query("events_today_and_this_hour", "W17", sql="""WITH t AS (SELECT event_id, hour, row_number() OVER (PARTITION BY customer_id, event_date ORDER BY sec, event_id) - 1 AS today,
      row_number() OVER (PARTITION BY customer_id, event_hour ORDER BY sec, event_id) - 1 AS this_hour FROM ev)
    SELECT event_id, today AS events_before_today, this_hour AS cnt_events_this_hour,
      round(CASE WHEN hour > 0 THEN CAST(today AS DOUBLE) / hour ELSE CAST(today AS DOUBLE) END, 6) AS event_rate_today FROM t""")
def _today(spark, folder):
    return x.today_counts(customers(events(spark, folder))).frame().select(
        "event_id", "events_before_today", "cnt_events_this_hour", *r6("event_rate_today"))


@query("amounts_today", "W18", sql="""WITH t AS (SELECT event_id, amt,
      CASE WHEN cents IS NOT NULL THEN COALESCE(CAST(sum(abs(cents)) OVER (PARTITION BY customer_id, event_date ORDER BY sec, event_id {past}) AS DOUBLE), 0) / 100.0 END AS total,
      COALESCE(CAST(max(abs(cents)) OVER (PARTITION BY customer_id, event_date ORDER BY sec, event_id {past}) AS DOUBLE), 0) / 100.0 AS top FROM ev)
    SELECT event_id, total AS today_total_amount, top AS today_max_amount,
      CASE WHEN total > 1.0 THEN round(abs(amt) / total, 6) ELSE 1.0 END AS today_amt_vs_daily_norm FROM t""")
def _today_amounts(spark, folder):
    return x.today_amounts(customers(events(spark, folder))).frame().select(
        "event_id", "today_total_amount", "today_max_amount", *r6("today_amt_vs_daily_norm"))


def _frame(seconds):
    return f"(PARTITION BY customer_id ORDER BY sec RANGE BETWEEN {seconds} PRECEDING AND 1 PRECEDING)"


def _sum(expr, seconds):
    return f"CAST(COALESCE(sum({expr}) OVER {_frame(seconds)}, 0) AS DOUBLE) / 100.0"


@query("velocity_windows", "W19", "J8", sql="SELECT event_id, "
       + ", ".join(f"count(*) OVER {_frame(s)} AS cnt_{n}" for n, s in x.COUNT_WINDOWS.items()) + ", "
       + ", ".join(f"{_sum('abs(cents)', s)} AS amt_sum_{n}" for n, s in x.SUM_WINDOWS.items()) + " FROM ev")
def _velocity(spark, folder):
    return x.velocity(customer_times(events(spark, folder))).frame().select(
        "event_id", *[f"cnt_{n}" for n in x.COUNT_WINDOWS], *[f"amt_sum_{n}" for n in x.SUM_WINDOWS])


@query("velocity_without_pretrain", "W19", sql=f"""SELECT event_id, count(*) OVER {_frame(604800)} AS cnt_7d,
    {_sum('abs(cents)', 86400)} AS amt_sum_24h FROM ev WHERE period <> 'pretrain'""")
def _velocity_recent(spark, folder):
    rows = events(spark, folder).filter("period <> 'pretrain'")
    return x.velocity(customer_times(rows)).frame().select("event_id", "cnt_7d", "amt_sum_24h")


@query("signed_velocity_windows", "W19", sql=f"""SELECT event_id, count(cents) OVER {_frame(3600)} AS cnt_last_1h,
    count(cents) OVER {_frame(86400)} AS cnt_last_24h, {_sum('cents', 3600)} AS amt_sum_last_1h, {_sum('cents', 86400)} AS amt_sum_last_24h,
    CAST(COALESCE(max(cents) OVER {_frame(86400)}, 0) AS DOUBLE) / 100.0 AS max_amt_last_24h FROM ev""")
def _signed(spark, folder):
    return x.signed_velocity(customer_times(events(spark, folder))).frame().select(
        "event_id", "cnt_last_1h", "cnt_last_24h", "amt_sum_last_1h", "amt_sum_last_24h", "max_amt_last_24h")


@query("velocity_by_position", "W20", sql="""
    WITH p AS (SELECT customer_id, event_id, sec, cents, row_number() OVER ({c}) AS pos FROM ev)
    SELECT a.event_id, """ + ", ".join(
    f"""count(b.event_id) FILTER (WHERE b.sec > a.sec - {s}) AS events_last_{n},
      CASE WHEN any_value(a.cents) IS NOT NULL THEN CAST(COALESCE(sum(b.cents) FILTER (WHERE b.sec > a.sec - {s}), 0) AS DOUBLE) / 100.0 END AS amt_sum_last_{n}"""
    for n, s in {"5min": 300, "60min": 3600, "24h": 86400}.items()) + """
    FROM p a LEFT JOIN p b ON a.customer_id = b.customer_id AND b.pos < a.pos AND b.sec > a.sec - 86400 GROUP BY a.event_id""")
def _by_position(spark, folder):
    windows = {"5min": 300, "60min": 3600, "24h": 86400}
    return x.as_of_velocity(customer_times(events(spark, folder)), windows).frame().select(
        "event_id", *[f"events_last_{n}" for n in windows], *[f"amt_sum_last_{n}" for n in windows])


@query("asof_join_backward", "J7", sql="""
    WITH p AS (SELECT customer_id, event_id, sec, row_number() OVER ({c}) AS idx FROM ev)
    SELECT a.event_id, max(b.idx) AS ref_idx, max(b.sec) AS ref_sec
    FROM p a LEFT JOIN p b ON a.customer_id = b.customer_id AND b.sec <= a.sec - 86400 GROUP BY a.event_id""")
def _asof(spark, folder):
    rows = customers(events(spark, folder).select("customer_id", "event_id", "sec")).past(n=Past.count()).frame()
    left = rows.select("customer_id", "event_id", (F.col("sec") - 86400).alias("ago"))
    right = rows.select("customer_id", "sec", F.col("sec").alias("ref_sec"), (F.col("n") + 1).alias("ref_idx"))
    return asof_join(left, right, "customer_id", "ago", "sec", tie="ref_idx").select("event_id", "ref_idx", "ref_sec")


_MCC = {"unique_mcc_1h": 3600, "unique_mcc_24h": 86400, "unique_mcc_7d": 604800}


@query("distinct_categories_in_window", "W22", sql="SELECT *, CASE WHEN unique_mcc_24h > 0 THEN round(unique_mcc_1h / CAST(unique_mcc_24h AS DOUBLE), 6) ELSE 0.0 END AS mcc_scatter_ratio FROM (SELECT event_id, " + ", ".join(
    f"count(DISTINCT mcc_code_i) OVER {_frame(s)} AS {n}" for n, s in _MCC.items()) + " FROM ev)")
def _distinct(spark, folder):
    out = x.distinct_within(events(spark, folder), "mcc_code_i", _MCC)
    share = F.when(F.col("unique_mcc_24h") > 0, F.col("unique_mcc_1h") / F.col("unique_mcc_24h")).otherwise(0.0)
    return out.select("event_id", *_MCC, fixed(share, 6).alias("mcc_scatter_ratio"))


@query("risk_events_in_window", "W23", sql=f"""WITH t AS (SELECT *, CASE WHEN timezone <> lag(timezone) OVER ({{c}}) THEN 1 ELSE 0 END AS tz_changed FROM ev)
    SELECT event_id, count(*) FILTER (WHERE phone_voip_call_state = 1) OVER {_frame(900)} AS voip_cnt_15min,
      CAST(COALESCE(sum(tz_changed) OVER {_frame(86400)}, 0) AS BIGINT) AS tz_change_cnt_24h,
      CAST(count(*) FILTER (WHERE phone_voip_call_state = 1) OVER {_frame(900)} > 0 AS INT) AS had_voip_before_txn FROM t""")
def _risk(spark, folder):
    return x.risk_velocity(x.change_flags(customer_times(events(spark, folder)))).frame().select(
        "event_id", "voip_cnt_15min", "tz_change_cnt_24h", "had_voip_before_txn")


@query("velocity_ratios", "W24", sql=f"""WITH v AS (SELECT event_id, amt, count(*) OVER {_frame(900)} AS c15, count(*) OVER {_frame(3600)} AS c1,
      count(*) OVER {_frame(86400)} AS c24, {_sum('abs(cents)', 3600)} AS a1, {_sum('abs(cents)', 86400)} AS a24,
      {_sum('cents', 3600)} AS s1, {_sum('cents', 86400)} AS s24 FROM ev)
    SELECT event_id, CASE WHEN abs(s1) > 1.0 THEN round(amt / (abs(s1) + 1.0), 6) ELSE 0.0 END AS amt_vs_1h_sum,
      CASE WHEN abs(s24) > 1.0 THEN round(amt / (abs(s24) + 1.0), 6) ELSE 0.0 END AS amt_vs_24h_sum,
      CASE WHEN a24 > 1.0 THEN round(abs(amt) / a24, 6) ELSE 1.0 END AS amt_ratio_24h,
      CASE WHEN c24 > 0 THEN round(c1 / CAST(c24 AS DOUBLE), 6) ELSE 0.0 END AS burst_ratio_1h_24h,
      CASE WHEN c1 > 0 THEN round(c15 / CAST(c1 AS DOUBLE), 6) ELSE 0.0 END AS burst_ratio_15m_1h,
      CASE WHEN a24 > 1.0 THEN round(a1 / a24, 6) ELSE 0.0 END AS spend_concentration_1h FROM v""")
def _ratios(spark, folder):
    h = x.velocity_ratios(x.signed_velocity(x.velocity(customer_times(events(spark, folder)))))
    return h.frame().select("event_id", *r6("amt_vs_1h_sum", "amt_vs_24h_sum", "amt_ratio_24h", "burst_ratio_1h_24h", "burst_ratio_15m_1h", "spend_concentration_1h"))


def _mean(n):
    rows = f"OVER ({{c}} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(cents) {rows} = {n} THEN round(CAST(sum(cents) {rows} AS DOUBLE) / {n} / 100.0, 6) END"


@query("trailing_row_means", "W26", sql=f"""WITH t AS (SELECT event_id, """ + ", ".join(f"{_mean(n)} AS amt_avg_{n}" for n in (5, 10, 50, 100)) + """,
      CASE WHEN count(*) OVER ({c} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5
        THEN round(CAST(sum(hour) OVER ({c} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE) / 5, 6) END AS hour_mean_5 FROM ev)
    SELECT *, round(COALESCE(amt_avg_5, 0) - COALESCE(amt_avg_50, 0), 5) AS amt_momentum FROM t""")
def _trailing(spark, folder):
    return x.trailing_means(customers(events(spark, folder))).frame().select(
        "event_id", *r6("amt_avg_5", "amt_avg_10", "amt_avg_50", "amt_avg_100", "hour_mean_5"), fixed("amt_momentum", 5).alias("amt_momentum"))


@query("change_flags", "W27", sql="""WITH t AS (SELECT event_id, operating_system_type AS os, screen_w AS sw, timezone AS tz, mcc_code_i AS mcc, session_id AS ses,
      lag(operating_system_type) OVER ({c}) AS pos, lag(screen_w) OVER ({c}) AS psw, lag(timezone) OVER ({c}) AS ptz,
      COALESCE(lag(mcc_code_i) OVER ({c}), -1) AS pmcc, COALESCE(lag(session_id) OVER ({c}), -1) AS pses,
      COALESCE(sec - lag(sec) OVER ({c}), -1) AS gap FROM ev)
    SELECT event_id, CAST(COALESCE(os <> pos, false) AS INT) AS os_changed, CAST(COALESCE(sw <> psw, false) AS INT) AS screen_changed,
      CAST(COALESCE(tz <> ptz, false) AS INT) AS tz_changed, CAST(mcc <> pmcc AS INT) AS mcc_changed, CAST(ses <> pses AS INT) AS session_changed,
      COALESCE(abs(tz - ptz), 0) AS tz_jump_magnitude,
      CAST(COALESCE(abs(tz - ptz), 0) > 2 AND gap > 0 AND gap < 3600 AS INT) AS impossible_travel FROM t""")
def _changes(spark, folder):
    return x.change_flags(customers(events(spark, folder))).frame().select(
        "event_id", "os_changed", "screen_changed", "tz_changed", "mcc_changed", "session_changed", "tz_jump_magnitude", "impossible_travel")


@query("category_transition_surprise", "W28", sql="""WITH t AS (SELECT *, COALESCE(lag(mcc_code_i) OVER ({c}), -1) AS p FROM ev),
    u AS (SELECT event_id, row_number() OVER (PARTITION BY customer_id, p ORDER BY sec, event_id) - 1 AS uses,
      row_number() OVER (PARTITION BY customer_id, p, mcc_code_i ORDER BY sec, event_id) - 1 AS pairs FROM t)
    SELECT event_id, round(pairs / CAST(greatest(uses, 1) AS DOUBLE), 6) AS markov_mcc_prob,
      round(-ln(greatest(pairs / CAST(greatest(uses, 1) AS DOUBLE), 1e-6)), 6) AS markov_mcc_surprise FROM u""")
def _transition(spark, folder):
    return x.mcc_transition(customers(events(spark, folder))).frame().select("event_id", *r6("markov_mcc_prob", "markov_mcc_surprise"))


@query("past_mean_by_desc_and_device", "W35", sql="SELECT event_id, " + ", ".join(f"""
    round(mean_{n}, 6) AS cust_prev_mean_amt_same_{n},
    CASE WHEN abs(mean_{n}) > 1e-6 THEN round(amt / (mean_{n} + 1e-6), 4) ELSE 0.0 END AS amt_vs_same_{n}_mean""" for n in ("desc", "device")) + """
    FROM (SELECT event_id, amt, """ + ", ".join(f"""
      CASE WHEN row_number() OVER (PARTITION BY customer_id, {c} ORDER BY sec, event_id) > 1 THEN CASE WHEN cents IS NOT NULL THEN
        COALESCE(CAST(sum(cents) OVER (PARTITION BY customer_id, {c} ORDER BY sec, event_id {{past}}) AS DOUBLE), 0)
          / (row_number() OVER (PARTITION BY customer_id, {c} ORDER BY sec, event_id) - 1) / 100.0 END ELSE 0.0 END AS mean_{n}"""
    for n, c in (("desc", "event_desc"), ("device", "device_fp_i"))) + " FROM ev)")
def _same_means(spark, folder):
    names = [f"cust_prev_mean_amt_same_{n}" for n in ("desc", "device")]
    ratios = [f"amt_vs_same_{n}_mean" for n in ("desc", "device")]
    return x.running_amounts_same(customers(events(spark, folder))).frame().select(
        "event_id", *r6(*names), *[fixed(c, 4).alias(c) for c in ratios])


@query("amount_interactions", "P41", sql=f"""WITH t AS (SELECT event_id, ln(1 + abs(amt)) AS size, hour, COALESCE(sec - lag(sec) OVER ({{c}}), -1) AS gap,
      count(*) OVER {_frame(3599)} + row_number() OVER (PARTITION BY customer_id, sec ORDER BY event_id) - 1 AS n60 FROM ev)
    SELECT event_id, round(size * n60, 6) AS amt_x_velocity_60, round(size * CASE WHEN hour < 6 THEN 1 ELSE 0 END, 6) AS amt_x_night,
      CASE WHEN gap > 0 THEN round(size / (gap + 1.0), 6) ELSE 0.0 END AS amt_speed FROM t""")
def _interactions(spark, folder):
    h = customer_times(clocked(spark, folder).withColumn("amt_log_abs", m.log_size("amt")))
    h = x.as_of_velocity(x.event_gap(h), {"60min": 3600})
    return x.interactions(h.frame()).select("event_id", *r6("amt_x_velocity_60", "amt_x_night", "amt_speed"))


@query("sorted_by_customer_and_time", "O1", sql="""SELECT event_id, row_number() OVER ({c}) AS place,
    row_number() OVER (PARTITION BY customer_id ORDER BY event_dttm, CASE period WHEN 'pretrain' THEN 0 WHEN 'train' THEN 1 WHEN 'pretest' THEN 2 ELSE 3 END, event_id) AS stable_place
    FROM ev JOIN bank_events USING (event_id, customer_id, period)""")
def _order(spark, folder):
    ranks = F.when(F.col("period") == "pretrain", 0).when(F.col("period") == "train", 1).when(F.col("period") == "pretest", 2).otherwise(3)
    rows = bank_events(spark, folder).select("customer_id", "event_id", "event_dttm", ranks.alias("dataset"))
    rows = rows.withColumn("sec", m.seconds(F.col("event_dttm").cast("timestamp")))
    first = customers(rows).past(place=Past.count()).frame()
    both = History.of(first, "customer_id", ["sec", "dataset", "event_id"]).past(stable_place=Past.count()).frame()
    return both.select("event_id", (F.col("place") + 1).alias("place"), (F.col("stable_place") + 1).alias("stable_place"))
