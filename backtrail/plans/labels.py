"""Queries of label histories, priors, devices and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from backtrail.operators import features as x
from backtrail.operators import labels as y
from backtrail.operators.feature_table import feature_table
from backtrail.plans.base import CUTOFF, HALF_TIME, ORDER, bank_events, bank_labels, customer_times, customers, events, fixed, labelled, query
from backtrail.sources.tables import device_source, prior_source


def r6(*names):
    return [fixed(n).alias(n) for n in names]


def _past(expr, by=None):
    keys = "customer_id" + (f", {by}" if by else "")
    return f"COALESCE(CAST(sum({expr}) OVER (PARTITION BY {keys} ORDER BY sec, event_id {{past}}) AS BIGINT), 0)"


_COUNTS = ", ".join(
    [f"{_past('is_red')} AS r", f"{_past('is_yellow')} AS w", f"{_past('is_labeled')} AS l", "row_number() OVER ({c}) - 1 AS n"]
    + [f"{_past('is_red', by)} AS r_{g}, {_past('is_yellow', by)} AS w_{g}, {_past('is_labeled', by)} AS l_{g}" for g, by in y.LABEL_GROUPS.items()]
)
_COUNT_NAMES = ["cust_prev_red_lbl_cnt", "cust_prev_yellow_lbl_cnt", "cust_prev_labeled_cnt"] + [
    f"cnt_prev_{k}_same_{g}" for g in y.LABEL_GROUPS for k in ("red", "yellow", "labeled")]
_RATE_NAMES = ["cust_prev_red_lbl_rate", "cust_prev_yellow_lbl_rate", "cust_prev_susp_lbl_rate"] + [f"red_rate_prev_same_{g}" for g in y.LABEL_GROUPS]


@query("label_history_counts", "W29", sql=f"""WITH t AS (SELECT event_id, {_COUNTS} FROM lv)
    SELECT event_id, r AS cust_prev_red_lbl_cnt, w AS cust_prev_yellow_lbl_cnt, l AS cust_prev_labeled_cnt, """ + ", ".join(
    f"r_{g} AS cnt_prev_red_same_{g}, w_{g} AS cnt_prev_yellow_same_{g}, l_{g} AS cnt_prev_labeled_same_{g}" for g in y.LABEL_GROUPS) + """,
    CAST(r > 0 AS INT) AS cust_prev_any_red_flag, CAST(w > 0 AS INT) AS cust_prev_any_yellow_flag FROM t""")
def _counts(spark, folder):
    h = y.label_rates(y.label_counts(customers(labelled(spark, folder))))
    return h.frame().select("event_id", *_COUNT_NAMES, "cust_prev_any_red_flag", "cust_prev_any_yellow_flag")


@query("label_history_smoothed_rates", "W29", sql=f"""WITH t AS (SELECT event_id, {_COUNTS} FROM lv)
    SELECT event_id, round((r + 0.1) / (l + 1.0), 6) AS cust_prev_red_lbl_rate, round((w + 0.1) / (l + 1.0), 6) AS cust_prev_yellow_lbl_rate,
      round((r + w + 0.1) / (n + 1.0), 6) AS cust_prev_susp_lbl_rate, """ + ", ".join(
    f"round((r_{g} + 0.1) / (l_{g} + 1.0), 6) AS red_rate_prev_same_{g}" for g in y.LABEL_GROUPS) + " FROM t")
def _smooth(spark, folder):
    h = y.label_rates(y.label_counts(customers(labelled(spark, folder))))
    return h.frame().select("event_id", *r6(*_RATE_NAMES))


@query("label_history_plain_rates", "W30", sql=f"""WITH t AS (SELECT event_id, {_COUNTS} FROM lv)
    SELECT event_id, round(r / CAST(greatest(l, 1) AS DOUBLE), 6) AS cust_prev_red_lbl_rate, round(w / CAST(greatest(l, 1) AS DOUBLE), 6) AS cust_prev_yellow_lbl_rate,
      round((r + w) / CAST(greatest(l, 1) AS DOUBLE), 6) AS cust_prev_susp_lbl_rate, """ + ", ".join(
    f"round(r_{g} / CAST(greatest(l_{g}, 1) AS DOUBLE), 6) AS red_rate_prev_same_{g}" for g in y.LABEL_GROUPS) + " FROM t")
def _plain(spark, folder):
    h = y.label_rates(y.label_counts(customers(labelled(spark, folder))), smooth=False)
    return h.frame().select("event_id", *r6(*_RATE_NAMES))


def _last(flag):
    return f"max(CASE WHEN {flag} = 1 THEN sec END) OVER ({{c}} {{past}})"


@query("gap_since_label", "W31", sql=f"""SELECT event_id, COALESCE(sec - {_last('is_red')}, -1) AS sec_since_prev_red_lbl,
    COALESCE(sec - {_last('is_yellow')}, -1) AS sec_since_prev_yellow_lbl FROM lv""")
def _gaps(spark, folder):
    return y.label_gaps(customers(labelled(spark, folder))).frame().select("event_id", "sec_since_prev_red_lbl", "sec_since_prev_yellow_lbl")


_KINDS = {"yellow": "is_yellow", "red": "is_red", "suspicious": "is_labeled"}
_LOGS = [f"lh_prev_{k}_count_log" for k in _KINDS] + [f"lh_since_last_{k}_log" for k in _KINDS]


@query("label_history_logs", "W32", sql="SELECT event_id, " + ", ".join(
    f"""round(ln(1 + {_past(e)}), 6) AS lh_prev_{k}_count_log,
    round(ln(1 + CAST(COALESCE(least(sec - {_last(e)}, 31536000), 31536000) AS DOUBLE)), 6) AS lh_since_last_{k}_log""" for k, e in _KINDS.items()) + " FROM lv")
def _logs(spark, folder):
    return y.label_logs(customers(labelled(spark, folder))).frame().select("event_id", *r6(*_LOGS))


# -- priors ---------------------------------------------------------------------------------------

_SOURCE = f"src AS (SELECT ev.*, target FROM ev LEFT JOIN bank_labels USING (event_id) WHERE period = 'train' AND event_ts < TIMESTAMP '{CUTOFF}')"


def _prior_sql(keys, cols=("cnt", "red_rate_all", "labeled_rate_all", "red_share_labeled"), source="src"):
    name = "x".join(keys)
    forms = {
        "cnt": "count(*)", "red_rate_all": "round((COALESCE(sum(target), 0) + 1.0) / (count(*) + 200.0), 9)",
        "labeled_rate_all": "round((count(target) + 1.0) / (count(*) + 200.0), 9)",
        "red_share_labeled": "round((COALESCE(sum(target), 0) + 1.0) / (count(target) + 2.0), 9)",
    }
    return f"SELECT {', '.join(keys)}, " + ", ".join(f"{forms[c]} AS prior_{name}_{c}" for c in cols) + f" FROM {source} GROUP BY {', '.join(keys)}"


def _r9(df, keys):
    return df.select(*[c if c in keys or c.endswith("_cnt") else fixed(c, 9).alias(c) for c in df.columns])


@query("rows_per_key", "A1", "SRC8", sql=f"WITH {_SOURCE} SELECT event_desc, count(*) AS n FROM src GROUP BY 1")
def _per_key(spark, folder):
    return y.count_per_key(prior_source(events(spark, folder), "event_desc", CUTOFF), ["event_desc"])


@query("labelled_rows_per_key", "A2", "J2", sql=f"WITH {_SOURCE} SELECT event_desc, count(*) AS lbl, CAST(sum(target) AS DOUBLE) AS red FROM src WHERE target IS NOT NULL GROUP BY 1")
def _labelled_key(spark, folder):
    return y.labelled_per_key(prior_source(events(spark, folder), "event_desc", CUTOFF), bank_labels(spark, folder), ["event_desc"])


def _register_prior(key):
    @query(f"prior_table_{key}", "A3", "A4", "SRC8", sql=f"WITH {_SOURCE} {_prior_sql([key])}")
    def _prior(spark, folder):
        return _r9(y.prior_table(events(spark, folder), bank_labels(spark, folder), [key], CUTOFF), [key])


for _key in y.PRIOR_KEYS:
    _register_prior(_key)

_CROSS = {"cross_type_mcc": ["event_type_nm", "mcc_code_i"], "cross_mcc_channel": ["mcc_code_i", "channel_indicator_type"],
          "cross_os_compromised": ["operating_system_type", "compromised_i"]}


@query("prior_tables_of_crossed_keys", "A4", sql=f"WITH {_SOURCE} " + " UNION ALL ".join(
    f"SELECT '{n}' AS cross_name, CAST({a} AS VARCHAR) || '_x_' || CAST({b} AS VARCHAR) AS value, count(*) AS n, round((COALESCE(sum(target), 0) + 1.0) / (count(*) + 200.0), 9) AS red_rate_all FROM src GROUP BY {a}, {b}"
    for n, (a, b) in _CROSS.items()))
def _cross_priors(spark, folder):
    out = None
    tables = y.prior_tables(events(spark, folder), bank_labels(spark, folder), [tuple(k) for k in _CROSS.values()], CUTOFF)
    for n, keys in _CROSS.items():
        t, name = tables[tuple(keys)], "x".join(keys)
        t = t.select(F.lit(n).alias("cross_name"), F.concat_ws("_x_", *[F.col(k).cast("string") for k in keys]).alias("value"),
                     F.col(f"prior_{name}_cnt").alias("n"), fixed(f"prior_{name}_red_rate_all", 9).alias("red_rate_all"))
        out = t if out is None else out.unionByName(t)
    return out


def _register_pair(a, b):
    @query(f"pair_prior_{a}_{b}", "A5", sql=f"WITH {_SOURCE} {_prior_sql([a, b], ('red_rate_all', 'red_share_labeled'))}")
    def _pair(spark, folder):
        t, name = y.prior_table(events(spark, folder), bank_labels(spark, folder), [a, b], CUTOFF), f"{a}x{b}"
        return _r9(t.select(a, b, f"prior_{name}_red_rate_all", f"prior_{name}_red_share_labeled"), [a, b])


for _a, _b in y.PRIOR_PAIRS:
    _register_pair(_a, _b)


@query("priors_before_cutoff_and_full", "A6", sql=f"""WITH {_SOURCE}, full_src AS (SELECT ev.*, target FROM ev LEFT JOIN bank_labels USING (event_id) WHERE period = 'train')
    SELECT 'before' AS tag, * FROM ({_prior_sql(['event_desc'])}) UNION ALL SELECT 'full' AS tag, * FROM ({_prior_sql(['event_desc'], source='full_src')})""")
def _tags(spark, folder):
    rows, labels = events(spark, folder), bank_labels(spark, folder)
    parts = [_r9(y.prior_table(rows, labels, ["event_desc"], cut), ["event_desc"]).withColumn("tag", F.lit(tag))
             for tag, cut in (("before", CUTOFF), ("full", None))]
    return parts[0].unionByName(parts[1])


@query("priors_attached", "J3", sql=f"WITH {_SOURCE} SELECT event_id, " + ", ".join(f"prior_{k}_red_rate_all" for k in y.PRIOR_KEYS) + " FROM ev "
       + " ".join(f"LEFT JOIN ({_prior_sql([k])}) USING ({k})" for k in y.PRIOR_KEYS))
def _attached(spark, folder):
    rows, labels = events(spark, folder), bank_labels(spark, folder)
    return y.attach_all_priors(rows, rows, labels, [(k,) for k in y.PRIOR_KEYS], CUTOFF).select("event_id", *[fixed(f"prior_{k}_red_rate_all", 9).alias(f"prior_{k}_red_rate_all") for k in y.PRIOR_KEYS])


@query("pair_priors_attached", "J4", sql=f"WITH {_SOURCE} SELECT event_id, " + ", ".join(f"prior_{a}x{b}_red_share_labeled" for a, b in y.PRIOR_PAIRS)
       + " FROM ev " + " ".join(f"LEFT JOIN ({_prior_sql([a, b])}) USING ({a}, {b})" for a, b in y.PRIOR_PAIRS))
def _pairs_attached(spark, folder):
    rows, labels = events(spark, folder), bank_labels(spark, folder)
    names = [f"prior_{a}x{b}_red_share_labeled" for a, b in y.PRIOR_PAIRS]
    return y.attach_all_priors(rows, rows, labels, list(y.PRIOR_PAIRS), CUTOFF).select("event_id", *[fixed(n, 9).alias(n) for n in names])


_ALL_SETS = [*[(k,) for k in y.PRIOR_KEYS], *y.PRIOR_PAIRS]


@query("prior_tables_of_all_keys", "A3", "A4", "A5", "J2", sql=f"WITH {_SOURCE} " + " UNION ALL ".join(
    f"SELECT '{'x'.join(k)}' AS key, {' || chr(44) || '.join(f'CAST({c} AS VARCHAR)' for c in k)} AS value, prior_{'x'.join(k)}_cnt AS cnt, "
    + ", ".join(f"prior_{'x'.join(k)}_{c} AS {c}" for c in ("red_rate_all", "labeled_rate_all", "red_share_labeled")) + f" FROM ({_prior_sql(list(k))})" for k in _ALL_SETS))
def _all_tables(spark, folder):
    """Every single and paired key from one scan of the events and one label join."""
    sums = y.prior_sums(events(spark, folder), bank_labels(spark, folder), _ALL_SETS, CUTOFF)
    named = F.array(*[F.lit("x".join(k)) for k in _ALL_SETS])[F.col("_set")]
    value = F.array(*[F.concat_ws(",", *[F.col(c).cast("string") for c in k]) for k in _ALL_SETS])[F.col("_set")]
    rates = y.smoothed_rates(F.col("n"), F.col("lbl"), F.col("red"))
    return sums.select(named.alias("key"), value.alias("value"), F.col("n").alias("cnt"), *[fixed(v, 9).alias(c) for c, v in rates.items()])


def _running(key):
    frame = f"OVER (PARTITION BY {key} ORDER BY sec, event_id {{past}})"
    return f"(COALESCE(CAST(sum(is_red) {frame} AS DOUBLE), 0) + 0.25) / (COALESCE(CAST(sum(is_labeled) {frame} AS DOUBLE), 0) + 2.0)"


@query("running_priors", "W34", sql="SELECT event_id, " + ", ".join(f"round({_running(k)}, 9) AS prior_{k}_red_rate" for k in y.PRIOR_KEYS) + " FROM lv")
def _running_priors(spark, folder):
    names = [f"prior_{k}_red_rate" for k in y.PRIOR_KEYS]
    return y.running_priors(labelled(spark, folder), ORDER).select("event_id", *[fixed(n, 9).alias(n) for n in names])


_RISK = {"desc": "event_desc", "device": "device_fp_i", "tz": "timezone", "mcc": "mcc_code_i"}


@query("novelty_times_prior", "W35", sql="SELECT event_id, " + ", ".join(
    f"round({_running(k)} * (1 + CASE WHEN row_number() OVER (PARTITION BY customer_id, {k} ORDER BY sec, event_id) = 1 THEN 1 ELSE 0 END), 9) AS risk_new_{n}_x_prior"
    for n, k in _RISK.items()) + " FROM lv")
def _novelty(spark, folder):
    rows = x.first_time_flags(customers(labelled(spark, folder))).frame()
    names = [f"risk_new_{n}_x_prior" for n in _RISK]
    return y.novelty_risks(y.running_priors(rows, ORDER, tuple(_RISK.values()))).select("event_id", *[fixed(n, 9).alias(n) for n in names])


# -- devices and profiles ---------------------------------------------------------------------------

_DEVICE_STATS = """SELECT device_fp_i, count(DISTINCT customer_id) AS c, count(DISTINCT session_id) AS s, count(*) AS o FROM ev
    WHERE period IN ({periods}) AND event_ts < TIMESTAMP '{cutoff}' GROUP BY 1"""


@query("device_statistics", "A7", "SRC9", sql="SELECT device_fp_i, round(ln(1 + c), 6) AS device_n_distinct_customers, round(ln(1 + s), 6) AS device_n_distinct_sessions, round(ln(1 + o), 6) AS device_n_total_ops FROM ("
       + _DEVICE_STATS.format(periods="'pretrain', 'train'", cutoff=CUTOFF) + ")")
def _device_stats(spark, folder):
    stats = y.device_stats(device_source(events(spark, folder), CUTOFF))
    return stats.select("device_fp_i", *r6("device_n_distinct_customers", "device_n_distinct_sessions", "device_n_total_ops"))


@query("device_statistics_raw", "A7", "SRC9", sql="SELECT device_fp_i, c AS device_n_distinct_customers, s AS device_n_distinct_sessions, o AS device_n_total_ops FROM ("
       + _DEVICE_STATS.format(periods="'pretrain', 'train', 'pretest'", cutoff="2024-02-01") + ")")
def _device_stats_raw(spark, folder):
    return y.device_stats(device_source(events(spark, folder), None, include_pretest=True), log=False)


@query("device_statistics_attached", "J11", sql="SELECT event_id, c AS device_n_distinct_customers, o AS device_n_total_ops FROM ev LEFT JOIN ("
       + _DEVICE_STATS.format(periods="'pretrain', 'train'", cutoff=CUTOFF) + ") USING (device_fp_i)")
def _device_attached(spark, folder):
    from backtrail.operators.lookups import lookup

    rows = events(spark, folder)
    stats = y.device_stats(device_source(rows, CUTOFF), log=False)
    return lookup(rows, stats, "device_fp_i").select("event_id", "device_n_distinct_customers", "device_n_total_ops")


_DEV = "PARTITION BY device_fp_i ORDER BY sec, event_id"
_DEV_SAME = {"customer": "customer_id", "desc": "event_desc", "mcc": "mcc_code_i", "timezone": "timezone", "subtype": "channel_indicator_sub_type"}


@query("device_history", "W33", sql=f"""WITH t AS (SELECT *, row_number() OVER ({_DEV}) - 1 AS ops,
      CASE WHEN row_number() OVER (PARTITION BY device_fp_i, customer_id ORDER BY sec, event_id) = 1 THEN 1 ELSE 0 END AS fc,
      CASE WHEN row_number() OVER (PARTITION BY device_fp_i, session_id ORDER BY sec, event_id) = 1 THEN 1 ELSE 0 END AS fs FROM ev),
    u AS (SELECT *, COALESCE(CAST(sum(fc) OVER ({_DEV} {{past}}) AS BIGINT), 0) AS uc, COALESCE(CAST(sum(fs) OVER ({_DEV} {{past}}) AS BIGINT), 0) AS us FROM t)
    SELECT event_id, ops AS device_prev_ops, uc AS device_prev_unique_customers, us AS device_prev_unique_sessions,
      round(ln(1 + ops), 6) AS device_prev_ops_log, round(ln(1 + uc), 6) AS device_prev_unique_customers_log, round(ln(1 + us), 6) AS device_prev_unique_sessions_log,
      CASE WHEN ops > 0 THEN round(uc / (ops + 1e-6), 6) ELSE 0.0 END AS device_customer_diversity, """ + ", ".join(
    f"row_number() OVER (PARTITION BY device_fp_i, {c} ORDER BY sec, event_id) - 1 AS device_prev_same_{n}" for n, c in _DEV_SAME.items()) + " FROM u")
def _device_history(spark, folder):
    return y.device_history(events(spark, folder), ORDER).select(
        "event_id", "device_prev_ops", "device_prev_unique_customers", "device_prev_unique_sessions",
        *r6("device_prev_ops_log", "device_prev_unique_customers_log", "device_prev_unique_sessions_log", "device_customer_diversity"),
        *[f"device_prev_same_{n}" for n in _DEV_SAME])


_PROFILE = """profile AS (SELECT customer_id, count(*) AS profile_txn_count, CAST(sum(cents) AS DOUBLE) / count(cents) / 100.0 AS profile_amt_mean,
      COALESCE(stddev_samp(amt), 0.0) AS profile_amt_std, quantile_cont(amt, 0.5) AS profile_amt_median, CAST(max(cents) AS DOUBLE) / 100.0 AS profile_amt_max,
      quantile_cont(amt, 0.95) AS profile_amt_p95, count(DISTINCT mcc_code_i) AS profile_n_unique_mcc, avg(hour) AS profile_hour_mean,
      count(*) / 365.0 AS profile_avg_daily_txns FROM ev WHERE period = 'pretrain' GROUP BY 1)"""
_PROFILE_NUMBERS = ["profile_amt_mean", "profile_amt_std", "profile_amt_median", "profile_amt_p95", "profile_hour_mean", "profile_avg_daily_txns"]


def _profiles(spark, folder):
    return y.customer_profiles(events(spark, folder).filter("period = 'pretrain'"))


@query("customer_profiles", "A8", sql=f"WITH {_PROFILE} SELECT customer_id, profile_txn_count, profile_n_unique_mcc, profile_amt_max, "
       + ", ".join(f"round({c}, 5) AS {c}" for c in _PROFILE_NUMBERS) + " FROM profile")
def _profile(spark, folder):
    return _profiles(spark, folder).select("customer_id", "profile_txn_count", "profile_n_unique_mcc", "profile_amt_max",
                                           *[fixed(c, 5).alias(c) for c in _PROFILE_NUMBERS])


@query("profiles_attached", "J9", sql=f"WITH {_PROFILE} SELECT event_id, COALESCE(profile_txn_count, 0) AS profile_txn_count, round(COALESCE(profile_amt_p95, 0.0), 5) AS profile_amt_p95 FROM ev LEFT JOIN profile USING (customer_id)")
def _profile_attached(spark, folder):
    return y.attach_profiles(events(spark, folder), _profiles(spark, folder)).select("event_id", "profile_txn_count", fixed("profile_amt_p95", 5).alias("profile_amt_p95"))


_DRIFTS = ["amt_over_profile_mean", "amt_over_profile_p95", "amt_profile_zscore", "amt_drift_5", "hour_drift", "mcc_diversity_ratio", "velocity_ratio_1h"]


@query("drift_from_profile", "W43", sql=f"""WITH {_PROFILE}, t AS (SELECT *, row_number() OVER ({{c}}) - 1 AS n,
      CASE WHEN row_number() OVER ({{c}}) > 1 THEN CASE WHEN cents IS NOT NULL THEN COALESCE(CAST(sum(cents) OVER ({{c}} {{past}}) AS DOUBLE), 0) / (row_number() OVER ({{c}}) - 1) / 100.0 END ELSE 0.0 END AS mean,
      CASE WHEN count(cents) OVER ({{c}} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5 THEN CAST(sum(cents) OVER ({{c}} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE) / 5 / 100.0 END AS a5,
      CASE WHEN count(*) OVER ({{c}} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5 THEN CAST(sum(hour) OVER ({{c}} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE) / 5 END AS h5,
      count(*) OVER (PARTITION BY customer_id ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS c1,
      count(DISTINCT mcc_code_i) OVER (PARTITION BY customer_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS u24 FROM ev)
    SELECT event_id, CASE WHEN abs(COALESCE(profile_amt_mean, 0)) > 0.01 THEN round(amt / profile_amt_mean, 4) ELSE 0.0 END AS amt_over_profile_mean,
      CASE WHEN abs(COALESCE(profile_amt_p95, 0)) > 0.01 THEN round(amt / profile_amt_p95, 4) ELSE 0.0 END AS amt_over_profile_p95,
      CASE WHEN COALESCE(profile_amt_std, 0) > 1.0 THEN round((amt - profile_amt_mean) / profile_amt_std, 4) ELSE 0.0 END AS amt_profile_zscore,
      round(COALESCE(a5, 0.0) - COALESCE(mean, 0.0), 4) AS amt_drift_5, round(abs(COALESCE(h5, 12.0) - COALESCE(profile_hour_mean, 0.0)), 4) AS hour_drift,
      CASE WHEN COALESCE(profile_n_unique_mcc, 0) > 0 THEN round(u24 / CAST(profile_n_unique_mcc AS DOUBLE), 4) ELSE 0.0 END AS mcc_diversity_ratio,
      CASE WHEN COALESCE(profile_avg_daily_txns, 0) > 0.1 THEN round(c1 / profile_avg_daily_txns, 4) ELSE 0.0 END AS velocity_ratio_1h
    FROM t LEFT JOIN profile USING (customer_id)""")
def _drift(spark, folder):
    h = x.velocity(x.trailing_means(x.amount_moments(customer_times(events(spark, folder)))))
    rows = x.distinct_within(h.frame(), "mcc_code_i", {"unique_mcc_24h": 86400})
    return y.profile_drift(y.attach_profiles(rows, _profiles(spark, folder))).select("event_id", *[fixed(c, 4).alias(c) for c in _DRIFTS])


# -- everything together -----------------------------------------------------------------------------


@query("feature_table", "SRC7", "SNK3")
def _feature_table(spark, folder):
    """All features at once; each of them is compared with SQL by the queries above."""
    return feature_table(bank_events(spark, folder), bank_labels(spark, folder), HALF_TIME)
