"""The main feature table: raw events and labels to one row per sampled train and test event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.operators import features as x
from backtrail.operators import labels as y
from backtrail.operators.gathered import together
from backtrail.operators.history import History
from backtrail.operators.parse import add_amounts, add_clock, add_labels, add_split, parse_events
from backtrail.settings import setting

# Column names of the table, which readers of it rely on.
META_COLUMNS = ("event_id", "period", "event_ts", "is_train_sample", "is_test", "train_target_raw", "target_bin")
CODE_COLUMNS = (
    "customer_id", "event_type_nm", "event_desc", "channel_indicator_type", "channel_indicator_sub_type",
    "currency_iso_cd", "mcc_code_i", "pos_cd", "timezone", "operating_system_type", "phone_voip_call_state",
    "web_rdp_connection", "developer_tools_i", "compromised_i", "accept_language_i", "browser_language_i", "device_fp_i",
)
AMOUNT_COLUMNS = ("amt", "amt_abs", "amt_log_abs", "amt_is_negative", "amt_bucket")
MISSING_COLUMNS = (
    "amt_missing", "currency_missing", "mcc_missing", "pos_missing", "accept_language_missing",
    "browser_language_missing", "timezone_missing", "session_id_missing", "operating_system_missing",
    "battery_missing", "device_system_version_missing", "screen_size_missing", "developer_tools_missing",
    "phone_voip_missing", "web_rdp_missing", "compromised_missing",
)
CLOCK_COLUMNS = (
    "hour", "weekday", "day", "is_weekend", "is_night", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos",
    "month_sin", "month_cos",
)
DEVICE_COLUMNS = ("battery_pct", "os_ver_major", "screen_w", "screen_h", "screen_pixels", "screen_ratio")
PAST_COLUMNS = (
    "days_since_first_event", "cust_active_days", "avg_prev_events_per_active_day", "cust_prev_events",
    "cust_prev_amt_mean", "cust_prev_amt_std", "cust_prev_max_amt", "amt_vs_personal_max", "sec_since_prev_event",
    "days_since_prev_event", "amt_delta_prev", "amt_zscore", "sec_since_session_start", "session_amt_before",
    "events_before_today", "cnt_events_this_hour",
)
SAME_COLUMNS = tuple(f"cnt_prev_same_{n}" for n in x.SAME)
GAP_NAMES = ("type", "desc", "channel_type", "currency", "device")
GAP_COLUMNS = tuple(f"sec_since_prev_same_{n}" for n in GAP_NAMES)
NEW_FLAGS = {
    "is_new_event_type": "type", "is_new_event_desc": "desc", "is_new_channel_sub": "subtype",
    "is_new_channel_type": "channel_type", "is_new_mcc": "mcc", "is_new_currency": "currency",
    "is_new_device_fp": "device", "is_first_in_session": "session",
}
WINDOW_COLUMNS = (
    "amt_sum_last_1h", "cnt_last_1h", "amt_sum_last_24h", "cnt_last_24h", "max_amt_last_24h", "amt_vs_1h_sum", "amt_vs_24h_sum",
)
LABEL_COLUMNS = (
    "cust_prev_red_lbl_cnt", "cust_prev_yellow_lbl_cnt", "cust_prev_labeled_cnt", "cust_prev_red_lbl_rate",
    "cust_prev_yellow_lbl_rate", "cust_prev_susp_lbl_rate", "cust_prev_any_red_flag", "cust_prev_any_yellow_flag",
    "sec_since_prev_red_lbl", "sec_since_prev_yellow_lbl",
)
# Column of the table -> column of the label history.
FINE_LABEL_COLUMNS = {
    "cnt_prev_labeled_same_desc": "cnt_prev_labeled_same_desc",
    "cnt_prev_red_same_desc_lbl": "cnt_prev_red_same_desc",
    "cnt_prev_yellow_same_desc_lbl": "cnt_prev_yellow_same_desc",
    "red_rate_prev_same_desc_lbl": "red_rate_prev_same_desc",
    "cnt_prev_red_same_channel": "cnt_prev_red_same_channel",
    "cnt_prev_labeled_same_channel": "cnt_prev_labeled_same_channel",
    "red_rate_prev_same_channel": "red_rate_prev_same_channel",
    "cnt_prev_red_same_type_lbl": "cnt_prev_red_same_type",
    "cnt_prev_labeled_same_type_lbl": "cnt_prev_labeled_same_type",
    "red_rate_prev_same_type": "red_rate_prev_same_type",
}
FEATURE_COLUMNS = (
    *CODE_COLUMNS, *AMOUNT_COLUMNS, *MISSING_COLUMNS, *CLOCK_COLUMNS, *DEVICE_COLUMNS, *PAST_COLUMNS, *SAME_COLUMNS,
    *GAP_COLUMNS, *NEW_FLAGS, *WINDOW_COLUMNS, *LABEL_COLUMNS, *FINE_LABEL_COLUMNS,
)


def feature_table(raw: DataFrame, labels: DataFrame, border: str, recent: int = 10, old: int = 30, seed: int = 67) -> DataFrame:
    """Meta columns and features of the sampled train rows and the test rows.

    All rows take part in the histories; the choice of rows comes last. For ordinary customers the
    whole table is built with one shuffle by customer and one pass over each partition.
    """
    rows = add_split(add_labels(parse_events(raw), labels), border, recent, old, seed)
    limit = setting(raw.sparkSession, "backtrail.rows.per.range.task")
    h = History.of(rows, "customer_id", ["sec", "event_id"], limit)
    h = together(h, [
        x.amount_moments, x.amount_positions, x.event_gap, x.account_age, x.active_days, x.previous_values,
        x.signed_velocity, y.label_gaps, x.session_position, x.today_counts, x.same_counts, y.label_counts,
        y.label_rates, lambda h: x.same_gaps(h, GAP_NAMES),
    ], F.expr("is_train_sample OR is_test"))
    total_1h, total_24h = F.abs("amt_sum_last_1h"), F.abs("amt_sum_last_24h")
    wanted = add_amounts(add_clock(h.frame())).withColumns(
        {
            **{flag: (F.col(f"cnt_prev_same_{n}") == 0).cast("int") for flag, n in NEW_FLAGS.items()},
            "amt_vs_1h_sum": F.when(total_1h > 1.0, F.col("amt") / (total_1h + 1.0)).otherwise(0.0),
            "amt_vs_24h_sum": F.when(total_24h > 1.0, F.col("amt") / (total_24h + 1.0)).otherwise(0.0),
        }
    )
    kept = [F.col(FINE_LABEL_COLUMNS.get(c, c)).alias(c) for c in FEATURE_COLUMNS]
    return wanted.select(*META_COLUMNS, *kept)
