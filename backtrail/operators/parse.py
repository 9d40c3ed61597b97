"""Raw event rows to the typed table every other operator starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.functions import fields as f
from backtrail.functions import measures as m
from backtrail.operators.lookups import lookup

# Output flag -> raw field whose absence it marks.
MISSING_FLAGS = {
    "amt_missing": "operaton_amt",
    "currency_missing": "currency_iso_cd",
    "mcc_missing": "mcc_code",
    "pos_missing": "pos_cd",
    "accept_language_missing": "accept_language",
    "browser_language_missing": "browser_language",
    "timezone_missing": "timezone",
    "session_id_missing": "session_id",
    "operating_system_missing": "operating_system_type",
    "battery_missing": "battery",
    "device_system_version_missing": "device_system_version",
    "screen_size_missing": "screen_size",
    "developer_tools_missing": "developer_tools",
    "phone_voip_missing": "phone_voip_call_state",
    "web_rdp_missing": "web_rdp_connection",
    "compromised_missing": "compromised",
}
# Codes kept under their own name.
PLAIN_CODES = (
    "event_type_nm",
    "event_desc",
    "channel_indicator_type",
    "channel_indicator_sub_type",
    "currency_iso_cd",
    "pos_cd",
    "timezone",
    "operating_system_type",
    "phone_voip_call_state",
    "web_rdp_connection",
)
# Decoded column -> raw text field.
TEXT_CODES = {
    "mcc_code_i": "mcc_code",
    "developer_tools_i": "developer_tools",
    "compromised_i": "compromised",
    "accept_language_i": "accept_language",
    "browser_language_i": "browser_language",
}


def parse_events(raw: DataFrame) -> DataFrame:
    """Typed codes (-1 for null), clock and amount columns, missing flags and the device number.

    `sec` is the event time in whole seconds and `cents` the amount in cents; both are exact, so
    windows and sums built on them do not depend on row order.
    """
    typed = raw.select(
        "customer_id",
        "event_id",
        *(["period"] if "period" in raw.columns else []),
        f.event_time("event_dttm").alias("event_ts"),
        F.col("operaton_amt").cast("double").alias("amt"),
        f.int_or("session_id", kind="bigint").alias("session_id"),
        *[f.int_or(c).alias(c) for c in PLAIN_CODES],
        *[f.int_or(source).alias(name) for name, source in TEXT_CODES.items()],
        f.battery_percent("battery").alias("battery_pct"),
        f.version_major("device_system_version").alias("os_ver_major"),
        f.screen_width("screen_size").alias("screen_w"),
        f.screen_height("screen_size").alias("screen_h"),
        *[f.missing(source).alias(name) for name, source in MISSING_FLAGS.items()],
    )
    return typed.withColumns(
        {
            "sec": m.seconds("event_ts"),
            "cents": m.cents("amt"),
            "device_fp_i": f.device_number("screen_w", "screen_h", "operating_system_type", "accept_language_i"),
        }
    )


def add_clock(events: DataFrame) -> DataFrame:
    hour, weekday, month = F.hour("event_ts"), m.iso_weekday("event_ts"), F.month("event_ts")
    columns = {
        "hour": hour,
        "weekday": weekday,
        "day": F.dayofmonth("event_ts"),
        "month": month,
        "is_weekend": m.weekend("event_ts"),
        "is_night": m.in_hours("event_ts", m.NIGHT_HOURS),
        "event_date": F.to_date("event_ts"),
        "event_hour": F.date_trunc("hour", "event_ts"),
    }
    for name, value, period in (("hour", hour, 24), ("weekday", weekday, 7), ("month", month, 12)):
        columns[f"{name}_sin"], columns[f"{name}_cos"] = m.cycle(value, period)
    return events.withColumns(columns)


def add_amounts(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {
            "amt_abs": F.abs("amt"),
            "amt_log_abs": m.log_size("amt"),
            "amt_bucket": m.amount_bucket("amt"),
            "amt_is_negative": (F.col("amt") < 0).cast("int"),
            "screen_pixels": f.screen_pixels("screen_w", "screen_h"),
            "screen_ratio": f.screen_ratio("screen_w", "screen_h"),
        }
    )


def add_labels(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Train label and the red, yellow and labelled flags."""
    joined = lookup(events, labels.select("event_id", "target"), "event_id", unique=True)
    label = m.train_label("period", "target")
    red = F.coalesce((label == 1).cast("int"), F.lit(0))
    yellow = F.coalesce((label == 0).cast("int"), F.lit(0))
    return joined.withColumns(
        {"train_target_raw": label, "is_red_lbl": red, "is_yellow_lbl": yellow, "is_labeled_fb": red + yellow}
    ).drop("target")


def add_split(events: DataFrame, border: str, recent: int, old: int, seed: int = 67) -> DataFrame:
    """Sampling of unlabelled train rows and the train/test flags."""
    keep = m.sampled_green("train_target_raw", "event_ts", "event_id", "customer_id", border, recent, old, seed)
    train = (F.col("period") == "train") & ((F.col("train_target_raw") != -1) | keep)
    return events.withColumns(
        {
            "keep_green": keep,
            "is_train_sample": train,
            "is_test": F.col("period") == "test",
            "target_bin": F.when(train, (F.col("train_target_raw") == 1).cast("int")),
        }
    )
