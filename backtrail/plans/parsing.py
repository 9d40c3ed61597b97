"""Queries of the projections: decoding, clocks, amounts, flags and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from backtrail.functions import fields as f
from backtrail.functions import measures as m
from backtrail.operators import quality
from backtrail.operators.parse import MISSING_FLAGS, PLAIN_CODES, TEXT_CODES, add_split
from backtrail.plans.base import HALF_TIME, REGISTRY, Query, bank_events, clocked, events, fixed, labelled, query, with_views


def projection(name, covers, columns, source=bank_events, view="bank_events"):
    """Register one row-wise query: alias -> (function giving the Spark column, SQL expression)."""

    def run(spark, folder):
        return source(spark, folder).select("event_id", *[c().alias(a) for a, (c, _) in columns.items()])

    body = ", ".join(f"{expr} AS {alias}" for alias, (_, expr) in columns.items())
    REGISTRY[name] = Query(run, with_views(f"SELECT event_id, {body} FROM {view}"), covers)


r6 = fixed

projection("parsed_event_time", ("P1",), {
    "event_ts": (lambda: f.event_time("event_dttm"), "CAST(event_dttm AS TIMESTAMP)"),
    "bad_time": (lambda: f.event_time(F.concat(F.lit("x"), "event_dttm")), "TRY_CAST(('x' || event_dttm) AS TIMESTAMP)"),
    "sec": (lambda: m.seconds(f.event_time("event_dttm")), "CAST(epoch(CAST(event_dttm AS TIMESTAMP)) AS BIGINT)"),
})

projection("codes_null_to_minus_one", ("P2",), {
    **{c: (lambda c=c: f.int_or(c), f"COALESCE(TRY_CAST({c} AS INT), -1)") for c in PLAIN_CODES},
    **{n: (lambda s=s: f.int_or(s), f"COALESCE(TRY_CAST({s} AS INT), -1)") for n, s in TEXT_CODES.items()},
    "session_id": (lambda: f.int_or("session_id", kind="bigint"), "COALESCE(session_id, -1)"),
})

projection("codes_null_to_zero", ("P3",), {
    short: (lambda raw=raw: f.int_or(raw, 0), f"COALESCE(TRY_CAST({raw} AS INT), 0)")
    for short, raw in {
        "etype": "event_type_nm", "edesc": "event_desc", "ch_type": "channel_indicator_type",
        "ch_sub": "channel_indicator_sub_type", "mcc": "mcc_code", "pos": "pos_cd", "tz": "timezone",
        "os": "operating_system_type", "voip": "phone_voip_call_state", "rdp": "web_rdp_connection",
    }.items()
})

projection("codes_shifted_by_one", ("P4",), {
    c: (lambda c=c: f.shifted_code(c), f"COALESCE(TRY_CAST({c} AS INT) + 1, 0)")
    for c in ("currency_iso_cd", "mcc_code", "pos_cd", "timezone", "operating_system_type", "developer_tools",
              "phone_voip_call_state", "web_rdp_connection", "compromised")
})

projection("missing_flags", ("P5",), {
    name: (lambda raw=raw: f.missing(raw), f"CASE WHEN {raw} IS NULL THEN 1 ELSE 0 END") for name, raw in MISSING_FLAGS.items()
})

UNSET = ("phone_voip_call_state", "web_rdp_connection", "timezone", "operating_system_type", "developer_tools_i",
         "compromised_i", "battery_pct", "os_ver_major", "screen_w", "screen_h")
projection("unset_flags_and_count", ("P6",), {
    **{f"null_{c}": (lambda c=c: f.is_unset(c), f"CASE WHEN {c} = -1 THEN 1 ELSE 0 END") for c in UNSET},
    "null_device_count": (
        lambda: f.total([f.is_unset(c) for c in UNSET]),
        " + ".join(f"CASE WHEN {c} = -1 THEN 1 ELSE 0 END" for c in UNSET),
    ),
}, events, "ev")

BATTERY_SQL = """CASE WHEN battery = 'NaN%' THEN -2.0 WHEN battery = 'not available' THEN -1.0
  ELSE TRY_CAST(replace(ltrim(battery, ':'), '%', '') AS DOUBLE) END"""
projection("battery_decoded", ("P7", "P8", "P9", "P10"), {
    "battery_pct": (lambda: f.battery_percent("battery"), "COALESCE(TRY_CAST(regexp_extract(battery, '([0-9]{1,3})', 1) AS INT), -1)"),
    # NaN% is no number here; engines differ on reading the text NaN
    "battery_value": (
        lambda: F.when(F.col("battery") != "NaN%", f.battery_number("battery")),
        "CASE WHEN battery <> 'NaN%' THEN TRY_CAST(trim(replace(battery, '%', '')) AS DOUBLE) END",
    ),
    "battery_code": (lambda: F.nanvl(f.battery_code("battery"), F.lit(-9.0)), f"COALESCE({BATTERY_SQL}, -9.0)"),
    "battery_share": (
        lambda: r6(f.battery_share(f.battery_code("battery"))),
        f"CASE WHEN ({BATTERY_SQL}) >= 0 THEN round(least(({BATTERY_SQL}), 100.0) / 100.0, 6) ELSE 0.0 END",
    ),
    "battery_available": (
        lambda: f.battery_available(f.battery_code("battery")).cast("int"),
        f"CASE WHEN ({BATTERY_SQL}) >= 0 THEN 1 ELSE 0 END",
    ),
    "battery_neg": (
        lambda: f.battery_reason(f.battery_code("battery")),
        f"CASE WHEN ({BATTERY_SQL}) < 0 THEN -({BATTERY_SQL}) ELSE 0.0 END",
    ),
})

_PIECE = "COALESCE(TRY_CAST(split_part(device_system_version, '.', {}) AS INT), 0)"
projection("system_version_decoded", ("P11", "P12"), {
    "os_ver_major": (lambda: f.version_major("device_system_version"), "COALESCE(TRY_CAST(regexp_extract(device_system_version, '^([0-9]+)', 1) AS INT), -1)"),
    "version_major": (lambda: f.version_first_piece("device_system_version"), "TRY_CAST(split_part(device_system_version, '.', 1) AS BIGINT)"),
    "version_number": (
        lambda: f.version_number("device_system_version"),
        "CASE WHEN device_system_version IS NULL THEN 0 ELSE "
        + " + ".join(f"{_PIECE.format(i + 1)} * {w}" for i, w in enumerate((10000, 100, 1))) + " END",
    ),
    "version_parts": (
        lambda: f.version_parts("device_system_version"),
        "CASE WHEN device_system_version IS NULL THEN 0 ELSE len(string_split(device_system_version, '.')) END",
    ),
})

projection("screen_sides", ("P13",), {
    "screen_w": (lambda: f.screen_width("screen_size"), "COALESCE(TRY_CAST(regexp_extract(screen_size, '^([0-9]+)', 1) AS INT), -1)"),
    "screen_h": (lambda: f.screen_height("screen_size"), "COALESCE(TRY_CAST(regexp_extract(screen_size, 'x([0-9]+)$', 1) AS INT), -1)"),
    "screen_width": (lambda: f.piece("screen_size", "x", 0).try_cast("bigint"), "TRY_CAST(split_part(screen_size, 'x', 1) AS BIGINT)"),
    "screen_height": (lambda: f.piece("screen_size", "x", 1).try_cast("bigint"), "TRY_CAST(split_part(screen_size, 'x', 2) AS BIGINT)"),
    "screen_size_1": (lambda: f.int_or(f.piece("screen_size", "x", 0), 0), "COALESCE(TRY_CAST(split_part(screen_size, 'x', 1) AS INT), 0)"),
})

_KNOWN = "screen_w > 0 AND screen_h > 0"
projection("screen_area_and_ratio", ("P14",), {
    "screen_pixels": (lambda: f.screen_pixels("screen_w", "screen_h"), "screen_w * screen_h"),
    "screen_pixels_or_unknown": (lambda: f.screen_pixels("screen_w", "screen_h", -1), f"CASE WHEN {_KNOWN} THEN screen_w * screen_h ELSE -1 END"),
    "screen_ratio": (lambda: r6(f.screen_ratio("screen_w", "screen_h")), f"CASE WHEN {_KNOWN} THEN round(screen_w / CAST(screen_h AS DOUBLE), 6) ELSE 0.0 END"),
    "screen_ratio_eps": (
        lambda: fixed(f.screen_ratio("screen_w", "screen_h", 1e-6), 9),
        f"CASE WHEN {_KNOWN} THEN round(screen_w / (CAST(screen_h AS DOUBLE) + 1e-6), 9) ELSE 0.0 END",
    ),
}, events, "ev")

projection("scaled_device_numbers", ("P15",), {
    "device_version_norm": (
        lambda: r6(f.version_number("device_system_version") / 100000.0),
        "CASE WHEN device_system_version IS NULL THEN 0.0 ELSE round(("
        + " + ".join(f"{_PIECE.format(i + 1)} * {w}" for i, w in enumerate((10000, 100, 1))) + ") / 100000.0, 6) END",
    ),
    "device_parts_norm": (
        lambda: r6(f.version_parts("device_system_version") / 4.0),
        "CASE WHEN device_system_version IS NULL THEN 0.0 ELSE len(string_split(device_system_version, '.')) / 4.0 END",
    ),
    "screen1_norm": (lambda: r6(f.int_or(f.piece("screen_size", "x", 0), 0) / 4000.0), "round(COALESCE(TRY_CAST(split_part(screen_size, 'x', 1) AS INT), 0) / 4000.0, 6)"),
    "screen2_norm": (lambda: r6(f.int_or(f.piece("screen_size", "x", 1), 0) / 4000.0), "round(COALESCE(TRY_CAST(split_part(screen_size, 'x', 2) AS INT), 0) / 4000.0, 6)"),
})

projection("language_cleaned", ("P16",), {
    "accept_language": (lambda: f.language_or_null("accept_language"), "CASE WHEN lower(accept_language) IN ('', 'not available', 'null') THEN NULL ELSE accept_language END"),
    "accept_language_primary": (lambda: f.language_letters("accept_language"), r"substring(regexp_replace(lower(accept_language), '[;,\s].*', ''), 1, 2)"),
    "accept_language_is_star": (lambda: (F.col("accept_language") == "*").cast("int"), "CAST(accept_language = '*' AS INT)"),
    "accept_language_has_comma": (lambda: F.col("accept_language").contains(",").cast("int"), "CAST(contains(accept_language, ',') AS INT)"),
})

projection("language_tags", ("P17", "P18"), {
    "lang_primary": (lambda: f.language_tag("accept_language"), "COALESCE(nullif(regexp_extract(accept_language, '^([a-zA-Z]{2}(-[a-zA-Z]{2})?)', 1), ''), 'unknown')"),
    "lang_base": (lambda: f.language_base("accept_language"), "split_part(split_part(split_part(COALESCE(lower(accept_language), ''), ',', 1), ';', 1), '-', 1)"),
    "has_lang_code": (
        lambda: (f.hashed_text(f.language_base("accept_language")) != 0).cast("int"),
        "CASE WHEN COALESCE(accept_language, '') = '' THEN 0 ELSE 1 END",
    ),
})

projection("language_flags", ("P19", "P20", "P21"), {
    "lang_count": (lambda: f.language_count("accept_language"), "CASE WHEN accept_language IS NULL THEN 0 ELSE len(string_split(accept_language, ',')) END"),
    "is_accept_lang_null": (lambda: f.missing("accept_language"), "CASE WHEN accept_language IS NULL THEN 1 ELSE 0 END"),
    "is_suspicious_lang": (lambda: f.suspicious_language("accept_language"), r"CASE WHEN regexp_matches(COALESCE(lower(accept_language), ''), 'en-us|\*') THEN 1 ELSE 0 END"),
    "is_suspicious_lang_exact": (lambda: f.suspicious_language("accept_language", exact=True), "CASE WHEN COALESCE(lower(accept_language), '') IN ('en-us', '*') THEN 1 ELSE 0 END"),
    "lang_mismatch": (
        lambda: f.language_mismatch("accept_language", "browser_language"),
        "CASE WHEN accept_language IS NULL OR browser_language IS NULL THEN -1 WHEN accept_language <> browser_language THEN 1 ELSE 0 END",
    ),
    "browser_language_state": (lambda: f.browser_language_state("browser_language"), "CASE WHEN browser_language IS NULL THEN 0 WHEN browser_language = 'not available' THEN 1 ELSE 2 END"),
})

projection("amount_shapes", ("P22", "P23", "P24"), {
    "amt_abs": (lambda: F.abs("amt"), "abs(amt)"),
    "amt_log_abs": (lambda: r6(m.log_size("amt")), "round(ln(1 + abs(amt)), 6)"),
    "amt_is_negative": (lambda: (F.col("amt") < 0).cast("int"), "CAST(amt < 0 AS INT)"),
    "amt_bucket": (lambda: m.amount_bucket("amt"), "CAST(least(greatest(floor(ln(1 + abs(amt)) * 4), 0), 63) AS INT)"),
    "amt_bucket_whole": (lambda: F.floor(m.log_size("amt")).cast("int"), "CAST(floor(ln(1 + abs(amt))) AS INT)"),
    "amount_log": (lambda: r6(F.log1p(m.non_negative("amt"))), "round(ln(1 + CASE WHEN amt IS NULL OR amt < 0 THEN 0 ELSE amt END), 6)"),
    "amount_missing": (lambda: f.missing("amt"), "CASE WHEN amt IS NULL THEN 1 ELSE 0 END"),
}, events, "ev")

# The driver's amounts stay below 500, so the tiers are also tested on the amount in cents.
projection("round_amounts", ("P25",), {
    "is_round_amount": (lambda: (F.pmod(F.abs("cents"), F.lit(50000)) == 0).cast("int"), "CAST(abs(cents) % 50000 = 0 AS INT)"),
    "is_round_10000": (lambda: m.divisible("cents", 10000), "CASE WHEN cents <> 0 AND abs(cents) % 1000000 = 0 THEN 1 ELSE 0 END"),
    "is_round_100": (lambda: m.divisible("cents", 100), "CASE WHEN cents <> 0 AND abs(cents) % 10000 = 0 THEN 1 ELSE 0 END"),
    "is_round_1000_scaled": (lambda: m.divisible(F.col("cents") * 100, 1000), "CASE WHEN cents <> 0 AND abs(cents * 100) % 100000 = 0 THEN 1 ELSE 0 END"),
}, events, "ev")

projection("clock_parts", ("P26",), {
    "hour": (lambda: F.hour("event_ts"), "hour(event_ts)"),
    "weekday": (lambda: m.iso_weekday("event_ts"), "isodow(event_ts)"),
    "day": (lambda: F.dayofmonth("event_ts"), "day(event_ts)"),
    "month": (lambda: F.month("event_ts"), "month(event_ts)"),
    "week_of_year": (lambda: F.weekofyear("event_ts"), "weekofyear(event_ts)"),
    "day_of_year": (lambda: F.dayofyear("event_ts"), "dayofyear(event_ts)"),
    "event_day_number": (lambda: m.epoch_day("event_ts"), "CAST(floor(sec / 86400.0) AS INT)"),
    "event_date": (lambda: F.date_format("event_ts", "yyyy-MM-dd"), "strftime(event_ts, '%Y-%m-%d')"),
    "event_hour": (lambda: F.date_format(F.date_trunc("hour", "event_ts"), "yyyy-MM-dd HH"), "strftime(date_trunc('hour', event_ts), '%Y-%m-%d %H')"),
}, events, "ev")


def _wave(column, expr, n):
    return tuple(
        (lambda i=i: r6(m.cycle(column(), n)[i]), f"round({wave}({expr} * (2 * pi() / {n})), 6)")
        for i, wave in enumerate(("sin", "cos"))
    )


_hour = _wave(lambda: F.hour("event_ts"), "hour(event_ts)", 24)
_week = _wave(lambda: m.iso_weekday("event_ts"), "isodow(event_ts)", 7)
_dow = _wave(lambda: m.iso_weekday("event_ts") - 1, "(isodow(event_ts) - 1)", 7)
_month = _wave(lambda: F.month("event_ts"), "month(event_ts)", 12)
projection("clock_waves", ("P27",), {
    "hour_sin": _hour[0], "hour_cos": _hour[1], "weekday_sin": _week[0], "weekday_cos": _week[1],
    "dow_sin": _dow[0], "dow_cos": _dow[1], "month_sin": _month[0], "month_cos": _month[1],
}, events, "ev")


def _hours(hours):
    return (lambda: m.in_hours("event_ts", hours), f"CAST(hour(event_ts) IN {hours} AS INT)")


projection("period_of_day_flags", ("P28",), {
    "is_weekend": (lambda: m.weekend("event_ts"), "CAST(isodow(event_ts) >= 5 AS INT)"),
    "is_weekend_sat_sun": (lambda: m.weekend("event_ts", 6), "CAST(isodow(event_ts) >= 6 AS INT)"),
    "is_night": _hours(m.NIGHT_HOURS), "is_night_wide": _hours(m.WIDE_NIGHT_HOURS),
    "is_late_night": _hours(m.LATE_NIGHT_HOURS), "is_evening_peak": _hours(m.EVENING_HOURS),
}, events, "ev")

projection("device_fingerprint_number", ("P29",), {"device_fp_i": (lambda: F.col("device_fp_i"), "device_fp_i")}, events, "ev")

_RAW_DEVICE = ("operating_system_type", "screen_size", "device_system_version")
_DEVICE_SQL = " || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), '?')" for c in _RAW_DEVICE)


# The 64-bit hash is the engine's own; what must agree is which rows share a device.
@query("device_fingerprint_hash", "P30", sql=f"""
    SELECT {_DEVICE_SQL} AS device_text, count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers
    FROM bank_events GROUP BY 1""")
def _device_hash(spark, folder):
    rows = bank_events(spark, folder).withColumn("device_hash", f.device_hash(*_RAW_DEVICE))
    return rows.groupBy("device_hash").agg(
        F.min(f.device_text(*_RAW_DEVICE)).alias("device_text"),
        F.count("*").alias("n_rows"),
        F.countDistinct("customer_id").alias("n_customers"),
    ).drop("device_hash")


_CROSSES = {
    "cross_type_mcc": ("event_type_nm", "mcc_code_i"), "cross_mcc_channel": ("mcc_code_i", "channel_indicator_type"),
    "cross_os_compromised": ("operating_system_type", "compromised_i"),
    "cross_hour_channel": ("hour", "channel_indicator_type"), "cross_type_currency": ("event_type_nm", "currency_iso_cd"),
}
projection("crossed_categories", ("P31",), {
    name: (lambda a=a, b=b: f.crossed(a, b), f"{a} || '_x_' || {b}") for name, (a, b) in _CROSSES.items()
}, clocked, "ev")

projection("risk_flags", ("P32",), {
    "voip_rdp_combo": (lambda: f.all_equal(1, "phone_voip_call_state", "web_rdp_connection"), "CAST(phone_voip_call_state = 1 AND web_rdp_connection = 1 AS INT)"),
    "any_risk_flag": (
        lambda: f.any_equal(1, "phone_voip_call_state", "web_rdp_connection", "compromised_i", "developer_tools_i"),
        "CAST(phone_voip_call_state = 1 OR web_rdp_connection = 1 OR compromised_i = 1 OR developer_tools_i = 1 AS INT)",
    ),
    "compromised_devtools": (lambda: f.all_equal(1, "compromised_i", "developer_tools_i"), "CAST(compromised_i = 1 AND developer_tools_i = 1 AS INT)"),
}, events, "ev")

_SHIFTED = {
    "browser_language_known": (lambda: f.browser_language_state("browser_language"), "browser_language IS NOT NULL"),
    "operating_system_type_known": (lambda: f.shifted_code("operating_system_type"), "operating_system_type IS NOT NULL"),
    "developer_tools_known": (lambda: f.shifted_code("developer_tools"), "developer_tools IS NOT NULL"),
    "phone_voip_call_state_known": (lambda: f.shifted_code("phone_voip_call_state"), "phone_voip_call_state IS NOT NULL"),
    "web_rdp_connection_known": (lambda: f.shifted_code("web_rdp_connection"), "web_rdp_connection IS NOT NULL"),
    "compromised_known": (lambda: f.shifted_code("compromised"), "compromised IS NOT NULL"),
    "device_version_known": (lambda: f.version_number("device_system_version"), "device_system_version IS NOT NULL"),
    "screen_known": (lambda: f.int_or(f.piece("screen_size", "x", 0), 0), "screen_size IS NOT NULL"),
    "accept_lang_primary_known": (lambda: F.length(f.language_base("accept_language")), "accept_language IS NOT NULL"),
    "session_present": (lambda: f.shifted_code(F.when(F.col("session_id").isNotNull(), 1)), "session_id IS NOT NULL"),
    "battery_known": (lambda: f.battery_available(f.battery_code("battery")).cast("int"), f"COALESCE(({BATTERY_SQL}) >= 0, false)"),
}
projection("known_flags", ("P33",), {
    **{n: (lambda c=c: f.known(c()), f"CAST({e} AS INT)") for n, (c, e) in _SHIFTED.items()},
    "telemetry_available_any": (lambda: f.known(*[c() for c, _ in _SHIFTED.values()]), "CAST(" + " OR ".join(e for _, e in _SHIFTED.values()) + " AS INT)"),
})

_HASH = "(event_id * 2654435761 + customer_id * 40503 + {})"
_KEEP = f"""COALESCE(train_target_raw = -1 AND CASE WHEN event_ts >= TIMESTAMP '{HALF_TIME}'
  THEN {_HASH.format(67)} % 10 = 0 ELSE {_HASH.format(84)} % 30 = 0 END, false)"""
_TRAIN = f"(period = 'train' AND (train_target_raw <> -1 OR {_KEEP}))"


def _split(spark, folder):
    return add_split(labelled(spark, folder), HALF_TIME, 10, 30)


projection("label_codes_and_split", ("P34", "P36", "P37"), {
    "train_target_raw": (lambda: F.col("train_target_raw"), "train_target_raw"),
    "keep_green": (lambda: F.col("keep_green").cast("int"), f"CAST({_KEEP} AS INT)"),
    "is_train_sample": (lambda: F.col("is_train_sample").cast("int"), f"CAST({_TRAIN} AS INT)"),
    "is_test": (lambda: F.col("is_test").cast("int"), "CAST(period = 'test' AS INT)"),
    "target_bin": (lambda: F.col("target_bin"), f"CASE WHEN {_TRAIN} THEN CAST(train_target_raw = 1 AS INT) END"),
}, _split, "lv")


@query("sampled_rows", "P36", "P37", sql=f"SELECT event_id, period FROM lv WHERE {_TRAIN} OR period = 'test'")
def _sampled_rows(spark, folder):
    return _split(spark, folder).filter("is_train_sample OR is_test").select("event_id", "period")


@query("sampled_by_event_only", "P38", sql="""
    SELECT event_id, CAST((event_id * 2654435761 + 67) % 6 = 0 AS INT) AS kept_by_hash FROM lv
    WHERE period = 'train' AND (train_target_raw <> -1 OR (event_id * 2654435761 + 67) % 6 = 0 OR event_id % 3 = 0)""")
def _event_only(spark, folder):
    kept, third = m.one_in("event_id", None, 6, 67), F.col("event_id") % 3 == 0
    rows = labelled(spark, folder).filter("period = 'train'")
    return rows.filter((F.col("train_target_raw") != -1) | kept | third).select("event_id", kept.cast("int").alias("kept_by_hash"))


@query("green_thinned_by_fraction", "P39", sql="""
    SELECT event_id, train_target_raw FROM lv WHERE period = 'train'
      AND NOT (train_target_raw = -1 AND (event_id * 2654435761 + customer_id * 40503 + 7) % 10000 >= 2500)""")
def _fraction(spark, folder):
    from backtrail.operators.folds import thin_class

    rows = labelled(spark, folder).filter("period = 'train'")
    return thin_class(rows, F.col("train_target_raw") == -1, 0.25, seed=7).select("event_id", "train_target_raw")


@query("row_subsets", "P40", sql=f"""
    SELECT event_id, CAST(event_ts < TIMESTAMP '{HALF_TIME}' AS INT) AS before_cutoff,
      CAST(event_ts >= TIMESTAMP '2024-01-17' AND event_ts < TIMESTAMP '2024-01-20' AS INT) AS in_validation,
      CAST(event_ts >= TIMESTAMP '{HALF_TIME}' OR train_target_raw <> -1 AS INT) AS recent_or_labelled,
      CAST(train_target_raw <> -1 AS INT) AS labelled_only
    FROM lv WHERE period = 'train'""")
def _subsets(spark, folder):
    time = F.col("event_ts")
    label = F.col("train_target_raw") != -1
    return labelled(spark, folder).filter("period = 'train'").select(
        "event_id",
        (time < F.lit(HALF_TIME).cast("timestamp")).cast("int").alias("before_cutoff"),
        time.between(F.lit("2024-01-17").cast("timestamp"), F.lit("2024-01-19 23:59:59").cast("timestamp")).cast("int").alias("in_validation"),
        ((time >= F.lit(HALF_TIME).cast("timestamp")) | label).cast("int").alias("recent_or_labelled"),
        label.cast("int").alias("labelled_only"),
    )


projection("categories_as_text", ("P42",), {
    c: (lambda c=c: f.category_or_missing(c), f"CASE WHEN {c} IS NULL OR CAST({c} AS VARCHAR) IN ('nan', 'None', '') THEN 'MISSING' ELSE CAST({c} AS VARCHAR) END")
    for c in ("mcc_code", "currency_iso_cd", "timezone", "developer_tools", "browser_language")
})

_RANGES = {"event_type_nm": 256, "event_desc": 256, "currency_iso_cd": 255, "timezone": 60000, "pos_cd": 5}


@query("input_range_report", "P43", sql=" UNION ALL ".join(
    f"""SELECT '{c}' AS field, CAST(count(*) FILTER (WHERE {c} < 0) AS BIGINT) AS below,
      CAST(count(*) FILTER (WHERE {c} >= {top}) AS BIGINT) AS above,
      CAST(count(*) FILTER (WHERE {c} <> floor({c})) AS BIGINT) AS fractional,
      CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing FROM bank_events""" for c, top in _RANGES.items()))
def _ranges(spark, folder):
    return quality.range_report(bank_events(spark, folder), {c: (0, top) for c, top in _RANGES.items()})


@query("narrowed_types", "P44", sql=" UNION ALL ".join(
    f"""SELECT '{c}' AS field, CAST(min({c}) AS BIGINT) AS low, CAST(max({c}) AS BIGINT) AS high,
      CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint'
           WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'
           WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS kind
      FROM ev""" for c in ("event_desc", "timezone", "screen_w", "session_id", "device_fp_i")))
def _narrow(spark, folder):
    return quality.narrowest_types(events(spark, folder), ["event_desc", "timezone", "screen_w", "session_id", "device_fp_i"])


@query("narrowed_columns", "P44", sql="SELECT event_id, " + ", ".join(
    f"""CAST({c} AS BIGINT) AS {c}, (SELECT CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'
      WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END FROM ev) AS {c}_kind""" for c in ("event_desc", "screen_w", "device_fp_i")) + " FROM ev")
def _narrowed(spark, folder):
    names = ["event_desc", "screen_w", "device_fp_i"]
    rows = quality.narrow(events(spark, folder).select("event_id", *names), names)
    return rows.select("event_id", *[x for c in names for x in (F.col(c).cast("bigint").alias(c), F.typeof(c).alias(f"{c}_kind"))])


@query("deduplicated_column_list", "P45", sql="SELECT event_id, customer_id, event_desc FROM ev")
def _columns(spark, folder):
    return quality.select_present(events(spark, folder), ["event_id", "customer_id", "event_id", "no_such", "event_desc"])
