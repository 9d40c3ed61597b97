"""Registry of the comparison queries and the SQL views they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.operators.history import History
from backtrail.operators.parse import add_clock, add_labels, parse_events
from backtrail.settings import setting
from backtrail.sources.adapter import BANK_EVENTS_SQL, BANK_LABELS_SQL, bank_events, bank_labels

ORDER = ["sec", "event_id"]
HALF_TIME = "2024-01-16 00:00:00"
CUTOFF = "2024-01-18 00:00:00"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(name: str, *covers: str, sql: str | None = None):
    """Register a query under a name, with the inventory items it covers and its SQL twin."""

    def add(run):
        if name in REGISTRY:
            raise ValueError(f"two queries named {name}")
        REGISTRY[name] = Query(run, sql and with_views(sql), covers)
        return run

    return add


# -- Spark side -------------------------------------------------------------------------------------


def events(spark: SparkSession, folder: str) -> DataFrame:
    return parse_events(bank_events(spark, folder))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return add_labels(events(spark, folder), bank_labels(spark, folder))


def clocked(spark: SparkSession, folder: str) -> DataFrame:
    return add_clock(events(spark, folder))


def customers(df: DataFrame) -> History:
    """History per customer for features of the rows before."""
    return History.of(df, "customer_id", ORDER)


def customer_times(df: DataFrame) -> History:
    """History per customer for time windows, whose heavy limit is lower."""
    return History.of(df, "customer_id", ORDER, setting(df.sparkSession, "backtrail.rows.per.range.task"))


def fixed(column: str | Column, digits: int = 6) -> Column:
    """Round half up in plain double arithmetic, as `with_views` writes round() for the other engine."""
    value = F.col(column) if isinstance(column, str) else column
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


# -- SQL side ---------------------------------------------------------------------------------------

_CODES = ", ".join(
    f"COALESCE(TRY_CAST({source} AS INT), -1) AS {name}"
    for name, source in {
        "event_type_nm": "event_type_nm",
        "event_desc": "event_desc",
        "channel_indicator_type": "channel_indicator_type",
        "channel_indicator_sub_type": "channel_indicator_sub_type",
        "currency_iso_cd": "currency_iso_cd",
        "pos_cd": "pos_cd",
        "timezone": "timezone",
        "operating_system_type": "operating_system_type",
        "phone_voip_call_state": "phone_voip_call_state",
        "web_rdp_connection": "web_rdp_connection",
        "mcc_code_i": "mcc_code",
        "developer_tools_i": "developer_tools",
        "compromised_i": "compromised",
        "accept_language_i": "accept_language",
        "browser_language_i": "browser_language",
        "battery_pct": "regexp_extract(battery, '([0-9]{1,3})', 1)",
        "os_ver_major": "regexp_extract(device_system_version, '^([0-9]+)', 1)",
        "screen_w": "regexp_extract(screen_size, '^([0-9]+)', 1)",
        "screen_h": "regexp_extract(screen_size, 'x([0-9]+)$', 1)",
    }.items()
)

_VIEWS = f"""
WITH bank_events AS ({BANK_EVENTS_SQL}),
bank_labels AS ({BANK_LABELS_SQL}),
typed AS (
  SELECT customer_id, event_id, period, CAST(event_dttm AS TIMESTAMP) AS event_ts,
    CAST(epoch(CAST(event_dttm AS TIMESTAMP)) AS BIGINT) AS sec,
    operaton_amt AS amt, CAST(round(operaton_amt * 100) AS BIGINT) AS cents,
    COALESCE(session_id, -1) AS session_id, {_CODES}
  FROM bank_events),
ev AS (
  SELECT *, CAST(screen_w AS BIGINT) * 100000000 + CAST(screen_h AS BIGINT) * 100000
      + CAST(operating_system_type AS BIGINT) * 1000 + ((accept_language_i % 1000) + 1000) % 1000 AS device_fp_i,
    hour(event_ts) AS hour, CAST(event_ts AS DATE) AS event_date, date_trunc('hour', event_ts) AS event_hour
  FROM typed),
lv AS (
  SELECT ev.*, CASE WHEN period = 'train' THEN COALESCE(target, -1) END AS train_target_raw,
    CASE WHEN period = 'train' AND target = 1 THEN 1 ELSE 0 END AS is_red,
    CASE WHEN period = 'train' AND target = 0 THEN 1 ELSE 0 END AS is_yellow,
    CASE WHEN period = 'train' AND target IS NOT NULL THEN 1 ELSE 0 END AS is_labeled
  FROM ev LEFT JOIN bank_labels USING (event_id))
"""

# Frames used again and again: c = rows of the customer in order, past = strictly earlier rows.
WINDOWS = {
    "{c}": "PARTITION BY customer_id ORDER BY sec, event_id",
    "{past}": "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING",
}


def with_views(sql: str) -> str:
    for short, text in WINDOWS.items():
        sql = sql.replace(short, text)
    sql = _plain_rounding(sql)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"{_VIEWS}, {body[5:]}"
    return f"{_VIEWS} {body}"


def _plain_rounding(sql: str) -> str:
    """round(x, d) -> floor(x * 10^d + 0.5) / 10^d; engines differ on halves otherwise."""
    at = sql.rfind("round(")
    while at >= 0:
        depth, comma, end = 0, None, at + 5
        for end in range(at + 5, len(sql)):
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if depth == 1 and sql[end] == ",":
                comma = end
            if depth == 0:
                break
        if comma is not None:
            value, scale = sql[at + 6 : comma], f"1e{int(sql[comma + 1 : end])}"
            sql = f"{sql[:at]}(floor(({value}) * {scale} + 0.5) / {scale}){sql[end + 1 :]}"
        at = sql.rfind("round(", 0, at)
    return sql
