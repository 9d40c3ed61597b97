"""The driver's `events` table seen as bank operations.

The SQL below is valid in Spark and in DuckDB and gives the same rows in both, so the comparison
queries start from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from backtrail.settings import prepare

BANK_EVENTS_SQL = """
SELECT user_id AS customer_id, event_id, CAST(date_trunc('second', ts) AS STRING) AS event_dttm,
 CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 5 END AS event_type_nm,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20 AS event_desc,
 CAST(event_id % 4 AS INT) AS channel_indicator_type, CAST(event_id % 9 AS INT) AS channel_indicator_sub_type,
 CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_type = 'error' THEN -value ELSE value END AS operaton_amt,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 3 AS INT) END AS currency_iso_cd,
 CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 7 = 0 THEN NULL ELSE CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 12 AS STRING) END AS mcc_code,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 6 AS INT) END AS pos_cd,
 CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ru-RU,ru;q=0.9,en-US;q=0.8' WHEN 2 THEN 'en-US' WHEN 3 THEN '*' ELSE 'not available' END AS accept_language,
 CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'not available' ELSE 'ru' END AS browser_language,
 CASE WHEN user_id % 9 = 0 THEN NULL WHEN event_id % 17 = 0 THEN CAST((user_id + 5) % 24 AS INT) ELSE CAST(user_id % 24 AS INT) END AS timezone,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id * 1000 + day(ts) * 10 + CAST(floor(hour(ts) / 6) AS BIGINT) END AS session_id,
 CASE WHEN event_id % 10 < 3 THEN NULL ELSE CAST(user_id % 3 AS INT) END AS operating_system_type,
 CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'NaN%' WHEN 2 THEN 'not available' WHEN 3 THEN ':' || CAST(event_id % 101 AS STRING) || '%' ELSE CAST(event_id % 101 AS STRING) || '%' END AS battery,
 CASE WHEN event_id % 10 < 3 THEN NULL ELSE CAST(10 + user_id % 7 AS STRING) || '.' || CAST(user_id % 4 AS STRING) END AS device_system_version,
 CASE WHEN event_id % 10 < 3 THEN NULL ELSE CAST(360 + user_id % 4 * 120 AS STRING) || 'x' || CAST(800 + user_id % 3 * 240 AS STRING) END AS screen_size,
 CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '1' ELSE '0' END AS developer_tools,
 CASE WHEN event_id % 10 < 3 THEN NULL WHEN event_id % 31 = 3 THEN 1 ELSE 0 END AS phone_voip_call_state,
 CASE WHEN event_id % 10 < 3 THEN NULL WHEN event_id % 37 = 4 THEN 1 ELSE 0 END AS web_rdp_connection,
 CASE event_id % 10 WHEN 0 THEN NULL WHEN 4 THEN '1' ELSE '0' END AS compromised,
 CASE WHEN day(ts) <= 10 THEN 'pretrain' WHEN day(ts) <= 20 THEN 'train' WHEN day(ts) <= 25 THEN 'pretest' ELSE 'test' END AS period
FROM events
"""

BANK_LABELS_SQL = """
SELECT event_id, user_id AS customer_id, CASE WHEN event_id % 5 < 2 THEN 1 ELSE 0 END AS target FROM events WHERE event_type = 'error' AND day(ts) > 10 AND day(ts) <= 20
"""


def _view(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    source = prepare(spark).read.parquet(f"{folder}/events.parquet")
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=source)


def bank_events(spark: SparkSession, folder: str) -> DataFrame:
    """Raw bank operations of all four periods."""
    return _view(spark, folder, BANK_EVENTS_SQL)


def bank_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse labels: 1 red, 0 yellow; every other event is green."""
    return _view(spark, folder, BANK_LABELS_SQL)
