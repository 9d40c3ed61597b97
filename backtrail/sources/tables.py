"""Readers: fixed schemas, tolerant column sets, period tags and histories before a cutoff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERIODS = ("pretrain", "train", "pretest", "test")

# Columns of the raw event table. The spelling of operaton_amt is the data's own.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("customer_id", T.LongType(), False),
        T.StructField("event_id", T.LongType(), False),
        T.StructField("event_dttm", T.StringType(), False),
        T.StructField("event_type_nm", T.IntegerType(), True),
        T.StructField("event_desc", T.IntegerType(), True),
        T.StructField("channel_indicator_type", T.IntegerType(), True),
        T.StructField("channel_indicator_sub_type", T.IntegerType(), True),
        T.StructField("operaton_amt", T.DoubleType(), True),
        T.StructField("currency_iso_cd", T.IntegerType(), True),
        T.StructField("mcc_code", T.StringType(), True),
        T.StructField("pos_cd", T.IntegerType(), True),
        T.StructField("accept_language", T.StringType(), True),
        T.StructField("browser_language", T.StringType(), True),
        T.StructField("timezone", T.IntegerType(), True),
        T.StructField("session_id", T.LongType(), True),
        T.StructField("operating_system_type", T.IntegerType(), True),
        T.StructField("battery", T.StringType(), True),
        T.StructField("device_system_version", T.StringType(), True),
        T.StructField("screen_size", T.StringType(), True),
        T.StructField("developer_tools", T.StringType(), True),
        T.StructField("phone_voip_call_state", T.IntegerType(), True),
        T.StructField("web_rdp_connection", T.IntegerType(), True),
        T.StructField("compromised", T.StringType(), True),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()
SCORE_SCHEMA = "event_id bigint, predict double"


def read_columns(spark: SparkSession, path: str | list[str], columns: list[str], schema=None) -> DataFrame:
    """Parquet scan of the named columns only."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*([path] if isinstance(path, str) else path)).select(*columns)


def present_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns that the table has, in the wanted order."""
    return df.select(*[c for c in columns if c in df.columns])


def complete_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Every column of the schema in its order; the missing ones are null."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def union_all(frames: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Union by name; columns only some inputs have are null elsewhere when allowed."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def tagged_periods(frames: dict[str, DataFrame]) -> DataFrame:
    """One table out of the four period tables, each row tagged with its period."""
    return union_all([df.withColumn("period", F.lit(name)) for name, df in frames.items()], allow_missing=True)


def distinct_pretest(events: DataFrame) -> DataFrame:
    """Exact copies occur only in the pretest rows and are dropped there."""
    keep = events.filter(F.col("period") != "pretest")
    return keep.unionByName(events.filter(F.col("period") == "pretest").distinct())


def before(df: DataFrame, cutoff: str | None, time: str = "event_ts") -> DataFrame:
    return df if cutoff is None else df.filter(F.col(time) < F.lit(cutoff).cast("timestamp"))


def prior_source(events: DataFrame, key: str | list[str], cutoff: str | None = None) -> DataFrame:
    """Train rows before the cutoff: the event and the prior key, nothing else."""
    keys = [key] if isinstance(key, str) else key
    return before(events.filter(F.col("period") == "train"), cutoff).select("event_id", *keys)


def device_source(events: DataFrame, cutoff: str | None = None, include_pretest: bool = False) -> DataFrame:
    """Rows that describe devices: pretrain and train, optionally pretest, before the cutoff."""
    periods = ["pretrain", "train"] + (["pretest"] if include_pretest else [])
    return before(events.filter(F.col("period").isin(periods)), cutoff).select(
        "device_fp_i", "customer_id", "session_id"
    )


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score table from CSV with a header."""
    return spark.read.schema(SCORE_SCHEMA).option("header", True).csv(path)
