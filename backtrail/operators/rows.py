"""Distinct rows, one row per event, and the last rows per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: str, order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in the given order.

    A running minimum of whole rows folds copies before the shuffle, so a key with very many
    copies sends one row per task.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    row = F.struct(*order, *rest)
    pick = (F.max if last else F.min)(row).alias("_row")
    return df.groupBy(key).agg(pick).select(key, "_row.*").select(*df.columns)


def keep_last_and_flag(df: DataFrame, key: str, order: list[str], flag: str = "duplicated_event") -> DataFrame:
    """The last row of each key; the flag tells that an earlier one was dropped."""
    rest = [c for c in df.columns if c != key and c not in order]
    folded = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_row"), F.count("*").alias("_n"))
    return folded.select(key, "_row.*", (F.col("_n") > 1).cast("int").alias(flag)).select(*df.columns, flag)


def last_rows(df: DataFrame, entity: str, order: list[str], n: int) -> DataFrame:
    """The last n rows per entity, numbered back from 1.

    Spark keeps only n rows per entity and task before the shuffle (window group limit), so the
    result of a heavy entity is as small as any other's.
    """
    back = Window.partitionBy(entity).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= n)
