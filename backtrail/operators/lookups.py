"""Joins of a large table with a table that holds one row per key.

A lookup table is broadcast only after its rows and bytes were counted. Beyond the bound the join is a
shuffle, and keys that hold too many rows of the large side are spread over several tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.settings import ensure_checkpoint_folder, setting

SALT = "_salt"


def heavy_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Keys with more than `limit` rows, the null key among them, as a checkpointed table; None when there are none.

    There are fewer than rows / limit of them. They are never collected.
    """
    ensure_checkpoint_folder(df.sparkSession)
    heavy = df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys).checkpoint()
    return None if heavy.isEmpty() else heavy


def split_by_keys(df: DataFrame, listed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is listed and the other rows; null matches null."""
    named = listed.select(*[F.col(k).alias(f"_listed_{k}") for k in keys])
    if fits_broadcast(named):
        named = F.broadcast(named)
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_listed_{k}")) for k in keys])
    return df.join(named, match, "left_semi"), df.join(named, match, "left_anti")


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of all keys in which null matches null."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: text by its length, arrays by eight bytes an element."""
    parts = [F.lit(0).cast("long")]
    for field in df.schema.fields:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        size = {"string": F.octet_length, "binary": F.octet_length, "array": lambda c: F.size(c) * 8, "map": lambda c: F.size(c) * 32}.get(kind)
        parts.append(F.lit(8) if size is None else F.coalesce(F.greatest(size(column), F.lit(0)), F.lit(0)) + 16)
    return reduce(lambda a, b: a + b, parts)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a table is within the bounds of rows and of bytes for a broadcast."""
    spark = df.sparkSession
    cap = setting(spark, "backtrail.broadcast.rows")
    rows, size = df.limit(cap + 1).agg(F.count("*"), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return rows <= cap and size <= setting(spark, "backtrail.broadcast.bytes")


def lookup(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", unique: bool = False) -> DataFrame:
    """Join `right`, which has one row per key, to `left` (how: left, inner, left_semi, left_anti).

    At most the rows that may be broadcast are checkpointed to be measured; a small table is so computed
    once and nothing stays cached. Call `spread_join` directly where the right side grows with the events.
    """
    keys = [on] if isinstance(on, str) else list(on)
    ensure_checkpoint_folder(left.sparkSession)
    some = right.limit(setting(left.sparkSession, "backtrail.broadcast.rows") + 1).checkpoint()
    if fits_broadcast(some):
        return left.join(F.broadcast(some), keys, how)
    return spread_join(left, right, keys, how, unique)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", unique: bool = False) -> DataFrame:
    """Shuffled lookup in which the rows of a heavy key are dealt to several tasks.

    The single right-hand row of a heavy key is repeated once per salt; other keys use salt 0. Rows of
    `left` with a null in the key match nothing; where they are many they are dealt over the salts like those of a heavy key. There
    is one join, so `left` is built once. Set `unique` where a key has few rows of `left` too, as an event id has: then
    nothing is counted.
    """
    spark = left.sparkSession
    heavy = None if unique else heavy_keys(left, keys, setting(spark, "backtrail.rows.per.task"))
    if heavy is None:
        return left.join(right, keys, how)
    salts = setting(spark, "backtrail.salts")
    # the partition number keeps exact copies of one row from sharing a salt
    deal = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in _hashable(left)]), F.lit(salts)).cast("int")
    lost = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    flagged = heavy.withColumn("_heavy", F.lit(True))
    if fits_broadcast(heavy):
        flagged = F.broadcast(flagged)
    salted_left = (
        left.join(flagged, keys, "left")
        .withColumn(SALT, F.when(F.col("_heavy") | lost, deal).otherwise(F.lit(0)))
        .drop("_heavy")
    )
    every_salt = F.sequence(F.lit(0), F.lit(salts - 1))
    salted_right = (
        right.join(flagged, keys, "left")
        .withColumn(SALT, F.explode(F.when(F.col("_heavy"), every_salt).otherwise(F.array(F.lit(0)))))
        .drop("_heavy")
    )
    return salted_left.join(salted_right, [*keys, SALT], how).drop(SALT)


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
