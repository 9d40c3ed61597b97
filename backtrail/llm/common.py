"""Helpers that the corpus operators share: tables in the shared folder, folds, row keys."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.settings import ensure_checkpoint_folder, remove_at_exit, remove_folder


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table below the checkpoint folder that all executors share, and read it back.

    The lineage ends there, so a lost executor costs only a read of the table, and Spark knows the
    table's size, so that it chooses broadcast joins by measured bytes. The table is removed when
    the driver's Python ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_folder(spark)
    path = remove_at_exit(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_to = path
    return table


def release(*tables: DataFrame) -> None:
    """Remove tables of `cut` that nothing reads any more: what was made of them is written itself."""
    for table in tables:
        remove_folder(table.sparkSession, table._cut_to)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the files of shuffles that no DataFrame needs any more.

    Spark keeps them until the driver collects its garbage, which a long row of small jobs hardly makes it do: each of
    their shuffles leaves some files per task on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(parts))


def row_key(doc_id: str, text: str) -> list[Column]:
    """Two columns that tell rows apart by id and text; equal rows share a key, nulls have one too.

    Rows with the same id and different texts meet only if their 64-bit hashes collide as well.
    """
    return [F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.xxhash64(F.col(text)).alias("_text")]


def hash_share(columns: list[Column]) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def sampled(df: DataFrame, key: str, most: int, rows: int) -> DataFrame:
    """About `most` of `rows` rows, chosen by a hash of the key: the same ones on every run."""
    return df if rows <= most else df.filter(hash_share([F.col(key), F.lit("sample")]) < most / rows)
