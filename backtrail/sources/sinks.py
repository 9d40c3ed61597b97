"""Writers: parquet parts, split tables, score files and build-once artefacts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_within: list[str] | None = None):
    """Zstd parquet; `sort_within` orders rows inside each file without a global sort."""
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def merge_parts(spark: SparkSession, paths: list[str], out: str):
    """One table out of part tables, whose columns may differ."""
    write_parquet(spark.read.option("mergeSchema", True).parquet(*paths), out)


def write_split(df: DataFrame, path: str):
    """Train rows and test rows as the two partitions `split=train` and `split=test`."""
    split = F.when(F.col("is_train_sample"), "train").when(F.col("is_test"), "test")
    rows = df.withColumn("split", split).filter(F.col("split").isNotNull())
    write_parquet(rows, path, partition_by=["split"])


def write_scores(scores: DataFrame, csv_path: str, parquet_path: str | None = None):
    """Event scores as CSV with a header and, when asked, as parquet."""
    table = scores.select("event_id", "predict")
    if parquet_path is not None:
        write_parquet(table, parquet_path)
        table = table.sparkSession.read.parquet(parquet_path)
    table.write.mode("overwrite").option("header", True).csv(csv_path)


def write_in_order(scores: DataFrame, path: str, position: str = "position"):
    """Score rows as CSV parts that follow each other in the order of `position`, which is written too."""
    ordered = scores.select(position, "event_id", "predict").repartitionByRange(position).sortWithinPartitions(position)
    ordered.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str):
    """Small result rows (metrics, weights, settings) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Read the table at `path`, building it first when it is absent, unfinished or `force` is set."""
    if force or not _finished(spark, path):
        write_parquet(build(), path)
    return spark.read.parquet(path)


def _finished(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)
