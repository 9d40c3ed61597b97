"""Session settings the operators read: sizes that decide when a group is too large for one task."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import SparkSession

# Setting name -> default. Each can be overridden with spark.conf.set(name, value).
DEFAULTS = {
    # Most rows of one key that a single window task may hold.
    "backtrail.rows.per.task": 2_000_000,
    # The same for sliding time frames, whose cost grows with rows x frame length.
    "backtrail.rows.per.range.task": 100_000,
    # Rows that one task of a history of many entities gets; an entity of more rows stays whole up to the bounds above.
    "backtrail.rows.per.partition": 30_000,
    # Largest lookup table that is broadcast; larger ones are joined by shuffle.
    "backtrail.broadcast.rows": 200_000,
    # The same in bytes.
    "backtrail.broadcast.bytes": 64 << 20,
    # Most rows of a history without an entity that are one block.
    "backtrail.rows.per.global.task": 100_000,
    # Pieces a heavy key is cut into for a shuffled lookup.
    "backtrail.salts": 64,
}
LARGEST_COMPILED = 8000  # bytes of the largest method that the JVM compiles


def setting(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(name, str(DEFAULTS[name])))


def prepare(spark: SparkSession) -> SparkSession:
    """Clock features are defined on UTC, so the session zone is pinned before any plan is built; large methods are avoided."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # the JVM never compiles a method of more bytes; a plan that would need one then runs as smaller methods
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > LARGEST_COMPILED:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(LARGEST_COMPILED))
    return spark


def ensure_checkpoint_folder(spark: SparkSession) -> None:
    """Use the folder the cluster names; make a private one only for a local master without any."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="backtrail-checkpoint-")
    context.setCheckpointDir(folder)


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remove_at_exit(spark: SparkSession, path: str) -> str:
    """Remove a folder when the driver's Python ends; gives the path back."""

    def remove() -> None:
        try:
            remove_folder(spark, path)
        except Exception:  # the session has ended already; the cluster's own clean-up takes the folder
            pass

    atexit.register(remove)
    return path
