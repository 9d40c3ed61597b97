"""Average precision of every weighting of some scores, without a table of rows times weightings.

A positive's threshold needs two counts: the positives and the rows at or above it. Positives are few and every
task holds them; rows are packed into blocks, and the task of a group of weightings reads all blocks one after another,
sorts the blended scores of each and adds up the counts. What is shuffled is one copy of the scores per group; counts
stay in their task, and there are as many groups as its memory for them calls for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.settings import setting

BLOCK_ROWS = 1 << 19
TOGETHER = 1 << 21  # rows that a task sorts at once
HELD_BYTES = 400 << 20  # counts that a task holds
MOST_UINT32 = (1 << 32) - 1


def blended(scores: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sum, added up in the order of the columns."""
    out = weights[0] * scores[:, 0]
    for i in range(1, len(weights)):
        out = out + weights[i] * scores[:, i]
    return out


def packed(rows: DataFrame, heads: list[str]) -> DataFrame:
    """Blocks of at most `BLOCK_ROWS` rows as the bytes of their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype("<f8"))
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()])], ["block"])
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()])], ["block"])

    return rows.select(*heads).mapInArrow(run, "block binary")


def search_blocks(rows: DataFrame, heads: list[str], target: str, weightings: np.ndarray) -> DataFrame | None:
    """(id, ap) per row of `weightings`; None when the positives are too many for every task to hold.

    rows: no nulls in `heads`. Equal blended scores share a threshold. ap is null without positives.
    """
    spark = rows.sparkSession
    positives = rows.filter(F.col(target) > 0).select(*heads)
    most = setting(spark, "backtrail.broadcast.bytes") // (8 * len(heads))
    some = positives.limit(most + 1)
    if some.count() > most:
        return None
    good = np.array([list(r) for r in positives.collect()], float).reshape(-1, len(heads))
    held = max(1, HELD_BYTES // (4 * max(1, len(good))))  # weightings whose counts one task can hold
    groups = max(1, min(len(weightings), max(4 * spark.sparkContext.defaultParallelism, -(-len(weightings) // held))))

    def thresholds(i: int) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(blended(good, weightings[i]), return_counts=True)

    def precision(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, np.ndarray] = {}  # rows at or above each threshold, by weighting
        seen = 0
        for scores, own in joined_blocks(batches, len(heads), groups, len(weightings)):
            seen += len(scores)
            for i in own:
                values, marks = np.sort(blended(scores, weightings[i])), thresholds(i)[0]
                so_far = above.pop(i, None)
                if so_far is None:
                    so_far = np.zeros(len(marks), np.uint32)
                if seen > MOST_UINT32 and so_far.dtype == np.uint32:
                    so_far = so_far.astype(np.int64)
                so_far += (len(values) - np.searchsorted(values, marks, "left")).astype(so_far.dtype)
                above[i] = so_far
        for i in sorted(above):
            n = thresholds(i)[1].astype(float)
            reached = np.cumsum(n[::-1])[::-1]
            ap = float((n * reached / above.pop(i)).sum() / n.sum()) if len(n) else None
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([ap], pa.float64())], ["id", "ap"])

    each = packed(rows, heads).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return each.repartitionById(groups, F.col("group")).mapInArrow(precision, "id int, ap double")


def joined_blocks(batches: Iterator[pa.RecordBatch], width: int, groups: int, many: int) -> Iterator[tuple[np.ndarray, range]]:
    """Blocks (block, group) of one group put together to about `TOGETHER` rows, with the places of the group's weightings."""
    some, size, own = [], 0, range(0)
    for batch in batches:
        for block, group in zip(batch.column(0), batch.column(1)):
            some.append(np.frombuffer(block.as_buffer(), "<f8").reshape(-1, width))
            size, own = size + len(some[-1]), range(group.as_py(), many, groups)
            if size >= TOGETHER:
                yield np.concatenate(some), own
                some, size = [], 0
    if some:
        yield np.concatenate(some), own


def search(df: DataFrame, target: str, heads: list[str], grid: DataFrame, otherwise: Callable[[], DataFrame]) -> DataFrame:
    """AP of every row of `grid` (w_<head>, ...), a table as long as the search has weightings."""
    names = [f"w_{h}" for h in heads]
    spark = df.sparkSession
    weightings = np.array([list(r) for r in grid.select(*names).collect()], float).reshape(-1, len(heads))
    rows = df.select(F.col(target).alias("_y"), *[F.col(h).cast("double").alias(h) for h in heads]).na.drop(subset=heads)
    found = search_blocks(rows, heads, "_y", weightings)
    if found is None:
        return otherwise()
    shares = ", ".join(f"`{n}` double" for n in names)
    table = spark.createDataFrame([(i, *map(float, w)) for i, w in enumerate(weightings)], f"id int, {shares}")
    return table.join(found, "id").select(*names, "ap")
