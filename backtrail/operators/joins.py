"""Joins with a rule of their own: as-of, template, several score tables, keyed updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.operators.history import History, Past
from backtrail.operators.lookups import lookup


def asof_join(
    left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, tie: str | None = None
) -> DataFrame:
    """Each left row with the last right row of the same key at or before its time.

    Both sides are put in one order, right rows first at equal times, and the latest right row is
    carried forward; `tie` orders right rows of one time. A key with most of the rows is cut like
    any other history, so no key is joined pairwise.
    """
    payload = [c for c in right.columns if c not in (by, right_time)]
    last = F.lit(0) if tie is None else F.col(tie).cast("long")
    probes = left.select(
        F.col(by), F.col(left_time).alias("_at"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"),
        F.xxhash64(*left.columns).alias("_row"), F.struct(*left.columns).alias("_left"),
        F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType).alias("_right"),
    )
    marks = right.select(
        F.col(by), F.col(right_time).alias("_at"), F.lit(0).alias("_side"), last.alias("_tie"),
        F.xxhash64(*right.columns).alias("_row"),
        F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"),
        F.struct(*payload).alias("_right"),
    )
    h = History.of(probes.unionByName(marks), by, ["_at", "_side", "_tie", "_row"]).past(_found=Past.latest("_right"))
    return h.frame().filter("_side = 1").select("_left.*", *[F.col("_found")[c].alias(c) for c in payload])


def only_row(df: DataFrame) -> dict[str, Column]:
    """The values of a one-row aggregate as literals, for use in expressions on other tables."""
    row = df.first()
    return {name: F.lit(row[name]) for name in df.columns}


def keep_customers(df: DataFrame, customers: DataFrame) -> DataFrame:
    """Rows of the listed customers; the list may hold repeats."""
    return lookup(df, customers.select("customer_id").distinct(), "customer_id", "left_semi")


def fill_template(template: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per template event; events without a score take the median score.

    Of several scores of one event the smallest is taken, so that a rerun gives the same file.
    """
    from backtrail.operators.quality import percentiles

    events = template.select("event_id").distinct()
    per_event = scores.groupBy("event_id").agg(F.min("predict").alias("predict"))
    joined = lookup(events, per_event, "event_id")
    middle = only_row(percentiles(joined, [], "predict", {"median": 0.5}))["median"]
    return joined.withColumn("predict", F.coalesce("predict", middle))


def gather_scores(template: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Template events with one column per score table, null where it has no score.

    All tables meet in one aggregation by event, which is joined once. Of several scores of one
    event in one table the largest is taken.
    """
    tagged = [t.select("event_id", F.lit(name).alias("_source"), F.col("predict").alias("_score")) for name, t in sources.items()]
    if not tagged:
        return template.select("event_id")
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    scores = [F.max(F.when(F.col("_source") == name, F.col("_score"))).alias(name) for name in sources]
    return lookup(template.select("event_id"), every.groupBy("event_id").agg(*scores), "event_id", unique=True)


def fill_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    from backtrail.operators.quality import fill_values, medians

    return fill_values(df, medians(df, columns), "median")


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return counts.unpivot([], columns, "source", "missing")


def set_where_listed(df: DataFrame, column: str, updates: DataFrame, key: str = "event_id") -> DataFrame:
    """Replace a column on rows whose key is in `updates` (key, value)."""
    joined = lookup(df, updates.select(key, F.col("value").alias("_value")), key)
    return joined.withColumn(column, F.coalesce("_value", column)).drop("_value")


def flag_listed(df: DataFrame, listed: DataFrame, key: str, name: str) -> DataFrame:
    """1 on rows whose key occurs in `listed`, else 0."""
    keys = listed.select(key).distinct().withColumn("_listed", F.lit(1))
    return lookup(df, keys, key).withColumn(name, F.coalesce("_listed", F.lit(0))).drop("_listed")


def positions(index: DataFrame, queries: DataFrame, key: str = "event_id") -> DataFrame:
    """Place of each queried event in the ordered index; `require_all` tells whether all were found."""
    numbered = History.of(index.select(key), [], [key]).past(pos=Past.count()).frame()
    return lookup(queries.select(key), numbered, key)


def require_all(queries: DataFrame, index: DataFrame, key: str = "event_id") -> None:
    absent = queries.select(key).join(index.select(key), key, "left_anti")
    if not absent.isEmpty():
        raise ValueError(f"some values of {key} are not in the index")
