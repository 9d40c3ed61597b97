"""Checks and audits of tables: ranges, types, feature selection, imputation, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.operators.history import History, Past
from backtrail.operators.joins import only_row
from backtrail.operators.lookups import lookup


def unpivoted(df: DataFrame, columns: list[str], name: str, value: str, ids: list[str] | None = None) -> DataFrame:
    return df.unpivot(ids or [], columns, name, value)


def range_report(df: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Per field the rows below, at or above its bounds, with a fraction, and null; one pass."""
    def tally(condition):
        return F.count(F.when(condition, 1))

    report = df.agg(
        *[
            F.struct(
                F.lit(c).alias("field"),
                tally(F.col(c) < low).alias("below"),
                tally(F.col(c) >= high).alias("above"),
                tally(F.col(c) != F.floor(F.col(c))).alias("fractional"),
                tally(F.col(c).isNull()).alias("missing"),
            ).alias(c)
            for c, (low, high) in bounds.items()
        ]
    )
    return report.select(F.inline(F.array(*bounds)))


_WIDTHS = (("tinyint", 7), ("smallint", 15), ("int", 31))


def narrowest_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Smallest whole-number type that holds the observed values of each column."""
    def kind(low, high):
        choice = F.lit("bigint")
        for name, bits in reversed(_WIDTHS):
            choice = F.when((low >= -(2**bits)) & (high < 2**bits), name).otherwise(choice)
        return choice

    extremes = df.agg(
        *[
            F.struct(
                F.lit(c).alias("field"), F.min(c).cast("long").alias("low"), F.max(c).cast("long").alias("high")
            ).alias(c)
            for c in columns
        ]
    ).select(F.inline(F.array(*columns)))
    return extremes.withColumn("kind", kind(F.col("low"), F.col("high")))


def narrow(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast the columns to the types `narrowest_types` finds (one result row per column)."""
    kinds = {row["field"]: row["kind"] for row in narrowest_types(df, columns).collect()}
    return df.withColumns({c: F.col(c).cast(kinds[c]) for c in columns})


def distinct_names(names: list[str]) -> list[str]:
    """The names once each, in the order of their first use."""
    return list(dict.fromkeys(names))


def select_present(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[c for c in distinct_names(names) if c in df.columns])


# -- percentiles and imputation -----------------------------------------------------------------


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles per key, without holding a key's values in one task.

    Equal values are counted first; the running count over ordered values then tells which of them
    stand at the two places around each percentile.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = History.of(counts, keys, ["_v"]).past(_below=Past.sum("_n")).frame()
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    placed = lookup(ranked, totals, keys) if keys else ranked.withColumns({"_total": only_row(totals)["_total"]})
    columns = []
    for name, p in points.items():
        place = (F.col("_total") - 1) * p
        low, high = F.floor(place), F.ceil(place)
        columns += [
            F.max(F.when((F.col("_below") <= low) & (low < F.col("_below") + F.col("_n")), F.col("_v"))).alias(f"_{name}_lo"),
            F.max(F.when((F.col("_below") <= high) & (high < F.col("_below") + F.col("_n")), F.col("_v"))).alias(f"_{name}_hi"),
            F.max(place - low).alias(f"_{name}_part"),
        ]
    found = placed.groupBy(*keys).agg(*columns)
    return found.select(
        *keys,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n)
            for n in points
        ],
    )


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: feature and its exact median."""
    long = unpivoted(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), columns, "feature", "value")
    return percentiles(long, ["feature"], "value", {"median": 0.5})


def fill_values(df: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Fill nulls from a table with one row per column (feature, value)."""
    found = {row["feature"]: row[value] for row in values.collect()}
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in found.items() if v is not None}
    )


def impute(fit: DataFrame, others: list[DataFrame], numeric: list[str], categories: list[str]) -> list[DataFrame]:
    """Medians of the fit rows fill the numbers of every table, -1 fills the categories."""
    middle = medians(fit, numeric)
    filled = [fill_values(df, middle, "median") for df in (fit, *others)]
    return [df.fillna(-1, subset=categories) for df in filled]


def means(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.avg(c).alias(c) for c in columns])
    return unpivoted(one, columns, "feature", "mean")


# -- audit ------------------------------------------------------------------------------------------

# Features built from labels; they describe the training rows too well to be used on others.
# Fixed values.
RISKY_FEATURES = (
    "cnt_prev_labeled_same_desc", "cnt_prev_red_same_desc_lbl", "cnt_prev_yellow_same_desc_lbl",
    "red_rate_prev_same_desc_lbl", "cnt_prev_red_same_channel", "cnt_prev_labeled_same_channel",
    "red_rate_prev_same_channel", "cnt_prev_red_same_type_lbl", "cnt_prev_labeled_same_type_lbl",
    "red_rate_prev_same_type",
)
RISKY_SUFFIXES = ("_red_rate_all", "_labeled_rate_all", "_red_share_labeled")
# Limits of the two rule sets: share of the most common value, share of nulls, collapse of a category.
STRICT_RULES = {"dominant": 0.9995, "sparse": 0.995, "collapse_values": 20, "risky": True}
LOOSE_RULES = {"dominant": 0.9997, "sparse": 0.997, "collapse_values": 50, "risky": False}


def _value_profile(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    """Distinct values (null counted), null share and largest share per column."""
    long = unpivoted(df.select(*[F.col(c).cast("string").alias(c) for c in columns]), columns, "feature", "value")
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    total = F.sum("n")
    return counts.groupBy("feature").agg(
        F.count("*").alias(f"{side}_nunique"),
        (F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)) / total).alias(f"{side}_missing_rate"),
        (F.max("n") / total).alias(f"{side}_top_share"),
    )


def audit_features(
    train: DataFrame, test: DataFrame, columns: list[str], categories: list[str], rules: dict = STRICT_RULES
) -> DataFrame:
    """One row per feature with the reason to drop it, or `keep`."""
    both = [c for c in columns if c in train.columns and c in test.columns]
    table = _value_profile(train, both, "train").join(_value_profile(test, both, "test"), "feature")
    name, category = F.col("feature"), F.col("feature").isin(*categories) if categories else F.lit(False)
    nunique, missing = F.col("train_nunique"), F.col("train_missing_rate")
    share = F.when(category | (nunique <= 128) | (missing >= 0.95), F.col("train_top_share")).otherwise(0.0)
    reason = F.when(F.lit(False), "")
    if rules["risky"]:
        reason = reason.when(name.isin(*RISKY_FEATURES), "risky_label_feature")
        for suffix in RISKY_SUFFIXES:
            reason = reason.when(name.endswith(suffix), "risky_label_prior")
    reason = (
        reason.when(nunique <= 1, "constant")
        .when(share >= rules["dominant"], "almost_constant")
        .when((missing >= rules["sparse"]) & (F.col("test_missing_rate") >= rules["sparse"]), "too_sparse")
        .when(
            category & (missing >= 0.85) & (nunique >= rules["collapse_values"]) & (F.col("test_nunique") <= 2),
            "collapsed_in_test",
        )
        .otherwise("keep")
    )
    audited = table.select(
        "feature", reason.alias("drop_reason"), "train_nunique", "test_nunique", "train_missing_rate",
        "test_missing_rate", share.alias("dominant_share"),
    )
    absent = [(c,) for c in columns if c not in both]
    if absent:
        gone = train.sparkSession.createDataFrame(absent, "feature string")
        gone = gone.withColumn("drop_reason", F.lit("missing_in_split"))
        audited = audited.unionByName(gone, allowMissingColumns=True)
    return audited


def audit_order(audit: DataFrame) -> DataFrame:
    return audit.orderBy("drop_reason", F.col("train_missing_rate").desc(), F.col("dominant_share").desc(), "feature")


def completeness(scores: DataFrame, template: DataFrame) -> DataFrame:
    """One row: template events, score rows, missing, duplicated and unknown events."""
    per_event = scores.groupBy("event_id").agg(F.count("*").alias("n"))
    wanted = template.select("event_id").distinct().withColumn("wanted", F.lit(1))
    both = wanted.join(per_event, "event_id", "full")
    tally = lambda condition: F.count(F.when(condition, 1))
    return both.agg(
        tally(F.col("wanted") == 1).alias("template_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("score_rows"),
        tally(F.col("n").isNull()).alias("missing"),
        tally(F.col("n") > 1).alias("duplicated"),
        tally(F.col("wanted").isNull()).alias("unknown"),
    )


def dataset_overview(df: DataFrame, dataset: str, telemetry: str) -> DataFrame:
    """Rows, labels by colour and share of rows with telemetry and with a session, per dataset."""
    tally = lambda condition: F.count(F.when(condition, 1))
    target = F.col("target")
    return df.groupBy(dataset).agg(
        F.count("*").alias("n"),
        tally(target == 1).alias("red"),
        tally(target == 0).alias("yellow"),
        tally(target.isNull() & (F.col(dataset) == "train")).alias("green"),
        F.avg(F.col(telemetry).cast("double")).alias("telemetry_rate"),
        F.avg(F.col("session_id").isNotNull().cast("double")).alias("session_present_rate"),
    )
