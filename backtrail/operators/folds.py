"""Time folds, validation choice, class thinning and row weights."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backtrail.functions import measures as m
from backtrail.operators.history import History, Past
from backtrail.operators.joins import only_row
from backtrail.operators.lookups import fits_broadcast, lookup
from backtrail.settings import ensure_checkpoint_folder


def thin_class(df: DataFrame, of_class: Column, share: float, seed: int = 0) -> DataFrame:
    """Keep the given share of one class and every other row; always the same rows."""
    draw = F.pmod(m.sampling_hash("event_id", "customer_id", seed), F.lit(10_000))
    return df.filter(~(F.coalesce(of_class, F.lit(False)) & (draw >= int(round(share * 10_000)))))


# -- folds ---------------------------------------------------------------------------------------


def time_holdout(df: DataFrame, start: str, time: str = "event_ts") -> DataFrame:
    """`is_valid`: rows from the start of validation on."""
    return df.withColumn("is_valid", (F.col(time) >= F.lit(start).cast("timestamp")).cast("int"))


def one_day_per_customer(df: DataFrame, start: str, end: str, seed: int = 42) -> DataFrame:
    """Rows of one hashed-random active day per customer inside the window.

    Days are few per customer and repeats are folded before the choice, so a busy customer costs
    no more than a quiet one.
    """
    inside = df.filter((F.col("event_ts") >= F.lit(start).cast("timestamp")) & (F.col("event_ts") < F.lit(end).cast("timestamp")))
    dated = inside.withColumn("_date", F.to_date("event_ts"))
    draw = F.pmod(F.unix_date("_date").cast("long") * m.EVENT_FACTOR + F.col("customer_id") * m.CUSTOMER_FACTOR + seed, F.lit(1_000_003))
    days = dated.groupBy("customer_id").agg(F.min(F.struct(draw.alias("draw"), F.col("_date").alias("_date")))["_date"].alias("_date"))
    # the pair is unique on the right, and a busy customer's rows are dealt out when it must shuffle
    return lookup(dated, days, ["customer_id", "_date"], "left_semi").drop("_date")


def month_spans(first: str, end: str, train_start: str, months: int | None = 3) -> list[tuple[str, str, str, str]]:
    """Validation months from `first` to `end`, each trained on the `months` before it, or on all.

    Spans are (name, train start, validation start, validation end).
    """
    def later(day: date, n: int) -> date:
        place = day.year * 12 + day.month - 1 + n
        return date(place // 12, place % 12 + 1, 1)

    start, stop, earliest = (date.fromisoformat(t) for t in (first, end, train_start))
    spans = []
    while start < stop:
        train = earliest if months is None else max(earliest, later(start, -months))
        if train < start:
            spans.append((f"f{len(spans)}", str(train), str(start), str(min(later(start, 1), stop))))
        start = later(start, 1)
    return spans


def mark_folds(df: DataFrame, spans: list[tuple[str, str, str, str]]) -> DataFrame:
    """Repeat each row for every fold it serves in: columns fold and part (train or valid).

    Spans are (name, train start, validation start, validation end), all but the last excluded at
    their end; each row is held against the few spans in place, without a join.
    """
    time = F.col("event_ts")
    roles = []
    for name, train_start, valid_start, valid_end in spans:
        at = {k: F.lit(v).cast("timestamp") for k, v in (("t", train_start), ("v", valid_start), ("e", valid_end))}
        part = F.when((time >= at["t"]) & (time < at["v"]), "train").when((time >= at["v"]) & (time < at["e"]), "valid")
        roles.append(F.struct(F.lit(name).alias("fold"), part.alias("part")))
    return df.select("*", F.inline(F.array(*roles))).filter("part IS NOT NULL")


# -- weights ----------------------------------------------------------------------------------------

# Weights of a row by its label: red, yellow, anything else.
BASE_WEIGHTS = (10.0, 2.5, 1.0)
GREEN_RECENT, GREEN_OLD, RECENT_FACTOR = 1.8, 3.0, 1.15
DECAY = (0.85, 1.25)


def label_weight(label: Column) -> Column:
    red, yellow, other = BASE_WEIGHTS
    return F.when(label == 1, red).when(label == 0, yellow).otherwise(other)


def dated_weight(label: Column, time: Column, border: str, recent: str) -> Column:
    late = time >= F.lit(border).cast("timestamp")
    base = F.when(label == -1, F.when(late, GREEN_RECENT).otherwise(GREEN_OLD)).otherwise(label_weight(label))
    return base * F.when(time >= F.lit(recent).cast("timestamp"), RECENT_FACTOR).otherwise(1.0)


def time_decay(df: DataFrame, time: str = "sec") -> Column:
    """Linear factor from 0.85 on the first to 1.25 on the last moment of the table."""
    ends = only_row(df.agg(F.min(time).alias("low"), F.max(time).alias("high")))
    days = F.greatest((ends["high"] - ends["low"]) / 86400.0, F.lit(1.0))
    share = (F.col(time) - ends["low"]) / 86400.0 / days
    return DECAY[0] + (DECAY[1] - DECAY[0]) * share


def importance_weights(df: DataFrame, kind: str, border: str, recent: int = 6, old: int = 20) -> DataFrame:
    """Class x inverse sampling rate x decay, scaled to mean 1; kind is main, labelled or suspicious."""
    label = F.col("train_target_raw")
    late = F.col("event_ts") >= F.lit(border).cast("timestamp")
    inverse = F.when(label == -1, F.when(late, float(recent)).otherwise(float(old))).otherwise(1.0)
    by_class = {
        "main": F.when(label == 0, 2.8).when(label == 1, 6.5).otherwise(1.0),
        "labelled": F.when(label == 0, 1.35).when(label == 1, 2.6).otherwise(1.0),
        "suspicious": F.when(label != -1, 3.0).otherwise(1.0),
    }[kind]
    raw = by_class * time_decay(df) * (F.lit(1.0) if kind == "labelled" else inverse)
    weighed = df.withColumn("_w", raw)
    base = weighed.filter(label != -1) if kind == "labelled" else weighed
    mean = only_row(base.agg(F.avg("_w").alias("mean")))["mean"]
    return weighed.withColumn("weight", F.col("_w") / mean).drop("_w")


def positive_weight(df: DataFrame, target: Column, cap: float = 100.0) -> DataFrame:
    """One row: negatives per positive, at least 1 and at most the cap; 1 without positives."""
    pos, neg = F.count(F.when(target == 1, 1)), F.count(F.when(target == 0, 1))
    ratio = F.least(F.lit(cap), F.greatest(F.lit(1.0), neg / F.nullif(pos, F.lit(0))))
    return df.agg(F.when(pos > 0, ratio).otherwise(1.0).alias("pos_weight"))


# -- heads and encodings --------------------------------------------------------------------------------


def head_part(head: str, recent: str) -> tuple[Column, Column, Column]:
    """Which rows a head has, their target and weight; heads are main, recent, suspicious, red_given_suspicious."""
    label = F.col("train_target_raw")
    red, suspicious = (label == 1).cast("int"), (label != -1).cast("int")
    if head == "suspicious":
        return F.lit(True), suspicious, F.when(label != -1, 6.0).otherwise(1.2)
    if head == "red_given_suspicious":
        return F.coalesce(label != -1, F.lit(False)), red, F.when(label == 1, 2.2).otherwise(1.0)
    own = F.lit(True)
    if head == "recent":
        own = F.coalesce((F.col("event_ts") >= F.lit(recent).cast("timestamp")) | (label != -1), F.lit(False))
    return own, red, label_weight(label)


def head_rows(df: DataFrame, head: str, recent: str) -> DataFrame:
    """Rows and target `y` of a head, with weight `w`."""
    own, target, weight = head_part(head, recent)
    return df.filter(own).withColumn("y", target).withColumn("w", weight)


def vocabulary(fit: DataFrame, column: str, first: int = 2) -> DataFrame:
    """Codes of the known values in ascending order, from `first` on."""
    values = fit.filter(F.col(column).isNotNull()).select(column).distinct()
    ranked = History.of(values, [], [column]).past(_at=Past.count()).frame()
    return ranked.select(column, (F.col("_at") + first).alias(f"{column}_code"))


def encode(df: DataFrame, fit: DataFrame, columns: list[str], unknown: int = 1) -> DataFrame:
    """Codes per column: 0 is left for padding, `unknown` for unseen values, known ones follow."""
    for column in columns:
        df = lookup(df, vocabulary(fit, column, unknown + 1), column)
        df = df.withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(unknown)))
    return df


def first_sightings(df: DataFrame, columns: list[str], time: str) -> DataFrame:
    """(column, value, first): when each value of each column was first seen, from one pass over the rows.

    The columns share a type. Values are folded in the task that reads them, so the shuffle takes different values only.
    Nulls are no values. The table is checkpointed, as the codes of each column are read from it.
    """
    ensure_checkpoint_folder(df.sparkSession)
    long = df.select(time, *columns).unpivot([time], list(columns), "column", "value").filter("value IS NOT NULL")
    return long.groupBy("column", "value").agg(F.min(time).alias("first")).checkpoint()


def fold_codes(sightings: DataFrame, borders: dict[str, str], unknown: int = 1) -> DataFrame:
    """(column, value, one code per fold): a fold knows the values first seen before its border, numbered in ascending order."""
    known = {fold: F.col("first") < F.lit(border).cast("timestamp") for fold, border in borders.items()}
    h = History.of(sightings, "column", ["value"]).past(**{f"_n_{f}": Past.sum(k.cast("long")) for f, k in known.items()})
    codes = [F.when(k, F.col(f"_n_{f}") + unknown + 1).otherwise(unknown).alias(f) for f, k in known.items()]
    return h.frame().select("column", "value", *codes)


def encode_folds(df: DataFrame, fit: DataFrame, columns: list[str], time: str, borders: dict[str, str], unknown: int = 1) -> DataFrame:
    """`encode` of all columns for all folds at once: adds {column}_code_{fold}.

    borders: fold -> time before which rows of `fit` count. The rows of `fit` are read once, whatever the columns and folds; the
    codes are broadcast when all of them fit, else each column is a lookup. A null is unknown.
    """
    codes = fold_codes(first_sightings(fit, columns, time), borders, unknown).checkpoint()
    small = fits_broadcast(codes)
    for column in columns:
        names = {fold: f"{column}_code_{fold}" for fold in borders}
        own = codes.filter(F.col("column") == column).select(
            F.col("value").cast(df.schema[column].dataType).alias(column), *[F.col(f).alias(n) for f, n in names.items()]
        )
        df = df.join(F.broadcast(own), column, "left") if small else lookup(df, own, column)
        df = df.withColumns({n: F.coalesce(n, F.lit(unknown)) for n in names.values()})
    return df


def unknown_rates(encoded: DataFrame, columns: list[str], unknown: int = 1, one_hot_up_to: int = 8) -> DataFrame:
    """Per column the rate of unknown codes, its cardinality and whether to one-hot it."""
    report = encoded.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.avg((F.col(f"{c}_code") == unknown).cast("double")).alias("unk_rate"),
                F.countDistinct(F.when(F.col(f"{c}_code") > unknown, F.col(f"{c}_code"))).alias("known_values"),
            ).alias(c)
            for c in columns
        ]
    ).select(F.inline(F.array(*columns)))
    cardinality = F.col("known_values") + 1
    return report.withColumn("mode", F.when(cardinality <= one_hot_up_to, "one_hot").otherwise("embedding"))


def standardise(fit: DataFrame, others: list[DataFrame], columns: list[str]) -> list[DataFrame]:
    """(x - mean) / population deviation of the fit rows, for every table; constant columns become 0."""
    stats = only_row(
        fit.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns])
    )
    scaled = {
        c: (F.col(c) - stats[f"{c}_mean"]) / F.when(stats[f"{c}_std"] > 0, stats[f"{c}_std"]).otherwise(1.0)
        for c in columns
    }
    return [df.withColumns(scaled) for df in (fit, *others)]
