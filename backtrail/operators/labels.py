"""Features of the labels on earlier rows, label priors per key, devices and customer profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backtrail.operators.history import BLOCK, History, Past
from backtrail.operators.lookups import fits_broadcast, lookup
from backtrail.settings import ensure_checkpoint_folder, setting
from backtrail.sources.tables import prior_source

PRIOR_KEYS = (
    "event_desc", "mcc_code_i", "timezone", "operating_system_type", "channel_indicator_sub_type",
    "event_type_nm", "pos_cd", "channel_indicator_type", "accept_language_i", "browser_language_i", "device_fp_i",
)
PRIOR_PAIRS = (
    ("mcc_code_i", "event_type_nm"), ("event_desc", "channel_indicator_sub_type"),
    ("pos_cd", "event_type_nm"), ("mcc_code_i", "channel_indicator_sub_type"),
)
# Group of a fine label history -> its column.
LABEL_GROUPS = {"desc": "event_desc", "channel": "channel_indicator_type", "type": "event_type_nm"}


# -- label history -------------------------------------------------------------------------------


def label_counts(h: History) -> History:
    """Past red, yellow and labelled rows of the customer, overall and per group."""
    features = {
        "cust_prev_red_lbl_cnt": Past.sum("is_red_lbl"),
        "cust_prev_yellow_lbl_cnt": Past.sum("is_yellow_lbl"),
        "cust_prev_labeled_cnt": Past.sum("is_labeled_fb"),
        "cust_prev_events": Past.count(),
    }
    for name, by in LABEL_GROUPS.items():
        features[f"cnt_prev_red_same_{name}"] = Past.sum("is_red_lbl", by)
        features[f"cnt_prev_yellow_same_{name}"] = Past.sum("is_yellow_lbl", by)
        features[f"cnt_prev_labeled_same_{name}"] = Past.sum("is_labeled_fb", by)
    return h.past(**features)


def label_rates(h: History, smooth: bool = True) -> History:
    """Rates over the counts of `label_counts`; smoothed by +0.1 / +1, or plain with at least 1 below."""
    c = F.col

    def rate(top, bottom):
        return (top + 0.1) / (bottom + 1.0) if smooth else top / F.greatest(bottom, F.lit(1))

    red, yellow, labelled = c("cust_prev_red_lbl_cnt"), c("cust_prev_yellow_lbl_cnt"), c("cust_prev_labeled_cnt")
    columns = {
        "cust_prev_red_lbl_rate": rate(red, labelled),
        "cust_prev_yellow_lbl_rate": rate(yellow, labelled),
        # the smoothed suspicious rate is taken over all past events, the plain one over the labelled
        "cust_prev_susp_lbl_rate": rate(red + yellow, c("cust_prev_events") if smooth else labelled),
        "cust_prev_any_red_flag": (red > 0).cast("int"),
        "cust_prev_any_yellow_flag": (yellow > 0).cast("int"),
    }
    for name in LABEL_GROUPS:
        columns[f"red_rate_prev_same_{name}"] = rate(c(f"cnt_prev_red_same_{name}"), c(f"cnt_prev_labeled_same_{name}"))
    return h.with_columns(columns)


def label_gaps(h: History) -> History:
    """Seconds since the last past red and yellow row, -1 when there is none."""
    red, yellow = F.when(F.col("is_red_lbl") == 1, F.col("sec")), F.when(F.col("is_yellow_lbl") == 1, F.col("sec"))
    h = h.past(_red_at=Past.latest(red), _yellow_at=Past.latest(yellow))
    h = h.with_columns(
        {
            "sec_since_prev_red_lbl": F.coalesce(F.col("sec") - F.col("_red_at"), F.lit(-1)),
            "sec_since_prev_yellow_lbl": F.coalesce(F.col("sec") - F.col("_yellow_at"), F.lit(-1)),
        }
    )
    return h.each(lambda df: df.drop("_red_at", "_yellow_at"))


def label_logs(h: History, default_days: int = 365) -> History:
    """Log counts of, and log seconds since, past yellow, red and suspicious (either) rows."""
    kinds = {"yellow": F.col("is_yellow_lbl"), "red": F.col("is_red_lbl"), "suspicious": F.col("is_labeled_fb")}
    h = h.past(**{f"_n_{k}": Past.sum(flag) for k, flag in kinds.items()},
               **{f"_at_{k}": Past.latest(F.when(flag == 1, F.col("sec"))) for k, flag in kinds.items()})
    cap = default_days * 86400
    columns = {}
    for k in kinds:
        gap = F.greatest(F.least(F.col("sec") - F.col(f"_at_{k}"), F.lit(cap)), F.lit(0))
        columns[f"lh_prev_{k}_count_log"] = F.log1p(F.col(f"_n_{k}"))
        known = F.col(f"_at_{k}").isNotNull()
        columns[f"lh_since_last_{k}_log"] = F.when(known, F.log1p(gap.cast("double"))).otherwise(math.log1p(cap))
    helpers = [f"_{p}_{k}" for p in ("n", "at") for k in kinds]
    return h.with_columns(columns).each(lambda df: df.drop(*helpers))


# -- prior tables ------------------------------------------------------------------------------------


def count_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def labelled_per_key(df: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labelled rows and red rows per key, from the labelled events only."""
    joined = lookup(df, labels.select("event_id", "target"), "event_id", "inner", unique=True)
    return joined.groupBy(*keys).agg(F.count("*").alias("lbl"), F.sum("target").cast("double").alias("red"))


def prior_table(events: DataFrame, labels: DataFrame, keys: list[str], cutoff: str | None = None) -> DataFrame:
    """Smoothed label rates per key over train rows before the cutoff, in one pass over the events.

    The rates of all rows are drawn towards 1/200, the share among labelled rows towards 1/2.
    """
    source = lookup(prior_source(events, keys, cutoff), labels.select("event_id", "target"), "event_id", unique=True)
    return _prior_rates(source.groupBy(*keys).agg(*_prior_counts()), keys)


def _prior_counts() -> list[Column]:
    return [F.count("*").alias("n"), F.count("target").alias("lbl"), F.coalesce(F.sum("target"), F.lit(0)).alias("red")]


def smoothed_rates(n: Column, lbl: Column, red: Column) -> dict[str, Column]:
    return {
        "red_rate_all": (red + 1.0) / (n + 200.0),
        "labeled_rate_all": (lbl + 1.0) / (n + 200.0),
        "red_share_labeled": (red + 1.0) / (lbl + 2.0),
    }


def _prior_rates(sums: DataFrame, keys: list[str]) -> DataFrame:
    name = "x".join(keys)
    rates = smoothed_rates(F.col("n"), F.col("lbl"), F.col("red"))
    return sums.select(*keys, F.col("n").alias(f"prior_{name}_cnt"), *[v.alias(f"prior_{name}_{k}") for k, v in rates.items()])


def prior_sums(events: DataFrame, labels: DataFrame, key_sets: list[tuple[str, ...]], cutoff: str | None = None) -> DataFrame:
    """Rows, labelled rows and red rows per value of every key set, from one scan and one label join.

    One row per key set (`_set`, its place in the list) and value; columns of other key sets are null. Rows are
    repeated per key set inside the task and summed there, so that only sums are shuffled. The table is
    checkpointed, as each key set is read from it on its own.
    """
    ensure_checkpoint_folder(events.sparkSession)
    keys = _key_columns(key_sets)
    source = lookup(prior_source(events, keys, cutoff), labels.select("event_id", "target"), "event_id", unique=True)
    sums = source.groupingSets([list(k) for k in key_sets], *keys).agg(*_prior_counts(), F.grouping_id().alias("_set"))
    places = F.create_map(*[F.lit(v) for i, k in enumerate(key_sets) for v in (_grouping_id(keys, k), i)])
    return sums.withColumn("_set", places[F.col("_set")]).checkpoint()


def prior_tables(events: DataFrame, labels: DataFrame, key_sets: list[tuple[str, ...]], cutoff: str | None = None) -> dict[tuple[str, ...], DataFrame]:
    """`prior_table` of every key set, all from one scan."""
    return _split_sums(prior_sums(events, labels, key_sets, cutoff), key_sets)


def _split_sums(sums: DataFrame, key_sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], DataFrame]:
    return {k: _prior_rates(sums.filter(F.col("_set") == i), list(k)) for i, k in enumerate(key_sets)}


def _key_columns(key_sets: list[tuple[str, ...]]) -> list[str]:
    return list(dict.fromkeys(c for keys in key_sets for c in keys))


def _grouping_id(columns: list[str], grouped: tuple[str, ...]) -> int:
    """The number Spark gives a grouping set: one bit per column, first column highest, set where left out."""
    return sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in grouped)


def attach_priors(df: DataFrame, priors: dict[tuple[str, ...], DataFrame]) -> DataFrame:
    for keys, table in priors.items():
        df = lookup(df, table, list(keys))
    return df


def attach_all_priors(
    df: DataFrame, events: DataFrame, labels: DataFrame, key_sets: list[tuple[str, ...]], cutoff: str | None = None
) -> DataFrame:
    """Priors of every key set, measured together: broadcast when all of them fit, else one lookup each."""
    sums = prior_sums(events, labels, key_sets, cutoff)
    tables = _split_sums(sums, key_sets)
    if not fits_broadcast(sums):
        return attach_priors(df, tables)
    for keys, table in tables.items():
        df = df.join(F.broadcast(table), list(keys), "left")
    return df


def running_priors(events: DataFrame, order: list[str], keys: tuple[str, ...] = PRIOR_KEYS) -> DataFrame:
    """Red share of the earlier labelled rows of any customer with the same key value.

    Few key values hold all rows, so the rows are one global history in time order, which beyond one
    task's rows is cut into time blocks that all keys share. Per block and value present in it the sums of
    earlier blocks become one narrow opening row; rows and opening rows meet in one shuffle by block,
    which serves the windows of all keys.
    """
    h = History.of(events, [], order)
    sets = {key: _grouping_id([BLOCK, *keys], (BLOCK, key)) for key in keys}
    if h.heavy is None:
        rows = h.light.withColumns({BLOCK: F.lit(0), "_set": F.lit(None).cast("long")}).repartition(1)
    else:
        rows = h.heavy.withColumn("_set", F.lit(None).cast("long"))
        rows = rows.unionByName(_opening_rows(h.heavy, keys), allowMissingColumns=True)
        rows = rows.repartitionById(h.blocks, F.col(BLOCK))  # one block a task: no merging of small partitions, no shared hashes
    rates, sums = {}, {}
    for key, number in sets.items():
        past = Window.partitionBy(BLOCK, key).orderBy(F.col("_set").isNull(), *order).rowsBetween(Window.unboundedPreceding, -1)
        counted = F.col("_set").isNull() | (F.col("_set") == number)
        for name, flag in (("red", "is_red_lbl"), ("lab", "is_labeled_fb")):
            sums[f"_{name}_{key}"] = F.coalesce(F.sum(F.when(counted, F.col(flag))).over(past), F.lit(0))
        rates[f"prior_{key}_red_rate"] = (F.col(f"_red_{key}") + 0.25) / (F.col(f"_lab_{key}") + 2.0)
    own = rows.withColumns(sums).filter(F.col("_set").isNull())
    return own.withColumns(rates).drop(BLOCK, "_set", *sums)


def _opening_rows(blocks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per block, key and value in that block: red and labelled rows of the value in all earlier blocks."""
    narrow = blocks.select(BLOCK, *keys, "is_red_lbl", "is_labeled_fb")
    sums = narrow.groupingSets([[BLOCK, key] for key in keys], BLOCK, *keys).agg(
        F.sum("is_red_lbl").alias("_red"), F.sum("is_labeled_fb").alias("_lab"), F.grouping_id().alias("_set")
    )
    earlier = Window.partitionBy("_set", *keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        BLOCK, "_set", *keys, F.sum("_red").over(earlier).alias("is_red_lbl"), F.sum("_lab").over(earlier).alias("is_labeled_fb")
    ).filter("is_labeled_fb > 0")


def novelty_risks(df: DataFrame) -> DataFrame:
    """Running priors doubled on the customer's first use of the value."""
    pairs = {"desc": ("event_desc", "is_new_event_desc"), "device": ("device_fp_i", "is_new_device_fp"),
             "tz": ("timezone", "is_new_tz"), "mcc": ("mcc_code_i", "is_new_mcc")}
    return df.withColumns(
        {f"risk_new_{n}_x_prior": F.col(f"prior_{key}_red_rate") * (F.col(flag) + 1) for n, (key, flag) in pairs.items()}
    )


# -- devices and profiles -------------------------------------------------------------------------------


def device_stats(source: DataFrame, log: bool = True) -> DataFrame:
    """Customers, sessions and rows per device."""
    stats = source.groupBy("device_fp_i").agg(
        F.countDistinct("customer_id").alias("device_n_distinct_customers"),
        F.countDistinct("session_id").alias("device_n_distinct_sessions"),
        F.count("*").alias("device_n_total_ops"),
    )
    names = [c for c in stats.columns if c != "device_fp_i"]
    return stats.withColumns({c: F.log1p(c) for c in names}) if log else stats


def device_history(events: DataFrame, order: list[str]) -> DataFrame:
    """State of the device before each event, over all customers in time order."""
    # a device is shared by many customers, and each step below sorts its rows in one task: the lower bound of rows
    h = History.of(events, "device_fp_i", order, setting(events.sparkSession, "backtrail.rows.per.range.task"))
    h = h.past(
        device_prev_ops=Past.count(),
        device_prev_same_customer=Past.count("customer_id"),
        _session=Past.count("session_id"),
        device_prev_same_desc=Past.count("event_desc"),
        device_prev_same_mcc=Past.count("mcc_code_i"),
        device_prev_same_timezone=Past.count("timezone"),
        device_prev_same_subtype=Past.count("channel_indicator_sub_type"),
    )
    first = {"_c": (F.col("device_prev_same_customer") == 0).cast("int"), "_s": (F.col("_session") == 0).cast("int")}
    h = h.with_columns(first).past(device_prev_unique_customers=Past.sum("_c"), device_prev_unique_sessions=Past.sum("_s"))
    ops, people = F.col("device_prev_ops"), F.col("device_prev_unique_customers")
    return h.frame().drop("_session", "_c", "_s").withColumns(
        {
            "device_prev_ops_log": F.log1p(ops),
            "device_prev_unique_customers_log": F.log1p(people),
            "device_prev_unique_sessions_log": F.log1p("device_prev_unique_sessions"),
            "device_customer_diversity": F.when(ops > 0, people / (ops + 1e-6)).otherwise(0.0),
        }
    )


def customer_profiles(events: DataFrame, days: float = 365.0) -> DataFrame:
    """Amount and activity statistics per customer, normally of the pretrain rows."""
    from backtrail.operators.quality import percentiles

    sums = events.groupBy("customer_id").agg(
        F.count("*").alias("profile_txn_count"),
        (F.sum("cents").cast("double") / F.count("cents") / 100.0).alias("profile_amt_mean"),
        F.coalesce(F.stddev_samp("amt"), F.lit(0.0)).alias("profile_amt_std"),
        (F.max("cents").cast("double") / 100.0).alias("profile_amt_max"),
        F.countDistinct("mcc_code_i").alias("profile_n_unique_mcc"),
        F.coalesce(F.avg(F.hour("event_ts")), F.lit(12.0)).alias("profile_hour_mean"),
    )
    shape = percentiles(events, ["customer_id"], "amt", {"profile_amt_median": 0.5, "profile_amt_p95": 0.95})
    return sums.join(shape, "customer_id", "left").withColumn(
        "profile_avg_daily_txns", F.col("profile_txn_count") / F.lit(days)
    )


def attach_profiles(df: DataFrame, profiles: DataFrame) -> DataFrame:
    names = [c for c in profiles.columns if c != "customer_id"]
    return lookup(df, profiles, "customer_id").fillna(0, names)


def profile_drift(df: DataFrame) -> DataFrame:
    """Present behaviour against the profile; needs the trailing means, 24-hour variety and profiles."""
    c = F.col

    def guarded(top, bottom, low):
        return F.when(c(bottom) > low, top / c(bottom)).otherwise(0.0)

    return df.withColumns(
        {
            "amt_over_profile_mean": F.when(F.abs("profile_amt_mean") > 0.01, c("amt") / c("profile_amt_mean")).otherwise(0.0),
            "amt_over_profile_p95": F.when(F.abs("profile_amt_p95") > 0.01, c("amt") / c("profile_amt_p95")).otherwise(0.0),
            "amt_profile_zscore": guarded(c("amt") - c("profile_amt_mean"), "profile_amt_std", 1.0),
            "amt_drift_5": F.coalesce("amt_avg_5", F.lit(0.0)) - F.coalesce("cust_prev_amt_mean", F.lit(0.0)),
            "hour_drift": F.abs(F.coalesce("hour_mean_5", F.lit(12.0)) - F.coalesce("profile_hour_mean", F.lit(12.0))),
            "mcc_diversity_ratio": guarded(F.coalesce("unique_mcc_24h", F.lit(0)), "profile_n_unique_mcc", 0),
            "velocity_ratio_1h": guarded(F.coalesce("cnt_1h", F.lit(0)), "profile_avg_daily_txns", 0.1),
        }
    )
