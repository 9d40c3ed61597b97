"""History features of each event from the earlier events of its customer.

Every function takes a `History` of parsed events and returns it with more columns. Nothing here
reads the current label or any later row; the two functions that look ahead say so in their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.functions import measures as m
from backtrail.operators.history import History, Past, Within
from backtrail.operators.lookups import lookup, spread_join

DAY = 86400
# Output suffix -> column that must be equal on the earlier row.
SAME = {
    "type": "event_type_nm",
    "desc": "event_desc",
    "mcc": "mcc_code_i",
    "subtype": "channel_indicator_sub_type",
    "channel_type": "channel_indicator_type",
    "currency": "currency_iso_cd",
    "device": "device_fp_i",
    "session": "session_id",
}
GAP_SAME = ("type", "desc", "channel_type", "currency", "device", "mcc", "subtype")
# Fixed values.
LOG_COUNT_COLUMNS = (
    "event_type_nm", "event_desc", "channel_indicator_type", "channel_indicator_sub_type", "currency_iso_cd",
    "mcc_code_i", "pos_cd", "timezone", "session_id", "operating_system_type", "developer_tools_i",
    "compromised_i", "phone_voip_call_state", "web_rdp_connection",
)
# Fixed values.
FIRST_TIME = {
    "is_new_event_type": "event_type_nm", "is_new_event_desc": "event_desc",
    "is_new_channel_type": "channel_indicator_type", "is_new_channel_sub": "channel_indicator_sub_type",
    "is_new_mcc": "mcc_code_i", "is_new_currency": "currency_iso_cd", "is_new_device_fp": "device_fp_i",
    "is_first_in_session": "session_id", "is_new_pos": "pos_cd", "is_new_tz": "timezone",
    "is_new_os": "operating_system_type",
}


def _money(cents: Column) -> Column:
    return cents.cast("double") / 100.0


def drop_helpers(h: History) -> History:
    """Remove the intermediate columns, whose names start with two underscores."""
    return h.each(lambda df: df.drop(*[c for c in df.columns if c.startswith("__")]))


# -- counts ---------------------------------------------------------------------------------------


def event_count(h: History) -> History:
    return h.past(cust_prev_events=Past.count())


def same_counts(h: History, same: dict[str, str] = SAME) -> History:
    """Earlier events that share a value."""
    return h.past(**{f"cnt_prev_same_{name}": Past.count(column) for name, column in same.items()})


def log_counts(h: History, columns: tuple[str, ...] = LOG_COUNT_COLUMNS) -> History:
    pair = F.concat_ws("_", "channel_indicator_sub_type", "operating_system_type")
    h = h.with_columns({"__channel_system": pair})
    h = h.past(**{f"__n_{c}": Past.count(c) for c in columns}, __n_pair=Past.count("__channel_system"))
    logs = {f"{c}_log_cnt": F.log1p(F.col(f"__n_{c}")) for c in columns}
    return drop_helpers(h.with_columns({**logs, "ch_dev_combo_log_cnt": F.log1p("__n_pair")}))


def first_time_flags(h: History, flags: dict[str, str] = FIRST_TIME) -> History:
    h = h.past(**{f"__{flag}": Past.count(column) for flag, column in flags.items()})
    return drop_helpers(h.with_columns({flag: (F.col(f"__{flag}") == 0).cast("int") for flag in flags}))


# -- amounts --------------------------------------------------------------------------------------


def amount_moments(h: History, null_as_zero: bool = False) -> History:
    """Mean, population deviation and maximum of past amounts.

    The divisor counts every past row. With nulls kept, a row without an amount has no mean or
    deviation; `null_as_zero` reads a missing amount as 0 throughout.
    """
    cents = F.coalesce("cents", F.lit(0)) if null_as_zero else F.col("cents")
    exact = cents.cast("decimal(18,0)")
    h = h.past(__n=Past.count(), __sum=Past.sum(cents), __sq=Past.sum(exact * exact), __max=Past.max(cents))
    n, given = F.col("__n"), cents.isNotNull()
    mean = F.col("__sum").cast("double") / n
    spread = F.greatest(F.col("__sq").cast("double") / n - mean * mean, F.lit(0.0))
    return drop_helpers(
        h.with_columns(
            {
                "cust_prev_amt_mean": F.when(n > 0, F.when(given, mean / 100.0)).otherwise(0.0),
                "cust_prev_amt_std": F.when(n > 1, F.when(given, F.sqrt(spread) / 100.0)).otherwise(0.0),
                "cust_prev_max_amt": F.coalesce(_money(F.col("__max")), F.lit(0.0)),
            }
        )
    )


def amount_positions(h: History) -> History:
    """Where the amount stands against the past of the customer; needs `amount_moments`."""
    mean, std, top = F.col("cust_prev_amt_mean"), F.col("cust_prev_amt_std"), F.col("cust_prev_max_amt")
    away = F.col("amt") - mean
    return h.with_columns(
        {
            "amt_zscore": F.when(std > 0, away / (std + 1.0)).otherwise(0.0),
            "amt_zscore_raw": F.when(std > 1.0, away / std).otherwise(0.0),
            "amt_zscore_eps": F.when(std > 1e-6, away / (std + 1e-6)).otherwise(0.0),
            "amt_vs_personal_max": F.when(F.abs(top) > 1.0, F.col("amt") / (F.abs(top) + 1.0)).otherwise(0.0),
            "amt_vs_prev_max": m.ratio("amt", top, F.abs(top) > 1e-6, plus=1e-6),
            "amt_to_prev_mean": m.ratio("amt", mean, F.abs(mean) > 0.01),
            "amt_vs_prev_mean": m.ratio("amt", mean, F.abs(mean) > 1e-6, plus=1e-6),
        }
    )


def running_amounts_same(h: History) -> History:
    """Past mean amount with the same description and the same device, and the amount against each."""
    for name in ("desc", "device"):
        by = SAME[name]
        h = h.past(**{f"__n_{name}": Past.count(by), f"__s_{name}": Past.sum("cents", by)})
        mean = F.col(f"__s_{name}").cast("double") / F.col(f"__n_{name}") / 100.0
        given = F.when(F.col("cents").isNotNull(), mean)
        h = h.with_columns({f"cust_prev_mean_amt_same_{name}": F.when(F.col(f"__n_{name}") > 0, given).otherwise(0.0)})
        past = F.col(f"cust_prev_mean_amt_same_{name}")
        h = h.with_columns({f"amt_vs_same_{name}_mean": m.ratio("amt", past, F.abs(past) > 1e-6, plus=1e-6)})
    return drop_helpers(h)


def trailing_means(h: History, sizes: tuple[int, ...] = (5, 10, 50, 100)) -> History:
    """Mean of exactly the last n amounts, null until there are n without a gap; and short minus long."""
    def columns(window):
        out = {}
        for n in sizes:
            frame = window.rowsBetween(-n, -1)
            full = F.count("cents").over(frame) == n
            out[f"amt_avg_{n}"] = F.when(full, F.sum("cents").over(frame).cast("double") / n / 100.0)
        hours = window.rowsBetween(-5, -1)
        whole = F.count("event_ts").over(hours) == 5
        out["hour_mean_5"] = F.when(whole, F.sum(F.hour("event_ts")).over(hours).cast("double") / 5)
        return out

    h = h.neighbours(columns, before=max(*sizes, 5))
    if 5 in sizes and 50 in sizes:
        none = F.lit(0.0)
        h = h.with_columns({"amt_momentum": F.coalesce("amt_avg_5", none) - F.coalesce("amt_avg_50", none)})
    return h


# -- gaps -----------------------------------------------------------------------------------------


def previous_values(h: History) -> History:
    """Values of the row before; -1 for codes when there is none."""
    h = h.past(
        prev_event_ts=Past.previous("event_ts"),
        prev_event_date=Past.previous(F.to_date("event_ts")),
        prev_cents=Past.previous("cents"),
        prev_mcc_code_i=Past.previous("mcc_code_i"),
        prev_session_id=Past.previous("session_id"),
    )
    minus = F.lit(-1)
    return h.with_columns(
        {
            "prev_mcc_code_i": F.coalesce("prev_mcc_code_i", minus),
            "prev_session_id": F.coalesce("prev_session_id", minus),
            "amt_delta_prev": _money(F.col("cents") - F.coalesce("prev_cents", F.lit(0))),
        }
    )


def event_gap(h: History) -> History:
    h = h.past(__prev=Past.previous("sec"))
    gap = F.coalesce(F.col("sec") - F.col("__prev"), F.lit(-1))
    days = F.when(gap >= 0, gap / F.lit(float(DAY))).otherwise(-1.0)
    return drop_helpers(h.with_columns({"sec_since_prev_event": gap, "days_since_prev_event": days}))


def same_gaps(h: History, names: tuple[str, ...] = GAP_SAME) -> History:
    h = h.past(**{f"__{n}": Past.previous("sec", SAME[n]) for n in names})
    gaps = {f"sec_since_prev_same_{n}": F.coalesce(F.col("sec") - F.col(f"__{n}"), F.lit(-1)) for n in names}
    return drop_helpers(h.with_columns(gaps))


def log_gap(h: History) -> History:
    h = h.past(__prev=Past.previous("sec"))
    return drop_helpers(h.with_columns({"delta_time_log": m.capped_log_gap(F.col("sec") - F.col("__prev"))}))


def burst_flags(h: History) -> History:
    """Needs `event_gap`."""
    gap = F.col("sec_since_prev_event")
    return h.with_columns(
        {
            "is_burst_5min": ((gap > 0) & (gap < 300)).cast("int"),
            "is_rapid_1min": ((gap > 0) & (gap < 60)).cast("int"),
        }
    )


# -- age and days -----------------------------------------------------------------------------------


def account_age(h: History) -> History:
    h = h.past(__first=Past.min("sec", current=True), __n=Past.count())
    age = F.col("sec") - F.col("__first")
    days = F.floor(age / DAY)
    return drop_helpers(
        h.with_columns(
            {
                "days_since_first_event": days.cast("int"),
                "days_since_first_event_exact": age / F.lit(float(DAY)),
                "cust_events_per_day": F.when(days > 0, (F.col("__n") + 1) / days).otherwise(1.0),
            }
        )
    )


def active_days(h: History) -> History:
    """Days with events before today's, and past events per day."""
    h = h.past(__n=Past.count()).changes(__days=F.to_date("event_ts"))
    h = h.with_columns({"cust_active_days": F.col("__days")})
    per_day = F.col("__n") / (F.col("cust_active_days") + 1.0)
    return drop_helpers(h.with_columns({"avg_prev_events_per_active_day": per_day}))


def active_days_looking_ahead(df: DataFrame) -> DataFrame:
    """Distinct days of the whole history, later rows included."""
    days = df.groupBy("customer_id").agg(F.countDistinct(F.to_date("event_ts")).alias("cust_active_days_all"))
    return lookup(df, days, "customer_id")


# -- sessions and today --------------------------------------------------------------------------------


def session_position(h: History) -> History:
    h = h.past(
        __start=Past.min("sec", "session_id", current=True),
        __cents=Past.sum("cents", "session_id"),
        session_event_idx=Past.count("session_id"),
    )
    return drop_helpers(
        h.with_columns(
            {
                "sec_since_session_start": F.col("sec") - F.col("__start"),
                "session_amt_before": F.when(F.col("cents").isNotNull(), _money(F.col("__cents"))),
            }
        )
    )


def minutes_in_session(df: DataFrame) -> DataFrame:
    """Whole minutes since the first event of the session, whoever's it is; -1 without a session."""
    starts = df.groupBy("session_id").agg(F.min("sec").alias("__start"))
    joined = spread_join(df, starts, ["session_id"])
    minutes = F.floor((F.col("sec") - F.col("__start")) / 60).cast("double")
    return joined.withColumn(
        "minutes_from_session_start", F.when(F.col("session_id") != -1, minutes).otherwise(-1.0)
    ).drop("__start")


def today_counts(h: History) -> History:
    h = h.with_columns({"__day": F.to_date("event_ts"), "__hour": F.date_trunc("hour", "event_ts")})
    h = h.past(events_before_today=Past.count("__day"), cnt_events_this_hour=Past.count("__hour"))
    hour, before = F.hour("event_ts"), F.col("events_before_today").cast("double")
    return drop_helpers(h.with_columns({"event_rate_today": F.when(hour > 0, before / hour).otherwise(before)}))


def today_amounts(h: History) -> History:
    h = h.with_columns({"__day": F.to_date("event_ts"), "__size": F.abs("cents")})
    h = h.past(__total=Past.sum("__size", "__day"), __top=Past.max("__size", "__day"))
    h = h.with_columns(
        {
            "today_total_amount": F.when(F.col("cents").isNotNull(), _money(F.col("__total"))),
            "today_max_amount": F.coalesce(_money(F.col("__top")), F.lit(0.0)),
        }
    )
    total = F.col("today_total_amount")
    share = F.when(total > 1.0, F.abs("amt") / total).otherwise(1.0)
    return drop_helpers(h.with_columns({"today_amt_vs_daily_norm": share}))


# -- changes and transitions ------------------------------------------------------------------------------


def change_flags(h: History) -> History:
    """What differs from the row before, and time zone jumps too fast to be travel."""
    h = h.past(
        __os=Past.previous("operating_system_type"), __screen=Past.previous("screen_w"),
        __tz=Past.previous("timezone"), __mcc=Past.previous("mcc_code_i"),
        __session=Past.previous("session_id"), __sec=Past.previous("sec"),
    )
    def differs(column, before):
        return F.coalesce((F.col(column) != F.col(before)).cast("int"), F.lit(0))

    jump = F.coalesce(F.abs(F.col("timezone") - F.col("__tz")), F.lit(0))
    gap = F.coalesce(F.col("sec") - F.col("__sec"), F.lit(-1))
    return drop_helpers(
        h.with_columns(
            {
                "os_changed": differs("operating_system_type", "__os"),
                "screen_changed": differs("screen_w", "__screen"),
                "tz_changed": differs("timezone", "__tz"),
                "mcc_changed": (F.col("mcc_code_i") != F.coalesce("__mcc", F.lit(-1))).cast("int"),
                "session_changed": (F.col("session_id") != F.coalesce("__session", F.lit(-1))).cast("int"),
                "tz_jump_magnitude": jump,
                "impossible_travel": ((jump > 2) & (gap > 0) & (gap < 3600)).cast("int"),
            }
        )
    )


def mcc_transition(h: History) -> History:
    """How often this category followed the one before, among the past uses of the one before."""
    h = h.past(__from=Past.previous("mcc_code_i")).with_columns({"__from": F.coalesce("__from", F.lit(-1))})
    h = h.past(__uses=Past.count("__from"), __pairs=Past.count("__from", "mcc_code_i"))
    p = F.col("__pairs") / F.greatest(F.col("__uses"), F.lit(1))
    return drop_helpers(
        h.with_columns({"markov_mcc_prob": p, "markov_mcc_surprise": -F.log(F.greatest(p, F.lit(1e-6)))})
    )


# -- time windows -------------------------------------------------------------------------------------------

COUNT_WINDOWS = {"15min": 900, "1h": 3600, "6h": 21600, "24h": DAY, "7d": 7 * DAY}
SUM_WINDOWS = {"15min": 900, "1h": 3600, "24h": DAY}


def velocity(h: History) -> History:
    """Events and absolute amounts in windows up to, and without, the current second."""
    size = F.abs("cents")
    h = h.within(
        **{f"cnt_{n}": Within.count(s) for n, s in COUNT_WINDOWS.items()},
        **{f"__sum_{n}": Within.sum(size, s) for n, s in SUM_WINDOWS.items()},
    )
    return drop_helpers(h.with_columns({f"amt_sum_{n}": _money(F.col(f"__sum_{n}")) for n in SUM_WINDOWS}))


def signed_velocity(h: History) -> History:
    """Events with an amount, their signed sum and maximum over one hour and one day; 0 when empty."""
    given = F.col("cents").isNotNull()
    h = h.within(
        cnt_last_1h=Within.count(3600, given), cnt_last_24h=Within.count(DAY, given),
        __1h=Within.sum("cents", 3600), __24h=Within.sum("cents", DAY), __max=Within.max("cents", DAY),
    )
    return drop_helpers(
        h.with_columns(
            {
                "amt_sum_last_1h": _money(F.col("__1h")),
                "amt_sum_last_24h": _money(F.col("__24h")),
                "max_amt_last_24h": F.coalesce(_money(F.col("__max")), F.lit(0.0)),
            }
        )
    )


def as_of_velocity(h: History, windows: dict[str, int]) -> History:
    """Earlier rows after the last row at or before `t - w`: events and signed sum, by position.

    Unlike `velocity`, an event exactly w ago is left out and earlier rows of the same second count.
    The rows at or before `t - w` are those before `t` less those in the window [t - w + 1s, t).
    """
    h = h.past(__same_n=Past.count("sec"), __same_sum=Past.sum("cents", "sec"))
    h = h.within(
        **{f"__n_{n}": Within.count(s - 1) for n, s in windows.items()},
        **{f"__s_{n}": Within.sum("cents", s - 1) for n, s in windows.items()},
    )
    columns = {}
    for n in windows:
        columns[f"events_last_{n}"] = F.col(f"__n_{n}") + F.col("__same_n")
        total = _money(F.col(f"__s_{n}") + F.col("__same_sum"))
        columns[f"amt_sum_last_{n}"] = F.when(F.col("cents").isNotNull(), total)
    return drop_helpers(h.with_columns(columns))


def risk_velocity(h: History) -> History:
    """Calls during payment in 15 minutes and time zone changes in a day; needs `tz_changed`."""
    h = h.within(
        voip_cnt_15min=Within.count(900, F.col("phone_voip_call_state") == 1),
        tz_change_cnt_24h=Within.sum(F.col("tz_changed").cast("long"), DAY),
    )
    return h.with_columns({"had_voip_before_txn": (F.col("voip_cnt_15min") > 0).cast("int")})


def velocity_ratios(h: History) -> History:
    """Needs `velocity` and `signed_velocity`."""
    c = F.col
    def share(top, bottom):
        return F.when(c(bottom) > 0, c(top) / c(bottom)).otherwise(0.0)

    def against(total):
        return F.when(F.abs(c(total)) > 1.0, c("amt") / (F.abs(c(total)) + 1.0)).otherwise(0.0)

    return h.with_columns(
        {
            "amt_vs_1h_sum": against("amt_sum_last_1h"),
            "amt_vs_24h_sum": against("amt_sum_last_24h"),
            "amt_ratio_24h": F.when(c("amt_sum_24h") > 1.0, F.abs("amt") / c("amt_sum_24h")).otherwise(1.0),
            "burst_ratio_1h_24h": share("cnt_1h", "cnt_24h"),
            "burst_ratio_15m_1h": share("cnt_15min", "cnt_1h"),
            "spend_concentration_1h": F.when(c("amt_sum_24h") > 1.0, c("amt_sum_1h") / c("amt_sum_24h")).otherwise(0.0),
        }
    )


def distinct_within(df: DataFrame, value: str, windows: dict[str, int], entity: str = "customer_id") -> DataFrame:
    """Distinct values of a column in [t - w, t), one column per window.

    A value seen at s counts for the times after s up to s + w, or up to its next sighting if that is
    earlier. Writing +1 at the start and -1 at the end of each such stretch turns the distinct count
    into a running sum, which needs no list of values per row and no join of a row with its window.
    """
    seen = df.groupBy(entity, value, "sec").agg(F.count("*").alias("__rows"))
    # sightings in falling time order, so that the row before is the next sighting
    h = History.of(seen.withColumn("__back", -F.col("sec")), [entity, value], ["__back"])
    h = h.past(__next=Past.previous("sec"))
    def edge(at, **delta):
        return F.struct(at.alias("__at"), *[F.lit(delta.get(n, 0)).alias(n) for n in windows])

    soonest = F.coalesce("__next", F.lit(2**62))
    edges = [edge(F.col("sec"), **{n: 1 for n in windows})]
    edges += [edge(F.least(F.col("sec") + width, soonest), **{n: -1}) for n, width in windows.items()]
    deltas = h.frame().select(entity, F.inline(F.array(*edges)))
    steps = deltas.groupBy(entity, "__at").agg(*[F.sum(n).alias(n) for n in windows])
    at_row = df.select(entity, F.col("sec").alias("__at")).distinct()
    clock = steps.join(at_row.withColumn("__row", F.lit(True)), [entity, "__at"], "full").fillna(0, list(windows))
    counted = History.of(clock, entity, ["__at"]).past(**{f"__c_{n}": Past.sum(n) for n in windows}).frame()
    result = counted.filter("__row").select(
        entity, F.col("__at").alias("sec"), *[F.col(f"__c_{n}").alias(n) for n in windows]
    )
    return spread_join(df, result, [entity, "sec"])


def interactions(df: DataFrame) -> DataFrame:
    """Amount against speed and time of day; needs the 60-minute count, the night flag and the gap."""
    size, gap = F.col("amt_log_abs"), F.col("sec_since_prev_event")
    return df.withColumns(
        {
            "amt_x_velocity_60": size * F.coalesce("events_last_60min", F.lit(0)),
            "amt_x_night": size * F.col("is_night"),
            "amt_speed": F.when(gap > 0, size / (gap + 1.0)).otherwise(0.0),
        }
    )
