"""Column expressions on amounts, clocks, sampling hashes, labels and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers of the sampling hash; fixed so that any SQL engine can repeat the choice of rows.
EVENT_FACTOR = 2654435761
CUSTOMER_FACTOR = 40503
NIGHT_HOURS = tuple(range(0, 6))
WIDE_NIGHT_HOURS = (22, 23, *NIGHT_HOURS)
LATE_NIGHT_HOURS = tuple(range(0, 4))
EVENING_HOURS = tuple(range(19, 24))


# -- amounts -------------------------------------------------------------------------------------


def cents(amount) -> Column:
    """Money as whole cents, so that sums do not depend on the order of rows."""
    return F.round(_c(amount) * 100).cast("long")


def log_size(amount) -> Column:
    return F.log1p(F.abs(_c(amount)))


def amount_bucket(amount, steps: float = 4.0, top: int = 63) -> Column:
    return F.least(F.greatest(F.floor(log_size(amount) * steps), F.lit(0)), F.lit(top)).cast("int")


def non_negative(amount) -> Column:
    """0 for null and for negative amounts."""
    return F.when(_c(amount).isNull() | (_c(amount) < 0), 0.0).otherwise(_c(amount))


def divisible(cents_column, units: int) -> Column:
    """1 when the absolute amount is a multiple of `units`; 0 for a zero or missing amount."""
    size = F.abs(_c(cents_column))
    return F.when((size > 0) & (size % (units * 100) == 0), 1).otherwise(0)


def ratio(top, bottom, when: Column, otherwise: float = 0.0, plus: float = 0.0) -> Column:
    """top / (bottom + plus) where the guard holds."""
    return F.when(when, _c(top) / (_c(bottom) + plus)).otherwise(otherwise)


# -- clocks ----------------------------------------------------------------------------------------


def seconds(time) -> Column:
    return F.unix_timestamp(_c(time))


def iso_weekday(time) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(_c(time)) + 1


def weekend(time, from_day: int = 5) -> Column:
    """1 from the given ISO day on; the default counts Friday in."""
    return (iso_weekday(time) >= from_day).cast("int")


def in_hours(time, hours: tuple[int, ...]) -> Column:
    return F.hour(_c(time)).isin(*hours).cast("int")


def cycle(value, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle."""
    angle = _c(value).cast("double") * (2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def epoch_day(time) -> Column:
    return F.unix_date(F.to_date(_c(time)))


def capped_log_gap(gap, default_days: int = 30, cap_days: int = 365) -> Column:
    """log(1 + seconds), capped; the default stands for no or a negative gap."""
    day = 86400
    known = F.least(_c(gap), F.lit(cap_days * day))
    return F.log1p(F.when(_c(gap).isNull() | (_c(gap) < 0), default_days * day).otherwise(known).cast("double"))


# -- labels and sampling -----------------------------------------------------------------------------


def train_label(period, target) -> Column:
    """On train rows 1 red, 0 yellow, -1 unlabelled; null elsewhere."""
    return F.when(_c(period) == "train", F.coalesce(_c(target), F.lit(-1)))


def sampling_hash(event, customer=None, seed: int = 0) -> Column:
    mixed = _c(event).cast("long") * EVENT_FACTOR + seed
    return mixed if customer is None else mixed + _c(customer).cast("long") * CUSTOMER_FACTOR


def one_in(event, customer, modulus: int, seed: int = 0) -> Column:
    """True for one row in `modulus`, always the same rows."""
    return F.pmod(sampling_hash(event, customer, seed), F.lit(modulus)) == 0


def sampled_green(label, time, event, customer, border: str, recent: int, old: int, seed: int = 67) -> Column:
    """Unlabelled train rows to keep: one in `recent` from the border on, one in `old` before it."""
    late = _c(time) >= F.lit(border).cast("timestamp")
    keep = F.when(late, one_in(event, customer, recent, seed)).otherwise(one_in(event, customer, old, seed + 17))
    return F.coalesce((_c(label) == -1) & keep, F.lit(False))


# -- scores --------------------------------------------------------------------------------------------


def clip(value, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(value), F.lit(low)), F.lit(high))


def logit(p, eps: float = 1e-7) -> Column:
    inside = clip(p, eps, 1.0 - eps)
    return F.log(inside / (1.0 - inside))


def sigmoid(x, bound: float | None = None) -> Column:
    value = _c(x) if bound is None else clip(x, -bound, bound)
    return 1.0 / (1.0 + F.exp(-value))


def product_logit(a, b) -> Column:
    """Logit of the product of two probabilities given as logits."""
    return logit(sigmoid(a, 40.0) * sigmoid(b, 40.0), 1e-8)


def geometric_gate(a, b) -> Column:
    """Geometric mean of two ranks, each kept inside [1e-6, 1]."""
    return F.sqrt(clip(a, 1e-6, 1.0) * clip(b, 1e-6, 1.0))


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
