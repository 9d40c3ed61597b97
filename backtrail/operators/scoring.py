"""Score tables: ranks, average precision, standardised logits, blends and the search for weights.

Ranks and precision need one order over all rows. Equal scores are counted first, and the running
totals come from a `History` of the distinct scores, which is cut into blocks when there are many.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.functions import measures as m
from backtrail.operators.history import History, Past
from backtrail.operators.joins import only_row
from backtrail.operators.lookups import lookup, spread_join
from backtrail.operators.weights import search

# Shares of the outside score tried by the strategy grid.
OUTSIDE_SHARES = (0.55, 0.65, 0.75, 0.85, 0.90, 0.95)


# -- ranks ---------------------------------------------------------------------------------------


def rank_normalised(df: DataFrame, scores: list[str], suffix: str = "_rank", extra: int = 1, by: list[str] | None = None) -> DataFrame:
    """Average rank of each score divided by n + extra (extra 0 for the plain share).

    All scores are ranked in one order by (name, value): different combinations of scores are counted, then different
    values of each score, and the ranks come back in one join of the rows, whatever the number of scores.
    """
    keys = by or []
    whole = F.struct(*[F.col(c) for c in [*keys, *scores]])  # equal even where a score is null
    tuples = df.groupBy(whole.alias("_whole")).agg(F.count("*").alias("_n"))
    named = [F.struct(F.lit(i).alias("_name"), F.col(f"_whole.{c}").cast("double").alias("_value")) for i, c in enumerate(scores)]
    long = tuples.select("_whole", *[F.col(f"_whole.{k}").alias(k) for k in keys], "_n", F.inline(F.array(*named)))
    counts = long.groupBy(*keys, "_name", "_value").agg(F.sum("_n").alias("_n"))
    running = History.of(counts, [*keys, "_name"], ["_value"]).past(_below=Past.sum("_n")).frame()
    ranks = running.select(*keys, "_name", "_value", (F.col("_below") + (F.col("_n") + 1) / 2.0).alias("_rank"))
    told = spread_join(long.drop("_n"), ranks, [*keys, "_name", "_value"], "inner")
    wide = told.groupBy("_whole").agg(*[F.max(F.when(F.col("_name") == i, F.col("_rank"))).alias(f"{c}{suffix}") for i, c in enumerate(scores)])
    ranked = spread_join(df.withColumn("_whole", whole), wide, ["_whole"]).drop("_whole")
    if keys:
        ranked = lookup(ranked, df.groupBy(*keys).agg(F.count("*").alias("_total")), keys)
        total = F.col("_total")
    else:
        total = only_row(df.agg(F.count("*").alias("total")))["total"]
    return ranked.withColumns({f"{c}{suffix}": F.col(f"{c}{suffix}") / (total + extra) for c in scores}).drop("_total")


def spearman(df: DataFrame, scores: list[str]) -> DataFrame:
    """Rank correlation of every pair of scores: columns a, b, rho."""
    ranked = rank_normalised(df, scores)
    pairs = list(combinations(scores, 2))
    row = ranked.agg(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(f"{a}_rank", f"{b}_rank").alias("rho")).alias(f"{a}__{b}")
            for a, b in pairs
        ]
    )
    return row.select(F.inline(F.array(*[f"{a}__{b}" for a, b in pairs])))


# -- average precision ------------------------------------------------------------------------------


def average_precision(df: DataFrame, target: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Precision averaged over the positives, ties sharing one threshold; null without positives."""
    keys = by or []
    counts = df.groupBy(*keys, (-F.col(score)).alias("_fall")).agg(
        F.count("*").alias("_n"), F.sum(F.col(target).cast("long")).alias("_pos")
    )
    running = History.of(counts, keys, ["_fall"]).past(_n0=Past.sum("_n"), _pos0=Past.sum("_pos")).frame()
    precision = (F.col("_pos0") + F.col("_pos")) / (F.col("_n0") + F.col("_n"))
    gained, positives = F.sum(F.col("_pos") * precision), F.sum("_pos")
    found = running.groupBy(*keys).agg(
        F.when(positives > 0, gained / positives).alias("ap"), positives.alias("positives"), F.sum("_n").alias("rows")
    )
    return found


def average_precision_by_row(df: DataFrame, target: str, score: str, tie: str) -> DataFrame:
    """The same with every row its own threshold; of equal scores the later `tie` comes first."""
    rows = df.select((-F.col(score)).alias("_fall"), (-F.col(tie)).alias("_tie"), F.col(target).cast("long").alias("_pos"))
    running = History.of(rows, [], ["_fall", "_tie"]).past(_n0=Past.count(), _pos0=Past.sum("_pos")).frame()
    precision = (F.col("_pos0") + F.col("_pos")) / (F.col("_n0") + 1)
    positives = F.sum("_pos")
    return running.agg(F.when(positives > 0, F.sum(F.col("_pos") * precision) / positives).otherwise(0.0).alias("ap"))


def head_precisions(df: DataFrame, heads: dict[str, tuple[Column, Column, str]]) -> DataFrame:
    """AP per head, each with its own rows, target and score: name -> (mask, target, score)."""
    long = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("head"), mask.alias("use"), target.cast("int").alias("y"), F.col(score).alias("s"))
                    for name, (mask, target, score) in heads.items()
                ]
            )
        )
    )
    names = df.sparkSession.createDataFrame([(n,) for n in heads], "head string")
    return names.join(average_precision(long.filter("use"), "y", "s", ["head"]), "head", "left").select("head", "ap")


def mean_over_folds(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Mean of each metric over the folds, folds without a value left out."""
    return metrics.agg(*[F.avg(F.when(~F.isnan(n), F.col(n))).alias(n) for n in names])


def mean_prediction(scores: DataFrame, event: str = "event_id") -> DataFrame:
    """Mean score per event over folds or seeds; NaN scores are left out."""
    value = F.when(~F.isnan("predict"), F.col("predict"))
    return scores.groupBy(event).agg(F.avg(value).alias("predict"))


# -- standardised logits -----------------------------------------------------------------------------


def logit_zscores(df: DataFrame, scores: list[str], eps: float = 1e-7, suffix: str = "_z") -> DataFrame:
    """Logit of each score minus its mean, over its population deviation."""
    stats = only_row(
        df.agg(
            *[F.avg(m.logit(s, eps)).alias(f"{s}_mean") for s in scores],
            *[F.stddev_pop(m.logit(s, eps)).alias(f"{s}_std") for s in scores],
        )
    )
    return df.withColumns(
        {f"{s}{suffix}": (m.logit(s, eps) - stats[f"{s}_mean"]) / (stats[f"{s}_std"] + 1e-12) for s in scores}
    )


def blend_two(a: DataFrame, b: DataFrame, share: float, eps: float = 1e-7) -> DataFrame:
    """Common events of two score tables, mixed as standardised logits."""
    both = a.select("event_id", F.col("predict").alias("a")).join(
        b.select("event_id", F.col("predict").alias("b")), "event_id"
    )
    z = logit_zscores(both, ["a", "b"], eps)
    return z.select("event_id", m.sigmoid(share * F.col("a_z") + (1.0 - share) * F.col("b_z")).alias("predict"))


def blend_chain(tables: dict[str, DataFrame], steps: list[tuple[str, str, str, float, float]]) -> DataFrame:
    """Apply (left, right, result, share, eps) steps in order; the last result is returned."""
    known = dict(tables)
    for left, right, result, share, eps in steps:
        known[result] = blend_two(known[left], known[right], share, eps)
    return known[steps[-1][2]]


def blend_logits(df: DataFrame, weights: dict[str, float], eps: float = 1e-7) -> DataFrame:
    """Weighted mean of standardised logits, weights scaled to sum 1, undefined logits as 0."""
    whole = sum(weights.values())
    z = logit_zscores(df, list(weights), eps)
    mix = sum((F.coalesce(F.nanvl(f"{s}_z", F.lit(0.0)), F.lit(0.0)) * (w / whole) for s, w in weights.items()), F.lit(0.0))
    return z.withColumn("predict", m.sigmoid(mix)).drop(*[f"{s}_z" for s in weights])


def strategy_grid(df: DataFrame, strategies: dict[str, list[str]], outside: str, shares=OUTSIDE_SHARES) -> DataFrame:
    """Every strategy at every share of the outside score: event_id, tag, predict, in one pass."""
    inputs = sorted({s for names in strategies.values() for s in names} | {outside})
    z = logit_zscores(df, inputs)
    choices = []
    for name, members in strategies.items():
        for share in shares:
            own = (1.0 - share) / len(members)
            mix = sum((F.col(f"{s}_z") * own for s in members), F.col(f"{outside}_z") * share)
            choices.append(F.struct(F.lit(f"{name}_{round(share * 100)}").alias("tag"), m.sigmoid(mix).alias("predict")))
    return z.select("event_id", F.inline(F.array(*choices)))


# -- weight search -------------------------------------------------------------------------------------


def weight_grid(df: DataFrame, heads: list[str], parts: int) -> DataFrame:
    """Repeat every row for each way to share `parts` equal parts among the heads.

    Columns w_<head> hold the shares and `blend` the weighted score.
    """
    left = F.lit(parts)
    for head in heads[:-1]:
        df = df.withColumn(f"_p_{head}", F.explode(F.sequence(F.lit(0), left)))
        left = left - F.col(f"_p_{head}")
    df = df.withColumn(f"_p_{heads[-1]}", left)
    df = df.withColumns({f"w_{h}": F.col(f"_p_{h}") / float(parts) for h in heads})
    blend = sum((F.col(f"w_{h}") * F.col(h) for h in heads[1:]), F.col(f"w_{heads[0]}") * F.col(heads[0]))
    return df.withColumn("blend", blend).drop(*[f"_p_{h}" for h in heads])


def search_weights(df: DataFrame, target: str, heads: list[str], parts: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """AP of every weighting: one row per weighting. `keep` may drop weightings outside a range.

    Rows without one of the scores are left out. Only where the positives are too many to be held by every task are
    rows repeated per weighting.
    """
    one = df.sparkSession.range(1).select(*[F.lit(0.0).alias(h) for h in heads])
    grid = weight_grid(one, heads, parts)
    grid = grid if keep is None else keep(grid)

    def by_rows() -> DataFrame:
        every = weight_grid(df.select(target, *heads).na.drop(subset=heads), heads, parts)
        every = every if keep is None else keep(every)
        return average_precision(every, target, "blend", [f"w_{h}" for h in heads]).select(*[f"w_{h}" for h in heads], "ap")

    return search(df, target, heads, grid, by_rows)


def best_row(results: DataFrame, ties: list[str]) -> DataFrame:
    """The row with the highest AP."""
    return results.orderBy(F.col("ap").desc(), *ties).limit(1)


def feedback_mix(own: Column, feedback: Column, has_history: Column, share: Column) -> Column:
    """Customers with label history take a share of the feedback rank; others keep their own."""
    return F.when(has_history, (1.0 - share) * own + share * feedback).otherwise(own)


def search_share(df: DataFrame, target: str, score: Callable[[Column], Column], shares: list[float], by: list[str] | None = None) -> DataFrame:
    """AP for each candidate share of a one-parameter mix."""
    repeated = df.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    return average_precision(repeated.withColumn("_mix", score(F.col("share"))), target, "_mix", ["share", *(by or [])]).select(
        "share", *(by or []), "ap"
    )
