"""Queries of score tables. The scores are hashed from the events, some with many ties."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from backtrail.functions import measures as m
from backtrail.operators import joins as j
from backtrail.operators import quality as q
from backtrail.operators import scoring as s
from backtrail.plans.base import bank_labels, fixed, labelled, query

# Score -> (multiplier of the event, of the customer, modulus); small moduli make ties.
HEADS = {"p_a": (7919, 31, 10007), "p_b": (104729, 17, 997), "p_c": (15485863, 5, 50), "p_d": (611953, 101, 10007)}
_PART = {n: f"((event_id * {a} + customer_id * {b}) % {k} + 1) / {k + 2}.0" for n, (a, b, k) in HEADS.items()}
# Reds score a little higher, so that the heads are worth blending.
_SC = "sc AS (SELECT event_id, customer_id, event_ts, sec, train_target_raw, is_red AS y, " + ", ".join(
    f"CAST(({e}) * (1.0 + 0.05 * {i} * is_red) / 1.2 AS DOUBLE) AS {n}" for i, (n, e) in enumerate(_PART.items(), 1)) + " FROM lv WHERE period = 'train')"


def scored(spark, folder):
    rows = labelled(spark, folder).filter("period = 'train'").withColumnRenamed("is_red_lbl", "y")
    return rows.select(
        "event_id", "customer_id", "event_ts", "sec", "train_target_raw", "y",
        *[
            (((F.col("event_id") * a + F.col("customer_id") * b) % k + 1) / F.lit(k + 2.0) * (1.0 + 0.05 * i * F.col("y")) / 1.2).alias(n)
            for i, (n, (a, b, k)) in enumerate(HEADS.items(), 1)
        ],
    )


def r(*names, digits=6):
    return [fixed(n, digits).alias(n) for n in names]


def _rank(c, part="", plus=1):
    over = f"PARTITION BY {part}" if part else ""
    peers = f"{part + ', ' if part else ''}{c}"
    return f"(rank() OVER ({over} ORDER BY {c}) + (count(*) OVER (PARTITION BY {peers}) - 1) / 2.0) / (count(*) OVER ({over}) + {plus}.0)"


def _ap(source, y="y", score="s", by=None):
    """SQL for tie-aware average precision of a source with columns y, score (and a group)."""
    g, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""SELECT {g}CASE WHEN sum(pos) > 0 THEN sum(pos * cum_pos / cum_n) / sum(pos) END AS ap FROM (
      SELECT {g}pos, CAST(sum(pos) OVER ({part} ORDER BY score DESC) AS DOUBLE) AS cum_pos, CAST(sum(n) OVER ({part} ORDER BY score DESC) AS DOUBLE) AS cum_n FROM (
        SELECT {g}{score} AS score, count(*) AS n, sum({y}) AS pos FROM {source} GROUP BY {g}{score})) {'GROUP BY ' + by if by else ''}"""


@query("rank_normalised_scores", "W36", sql=f"WITH {_SC} SELECT event_id, " + ", ".join(f"round({_rank(n)}, 9) AS {n}_rank" for n in HEADS) + f", round({_rank('p_c', plus=0)}, 9) AS p_c_share FROM sc")
def _ranks(spark, folder):
    rows = s.rank_normalised(scored(spark, folder), list(HEADS))
    rows = s.rank_normalised(rows, ["p_c"], suffix="_share", extra=0)
    return rows.select("event_id", *r(*[f"{n}_rank" for n in HEADS], "p_c_share", digits=9))


def _z(c, eps="1e-7"):
    lo = f"ln(least(greatest({c}, {eps}), 1 - {eps}) / (1 - least(greatest({c}, {eps}), 1 - {eps})))"
    return f"(({lo}) - avg({lo}) OVER ()) / (stddev_pop({lo}) OVER () + 1e-12)"


@query("standardised_logits", "W37", sql=f"WITH {_SC} SELECT event_id, " + ", ".join(f"round({_z(n)}, 6) AS {n}_z" for n in HEADS) + " FROM sc")
def _logits(spark, folder):
    return s.logit_zscores(scored(spark, folder), list(HEADS)).select("event_id", *r(*[f"{n}_z" for n in HEADS]))


@query("average_precision_ties", "A18", sql=f"WITH {_SC} SELECT 'p_a' AS head, round(ap, 9) AS ap FROM ({_ap('sc', score='p_a')}) UNION ALL SELECT 'p_c' AS head, round(ap, 9) AS ap FROM ({_ap('sc', score='p_c')})")
def _precision(spark, folder):
    rows = scored(spark, folder)
    a, c = (s.average_precision(rows, "y", n).select(F.lit(n).alias("head"), *r("ap", digits=9)) for n in ("p_a", "p_c"))
    return a.unionByName(c)


@query("average_precision_by_row", "A18", sql=f"""WITH {_SC} SELECT round(sum(y * cum / n) / sum(y), 9) AS ap FROM (
    SELECT y, CAST(sum(y) OVER (ORDER BY p_c DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum, row_number() OVER (ORDER BY p_c DESC, event_id DESC) AS n FROM sc)""")
def _precision_row(spark, folder):
    return s.average_precision_by_row(scored(spark, folder), "y", "p_c", "event_id").select(*r("ap", digits=9))


@query("average_precision_per_head", "A19", sql=f"""WITH {_SC}, h AS (SELECT 'final' AS head, y, p_a AS s FROM sc UNION ALL SELECT 'red', y, p_b FROM sc
      UNION ALL SELECT 'suspicious', CAST(train_target_raw <> -1 AS INT), p_c FROM sc UNION ALL SELECT 'red_given_suspicious', y, p_d FROM sc WHERE train_target_raw <> -1
      UNION ALL SELECT 'no_positive', 0, p_a FROM sc)
    SELECT head, round(ap, 9) AS ap FROM ({_ap('h', by='head')})""")
def _heads(spark, folder):
    lbl, every = F.col("train_target_raw"), F.lit(True)
    out = s.head_precisions(scored(spark, folder), {
        "final": (every, F.col("y"), "p_a"), "red": (every, F.col("y"), "p_b"), "suspicious": (every, lbl != -1, "p_c"),
        "red_given_suspicious": (lbl != -1, F.col("y"), "p_d"), "no_positive": (every, F.lit(0), "p_a"),
    })
    return out.select("head", *r("ap", digits=9))


@query("spearman_of_pairs", "A20", sql=f"WITH {_SC}, rk AS (SELECT " + ", ".join(f"{_rank(n)} AS {n}" for n in HEADS) + " FROM sc) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM rk" for a, b in combinations(HEADS, 2)))
def _spearman(spark, folder):
    return s.spearman(scored(spark, folder), list(HEADS)).select("a", "b", *r("rho"))


_FOLDS = "folds AS (SELECT day(event_ts) % 4 AS fold, event_id, y, p_a, p_b, p_c FROM sc)"


@query("mean_metric_over_folds", "A22", sql=f"""WITH {_SC}, {_FOLDS}, a AS ({_ap('folds', score='p_a', by='fold')}), b AS ({_ap('folds', score='p_b', by='fold')})
    SELECT (SELECT round(avg(ap), 9) FROM a) AS ap_a, (SELECT round(avg(ap), 9) FROM b WHERE fold <> 0) AS ap_b, (SELECT quantile_cont(n, 0.5) FROM (SELECT count(*) AS n FROM folds GROUP BY fold)) AS median_rows""")
def _fold_means(spark, folder):
    rows = scored(spark, folder).withColumn("fold", F.dayofmonth("event_ts") % 4)
    a = s.average_precision(rows, "y", "p_a", ["fold"]).select("fold", F.col("ap").alias("ap_a"), "rows")
    b = s.average_precision(rows, "y", "p_b", ["fold"]).select("fold", F.when(F.col("fold") != 0, F.col("ap")).alias("ap_b"))
    folds = a.join(b, "fold")
    means = s.mean_over_folds(folds, ["ap_a", "ap_b"]).select(*r("ap_a", "ap_b", digits=9))
    middle = j.only_row(q.percentiles(folds, [], "rows", {"median_rows": 0.5}))["median_rows"]
    return means.withColumn("median_rows", middle)


@query("mean_prediction_per_event", "A23", "A24", sql=f"""WITH {_SC}, u AS (SELECT event_id, p_a AS p FROM sc UNION ALL SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE p_b END FROM sc UNION ALL SELECT event_id, p_c FROM sc)
    SELECT event_id, round(avg(p), 9) AS predict FROM u GROUP BY 1""")
def _mean_prediction(spark, folder):
    rows = scored(spark, folder)
    a = rows.select("event_id", F.col("p_a").alias("predict"))
    b = rows.select("event_id", F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("p_b")).alias("predict"))
    c = rows.select("event_id", F.col("p_c").alias("predict"))
    return s.mean_prediction(a.unionByName(b).unionByName(c)).select("event_id", *r("predict", digits=9))


def _sig(e):
    return f"(1.0 / (1.0 + exp(-({e}))))"


def _lg(e, eps="1e-8"):
    return f"ln(least(greatest({e}, {eps}), 1 - {eps}) / (1 - least(greatest({e}, {eps}), 1 - {eps})))"


_LA, _LB = _lg("p_a"), _lg("p_b")


@query("product_and_mixed_heads", "M14", "M15", sql=f"WITH {_SC} SELECT event_id, round({_lg(f'{_sig(_LA)} * {_sig(_LB)}')}, 6) AS product_logit, round(0.7 * p_a + 0.3 * p_b * p_d, 9) AS final_score FROM sc")
def _product(spark, folder):
    product = m.product_logit(m.logit("p_a", 1e-8), m.logit("p_b", 1e-8))
    return scored(spark, folder).select("event_id", fixed(product).alias("product_logit"),
                                        fixed(0.7 * F.col("p_a") + 0.3 * F.col("p_b") * F.col("p_d"), 9).alias("final_score"))


def _gate(a, b):
    return f"sqrt(least(greatest({a}, 1e-6), 1.0) * least(greatest({b}, 1e-6), 1.0))"


_RANKED = "k AS (SELECT event_id, " + ", ".join(f"{_rank(n)} AS {n}" for n in HEADS) + " FROM sc)"


@query("gate_heads", "M16", sql=f"""WITH {_SC}, {_RANKED}, kk AS (SELECT *, {_gate('p_a', 'p_b')} AS consensus FROM k)
    SELECT event_id, round(consensus, 9) AS consensus, round({_gate('consensus', 'p_c')}, 9) AS susp_gate,
      round({_gate('consensus', 'p_d')}, 9) AS lbl_gate, round({_gate('consensus', _gate('p_c', 'p_d'))}, 9) AS dual_gate FROM kk""")
def _gates(spark, folder):
    rows = s.rank_normalised(scored(spark, folder), list(HEADS)).withColumn("consensus", m.geometric_gate("p_a_rank", "p_b_rank"))
    rows = rows.withColumns({
        "susp_gate": m.geometric_gate("consensus", "p_c_rank"), "lbl_gate": m.geometric_gate("consensus", "p_d_rank"),
        "dual_gate": m.geometric_gate("consensus", m.geometric_gate("p_c_rank", "p_d_rank")),
    })
    return rows.select("event_id", *r("consensus", "susp_gate", "lbl_gate", "dual_gate", digits=9))


_HIST = "hist AS (SELECT DISTINCT customer_id, 1 AS has_history FROM bank_labels)"
_SHARED = f"fb AS (SELECT event_id, y, COALESCE(has_history, 0) AS has_history, {_rank('p_a', plus=0)} AS own, {_rank('p_b', plus=0)} AS fb FROM sc LEFT JOIN hist USING (customer_id))"


def _feedback(spark, folder):
    rows = j.flag_listed(scored(spark, folder), bank_labels(spark, folder), "customer_id", "has_history")
    return s.rank_normalised(rows, ["p_a", "p_b"], extra=0)


@query("label_history_customers", "J17", sql=f"WITH {_SC}, {_HIST} SELECT event_id, COALESCE(has_history, 0) AS has_history FROM sc LEFT JOIN hist USING (customer_id)")
def _history_flag(spark, folder):
    return _feedback(spark, folder).select("event_id", "has_history")


@query("feedback_injection", "M17", sql=f"WITH {_SC}, {_HIST}, {_SHARED} SELECT event_id, " + ", ".join(
    f"round(CASE WHEN has_history = 1 THEN (1.0 - {a}) * own + {a} * fb ELSE own END, 9) AS score_{int(a * 100)}" for a in (0.3, 0.5, 0.7)) + " FROM fb")
def _inject(spark, folder):
    mix = lambda a: s.feedback_mix(F.col("p_a_rank"), F.col("p_b_rank"), F.col("has_history") == 1, F.lit(a))
    return _feedback(spark, folder).select("event_id", *[fixed(mix(a), 9).alias(f"score_{int(a * 100)}") for a in (0.3, 0.5, 0.7)])


_ALPHAS = [i / 20 for i in range(11)]


@query("feedback_share_search", "M17", sql=f"""WITH {_SC}, {_HIST}, {_SHARED}, al AS (SELECT unnest({_ALPHAS})::DOUBLE AS share),
    g AS (SELECT share, y, CASE WHEN has_history = 1 THEN (1.0 - share) * own + share * fb ELSE own END AS s FROM fb CROSS JOIN al)
    SELECT share, round(ap, 6) AS ap FROM ({_ap('g', by='share')})""")
def _share_search(spark, folder):
    found = s.search_share(_feedback(spark, folder), "y",
                           lambda a: s.feedback_mix(F.col("p_a_rank"), F.col("p_b_rank"), F.col("has_history") == 1, a), _ALPHAS)
    return found.select("share", *r("ap"))


_COMBOS = {"a_b": ["p_a", "p_b"], "a_c": ["p_a", "p_c"], "b_c": ["p_b", "p_c"], "abc": ["p_a", "p_b", "p_c"], "abd": ["p_a", "p_b", "p_d"],
           "abcd": ["p_a", "p_b", "p_c", "p_d"], "c_d": ["p_c", "p_d"], "acd": ["p_a", "p_c", "p_d"]}


@query("rank_blends_of_combinations", "M18", sql=f"WITH {_SC}, k AS (SELECT event_id, " + ", ".join(f"{_rank(n)} AS {n}" for n in HEADS) + " FROM sc) SELECT event_id, " + ", ".join(
    f"round({' + '.join(f'{1.0 / len(h)} * {n}' for n in h)}, 9) AS blend_{c}" for c, h in _COMBOS.items()) + " FROM k")
def _combos(spark, folder):
    rows = s.rank_normalised(scored(spark, folder), list(HEADS))
    blends = {c: sum((F.col(f"{n}_rank") * (1.0 / len(h)) for n in h[1:]), F.col(f"{h[0]}_rank") * (1.0 / len(h))) for c, h in _COMBOS.items()}
    return rows.select("event_id", *[fixed(b, 9).alias(f"blend_{c}") for c, b in blends.items()])


_GRID = """grid AS (SELECT i / {k}.0 AS w_p_a, jj / {k}.0 AS w_p_b, ({k} - i - jj) / {k}.0 AS w_p_c, i, jj FROM range({k} + 1) a(i), range({k} + 1) b(jj) WHERE i + jj <= {k}),
    g AS (SELECT i * 1000 + jj AS id, y, w_p_a * p_a + w_p_b * p_b + w_p_c * p_c AS s FROM sc CROSS JOIN grid)"""


@query("blend_weight_grid", "M19", sql=f"WITH {_SC}, {_GRID.format(k=100)} SELECT CAST(w_p_a AS DOUBLE) AS w_p_a, CAST(w_p_b AS DOUBLE) AS w_p_b, CAST(w_p_c AS DOUBLE) AS w_p_c, round(ap, 6) AS ap FROM ({_ap('g', by='id')}) JOIN grid ON id = i * 1000 + jj")
def _grid(spark, folder):
    found = s.search_weights(scored(spark, folder), "y", ["p_a", "p_b", "p_c"], 100)
    return found.select("w_p_a", "w_p_b", "w_p_c", *r("ap"))


@query("blend_weight_grid_two_heads", "M19", sql=f"""WITH {_SC}, g AS (SELECT i, y, (i / 100.0) * p_a + ((100 - i) / 100.0) * p_b AS s FROM sc CROSS JOIN range(101) t(i))
    SELECT CAST(i / 100.0 AS DOUBLE) AS w_p_a, round(ap, 6) AS ap FROM ({_ap('g', by='i')})""")
def _grid_two(spark, folder):
    return s.search_weights(scored(spark, folder), "y", ["p_a", "p_b"], 100).select("w_p_a", *r("ap"))


@query("blend_weight_grid_four_heads", "M19", sql=f"""WITH {_SC}, grid AS (SELECT i / 20.0 AS a, jj / 20.0 AS b, k / 20.0 AS c, (20 - i - jj - k) / 20.0 AS d, i * 10000 + jj * 100 + k AS id FROM range(21) x(i), range(21) y(jj), range(21) z(k) WHERE i + jj + k <= 20),
    g AS (SELECT id, y, a * p_a + b * p_b + c * p_c + d * p_d AS s FROM sc CROSS JOIN grid)
    SELECT CAST(a AS DOUBLE) AS w_p_a, CAST(b AS DOUBLE) AS w_p_b, CAST(c AS DOUBLE) AS w_p_c, CAST(d AS DOUBLE) AS w_p_d, round(ap, 6) AS ap FROM ({_ap('g', by='id')}) JOIN grid USING (id)""")
def _grid_four(spark, folder):
    """Every twentieth; the operator takes any step, the SQL repeats all rows per weighting."""
    return s.search_weights(scored(spark, folder), "y", ["p_a", "p_b", "p_c", "p_d"], 20).select("w_p_a", "w_p_b", "w_p_c", "w_p_d", *r("ap"))


@query("best_blend", "O4", "M19", sql=f"WITH {_SC}, {_GRID.format(k=20)}, apx AS ({_ap('g', by='id')}) SELECT round(max(ap), 6) AS ap, arg_max(CAST(w_p_a AS DOUBLE), ap) AS w_p_a, arg_max(CAST(w_p_b AS DOUBLE), ap) AS w_p_b FROM apx JOIN grid ON id = i * 1000 + jj")
def _best(spark, folder):
    found = s.search_weights(scored(spark, folder), "y", ["p_a", "p_b", "p_c"], 20)
    return s.best_row(found, ["w_p_a", "w_p_b"]).select(*r("ap"), "w_p_a", "w_p_b")


_SHARES = [i / 20 for i in range(21)]


@query("blend_space_choice", "M20", sql=f"""WITH {_SC}, b AS (SELECT y, {_lg('p_a', '1e-7')} AS la, {_lg('p_b', '1e-7')} AS lb, {_rank('p_a', plus=0)} AS ra, {_rank('p_b', plus=0)} AS rb FROM sc), al AS (SELECT unnest({_SHARES})::DOUBLE AS share),
    g AS (SELECT 'logit_' || CAST(share AS VARCHAR) AS id, 'logit' AS mode, share, y, round(share * la + (1.0 - share) * lb, 6) AS s FROM b CROSS JOIN al
      UNION ALL SELECT 'rank_' || CAST(share AS VARCHAR), 'rank', share, y, round(share * ra + (1.0 - share) * rb, 9) FROM b CROSS JOIN al)
    SELECT DISTINCT mode, share, round(ap, 6) AS ap FROM ({_ap('g', by='id')}) JOIN (SELECT DISTINCT id, mode, share FROM g) USING (id)""")
def _space(spark, folder):
    rows = s.rank_normalised(scored(spark, folder), ["p_a", "p_b"], extra=0)
    modes = F.array(
        F.struct(F.lit("logit").alias("mode"), m.logit("p_a").alias("a"), m.logit("p_b").alias("b"), F.lit(6).alias("d")),
        F.struct(F.lit("rank").alias("mode"), F.col("p_a_rank").alias("a"), F.col("p_b_rank").alias("b"), F.lit(9).alias("d")),
    )
    both = rows.select("y", F.inline(modes))
    def mix(share):
        value = share * F.col("a") + (1.0 - share) * F.col("b")
        return F.when(F.col("mode") == "logit", fixed(value, 6)).otherwise(fixed(value, 9))

    return s.search_share(both, "y", mix, _SHARES, ["mode"]).select("mode", "share", *r("ap"))


_STEPS = [("p_a", "p_b", "one", 0.55, 1e-7), ("one", "p_c", "two", 0.55, 1e-7), ("two", "one", "four", 0.5485, 1e-8), ("one", "four", "total", 0.541415926, 1e-9)]


def _step_sql(left, right, result, share, eps):
    return f"{result} AS (SELECT event_id, {_sig(f'{share} * za + {1.0 - share} * zb')} AS predict FROM (SELECT event_id, {_z('a.predict', eps)} AS za, {_z('b.predict', eps)} AS zb FROM {left} a JOIN {right} b USING (event_id)))"


_TABLES = ", ".join(f"{n} AS (SELECT event_id, {n} AS predict FROM sc)" for n in ("p_a", "p_b", "p_c"))


@query("chained_two_way_blends", "M21", "J13", sql=f"WITH {_SC}, {_TABLES}, " + ", ".join(_step_sql(*st) for st in _STEPS) + " SELECT event_id, round(predict, 6) AS predict FROM total")
def _chain(spark, folder):
    rows = scored(spark, folder)
    tables = {n: rows.select("event_id", F.col(n).alias("predict")) for n in ("p_a", "p_b", "p_c")}
    return s.blend_chain(tables, _STEPS).select("event_id", *r("predict"))


_W = {"p_a": 2.0, "p_b": 1.0, "p_c": 1.0, "p_d": 0.5}


@query("weighted_logit_blend", "M22", sql=f"WITH {_SC} SELECT event_id, round({_sig(' + '.join(f'{w / 4.5} * ({_z(n)})' for n, w in _W.items()))}, 6) AS predict FROM sc")
def _weighted(spark, folder):
    return s.blend_logits(scored(spark, folder), _W).select("event_id", *r("predict"))


_STRATEGIES = {"diverse": ["p_a", "p_c"], "two_way": ["p_a"], "all": ["p_a", "p_b", "p_c"]}
_ZS = "zs AS (SELECT event_id, " + ", ".join(f"{_z(n)} AS {n}" for n in HEADS) + " FROM sc)"


@query("strategy_grid", "M23", sql=f"WITH {_SC}, {_ZS} " + " UNION ALL ".join(
    f"SELECT event_id, '{n}_{round(sh * 100)}' AS tag, round({_sig(' + '.join([f'{sh} * p_d'] + [f'{(1.0 - sh) / len(h)} * {c}' for c in h]))}, 6) AS predict FROM zs"
    for n, h in _STRATEGIES.items() for sh in s.OUTSIDE_SHARES))
def _strategies(spark, folder):
    return s.strategy_grid(scored(spark, folder), _STRATEGIES, "p_d").select("event_id", "tag", *r("predict"))


# -- joins of score tables --------------------------------------------------------------------------------

_GAPPY = "gappy AS (SELECT event_id, p_a AS predict FROM sc WHERE event_id % 7 <> 0)"


def _gappy(spark, folder):
    rows = scored(spark, folder)
    return rows, rows.filter("event_id % 7 <> 0").select("event_id", F.col("p_a").alias("predict"))


@query("template_filled_with_median", "J12", "SNK4", sql=f"WITH {_SC}, {_GAPPY} SELECT event_id, round(COALESCE(predict, (SELECT quantile_cont(predict, 0.5) FROM gappy)), 9) AS predict FROM sc LEFT JOIN gappy USING (event_id)")
def _template(spark, folder):
    rows, gappy = _gappy(spark, folder)
    return j.fill_template(rows.select("event_id"), gappy).select("event_id", *r("predict", digits=9))


@query("common_events_of_two_tables", "J13", sql=f"WITH {_SC}, {_GAPPY} SELECT event_id, round(predict, 9) AS predict, round(p_b, 9) AS p_b FROM sc JOIN gappy USING (event_id) WHERE event_id % 5 <> 0")
def _common(spark, folder):
    rows, gappy = _gappy(spark, folder)
    return rows.filter("event_id % 5 <> 0").join(gappy, "event_id").select("event_id", *r("predict", "p_b", digits=9))


_SOURCES = {f"s{i}": (list(HEADS)[i % 4], i + 3) for i in range(7)}


def _sources(spark, folder):
    rows = scored(spark, folder)
    return rows, {n: rows.filter(f"event_id % {k} <> 0").select("event_id", F.col(c).alias("predict")) for n, (c, k) in _SOURCES.items()}


@query("seven_tables_gathered", "J14", sql=f"WITH {_SC} SELECT event_id, " + ", ".join(
    f"round(CASE WHEN event_id % {k} <> 0 THEN {c} ELSE (SELECT quantile_cont({c}, 0.5) FROM sc WHERE event_id % {k} <> 0) END, 9) AS {n}" for n, (c, k) in _SOURCES.items()) + " FROM sc")
def _seven(spark, folder):
    rows, sources = _sources(spark, folder)
    gathered = j.gather_scores(rows, sources)
    return j.fill_medians(gathered, list(sources)).select("event_id", *r(*sources, digits=9))


@query("missing_after_gathering", "J14", "A28", sql=f"WITH {_SC} " + " UNION ALL ".join(f"SELECT '{n}' AS source, count(*) FILTER (WHERE event_id % {k} = 0) AS missing FROM sc" for n, (_, k) in _SOURCES.items()))
def _missing(spark, folder):
    rows, sources = _sources(spark, folder)
    return j.missing_counts(j.gather_scores(rows, sources), list(sources))


@query("score_completeness", "A28", sql=f"""WITH {_SC}, {_GAPPY} SELECT (SELECT count(*) FROM sc) AS template_rows, (SELECT count(*) FROM gappy) + (SELECT count(*) FROM sc WHERE event_id % 11 = 0) AS score_rows,
    (SELECT count(*) FROM sc WHERE event_id % 7 = 0 AND event_id % 11 <> 0) AS missing, (SELECT count(*) FROM sc WHERE event_id % 7 <> 0 AND event_id % 11 = 0) AS duplicated, 0::BIGINT AS "unknown" """)
def _complete(spark, folder):
    rows, gappy = _gappy(spark, folder)
    extra = rows.filter("event_id % 11 = 0").select("event_id", F.col("p_b").alias("predict"))
    return q.completeness(gappy.unionByName(extra), rows)


@query("results_table", "A27", sql=f"WITH {_SC} " + " UNION ALL ".join(f"SELECT '{n}' AS model, round(ap, 9) AS ap FROM ({_ap('sc', score=n)})" for n in HEADS))
def _results(spark, folder):
    heads = {n: (F.lit(True), F.col("y"), n) for n in HEADS}
    return s.head_precisions(scored(spark, folder), heads).select(F.col("head").alias("model"), *r("ap", digits=9)).orderBy(F.col("ap").desc())
