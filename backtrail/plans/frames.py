"""Queries of joins, distinct rows, set operations, folds, weights and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from backtrail.operators import folds as fd
from backtrail.operators import joins as j
from backtrail.operators import quality as q
from backtrail.operators import rows as rw
from backtrail.operators.lookups import lookup
from backtrail.plans.base import HALF_TIME, ORDER, bank_events, bank_labels, customers, events, fixed, labelled, query
from backtrail.operators.history import Past
from backtrail.settings import prepare
from backtrail.sources import tables


def r(*names, digits=6):
    return [fixed(n, digits).alias(n) for n in names]


# -- joins ---------------------------------------------------------------------------------------


@query("labels_joined", "J1", "SRC5", sql="SELECT event_id, target FROM ev LEFT JOIN bank_labels USING (event_id)")
def _labels(spark, folder):
    return lookup(events(spark, folder), bank_labels(spark, folder).select("event_id", "target"), "event_id").select("event_id", "target")


_BUSY = "(SELECT customer_id FROM ev GROUP BY 1 HAVING count(*) % 2 = 0)"


@query("rows_of_listed_customers", "J5", "J6", sql=f"SELECT event_id FROM ev WHERE customer_id IN {_BUSY}")
def _listed(spark, folder):
    rows = events(spark, folder)
    busy = rows.groupBy("customer_id").count().filter("count % 2 = 0")
    return j.keep_customers(rows, busy).select("event_id")


@query("embeddings_attached", "J10", sql="SELECT event_id, " + ", ".join(f"COALESCE(CAST(embedding[{i + 1}] AS DOUBLE), 0.0) AS emb_{i}" for i in range(64))
       + " FROM ev LEFT JOIN (SELECT vec_id AS customer_id, embedding FROM embeddings WHERE vec_id % 3 <> 0) USING (customer_id)")
def _embeddings(spark, folder):
    from backtrail.operators.sequences import attach_embeddings

    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").filter("vec_id % 3 <> 0")
    vectors = vectors.select(F.col("vec_id").alias("customer_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return attach_embeddings(events(spark, folder), vectors, 64).select("event_id", *[f"emb_{i}" for i in range(64)])


@query("labels_set_by_membership", "J15", "P35", sql="""SELECT event_id, CASE period WHEN 'pretrain' THEN 0 WHEN 'train' THEN 1 WHEN 'pretest' THEN 2 ELSE 3 END AS dataset,
    CASE WHEN period <> 'train' THEN 0 WHEN target = 0 THEN 2 WHEN target = 1 THEN 3 ELSE 1 END AS target FROM bank_events LEFT JOIN (SELECT event_id, target FROM bank_labels) USING (event_id)""")
def _membership(spark, folder):
    names = F.array(*[F.lit(p) for p in tables.PERIODS])
    rows = bank_events(spark, folder).select("event_id", (F.array_position(names, F.col("period")) - 1).cast("int").alias("dataset"))
    rows = rows.withColumn("target", F.when(F.col("dataset") == 1, 1).otherwise(0))
    found = bank_labels(spark, folder).select("event_id", (F.col("target") + 2).alias("value"))
    return j.set_where_listed(rows, "target", found)


@query("random_day_validation", "J16", "M2", "A25", sql="""WITH w AS (SELECT * FROM ev WHERE event_ts >= TIMESTAMP '2024-01-15' AND event_ts < TIMESTAMP '2024-01-21'),
    d AS (SELECT customer_id, event_date, row_number() OVER (PARTITION BY customer_id ORDER BY
      (CAST(date_diff('day', DATE '1970-01-01', event_date) AS BIGINT) * 2654435761 + customer_id * 40503 + 42) % 1000003, event_date) AS k FROM (SELECT DISTINCT customer_id, event_date FROM w))
    SELECT event_id FROM w JOIN d USING (customer_id, event_date) WHERE k = 1""")
def _random_day(spark, folder):
    return fd.one_day_per_customer(events(spark, folder), "2024-01-15", "2024-01-21").select("event_id")


@query("positions_in_index", "J18", sql="SELECT event_id, pos FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, period FROM ev) WHERE period = 'test'")
def _positions(spark, folder):
    rows = events(spark, folder)
    return j.positions(rows, rows.filter("period = 'test'"))


@query("queried_events_not_in_index", "J18", sql="SELECT event_id FROM ev WHERE period = 'test' AND event_id % 3 = 0")
def _absent(spark, folder):
    rows = events(spark, folder).select("event_id", "period")
    return rows.filter("period = 'test'").join(rows.filter("event_id % 3 <> 0"), "event_id", "left_anti").select("event_id")


# -- distinct rows, order and sets --------------------------------------------------------------------

_COPIES = "copies AS (SELECT customer_id, event_id, sec, 0 AS dataset FROM ev UNION ALL SELECT customer_id, event_id, sec, 1 FROM ev WHERE event_id % 7 = 0 UNION ALL SELECT customer_id, event_id, sec, 1 FROM ev WHERE event_id % 14 = 0)"


def _copies(spark, folder):
    rows = events(spark, folder).select("customer_id", "event_id", "sec")
    again = rows.withColumn("dataset", F.lit(1))
    return rows.withColumn("dataset", F.lit(0)).unionByName(again.filter("event_id % 7 = 0")).unionByName(again.filter("event_id % 14 = 0"))


@query("distinct_rows", "A10", "S3", sql=f"WITH {_COPIES} SELECT DISTINCT * FROM copies")
def _distinct(spark, folder):
    return _copies(spark, folder).distinct()


@query("one_row_per_event", "A11", sql=f"WITH {_COPIES} SELECT event_id, min(dataset) AS dataset, count(*) FILTER (WHERE dataset = 9) AS never FROM copies GROUP BY 1")
def _one(spark, folder):
    return rw.one_per_key(_copies(spark, folder), "event_id", ["dataset"]).select("event_id", "dataset", F.lit(0).cast("long").alias("never"))


@query("last_row_and_duplicate_flag", "A12", sql=f"WITH {_COPIES} SELECT event_id, max(dataset) AS dataset, CAST(count(*) > 1 AS INT) AS duplicated_event FROM copies GROUP BY 1")
def _last(spark, folder):
    return rw.keep_last_and_flag(_copies(spark, folder), "event_id", ["customer_id", "sec", "dataset"]).select("event_id", "dataset", "duplicated_event")


@query("distinct_customers", "A13", sql="SELECT DISTINCT customer_id FROM ev WHERE period = 'pretrain'")
def _customers(spark, folder):
    return events(spark, folder).filter("period = 'pretrain'").select("customer_id").distinct()


@query("last_rows_per_customer", "O3", sql="SELECT event_id, back FROM (SELECT event_id, row_number() OVER (PARTITION BY customer_id ORDER BY sec DESC, event_id DESC) AS back FROM ev) WHERE back <= 500")
def _tail(spark, folder):
    return rw.last_rows(events(spark, folder).select("customer_id", "event_id", "sec"), "customer_id", ORDER, 500).select("event_id", F.col("back").cast("long").alias("back"))


@query("union_of_periods", "S1", "SRC7", sql="SELECT period, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, count(DISTINCT customer_id) AS people FROM ev GROUP BY 1")
def _union(spark, folder):
    rows = events(spark, folder)
    parts = {p: rows.filter(F.col("period") == p).drop("period") for p in tables.PERIODS}
    return tables.tagged_periods(parts).groupBy("period").agg(
        F.count("*").alias("n"), F.sum("cents").alias("cents"), F.countDistinct("customer_id").alias("people"))


@query("union_with_missing_columns", "S2", "SRC4", sql="SELECT event_id, CASE WHEN period = 'train' THEN cents END AS cents, CASE WHEN period <> 'train' THEN timezone END AS timezone FROM ev")
def _missing_columns(spark, folder):
    rows = events(spark, folder)
    train = rows.filter("period = 'train'").select("event_id", "cents")
    rest = rows.filter("period <> 'train'").select("event_id", "timezone")
    return tables.union_all([train, rest], allow_missing=True)


@query("completed_columns", "SRC3", "SRC4", sql="SELECT event_id, CAST(NULL AS VARCHAR) AS battery, mcc_code, CAST(event_desc AS INT) AS event_desc FROM bank_events")
def _completed(spark, folder):
    raw = tables.present_columns(bank_events(spark, folder).drop("battery"), tables.EVENT_COLUMNS)
    return tables.complete_columns(raw, tables.EVENT_SCHEMA).select("event_id", "battery", "mcc_code", "event_desc")


@query("pretest_copies_removed", "A10", "SRC7", sql="SELECT period, count(*) AS n FROM ev GROUP BY 1")
def _pretest(spark, folder):
    raw = bank_events(spark, folder)
    return tables.distinct_pretest(raw.unionByName(raw.filter("period = 'pretest' AND event_id % 3 = 0"))).groupBy("period").agg(F.count("*").alias("n"))


# -- audits and filling ---------------------------------------------------------------------------------

_AUDITED = ["event_desc", "timezone", "mcc_code_i", "compromised_i", "screen_w", "cents", "accept_language_i", "rare", "sparse", "cnt_prev_labeled_same_desc", "prior_x_red_rate_all"]
_CATS = ["event_desc", "timezone", "mcc_code_i", "sparse"]
_AUDIT_VIEW = """f AS (SELECT event_id, period, event_desc, timezone, mcc_code_i, compromised_i, screen_w, cents, accept_language_i,
    CASE WHEN event_id % 5000 = 0 THEN 1 ELSE 0 END AS rare, CASE WHEN period = 'train' AND event_id % 10 = 0 THEN event_desc * 1000 + event_id % 97 WHEN event_id % 100 = 0 THEN 1 END AS sparse,
    event_id % 3 AS cnt_prev_labeled_same_desc, event_id % 5 AS prior_x_red_rate_all FROM ev)"""


def _audit_rows(spark, folder):
    sparse = F.when((F.col("period") == "train") & (F.col("event_id") % 10 == 0), F.col("event_desc") * 1000 + F.col("event_id") % 97).when(F.col("event_id") % 100 == 0, 1)
    rows = events(spark, folder).withColumns({
        "rare": F.when(F.col("event_id") % 5000 == 0, 1).otherwise(0), "sparse": sparse,
        "cnt_prev_labeled_same_desc": F.col("event_id") % 3, "prior_x_red_rate_all": F.col("event_id") % 5,
    })
    return rows.filter("period = 'train'"), rows.filter("period = 'test'")


def _audit_sql(dominant, sparse, values, risky):
    def side(c, p):
        return f"""(SELECT count(*) FROM (SELECT DISTINCT {c} FROM f WHERE period = '{p}')) AS {p}_nunique, (SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FROM f WHERE period = '{p}') AS {p}_missing_rate"""
    rows = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {side(c, 'train')}, {side(c, 'test')}, (SELECT max(n) / CAST(sum(n) AS DOUBLE) FROM (SELECT count(*) AS n FROM f WHERE period = 'train' GROUP BY {c})) AS top, {str(c in _CATS).lower()} AS cat"""
        for c in _AUDITED)
    risk = "WHEN feature LIKE 'cnt_prev_labeled_same_desc' THEN 'risky_label_feature' WHEN feature LIKE '%_red_rate_all' THEN 'risky_label_prior'" if risky else ""
    return f"""WITH {_AUDIT_VIEW}, a AS ({rows}), b AS (SELECT *, CASE WHEN cat OR train_nunique <= 128 OR train_missing_rate >= 0.95 THEN top ELSE 0.0 END AS share FROM a)
    SELECT feature, CASE {risk} WHEN train_nunique <= 1 THEN 'constant' WHEN share >= {dominant} THEN 'almost_constant'
      WHEN train_missing_rate >= {sparse} AND test_missing_rate >= {sparse} THEN 'too_sparse'
      WHEN cat AND train_missing_rate >= 0.85 AND train_nunique >= {values} AND test_nunique <= 2 THEN 'collapsed_in_test' ELSE 'keep' END AS drop_reason,
      train_nunique, test_nunique, round(train_missing_rate, 9) AS train_missing_rate, round(test_missing_rate, 9) AS test_missing_rate, round(share, 9) AS dominant_share FROM b"""


def _audit(spark, folder, rules):
    train, test = _audit_rows(spark, folder)
    out = q.audit_order(q.audit_features(train, test, _AUDITED, _CATS, rules))
    return out.select("feature", "drop_reason", "train_nunique", "test_nunique", *r("train_missing_rate", "test_missing_rate", "dominant_share", digits=9))


@query("feature_audit_strict", "A14", "O5", sql=_audit_sql(0.9995, 0.995, 20, True))
def _strict(spark, folder):
    return _audit(spark, folder, q.STRICT_RULES)


@query("feature_audit_loose", "A14", "O5", sql=_audit_sql(0.9997, 0.997, 50, False))
def _loose(spark, folder):
    return _audit(spark, folder, q.LOOSE_RULES)


def _nulls(spark, folder):
    rows = bank_events(spark, folder).select("event_id", "period", F.col("operaton_amt").alias("amt"), F.col("timezone").cast("double").alias("tz"),
                                             F.col("currency_iso_cd").alias("currency"))
    return rows


_NULLS = "nl AS (SELECT event_id, period, operaton_amt AS amt, CAST(timezone AS DOUBLE) AS tz, CAST(currency_iso_cd AS INT) AS currency FROM bank_events)"


@query("median_imputed", "A15", sql=f"WITH {_NULLS} SELECT event_id, " + ", ".join(f"round(COALESCE({c}, (SELECT quantile_cont({c}, 0.5) FROM nl WHERE period = 'train')), 6) AS {c}" for c in ("amt", "tz")) + ", COALESCE(currency, -1) AS currency FROM nl WHERE period = 'test'")
def _impute(spark, folder):
    rows = _nulls(spark, folder)
    _, test = q.impute(rows.filter("period = 'train'"), [rows.filter("period = 'test'")], ["amt", "tz"], ["currency"])
    return test.select("event_id", *r("amt", "tz"), "currency")


def _mean_sql(where):
    return f"WITH {_NULLS} SELECT event_id, " + ", ".join(f"round(COALESCE({c}, (SELECT avg({c}) FROM nl {where})), 5) AS {c}" for c in ("amt", "tz")) + " FROM nl"


@query("mean_filled_over_all_rows", "A16", sql=_mean_sql(""))
def _mean_all(spark, folder):
    rows = _nulls(spark, folder)
    return q.fill_values(rows, q.means(rows, ["amt", "tz"]), "mean").select("event_id", *r("amt", "tz", digits=5))


@query("mean_filled_from_train", "A17", sql=_mean_sql("WHERE period = 'train'"))
def _mean_train(spark, folder):
    rows = _nulls(spark, folder)
    return q.fill_values(rows, q.means(rows.filter("period = 'train'"), ["amt", "tz"]), "mean").select("event_id", *r("amt", "tz", digits=5))


@query("standardised_numbers", "A26", sql="SELECT event_id, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM ev WHERE period = 'train')) / (SELECT stddev_pop({c}) FROM ev WHERE period = 'train'), 5) AS {c}" for c in ("timezone", "screen_w")) + " FROM ev WHERE period = 'test'")
def _standard(spark, folder):
    rows = events(spark, folder)
    _, test = fd.standardise(rows.filter("period = 'train'"), [rows.filter("period = 'test'")], ["timezone", "screen_w"])
    return test.select("event_id", *r("timezone", "screen_w", digits=5))


# -- folds and weights --------------------------------------------------------------------------------------


@query("time_holdout", "M1", sql="SELECT event_id, CAST(event_ts >= TIMESTAMP '2024-01-18' AS INT) AS is_valid FROM ev WHERE period = 'train'")
def _holdout(spark, folder):
    return fd.time_holdout(events(spark, folder).filter("period = 'train'"), "2024-01-18").select("event_id", "is_valid")


def _orders(spark, folder):
    return prepare(spark).read.parquet(f"{folder}/orders.parquet").withColumn("event_ts", F.col("o_orderdate").cast("timestamp"))


def _fold_sql(months):
    start = "DATE '1996-01-01'" if months is None else f"greatest(DATE '1996-01-01', CAST(v - INTERVAL {months} MONTH AS DATE))"
    return f"""WITH m AS (SELECT CAST(v AS DATE) AS v, CAST(v + INTERVAL 1 MONTH AS DATE) AS e, 'f' || (row_number() OVER (ORDER BY v) - 1) AS fold FROM range(DATE '1997-01-01', DATE '1998-01-01', INTERVAL 1 MONTH) t(v)),
    s AS (SELECT *, {start} AS t FROM m) SELECT fold, CASE WHEN o_orderdate < v THEN 'train' ELSE 'valid' END AS part, count(*) AS n, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents
    FROM orders JOIN s ON o_orderdate >= t AND o_orderdate < e GROUP BY 1, 2"""


def _fold_counts(spark, folder, months):
    spans = fd.month_spans("1997-01-01", "1998-01-01", "1996-01-01", months)
    return fd.mark_folds(_orders(spark, folder), spans).groupBy("fold", "part").agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("sliding_month_folds", "M3", sql=_fold_sql(3))
def _sliding(spark, folder):
    return _fold_counts(spark, folder, 3)


@query("expanding_month_folds", "M3", sql=_fold_sql(None))
def _expanding(spark, folder):
    return _fold_counts(spark, folder, None)


_FIXED = [("f1", "1900-01-01", "2024-01-12", "2024-01-14"), ("f2", "1900-01-01", "2024-01-14", "2024-01-16"), ("f3", "1900-01-01", "2024-01-16", "2024-01-18"), ("f4", "1900-01-01", "2024-01-18", "2024-01-21")]


@query("fixed_folds", "M4", sql=" UNION ALL ".join(f"SELECT event_id, '{n}' AS fold, CASE WHEN event_ts < TIMESTAMP '{v}' THEN 'train' ELSE 'valid' END AS part FROM ev WHERE period = 'train' AND event_ts < TIMESTAMP '{e}'" for n, _, v, e in _FIXED))
def _fixed(spark, folder):
    return fd.mark_folds(events(spark, folder).filter("period = 'train'"), _FIXED).select("event_id", "fold", "part")


@query("row_weights", "M6", sql=f"""SELECT event_id, CAST(CASE train_target_raw WHEN 1 THEN 10.0 WHEN 0 THEN 2.5 ELSE 1.0 END AS DOUBLE) AS weight,
    round(CASE WHEN train_target_raw = -1 THEN CASE WHEN event_ts >= TIMESTAMP '{HALF_TIME}' THEN 1.8 ELSE 3.0 END WHEN train_target_raw = 1 THEN 10.0 ELSE 2.5 END
      * CASE WHEN event_ts >= TIMESTAMP '2024-01-14' THEN 1.15 ELSE 1.0 END, 6) AS dated_weight FROM lv WHERE period = 'train'""")
def _weights(spark, folder):
    label, time = F.col("train_target_raw"), F.col("event_ts")
    return labelled(spark, folder).filter("period = 'train'").select(
        "event_id", fd.label_weight(label).alias("weight"), fixed(fd.dated_weight(label, time, HALF_TIME, "2024-01-14")).alias("dated_weight"))


_DECAY = "0.85 + 0.4 * ((sec - (SELECT min(sec) FROM tr)) / 86400.0 / greatest((SELECT max(sec) - min(sec) FROM tr) / 86400.0, 1.0))"


@query("time_decay", "W42", sql=f"WITH tr AS (SELECT * FROM lv WHERE period = 'train') SELECT event_id, round({_DECAY}, 6) AS decay FROM tr")
def _decay(spark, folder):
    rows = labelled(spark, folder).filter("period = 'train'")
    return rows.select("event_id", fixed(fd.time_decay(rows)).alias("decay"))


_INV = f"CASE WHEN train_target_raw <> -1 THEN 1.0 WHEN event_ts >= TIMESTAMP '{HALF_TIME}' THEN 6.0 ELSE 20.0 END"


@query("importance_weights", "M7", sql=f"""WITH tr AS (SELECT * FROM lv WHERE period = 'train'), d AS (SELECT event_id, train_target_raw AS t, {_DECAY} AS decay, {_INV} AS inv FROM tr),
    w AS (SELECT event_id, t, inv * decay * CASE t WHEN 0 THEN 2.8 WHEN 1 THEN 6.5 ELSE 1.0 END AS main, decay * CASE t WHEN 0 THEN 1.35 WHEN 1 THEN 2.6 ELSE 1.0 END AS lab, inv * decay * CASE WHEN t <> -1 THEN 3.0 ELSE 1.0 END AS susp FROM d)
    SELECT event_id, round(main / (SELECT avg(main) FROM w), 5) AS w_main, round(lab / (SELECT avg(lab) FROM w WHERE t <> -1), 5) AS w_labelled, round(susp / (SELECT avg(susp) FROM w), 5) AS w_suspicious FROM w""")
def _importance(spark, folder):
    rows = labelled(spark, folder).filter("period = 'train'")
    for kind in ("main", "labelled", "suspicious"):
        rows = fd.importance_weights(rows, kind, HALF_TIME).withColumnRenamed("weight", f"w_{kind}")
    return rows.select("event_id", *r("w_main", "w_labelled", "w_suspicious", digits=5))


@query("class_balance_weight", "A21", sql="SELECT least(100.0, greatest(1.0, count(*) FILTER (WHERE is_red = 0) / CAST(count(*) FILTER (WHERE is_red = 1) AS DOUBLE))) AS pos_weight FROM lv WHERE period = 'train'")
def _balance(spark, folder):
    return fd.positive_weight(labelled(spark, folder).filter("period = 'train'"), F.col("is_red_lbl"))


_HEAD = {
    "main": ("CAST(train_target_raw = 1 AS INT)", "CASE train_target_raw WHEN 1 THEN 10.0 WHEN 0 THEN 2.5 ELSE 1.0 END", "true"),
    "recent": ("CAST(train_target_raw = 1 AS INT)", "CASE train_target_raw WHEN 1 THEN 10.0 WHEN 0 THEN 2.5 ELSE 1.0 END", f"event_ts >= TIMESTAMP '{HALF_TIME}' OR train_target_raw <> -1"),
    "suspicious": ("CAST(train_target_raw <> -1 AS INT)", "CASE WHEN train_target_raw <> -1 THEN 6.0 ELSE 1.2 END", "true"),
    "red_given_suspicious": ("CAST(train_target_raw = 1 AS INT)", "CASE WHEN train_target_raw = 1 THEN 2.2 ELSE 1.0 END", "train_target_raw <> -1"),
}


@query("head_targets", "M8", sql=" UNION ALL ".join(f"SELECT event_id, '{n}' AS head, {y} AS y, CAST({w} AS DOUBLE) AS w FROM lv WHERE period = 'train' AND ({c})" for n, (y, w, c) in _HEAD.items()))
def _head_targets(spark, folder):
    rows = labelled(spark, folder).filter("period = 'train'")
    return tables.union_all([fd.head_rows(rows, n, HALF_TIME).select("event_id", F.lit(n).alias("head"), "y", "w") for n in _HEAD])


_ENC = ["event_desc", "mcc_code_i", "timezone"]
_VOCAB = "fit AS (SELECT * FROM ev WHERE event_ts < TIMESTAMP '2024-01-02')"


def _code(c, unknown):
    return f"COALESCE((SELECT code FROM (SELECT {c} AS v, dense_rank() OVER (ORDER BY {c}) + {unknown} AS code FROM (SELECT DISTINCT {c} FROM fit)) WHERE v = ev.{c}), {unknown})"


@query("category_codes_with_unknown", "M9", sql=f"WITH {_VOCAB} SELECT event_id, " + ", ".join(f"{_code(c, 1)} AS {c}_code" for c in _ENC) + " FROM ev")
def _encode(spark, folder):
    rows = events(spark, folder)
    return fd.encode(rows, rows.filter("event_ts < TIMESTAMP '2024-01-02'"), _ENC).select("event_id", *[f"{c}_code" for c in _ENC])


@query("category_codes_from_train", "M10", sql=f"WITH {_VOCAB} SELECT event_id, " + ", ".join(f"{_code(c, 0)} AS {c}_code, {c} + 1 AS {c}_shifted" for c in _ENC) + " FROM ev WHERE period = 'test'")
def _encode_train(spark, folder):
    rows = events(spark, folder)
    coded = fd.encode(rows.filter("period = 'test'"), rows.filter("event_ts < TIMESTAMP '2024-01-02'"), _ENC, unknown=0)
    return coded.select("event_id", *[f"{c}_code" for c in _ENC], *[(F.col(c) + 1).alias(f"{c}_shifted") for c in _ENC])


_FOLD_BORDERS = {"a": "2024-01-02", "b": "2024-01-05", "c": "2024-01-20"}


@query("category_codes_of_all_folds", "M9", "M10", sql="SELECT event_id, " + ", ".join(
    f"COALESCE(v_{c}_{f}.code, 1) AS {c}_code_{f}" for c in _ENC for f in _FOLD_BORDERS) + " FROM ev " + " ".join(
    f"LEFT JOIN (SELECT {c}, row_number() OVER (ORDER BY {c}) + 1 AS code FROM (SELECT DISTINCT {c} FROM ev WHERE {c} IS NOT NULL AND event_ts < TIMESTAMP '{b}')) v_{c}_{f} ON v_{c}_{f}.{c} = ev.{c}"
    for c in _ENC for f, b in _FOLD_BORDERS.items()))
def _encode_folds(spark, folder):
    """All columns for three folds from one pass over the rows that are learnt from."""
    rows = events(spark, folder)
    coded = fd.encode_folds(rows, rows, list(_ENC), "event_ts", _FOLD_BORDERS)
    return coded.select("event_id", *[f"{c}_code_{f}" for c in _ENC for f in _FOLD_BORDERS])


@query("unknown_rate_and_mode", "M9", "M11", sql=f"WITH {_VOCAB} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IN (SELECT {c} FROM fit) THEN 0.0 ELSE 1.0 END), 6) AS unk_rate, count(DISTINCT CASE WHEN {c} IN (SELECT {c} FROM fit) THEN {c} END) AS known_values,
    CASE WHEN count(DISTINCT CASE WHEN {c} IN (SELECT {c} FROM fit) THEN {c} END) + 1 <= 15 THEN 'one_hot' ELSE 'embedding' END AS mode FROM ev""" for c in _ENC))
def _unknown(spark, folder):
    rows = events(spark, folder)
    coded = fd.encode(rows, rows.filter("event_ts < TIMESTAMP '2024-01-02'"), _ENC)
    return fd.unknown_rates(coded, _ENC, one_hot_up_to=15).select("feature", *r("unk_rate"), "known_values", "mode")


# -- a second event source ----------------------------------------------------------------------------------


@query("order_history", "W1", "W5", "W10", sql="""WITH o AS (SELECT o_custkey, o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS sec, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
    SELECT o_orderkey, row_number() OVER w - 1 AS n, COALESCE(CAST(sum(cents) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS past_cents, COALESCE(sec - lag(sec) OVER w, -1) AS gap
    FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY sec, o_orderkey)""")
def _order_history(spark, folder):
    from backtrail.operators.history import History

    rows = _orders(spark, folder).select("o_custkey", "o_orderkey", F.unix_timestamp("event_ts").alias("sec"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    h = History.of(rows, "o_custkey", ["sec", "o_orderkey"]).past(n=Past.count(), past_cents=Past.sum("cents"), before=Past.previous("sec"))
    return h.frame().select("o_orderkey", "n", "past_cents", F.coalesce(F.col("sec") - F.col("before"), F.lit(-1)).alias("gap"))
