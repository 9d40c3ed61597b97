"""Queries of sequences, pooling, sources, sinks and heads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from backtrail.functions import measures as m
from backtrail.operators import sequences as sq
from backtrail.operators.joins import only_row
from backtrail.plans.base import ORDER, bank_events, bank_labels, clocked, customers, events, fixed, labelled, query
from backtrail.settings import ensure_checkpoint_folder, remove_at_exit
from backtrail.sources import sinks, tables

FIELDS = {
    "etype": "event_type_nm", "edesc": "event_desc", "ch_type": "channel_indicator_type", "ch_sub": "channel_indicator_sub_type",
    "mcc": "mcc_code_i", "pos": "pos_cd", "tz": "timezone", "os": "operating_system_type", "voip": "phone_voip_call_state",
    "rdp": "web_rdp_connection", "hour": "hour", "dow": "weekday",
}


def r(*names, digits=6):
    return [fixed(n, digits).alias(n) for n in names]


def _fields(spark, folder):
    rows = clocked(spark, folder)
    return rows.select("customer_id", *ORDER, *[F.col(c).alias(n) for n, c in FIELDS.items()], F.coalesce(m.log_size("amt"), F.lit(0.0)).alias("amt_log"))


def _sequences(spark, folder, n=500):
    return sq.customer_sequences(_fields(spark, folder), [*FIELDS, "amt_log"], ORDER, n)


def _text(column):
    return F.array_join(F.transform(column, lambda v: v.cast("string")), ",")


_F_SQL = "fl AS (SELECT customer_id, sec, event_id, " + ", ".join(f"{'isodow(event_ts)' if n == 'dow' else c} AS {n}" for n, c in FIELDS.items()) + ", amt FROM ev)"
_TAIL = f"{_F_SQL}, tl AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY sec DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY customer_id) AS total FROM fl)"


@query("customer_sequences", "A9", sql=f"WITH {_TAIL} SELECT customer_id, " + ", ".join(f"string_agg(CAST({n} AS VARCHAR), ',' ORDER BY sec, event_id) AS {n}_seq" for n in FIELDS)
       + ", string_agg(CAST(CAST(floor(COALESCE(ln(1 + abs(amt)), 0) * 10000 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY sec, event_id) AS amt_log_seq, any_value(total) AS total_events FROM tl WHERE back <= 500 GROUP BY 1")
def _seq(spark, folder):
    s = _sequences(spark, folder)
    scaled = F.transform("amt_log_seq", lambda v: F.floor(v * 10000 + 0.5))
    return s.select("customer_id", *[_text(f"{n}_seq").alias(f"{n}_seq") for n in FIELDS], _text(scaled).alias("amt_log_seq"), "total_events")


_SIZE, _LEN = 500, 64
_VIEWS_SQL = f"""{_TAIL}, ls AS (SELECT customer_id, list(etype ORDER BY sec, event_id) AS etype, list(mcc ORDER BY sec, event_id) AS mcc FROM tl WHERE back <= {_SIZE} GROUP BY 1),
    vw AS (SELECT *, CASE WHEN len(etype) <= {_LEN} THEN 0 ELSE (customer_id * 40503 + view * 2654435761) % greatest(len(etype) - {_LEN}, 1) END AS start FROM ls, (VALUES (0), (1)) t(view))"""


@query("two_random_views", "M27", sql=f"WITH {_VIEWS_SQL} SELECT customer_id, view, CAST(start AS INT) AS start, array_to_string(etype[start + 1 : start + {_LEN}], ',') AS etype_seq, array_to_string(mcc[start + 1 : start + {_LEN}], ',') AS mcc_seq FROM vw")
def _views(spark, folder):
    v = sq.random_views(_sequences(spark, folder, _SIZE), ["etype", "mcc"], _LEN)
    return v.select("customer_id", "view", "start", _text("etype_seq").alias("etype_seq"), _text("mcc_seq").alias("mcc_seq"))


def _pad(c, top):
    return f"array_to_string(list_transform(range((SELECT max(len(etype)) FROM ls)), lambda i: CASE WHEN i < len({c}) THEN least(greatest({c}[i + 1] + 1, 0), {top}) ELSE 0 END), ',')"


@query("padded_sequences", "M28", sql=f"WITH {_VIEWS_SQL} SELECT customer_id, {_pad('etype', 19)} AS etype_seq, {_pad('mcc', 24)} AS mcc_seq, array_to_string(list_transform(range((SELECT max(len(etype)) FROM ls)), lambda i: CASE WHEN i < len(etype) THEN 1 ELSE 0 END), ',') AS mask FROM ls")
def _padded(spark, folder):
    p = sq.padded(_sequences(spark, folder, _SIZE), ["etype", "mcc"])
    return p.select("customer_id", *[_text(c).alias(c) for c in ("etype_seq", "mcc_seq", "mask")])


_BUCKETS = 16


@query("customer_frequency_embedding", "M26", sql=f"""WITH t AS (SELECT customer_id, 0 AS f, event_type_nm AS v FROM ev UNION ALL SELECT customer_id, 1, event_desc FROM ev UNION ALL SELECT customer_id, 2, mcc_code_i FROM ev),
    b AS (SELECT customer_id, ((v * 31 + f * 7919) % {_BUCKETS} + {_BUCKETS}) % {_BUCKETS} AS bucket FROM t) SELECT customer_id, """ + ", ".join(f"round(count(*) FILTER (WHERE bucket = {i}) / CAST(count(*) AS DOUBLE), 6) AS emb_{i}" for i in range(_BUCKETS)) + " FROM b GROUP BY 1")
def _frequency(spark, folder):
    v = sq.frequency_vectors(events(spark, folder), ["event_type_nm", "event_desc", "mcc_code_i"], _BUCKETS)
    return v.select("customer_id", *[fixed(F.col("embedding")[i]).alias(f"emb_{i}") for i in range(_BUCKETS)])


@query("customer_token_embedding", "M26")
def _tokens(spark, folder):
    return sq.token_embeddings(_sequences(spark, folder, 500), ["etype", "edesc"], size=16)


# -- pooling ---------------------------------------------------------------------------------------

_POOLED = ("event_desc", "timezone")


def _pool_sql(tag, sizes, use, frame="ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING", shares=True):
    out = []
    for n in sizes:
        over = f"OVER ({{c}} {frame.format(n=n)})"
        count = f"count(CASE WHEN {use} THEN 1 END) {over}"
        out.append(f"{count} / {float(n)} AS {tag}_{n}_share")
        for c in _POOLED:
            mean = f"COALESCE(CAST(sum(CASE WHEN {use} THEN {c} END) {over} AS DOUBLE) / nullif({count}, 0), 0.0)"
            has = f"CASE WHEN {count} > 0 THEN 1.0 ELSE 0.0 END"
            out += [f"round({mean} * {has}, 6) AS {tag}_{n}_{c}_mean", f"round(({c} - {mean}) * {has}, 6) AS {tag}_{n}_{c}_diff", f"round({c} * {mean} * {has}, 6) AS {tag}_{n}_{c}_prod"]
    return ", ".join(out)


def _pool_columns(tag, sizes):
    names = [f"{tag}_{n}_{c}_{k}" for n in sizes for c in _POOLED for k in ("mean", "diff", "prod")]
    return [*[f"{tag}_{n}_share" for n in sizes], *r(*names)]


@query("pooled_past_rows", "W38", sql=f"SELECT event_id, {_pool_sql('past', sq.HISTORY_SIZES, 'true')} FROM ev")
def _pool(spark, folder):
    return sq.pool_past(customers(events(spark, folder)), list(_POOLED)).frame().select("event_id", *_pool_columns("past", sq.HISTORY_SIZES))


@query("pooled_past_telemetry_rows", "W39", sql=f"SELECT event_id, {_pool_sql('telemetry', sq.HISTORY_SIZES, 'operating_system_type <> -1')} FROM ev")
def _pool_telemetry(spark, folder):
    h = sq.pool_past(customers(events(spark, folder)), list(_POOLED), where=F.col("operating_system_type") != -1, tag="telemetry")
    return h.frame().select("event_id", *_pool_columns("telemetry", sq.HISTORY_SIZES))


def _near_sql(tag, sizes, condition):
    """Pooling by a join of each row with its neighbours by position."""
    out = []
    for n in sizes:
        use = f"FILTER (WHERE {condition.format(n=n)})"
        out.append(f"count(*) {use} / {float(n)} AS {tag}_{n}_share")
        for c in _POOLED:
            mean = f"COALESCE(avg(b.{c}) {use}, 0.0)"
            has = f"CASE WHEN count(*) {use} > 0 THEN 1.0 ELSE 0.0 END"
            own = f"any_value(a.{c})"
            out += [f"round({mean} * {has}, 6) AS {tag}_{n}_{c}_mean", f"round(({own} - {mean}) * {has}, 6) AS {tag}_{n}_{c}_diff", f"round({own} * {mean} * {has}, 6) AS {tag}_{n}_{c}_prod"]
    return "WITH p AS (SELECT *, row_number() OVER ({c}) AS pos FROM ev) SELECT a.event_id, " + ", ".join(out) + " FROM p a LEFT JOIN p b ON a.customer_id = b.customer_id AND abs(a.pos - b.pos) <= 30 GROUP BY a.event_id"


@query("pooled_past_session_rows", "W39", sql=_near_sql("session", (3, 10, 30), "b.pos < a.pos AND b.pos >= a.pos - {n} AND a.session_id = b.session_id AND a.session_id > 0"))
def _pool_session(spark, folder):
    return sq.pool_session(customers(events(spark, folder)), list(_POOLED)).frame().select("event_id", *_pool_columns("session", (3, 10, 30)))


@query("pooled_future_rows_looking_ahead", "W40", sql=_near_sql("future", sq.FUTURE_SIZES, "b.pos > a.pos AND b.pos <= a.pos + {n} AND b.sec > a.sec AND b.sec <= a.sec + 86400 AND b.period <> 'pretest'"))
def _pool_future(spark, folder):
    h = sq.pool_future_looking_ahead(customers(events(spark, folder)), list(_POOLED), F.col("period") != "pretest")
    return h.frame().select("event_id", *_pool_columns("future", sq.FUTURE_SIZES))


@query("pooled_past_vectors", "W38", sql="""WITH v AS (SELECT event_id, customer_id, sec, embedding FROM ev JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings))
    SELECT event_id, """ + ", ".join(f"round(avg(CAST(embedding[{i + 1}] AS DOUBLE)) OVER ({{c}} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 5) AS mean_{n}_{i}" for n in (3, 10) for i in range(64)) + " FROM v")
def _pool_vectors(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    n = only_row(vectors.agg(F.count("*").alias("n")))["n"]
    rows = events(spark, folder).select("event_id", "customer_id", "sec", (F.col("event_id") % n).alias("vec_id")).join(vectors, "vec_id")
    h = sq.pool_vectors(customers(rows), "embedding", 64)
    return h.frame().select("event_id", *[fixed(F.col(f"embedding_{n}")[i], 5).alias(f"mean_{n}_{i}") for n in (3, 10) for i in range(64)])


_OK = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) = 64"
_MASKS = {"past": "true", "telemetry": "operating_system_type <> -1", "session": "session_id > 0"}


def _context_sql(mask, n):
    """Pooled components of one mask and size, as whole ten-thousandths in text."""
    part, frame = "customer_id, i", f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"
    if mask == "session":
        part, frame = "customer_id, session_id, i", f"RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING"
    over = f"OVER (PARTITION BY {part} ORDER BY pos {frame})"
    met = f"CASE WHEN {'session_id > 0' if mask == 'session' else 'true'} THEN count(CASE WHEN {mask}_mask THEN x END) {over} ELSE 0 END"
    text = lambda e: f"string_agg(CAST(CAST(floor(({e}) * 10000 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY i)"
    return f"""SELECT event_id, '{mask}' AS mask, {n} AS size, any_value(met) / {float(n)} AS share, {text('m')} AS mean,
      {text('CASE WHEN met > 0 THEN x - m ELSE 0 * x END')} AS diff, {text('CASE WHEN met > 0 THEN x * m ELSE 0 * x END')} AS prod
      FROM (SELECT event_id, i, x, met, CASE WHEN met > 0 THEN s / met ELSE 0.0 END AS m FROM
        (SELECT event_id, i, x, {met} AS met, sum(CASE WHEN {mask}_mask THEN x END) {over} AS s FROM long)) GROUP BY 1"""


@query("pooled_vectors_by_mask", "W38", "W39", sql=f"""WITH v AS (SELECT event_id, customer_id, session_id, embedding, {_OK} AS ok, {", ".join(f"{c} AS {n}_mask" for n, c in _MASKS.items())}, row_number() OVER ({{c}}) AS pos
      FROM ev JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings)),
    long AS (SELECT * EXCLUDE (embedding, ok), CASE WHEN ok THEN CAST(embedding[i] AS DOUBLE) END AS x FROM v, range(1, 65) t(i)) """
       + " UNION ALL ".join(_context_sql(mask, n) for mask in _MASKS for n in sq.HISTORY_SIZES))
def _vector_context(spark, folder):
    """Twelve rows an event: three masks at four sizes, all 64 components of mean, difference and product."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    n = only_row(vectors.agg(F.count("*").alias("n")))["n"]
    rows = events(spark, folder).select("event_id", "customer_id", "sec", "session_id", "operating_system_type", (F.col("event_id") % n).alias("vec_id"))
    masks = {"past": F.lit(True), "telemetry": F.col("operating_system_type") != -1}
    pooled = sq.pool_vector_context(sq.with_vectors(rows, vectors, "vec_id", customers), "embedding", 64, masks).frame()
    whole = lambda c: _text(F.transform(c, lambda v: F.floor(v * 10000 + 0.5)))
    each = F.array(*[
        F.struct(F.lit(mask).alias("mask"), F.lit(size).alias("size"), F.col(f"{mask}_{size}_share").alias("share"),
                 *[whole(f"embedding_{mask}_{size}_{k}").alias(k) for k in ("mean", "diff", "prod")])
        for mask in _MASKS for size in sq.HISTORY_SIZES])
    return pooled.select("event_id", F.inline(each))


@query("sequence_segments", "W41", sql="""WITH p AS (SELECT customer_id, sec, period, row_number() OVER ({c}) - 1 AS pos, count(*) OVER (PARTITION BY customer_id) AS total FROM ev),
    b AS (SELECT customer_id, CAST(floor(pos / 256.0) AS BIGINT) AS block, min(pos) AS start, max(pos) + 1 AS stop, max(sec) AS last, any_value(total) AS total, bool_or(period = 'train') AS wanted FROM p GROUP BY 1, 2)
    SELECT customer_id, block, greatest(start - 128, 0) AS context_start, start, stop AS "end",
      greatest(least(stop + 30, (SELECT count(*) FROM p WHERE p.customer_id = b.customer_id AND p.sec <= b.last + 86400), total), stop) AS context_end FROM b WHERE wanted""")
def _segments(spark, folder):
    return sq.segments(events(spark, folder), ORDER, F.col("period") == "train")


# -- sources and sinks -----------------------------------------------------------------------------------


def _shared_folder(spark):
    ensure_checkpoint_folder(spark)
    return remove_at_exit(spark, f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}")


@query("parquet_scan_of_columns", "SRC1", "SRC2", sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _scan(spark, folder):
    return tables.read_columns(spark, f"{folder}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])


@query("written_parts_merged", "SNK1", "SNK2", "SRC2", sql="SELECT event_id, cents, CASE WHEN event_id % 3 = 0 THEN timezone END AS timezone FROM ev")
def _merged(spark, folder):
    base, rows = _shared_folder(spark), events(spark, folder)
    for k in range(3):
        part = rows.filter(F.col("event_id") % 3 == k).select("event_id", "customer_id", "sec", "cents", *(["timezone"] if k == 0 else []))
        sinks.write_parquet(part, f"{base}/part_{k}", sort_within=["customer_id", "sec", "event_id"])
    sinks.merge_parts(spark, [f"{base}/part_{k}" for k in range(3)], f"{base}/all")
    return spark.read.parquet(f"{base}/all").select("event_id", "cents", "timezone")


@query("train_and_test_split_tables", "SNK3", sql="SELECT event_id, period AS split FROM ev WHERE period IN ('train', 'test')")
def _split_tables(spark, folder):
    path = f"{_shared_folder(spark)}/split"
    rows = events(spark, folder).select("event_id", (F.col("period") == "train").alias("is_train_sample"), (F.col("period") == "test").alias("is_test"))
    sinks.write_split(rows, path)
    return spark.read.parquet(path).select("event_id", "split")


@query("score_files_written_and_read", "SNK4", "SNK5", "SRC6", sql="SELECT event_id, (event_id % 97) / 97.0 AS predict FROM ev WHERE period = 'test'")
def _score_files(spark, folder):
    base = _shared_folder(spark)
    scores = events(spark, folder).filter("period = 'test'").select("event_id", ((F.col("event_id") % 97) / 97.0).alias("predict"))
    sinks.write_scores(scores, f"{base}/csv", f"{base}/parquet")
    return tables.read_scores(spark, f"{base}/csv")


@query("score_file_in_template_order", "SNK4", "J12", sql="""WITH t AS (SELECT event_id, row_number() OVER (ORDER BY sec DESC, event_id) - 1 AS position FROM ev WHERE period = 'test'),
    s AS (SELECT event_id, (event_id % 97) / 97.0 AS predict FROM t WHERE event_id % 7 <> 0)
    SELECT position, event_id, round(COALESCE(predict, (SELECT quantile_cont(predict, 0.5) FROM s)), 9) AS predict FROM t LEFT JOIN s USING (event_id)""")
def _template_order(spark, folder):
    from backtrail.operators.history import History, Past
    from backtrail.operators.joins import fill_template

    test = events(spark, folder).filter("period = 'test'").select("event_id", (-F.col("sec")).alias("_back"))
    template = History.of(test, [], ["_back", "event_id"]).past(position=Past.count()).frame().drop("_back")
    scores = test.filter("event_id % 7 <> 0").select("event_id", ((F.col("event_id") % 97) / 97.0).alias("predict"))
    path = f"{_shared_folder(spark)}/ordered"
    sinks.write_in_order(fill_template(template, scores).join(template, "event_id"), path)
    written = spark.read.schema("position bigint, event_id bigint, predict double").option("header", True).csv(path)
    return written.select("position", "event_id", *r("predict", digits=9))


@query("artefact_built_once", "SNK6", sql="SELECT customer_id, count(*) AS n FROM ev GROUP BY 1")
def _artefact(spark, folder):
    path = f"{_shared_folder(spark)}/counts"
    build = lambda: events(spark, folder).groupBy("customer_id").agg(F.count("*").alias("n"))
    sinks.materialize(spark, path, build)

    def unexpected():
        raise RuntimeError("the finished table must be reused")

    return sinks.materialize(spark, path, unexpected)


@query("metrics_as_json", "SNK7", sql="SELECT count(*) AS n_rows, CAST(sum(is_red) AS BIGINT) AS red FROM lv")
def _json(spark, folder):
    path = f"{_shared_folder(spark)}/metrics"
    sinks.write_json(labelled(spark, folder).agg(F.count("*").alias("n_rows"), F.sum("is_red_lbl").alias("red")), path)
    return spark.read.schema("n_rows bigint, red bigint").json(path)


@query("dataset_overview", "SNK8", sql="""SELECT b.period, count(*) AS n, count(*) FILTER (WHERE target = 1) AS red, count(*) FILTER (WHERE target = 0) AS yellow, count(*) FILTER (WHERE target IS NULL AND b.period = 'train') AS green,
    round(avg(CASE WHEN operating_system_type IS NOT NULL OR session_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS telemetry_rate, round(avg(CASE WHEN session_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS session_present_rate
    FROM bank_events b LEFT JOIN bank_labels l USING (event_id) GROUP BY 1""")
def _overview(spark, folder):
    from backtrail.operators.lookups import lookup
    from backtrail.operators.quality import dataset_overview

    rows = lookup(bank_events(spark, folder), bank_labels(spark, folder).select("event_id", "target"), "event_id")
    rows = rows.withColumn("telemetry", F.col("operating_system_type").isNotNull() | F.col("session_id").isNotNull())
    return dataset_overview(rows, "period", "telemetry").select("period", "n", "red", "yellow", "green", *r("telemetry_rate", "session_present_rate", digits=9))
