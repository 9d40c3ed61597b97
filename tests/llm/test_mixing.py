"""Mixing: posteriors and rates against plain counts and a plain solver."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from backtrail.llm import mixing
from backtrail.llm.common import read
from backtrail.llm.queries import DOMAIN_WEIGHTS, label_domains

FOLDER = "/root/testdata/sf0.01"


def plain_posteriors(spark, texts, labels, smooth=0.5):
    every = sorted({w for t in texts.values() for w in split(t)})
    places = dict(zip(every, [r.p for r in spark.createDataFrame([(w,) for w in every], "w string").select(F.expr(f"pmod(xxhash64(w), {mixing.PLACES})").alias("p")).collect()]))
    names = sorted(set(labels.values()))
    counts = {d: Counter(places[w] for i, x in labels.items() if x == d for w in split(texts[i])) for d in names}
    seen = set().union(*counts.values())
    out = {}
    for i, t in texts.items():
        own = [places[w] for w in split(t)]
        logs = []
        for d in names:
            total = sum(counts[d].values()) + smooth * mixing.PLACES
            prior = sum(x == d for x in labels.values()) / len(labels)
            logs.append(np.log(prior) + sum(np.log((counts[d][p] + smooth) / total) for p in own if p in seen) / np.sqrt(max(1, len(own))))
        e = np.exp(np.array(logs) - max(logs))
        out[i] = (len(own), e / e.sum())
    return names, out


def split(text):
    return [w for w in (text or "").lower().translate(str.maketrans("\n\t\r", "   ")).split(" ") if w]


def test_posteriors_and_targets(spark):
    docs, labels = read(spark, FOLDER, "documents"), label_domains(read(spark, FOLDER, "labels"))
    mixed, names = mixing.mix(docs, labels, DOMAIN_WEIGHTS)
    rows = mixed.collect()
    want_names, want = plain_posteriors(spark, {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.domain for r in labels.collect()})
    assert names == want_names and len(rows) == len(want)
    for r in rows:
        assert r.tokens == want[r.doc_id][0] and np.allclose(r.posterior, want[r.doc_id][1], atol=1e-6) and r.rate >= 0
    totals = {r.domain: r.expected for r in mixing.totals(mixed, names).collect()}
    share = np.array([DOMAIN_WEIGHTS[n] for n in names])
    target = share / share.sum() * sum(r.tokens for r in rows)
    assert np.allclose([totals[n] for n in names], target, rtol=1e-4)


def test_rates_reach_the_least_squares(spark):
    """Targets out of reach: the weighted residual comes near what 20,000 plain steps reach."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.5, 1.0, 2.0], 40)
    t = rng.integers(1, 90, 40).astype(float)
    table = spark.createDataFrame([(i, 1, float(n), *map(float, q)) for i, (n, q) in enumerate(zip(t, p))], "i int, n_rows int, tokens double, p0 double, p1 double, p2 double")
    target = np.array([1200.0, 100.0, 10.0])
    inverse = np.linalg.inv((p * t[:, None]).T @ p)
    cost = lambda r: ((r * t) @ p - target) @ inverse @ ((r * t) @ p - target)
    best = np.ones(40)
    for _ in range(20_000):
        best = np.maximum(0, best - p @ inverse @ ((best * t) @ p - target))
    got = np.array([x.rate for x in mixing.with_rates(table, target, close=1e-9).orderBy("i").collect()])
    assert (got >= 0).all() and cost(best) * 0.999 <= cost(got) <= cost(best) * 1.02


def test_corner_rows(spark):
    rows = [(i, f"good plain words {i}") for i in range(20)] + [(30 + i, "bad noise spam") for i in range(5)]
    rows += [(50, None), (51, ""), (None, "good plain"), (3, "good plain words 3"), (52, "spam " * 300_000), (52, "good")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rate", F.lit("x")).withColumn("place", F.lit(1))
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (31, "b"), (None, "b"), (4, None), (32, "b"), (32, "c")], "doc_id long, domain string")
    mixed, names = mixing.mix(docs, labels, {"a": 1.0, "b": 1.0})
    got = mixed.collect()
    assert names == ["a", "b"] and len(got) == len(rows) - 1 and sum(r.n_rows for r in got) == len(rows)
    assert all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 for r in got)
    assert {r.tokens for r in got if r.doc_id in (50, 51)} == {0.0}
    up = mixing.lifted(docs, labels, {"a": 0.9})
    assert all(r.rate >= 1 for r in up.collect())
    copies = mixing.sampled_copies(docs, up)
    assert copies.columns == docs.columns and copies.count() >= len(rows)
    alone, names = mixing.mix(docs, labels.limit(0), {"a": 1.0})
    assert names == ["all"] and all(abs(r.rate - 1) < 1e-9 for r in alone.collect())
    assert mixing.mix(docs.limit(0), labels, {"a": 1.0})[0].count() == 0
    with pytest.raises(ValueError, match="no weight"):
        mixing.mix(docs, labels, {"z": 1.0})


def test_growth_is_bounded(spark):
    """A domain with nearly all tokens and a small weight: the total stops at the bound, every row stays."""
    rows = [(i, "plain words here" if i % 50 else "odd noise there") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "b" if i % 50 == 0 else "a") for i in range(500)], "doc_id long, domain string")
    mixed, names = mixing.raised(docs, labels, {"a": 0.02, "b": 0.98}, most_growth=3.0)
    found = {r.domain: (r.tokens, r.expected) for r in mixing.totals(mixed, names).collect()}
    assert sum(e for _, e in found.values()) <= 1.25 * (3.0 * 0.98 * 1500 + found["a"][0])
    assert min(r.rate for r in mixed.collect()) >= 1
    assert mixing.raised(docs.limit(0), labels, {"a": 1.0})[0].count() == 0


def test_rates_that_do_not_settle_are_an_error(spark):
    table = spark.createDataFrame([(1, 5.0, 0.9, 0.1), (1, 5.0, 0.2, 0.8)], "n_rows int, tokens double, p0 double, p1 double")
    with pytest.raises(RuntimeError, match="settle"):
        mixing.with_rates(table, np.array([100.0, 0.0]), most_steps=1)
