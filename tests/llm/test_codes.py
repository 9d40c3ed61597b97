"""Vector codes against plain Lloyd's rounds that compare every part with every entry in Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from backtrail.llm import codes

KIND = "vec_id long, embedding array<double>, label int"


def plain(rows, parts, entries, rounds, scale=256):
    """(vec_id -> (codes, error)), codebooks; rows: (vec_id, vector, label), ids once."""
    kept = {i: [math.floor(scale * x) for x in v] for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    width = len(next(iter(kept.values()))) // parts
    cut = {i: [q[p * width : (p + 1) * width] for p in range(parts)] for i, q in kept.items()}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, book: min((far(v, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        fresh = [list(b) for b in books]
        for p in range(parts):
            homes = {}
            for v in cut.values():
                homes.setdefault(best(v[p], books[p])[1], []).append(v[p])
            for e, members in homes.items():
                fresh[p][e] = [sum(xs) // len(members) for xs in zip(*members)]
        books = fresh
    found = {i: [best(v[p], books[p]) for p in range(parts)] for i, v in cut.items()}
    return {i: ([e for _, e in f], sum(d for d, _ in f)) for i, f in found.items()}, books


def vectors(n=150, dimensions=12, seed=4, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dimensions))
    return [(7 * i % 1009, [float(x) for x in centres[i % 9] + rng.normal(size=dimensions) * spread], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize(("parts", "entries", "rounds", "spread"), [(4, 8, 2, 0.02), (3, 20, 5, 0.5), (12, 4, 3, 0.0), (4, 500, 2, 0.3), (4, 8, 0, 0.02)])
def test_equals_plain_rounds(spark, parts, entries, rounds, spread):
    rows = vectors(spread=spread)
    got, books = codes.compressed(spark.createDataFrame(rows, KIND).repartition(5), parts=parts, entries=entries, rounds=rounds)
    got = got.collect()
    want, want_books = plain(rows, parts, entries, rounds)
    assert {r.vec_id: (r.codes, r.error) for r in got} == want and len(got) == len(rows)
    assert books.tolist() == want_books
    sums = {}
    for i, _, lab in rows:
        sums[lab] = sums.get(lab, 0) + want[i][1]
    assert all(r.label_error == sums[r.label] for r in got)


@pytest.mark.parametrize("big", [1, 1 << 25])
def test_active_entries_give_what_a_full_scan_gives(big):
    """Few distinct small numbers make many ties; large ones take the way of whole numbers."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        x, book = rng.integers(-3, 4, (40, 3)) * big, rng.integers(-3, 4, (9, 3)) * big
        code, dist = codes.nearest(x, book)
        after = book.copy()
        some = rng.random(9) < 0.4
        after[some] += rng.integers(-1, 2, (int(some.sum()), 3)) * big
        moved = (after != book).any(axis=1)
        want = [min((int(((v - c) ** 2).sum()), e) for e, c in enumerate(after)) for v in x]
        got = codes.reassigned(x, after, moved, code, dist)
        assert list(zip(got[1].tolist(), got[0].tolist())) == want


def test_only_moved_entries_are_compared_where_the_own_one_stayed(monkeypatch):
    seen = []
    real = codes.distances
    monkeypatch.setattr(codes, "distances", lambda x, book: seen.append((len(x), len(book))) or real(x, book))
    x, book = np.arange(20)[:, None] * 10, np.arange(20)[:, None] * 10
    moved = np.zeros(20, bool)
    moved[3] = True
    book = book.copy()
    book[3] = 31
    codes.reassigned(x, book, moved, np.arange(20), np.zeros(20, np.int64))
    assert seen == [(1, 20), (19, 1)]


def test_corner_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [i / 10, -i / 7, 0.5, 0.0], None if i % 3 else 1) for i in range(1, 9)]
    bad = [(-1, None, 1), (-2, [1.0, None, 1.0, 1.0], 1), (-3, [nan] * 4, 1), (-4, [inf] * 4, 2), (90, [1.0, 2.0], 1), (91, [], 1), (92, [1.0] * 3, 1)]
    df = spark.createDataFrame(good + bad, KIND).withColumn("_q", F.lit("x")).withColumn("error", F.lit(1))
    got = codes.compressed(df, parts=2, entries=4)[0].collect()
    want, _ = plain(good, 2, 4, 2)
    assert {r.vec_id: (r.codes, r.error) for r in got} == want
    for lab in (None, 1):
        assert {r.label_error for r in got if r.label == lab} == {sum(want[i][1] for i, _, l in good if l == lab)}
    # repeated rows weigh as often as they come, a null id comes last
    twice = codes.compressed(spark.createDataFrame(good + good + [(None, [9.0] * 4, 5)] * 2, KIND), parts=2, entries=4)[0].collect()
    assert len(twice) == 18 and sum(r.vec_id is None for r in twice) == 2
    assert len({(r.vec_id, tuple(r.codes), r.error) for r in twice}) == 9
    only, books = codes.compressed(spark.createDataFrame([(None, [1.0, 2.0], 1)], KIND), parts=2, entries=4)
    assert [(r.codes, r.error) for r in only.collect()] == [([0, 0], 0)] and books.tolist() == [[[256]], [[512]]]
    none, books = codes.compressed(df.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "label", "codes", "error", "label_error"] and books.size == 0


def test_numbers_beyond_the_bound_count_as_the_bound(spark):
    rows = [(1, [1e300, 0.0], 1), (2, [-1e300, 0.0], 1), (3, [5e200, 0.0], 1)]
    got, books = codes.compressed(spark.createDataFrame(rows, KIND), parts=2, entries=2)
    most = math.isqrt((1 << 60) // 2)
    assert books[0].tolist() == [[most], [-most]]
    assert {r.vec_id: (r.codes, r.error) for r in got.collect()} == {1: ([0, 0], 0), 2: ([1, 0], 0), 3: ([0, 0], 0)}
