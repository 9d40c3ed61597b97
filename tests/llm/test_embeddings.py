"""Embedding near-duplicates against a comparison of all vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from backtrail.llm import embeddings


def plain(rows, threshold=0.93):
    """vec_id -> (n_links, component); rows: (vec_id, vector, label), each vec_id once."""
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links = {i: set() for i, _, _ in rows}
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if ok(v) and lab is not None]
    for i, v, a in good:
        for j, w, b in good:
            if i != j and a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[i].add(j)
    out = {}
    for i in sorted(links):
        todo, seen = [i], {i}
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(links[i]), min(seen))
    return out


def clustered(dimensions=8, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for centre in rng.normal(size=(12, dimensions)):
        for _ in range(25):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.normal(size=dimensions) * rng.choice([0.1, 0.3, 0.6])], int(rng.integers(0, 2))))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(40)]
    return rows


@pytest.mark.parametrize(("cells", "block"), [(1, 1024), (6, 1024), (20, 10), (None, 1024)])
def test_equals_comparing_all(spark, monkeypatch, cells, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = clustered()
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), cells=cells).collect()
    want = plain(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert max(n for n, _ in want.values()) > 40


def test_corner_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1e-200, 1e-202], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1),
        (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0, 0.01], 1), (12, [], 1), (13, [1.0, 0.0], 2), (14, [1e300, 1e300], 1), (15, [-1.0, 0.0], 1),
    ]
    kind = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows + rows[:3] + [(None, [1.0, 0.0], 1), (None, None, 1)], kind).withColumn("class", F.lit("x")).withColumn("n_links", F.lit(1))
    got = embeddings.near_duplicates(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == plain(rows)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)] * 2
    assert len(got) == len(rows) + 2
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1), (5, [1.0, 0.1], 1), (5, [0.0, 1.0], 1), (7, [0.1, 1.0], 1)], kind)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(twice).collect()) == [(1, 1, 1), (5, 2, 1), (7, 1, 1)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
