"""The fit of quality scores against a plain one whose slopes are finite differences of the risk."""

import numpy as np
import pytest

from backtrail.llm import quality

SIZE = len(quality.FEATURES)


def _rows(seed):
    """Two overlapping clouds; a third of the first one is trusted."""
    draw = np.random.default_rng(seed)
    good = draw.random(90) < 0.5
    x = draw.normal(size=(90, SIZE)).astype(np.float32) + np.where(good, 1.5, -1.5)[:, None].astype(np.float32) * (np.arange(SIZE) < 4)
    return x.astype(np.float32), good & (draw.random(90) < 0.4)


def _plain(x, positive, prior, steps, rate=0.4, decay=1e-3):
    """(weights, how often the negative part was clipped): the same steps, slopes by central differences."""
    x = x.astype(float)
    z = quality.expanded(x, x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6)))

    def parts(w):
        f = z @ w
        positives = prior * np.log1p(np.exp(-f[positive])).mean()
        negatives = np.log1p(np.exp(f)).mean() - prior * np.log1p(np.exp(f[positive])).mean()
        return positives, negatives, decay / 2 * (w[:-1] ** 2).sum()

    def risk(w):
        positives, negatives, penalty = parts(w)
        return positives + max(0.0, negatives) + penalty

    w = np.zeros(2 * SIZE + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second, clipped = np.zeros_like(w), np.zeros_like(w), 0
    for step in range(1, steps + 1):
        clipped += parts(w)[1] <= 0
        slope = np.array([(risk(w + 1e-5 * e) - risk(w - 1e-5 * e)) / 2e-5 for e in np.eye(len(w))])
        first, second = 0.8 * first + 0.2 * slope, 0.95 * second + 0.05 * slope**2
        move = first / (1 - 0.8**step) / (np.sqrt(second / (1 - 0.95**step)) + 1e-6)
        w = w - rate * (1 - step / (steps + 1)) * move
    return w, clipped


@pytest.mark.parametrize("prior, steps, clips", [(0.05, 4, False), (0.9, 12, True)])
def test_fit_follows_the_slope_of_the_risk(spark, prior, steps, clips):
    x, positive = _rows(1)
    table = spark.createDataFrame([(r.tolist(), bool(p)) for r, p in zip(x, positive)], "x array<float>, positive boolean")
    want, clipped = _plain(x, positive, prior, steps)
    assert (clipped > 0) == clips
    got = quality.fit(table, prior, steps=steps)
    assert got.weights == pytest.approx(want, abs=2e-3)


def test_repeated_rows_weigh_the_same(spark):
    x, positive = _rows(2)
    rows = [(r.tolist(), bool(p)) for r, p in zip(x, positive)]
    once, twice = (quality.fit(spark.createDataFrame(rows * k, "x array<float>, positive boolean"), 0.4, steps=5) for k in (1, 2))
    assert once.weights == pytest.approx(twice.weights, abs=1e-6)
