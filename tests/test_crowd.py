"""Sums over crowds of scores against plain sums over pairs."""

import math

import numpy as np
import pytest

from calibron.operators import ranking
from calibron.operators.crowd import normal_cdf, wrong_order_sums

erfc = np.vectorize(math.erfc)


@pytest.mark.parametrize("zone", [0.0, 0.02])
@pytest.mark.parametrize("least", [1e-12, 1e-4, 9e-3])
def test_crowd_sums_equal_sums_over_pairs(least, zone):
    rng = np.random.default_rng(3)
    s, v = rng.uniform(0, 1, 800), np.exp(rng.uniform(math.log(least), math.log(1e-2), 800))
    s[:40] = 0.5
    x, var = np.r_[rng.uniform(-0.2, 1.2, 160), s[:60]], np.exp(rng.uniform(math.log(least), math.log(1e-2), 220))
    want = (0.5 * erfc((abs(x[:, None] - s) + zone) / np.sqrt(2 * (var[:, None] + v)))).sum(axis=1)
    assert wrong_order_sums(x, var, s, v, zone) == pytest.approx(want, abs=1e-11)
    assert not wrong_order_sums(x, var, s[:0], v[:0]).any()
    z = np.linspace(-8.9, 8.9, 999)
    assert normal_cdf(z) == pytest.approx(0.5 * erfc(-z / math.sqrt(2)), abs=1e-15)


def test_gains_of_many_models_meet_no_pairs(spark, monkeypatch):
    """30,000 models in several blocks and crowds: 2 * 10**10 chances one by one, which no test could wait for."""
    rng = np.random.default_rng(4)
    n = 30_000
    rows = [(f"m{k}", float(s), float(v), k, float(v * 0.8), 9) for k, (s, v) in enumerate(zip(rng.normal(0.5, 0.1, n), rng.uniform(2e-4, 1e-3, n), strict=True))]
    table = spark.createDataFrame(rows, "model string, s double, v double, item_idx long, v_new double, n_open long")
    monkeypatch.setattr(ranking, "CROWD", 6)
    got = {r.model: r.gain for r in ranking.call_gains(table, 0.0, (1,)).collect()}
    assert len(got) == n
    s, v = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for k in (0, 17, n - 1):
        rest = np.arange(n) != k
        later = np.full((n - 1, 1), 0.8 * v[k])
        fall = ranking.expected_fall(s[k] - s[rest], np.full(n - 1, v[k]), v[rest], later).sum()
        assert got[f"m{k}"] == pytest.approx(fall, abs=1e-9)
