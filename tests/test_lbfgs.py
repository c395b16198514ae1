"""The distributed optimiser against numpy, and the fits by their gradients."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibron.operators import lbfgs


def test_direction_is_the_two_loop_recursion():
    rng = np.random.default_rng(0)
    h = np.diag(rng.uniform(0.5, 4, 7))
    s = rng.normal(size=(3, 7))
    y, g = s @ h, rng.normal(size=7)
    q, alpha = g.copy(), []
    for a, b in zip(s[::-1], y[::-1], strict=True):
        alpha.append(a @ q / (a @ b))
        q -= alpha[-1] * b
    q *= s[-1] @ y[-1] / (y[-1] @ y[-1])
    for a, b, al in zip(s, y, alpha[::-1], strict=True):
        q += a * (al - b @ q / (a @ b))
    basis = np.vstack((s, y, g))
    assert lbfgs.direction(basis @ basis.T, 3) @ basis == pytest.approx(-q)


def test_two_runs_find_their_minima(spark):
    """Separable objectives cosh(x - key) * scale of the run; the second run starts at its minimum."""
    start = spark.createDataFrame([(0, k, 3.0, 1.0 + k) for k in range(5)] + [(1, k, float(k), 2.0) for k in range(3)], "run int, key long, x double, h double")

    def evaluate(points):
        z = (F.col("x") - F.col("key")) * (1 + F.col("key"))
        parts = F.array(F.struct(F.col("key").alias("key"), ((1 + F.col("key")) * F.sinh(z)).alias("g")), F.struct(F.lit(None).cast("long").alias("key"), F.cosh(z).alias("g")))
        return points.select("run", F.explode(parts).alias("p")).select("run", "p.key", "p.g")

    points, trace = lbfgs.minimise(start, evaluate, tol=1e-6)
    assert all(abs(r.x - r.key) < 1e-6 for r in points.collect())
    assert trace[0].converged and trace[1].converged and trace[1].rounds == 0
    assert all(b <= a for a, b in zip(trace[0].objective, trace[0].objective[1:], strict=False)) and trace[0].objective[-1] == pytest.approx(5)
