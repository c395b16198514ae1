"""Items with general loadings against numpy's full matrices."""

import numpy as np
import pytest

from calibron.operators import loadings, ranking


def dense(load, b, w, answered):
    n, dims = load.shape
    at = sorted(answered)
    y = np.array([answered[i] for i in at], float)
    theta = np.zeros(dims)
    for _ in range(80):
        p = 1 / (1 + np.exp(-(load[at] @ theta - b[at])))
        theta = theta + np.linalg.solve(np.eye(dims) + (load[at] * (p * (1 - p))[:, None]).T @ load[at], load[at].T @ (y - p) - theta)
    p = 1 / (1 + np.exp(-(load @ theta - b)))
    q = p * (1 - p)
    info = np.eye(dims) + (load[at] * q[at][:, None]).T @ load[at]
    un = np.ones(n, bool)
    un[at] = False

    def variance(mask, cov):
        g = (w * q)[mask] @ load[mask]
        return g @ cov @ g + (w[mask] ** 2 * q[mask]).sum()

    after = {}
    for i in np.flatnonzero(un):
        mask = un.copy()
        mask[i] = False
        after[int(i)] = variance(mask, np.linalg.inv(info + q[i] * np.outer(load[i], load[i])))
    return theta, np.linalg.inv(info), sum(w[i] * v for i, v in answered.items()) + (w[un] * p[un]).sum(), variance(un, np.linalg.inv(info)), after


@pytest.mark.parametrize("dims", [1, 3])
def test_random_loadings_equal_full_matrices(spark, dims):
    rng = np.random.default_rng(dims)
    n = 24
    load, b, w = rng.normal(0.4, 0.7, (n, dims)), rng.normal(size=n), rng.random(n) / n
    bank = spark.createDataFrame([(k, load[k].tolist(), float(b[k]), float(w[k])) for k in range(n)], "item_idx int, loadings array<double>, b double, w double")
    answered = {f"m{m}": {int(i): int(rng.random() < 0.5) for i in rng.choice(n, 2 + 5 * m, replace=False)} for m in range(4)}
    answers = spark.createDataFrame([(m, i, y) for m, d in answered.items() for i, y in d.items()], "model string, item_idx int, y int").join(bank.drop("w"), "item_idx")
    post = {r.model: r for r in loadings.posteriors(answers, dims).collect()}
    rows = loadings.pooled(bank, answers, dims)
    got = {r.model: (r.s, r.v) for r in loadings.scores(rows, dims).collect()}
    after = {(r.model, r.item_idx): r.v_new for r in loadings.variances_after(rows, dims).collect()}
    for m, d in answered.items():
        theta, cov, s, v, vs = dense(load, b, w, d)
        assert post[m].theta == pytest.approx(theta.tolist(), abs=1e-7)
        assert post[m].cov == pytest.approx([cov[i, j] for i in range(dims) for j in range(i + 1)], rel=1e-7, abs=1e-9)
        assert got[m] == pytest.approx((s, v), rel=1e-7)
        assert {i: x for (k, i), x in after.items() if k == m} == pytest.approx(vs, rel=1e-7)


def test_one_hot_loadings_are_the_closed_form(spark, sf_dir):
    from pyspark.sql import functions as F

    from calibron.sources.domain import Domain

    d = Domain(spark, sf_dir)
    bank = ranking.family_weights(d.items.select("item_idx", "a", "b", "dim"))
    answers = d.responses.where("item_idx % 5 = 0").select("model", "item_idx", "dim", "a", "b", "y")
    one_hot = F.array(*(F.when(F.col("dim") == k, F.col("a")).otherwise(0.0) for k in (0, 1)))
    rows = loadings.pooled(bank.withColumn("loadings", one_hot), answers.withColumn("loadings", one_hot), 2)
    flat = ranking.pool_rows(answers, bank, answers)
    close = lambda a, b: a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-7) for k in a)
    by = lambda df, *keys: {tuple(r[k] for k in keys): r[df.columns[-1]] for r in df.collect()}
    assert close(by(loadings.scores(rows, 2), "model"), by(ranking.scores(flat), "model"))
    assert close(by(loadings.variances_after(rows, 2), "model", "item_idx"), by(ranking.variances_after(flat), "model", "item_idx"))


def test_dimensions_are_bounded(spark):
    with pytest.raises(ValueError):
        loadings.posteriors(spark.createDataFrame([], "model string, loadings array<double>, b double, y int"), 7)
