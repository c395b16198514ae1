"""The passes over packed answers against the fit of plain tables, and how many passes a fit takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibron.operators import fitting, lbfgs
from calibron.plans import catalogue


def test_held_out_scores_equal_the_loss_of_plain_tables(spark):
    rng = np.random.default_rng(6)
    cells = spark.createDataFrame([(r, f"m{m}", i, int(rng.random() < 0.6), bool((m + i + r) % 3 == 0)) for r in range(2) for m in range(9) for i in range(12)], "run int, model string, item_idx int, y int, held boolean")
    same = cells.where("run = 0").select("model", "item_idx", "y").join(cells.select("run", "model", "item_idx", "held"), ["model", "item_idx"])
    features = spark.createDataFrame([(r, i, i % 2, i % (1 + r), [1.0, i / 12]) for r in range(2) for i in range(12)], "run int, item_idx int, grp int, dim int, x array<double>")
    items, theta, _ = fitting.fit_explanatory(same.where("not held"), features, 2, 2, rounds=4)
    want = sorted(map(tuple, fitting.held_out_loss(same.where("held"), items, theta).collect()))
    bits = same.groupBy("model", "item_idx").agg(F.max("y").alias("y"), F.sum(F.when(F.col("held"), F.expr("shiftleft(1L, run)")).otherwise(F.lit(0))).alias("held"))
    packed = fitting.packed_answers(bits, held=F.col("held"), runs=3 - F.col("held"))
    _, solved, final, _ = fitting.explain(packed, features, 2, 2, rounds=4)
    got = sorted(map(tuple, fitting.held_out_scores(packed, solved, final).collect()))
    assert [(r, n) for r, n, *_ in got] == [(r, n) for r, n, *_ in want]
    assert np.array(got) == pytest.approx(np.array(want), rel=1e-9)


def test_small_and_partitioned_minimisation_agree(spark):
    h = np.array([1.0, 4.0, 9.0])
    x, trace = lbfgs.minimise_small(np.zeros(3), h, lambda x: (float((h * (x - 1) ** 2 / 2 + (x - 1) ** 4).sum()), h * (x - 1) + 4 * (x - 1) ** 3))
    assert trace.converged and x == pytest.approx(np.ones(3), abs=1e-4)
    assert all(b <= a for a, b in zip(trace.objective, trace.objective[1:], strict=False))


def test_2pl_query_ends_and_covers_every_answered_item(spark, sf_dir):
    rows = catalogue.queries()["m4_fit_2pl"](spark, sf_dir).collect()
    assert len(rows) == len({r.item_idx for r in rows}) > 0
