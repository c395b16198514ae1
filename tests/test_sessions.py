"""Sessions played side by side against one session at a time."""

import numpy as np
import pytest

from calibron.operators import sessions as X


@pytest.mark.parametrize(("selector", "se_target"), [("max_info", 0.45), ("max_info", None), ("random", None)])
def test_sessions_side_by_side_equal_a_plain_loop(selector, se_target):
    rng = np.random.default_rng(4)
    n_cells = np.array([0, 3, 40, 25, 40, 40])
    a, b, y = rng.integers(2, 9, (6, 40)) / 4, rng.normal(0, 1, (6, 40)), rng.integers(0, 2, (6, 40)).astype(float)
    names = [f"run:{k}" for k in range(6)]
    length, place, theta, se = X.play(names, n_cells, (a, b, y), selector, 5, 30, se_target)
    for s in range(6):
        items, done, t, e = np.arange(n_cells[s]), [], 0.0, 1.0
        while True:
            if done:
                t, e = X.ability(a[s, done], b[s, done], y[s, done], start=t)
            assert (theta[s, len(done)], se[s, len(done)]) == pytest.approx((t, e), abs=1e-12)
            if len(done) >= min(30, len(items)) or (se_target is not None and len(done) >= 5 and e < se_target):
                break
            left = np.setdiff1d(items, done)
            done.append(int(left[X.pick(selector, t, left, a[s, left], b[s, left], names[s], len(done))]))
        assert length[s] == len(done) and place[s, : len(done)].tolist() == done
    assert se_target is None or length.max() < 30


def test_a_model_without_answers_ends_at_once(spark):
    rows = [("m", 1, 1.0, 0.0, None), ("n", 1, 1.0, 0.0, 1), (None, 2, 1.0, 0.5, 0)]
    got = X.sessions(spark.createDataFrame(rows, "model string, item_idx int, a double, b double, y int")).collect()
    assert sorted((r.session_id, r.step, r.type, r.correct) for r in got if r.type != "item_selected") == [("run:None", 0, "answer_recorded", 0), ("run:None", 1, "finished", None), ("run:m", 0, "finished", None), ("run:n", 0, "answer_recorded", 1), ("run:n", 1, "finished", None)]
