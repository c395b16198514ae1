"""The allocator with calls in flight: decisions by brute force, and the limits that hold at all times."""

import numpy as np
import pandas as pd
import pytest

from calibron.operators import experiments as X
from calibron.operators.allocator import MOST_CALLS, NO_GAIN, OVER_BUDGET, SETTLED, TOO_FEW, Policy, concurrent_runs
from calibron.operators.ranking import LOOKAHEAD, expected_fall, wrong_order

MODELS, ITEMS = 5, 24
OF = ["east", "west", "east", "north", "east"]
WINDOW = {"east": 2, "west": 1, "north": 1}


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(11)
    a, b, dim = rng.lognormal(0, 0.35, ITEMS), rng.normal(0, 1, ITEMS), rng.integers(0, 2, ITEMS)
    theta = rng.normal(0, 1, MODELS)
    y = (rng.random((MODELS, ITEMS)) < 1 / (1 + np.exp(-(a * theta[:, None] - b)))).astype(float)
    y[1, 3] = y[4, 7] = np.nan
    took, cost = rng.integers(1, 9, y.shape) / 4, rng.integers(1, 9, y.shape) / 1000
    return a, b, dim, y, took, cost


def cells_of(spark, world):
    a, b, dim, y, took, cost = world
    rows = [(0, m, OF[m], i, float(a[i]), float(b[i]), int(dim[i]), int(y[m, i]), float(took[m, i]), float(cost[m, i])) for m in range(MODELS) for i in range(ITEMS) if not np.isnan(y[m, i])]
    return spark.createDataFrame(rows, "board long, model_idx long, provider string, item_idx long, a double, b double, dim int, y int, took double, cost double")


def played(spark, world, policy) -> pd.DataFrame:
    limits = spark.createDataFrame([(p, n, 0.004) for p, n in WINDOW.items()], "provider string, window int, guess double")
    return concurrent_runs(cells_of(spark, world), limits, {0: policy}).toPandas().sort_values("seq", ignore_index=True)


def lanes_at(world, calls, seq):
    """The lanes at the start of a call, and which models are being asked then; no two calls return at the same time."""
    a, b, dim, y, *_ = world
    w = np.where(dim == 0, 0.5 / (dim == 0).sum(), 0.5 / (dim == 1).sum())
    lanes, now = [X.Lane(a, b, dim, w) for _ in range(MODELS)], calls["started"][seq]
    heard = calls[(calls["seq"] < seq) & (calls["ended"] <= now)]
    for r in heard.itertuples():
        m, i = int(r.model_idx), int(r.item_idx)
        lanes[m].answers[i] = int(y[m, i])
    for x in lanes:
        x.refresh()
    open_ = calls[(calls["seq"] < seq) & ~calls["seq"].isin(heard["seq"])]
    return lanes, set(open_["model_idx"])


def gain_of(lanes, m, i, policy):
    """The gain of one call by its definition, pair by pair."""
    x, best = lanes[m], -np.inf
    n_open = int(np.isfinite(x.v_new).sum())
    for r in (1,) if policy.one_step else LOOKAHEAD:
        if r <= n_open:
            v = 1 / (1 / x.v + r * max(1 / x.v_new[i] - 1 / x.v, 0))
            fall = sum(expected_fall(np.array([x.s - o.s]), np.array([x.v]), np.array([o.v]), np.array([[v]]), policy.zone)[0, 0] for k, o in enumerate(lanes) if k != m)
            best = max(best, fall / r)
    return best


def distinct_times(world):
    a, b, dim, y, took, cost = world
    return a, b, dim, y, took + np.arange(took.size).reshape(took.shape) * 1e-6 * np.sqrt(2), cost


@pytest.mark.parametrize("policy", [Policy(most_calls=25), Policy(most_calls=25, zone=0.05, one_step=True)])
def test_each_call_is_the_best_by_brute_force(spark, world, policy):
    world = distinct_times(world)
    calls = played(spark, world, policy)
    assert len(calls) == 25 and set(calls["reason"]) == {MOST_CALLS}
    for seq in range(25):
        lanes, asked = lanes_at(world, calls, seq)
        busy = [OF[m] for m in asked]
        ready = [m for m in range(MODELS) if m not in asked and busy.count(OF[m]) < WINDOW[OF[m]]]
        for x, row in zip(lanes, world[3], strict=True):
            x.v_new[np.isnan(row)] = np.inf
        worth = {(m, i): gain_of(lanes, m, i, policy) for m in ready for i in np.flatnonzero(np.isfinite(lanes[m].v_new))}
        r = calls.loc[seq]
        assert (r.model_idx, r.item_idx) in worth
        assert r.gain == pytest.approx(max(worth.values()), abs=1e-12)
        assert worth[r.model_idx, r.item_idx] == pytest.approx(r.gain, abs=1e-12)


def test_one_call_at_a_time_equals_the_plain_allocator(spark, world):
    a, b, dim, y, *_ = world
    w = np.where(dim == 0, 0.5 / (dim == 0).sum(), 0.5 / (dim == 1).sum())
    calls = played(spark, world, Policy(most_calls=40, in_flight=1))
    assert [(r.seq, r.model_idx, r.item_idx) for r in calls.itertuples()] == [c[:3] for c in X.run("coupled", y, a, b, dim, w, 40)]
    assert (calls["started"][1:].to_numpy() == calls["ended"][:-1].to_numpy()).all()


def test_windows_hold_and_slots_stay_idle_below_the_floor(spark, world):
    eager, patient = (played(spark, world, Policy(most_calls=60, floor=f, by_cost=True)) for f in (0.0, 0.6))
    for calls in (eager, patient):
        assert calls["seq"].tolist() == list(range(60)) and not calls.duplicated(["model_idx", "item_idx"]).any()
        for r in calls.itertuples():
            flying = calls[(calls["started"] <= r.started) & (calls["ended"] > r.started)]
            assert not flying.duplicated("model_idx").any()
            assert all(n <= WINDOW[p] for p, n in flying["model_idx"].map(lambda m: OF[m]).value_counts().items())
    assert eager["left_idle"][0] == 0 < patient["left_idle"][0]
    assert eager["ended"].max() < patient["ended"].max()


def test_the_run_stops_for_a_reason(spark, world):
    all_of = played(spark, world, Policy())
    assert set(all_of["reason"]) == {NO_GAIN} and 0 < len(all_of) <= MODELS * ITEMS - 2
    money = played(spark, world, Policy(budget=0.05))
    assert set(money["reason"]) == {OVER_BUDGET} and 0.03 < money["spent"][0] <= 0.05 + 0.008 * 4 and len(money) < len(all_of)
    spent = sum(world[5][r.model_idx, r.item_idx] for r in money.itertuples())
    assert money["spent"][0] == pytest.approx(spent)
    settled = played(spark, world, Policy(settled=0.9))
    assert set(settled["reason"]) == {SETTLED} and len(settled) < len(all_of)
    # all calls are heard in the end, also those in flight when the board was settled
    one_by_one = played(spark, world, Policy(settled=0.9, in_flight=1))
    for size, above in ((len(one_by_one) - 1, True), (len(one_by_one), False)):
        begun = pd.concat([one_by_one[:size], pd.DataFrame([{"seq": 10**6, "started": np.inf, "ended": np.inf}], index=[10**6])])
        lanes, _ = lanes_at(world, begun, 10**6)
        left = sum(wrong_order(np.array([lanes[i].s - lanes[j].s]), np.array([lanes[i].v + lanes[j].v]))[0] for i in range(MODELS) for j in range(i))
        assert bool(left >= 0.9) == above
    at_once = played(spark, world, Policy(settled=1e9))
    assert len(at_once) == 1 and at_once["seq"].isna().all() and at_once["reason"][0] == SETTLED
    alone = concurrent_runs(cells_of(spark, world).where("model_idx = 2"), spark.createDataFrame([], "provider string, window int, guess double"), {7: Policy()}).collect()
    assert [(r.run, r.seq, r.reason) for r in alone] == [(7, None, TOO_FEW)]


def test_falls_are_worked_out_again_only_for_the_model_that_was_asked(world, monkeypatch):
    a, b, dim, y, *_ = world
    w = np.where(dim == 0, 0.5 / (dim == 0).sum(), 0.5 / (dim == 1).sum())
    pairs = []
    monkeypatch.setattr(X, "expected_fall", lambda d, *rest: pairs.append(len(d)) or expected_fall(d, *rest))
    calls = X.run("coupled", y, a, b, dim, w, 12)
    assert len(calls) == 12 and pairs[0] == MODELS * (MODELS - 1) and set(pairs[1:]) == {2 * (MODELS - 1)}
    lanes, allowed = [X.Lane(a, b, dim, w) for _ in range(MODELS)], list(~np.isnan(y))
    for _, m, i, gain in calls:
        best = [x.best(allowed[k]) for k, x in enumerate(lanes)]
        worth = X.gains(lanes, best, list(range(MODELS)))
        assert (m, i, gain) == (int(worth.argmax()), best[m][0], worth.max())
        lanes[m].answers[i] = int(y[m, i])
        lanes[m].refresh()
