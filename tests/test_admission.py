"""Admission over time against a plain event loop."""

import random

import pytest
from pyspark.sql import functions as F

from calibron.operators import admission
from calibron.operators.admission import admitted_over_time
from calibron.plans import catalogue
from calibron.plans.matrix_queries import timed_calls
from calibron.sources.domain import Domain

JOBS = "provider string, job string, seq long, at double, priority double, took double, cost double"


def line_of(rows, slots, fifo):
    """{job: (place, started, ends)} of one provider, second by second through its events."""
    todo, waiting, flying, out, now = sorted(rows, key=lambda r: (r[3], r[2])), [], [], {}, 0.0
    while todo or waiting:
        now = min([r[3] for r in todo[:1]] + (flying if waiting else []))
        for end in sorted(f for f in flying if f <= now):
            flying.remove(end)
            if waiting:
                best = min(waiting, key=lambda r: (0 if fifo else -r[4], r[2]))
                waiting.remove(best)
                flying.append(end + best[5])
                out[best[1]] = (len(out) + 1, end, end + best[5])
        while todo and todo[0][3] <= now and not (waiting and min(flying) <= now):
            r = todo.pop(0)
            if len(flying) < slots:
                flying.append(r[3] + r[5])
                out[r[1]] = (len(out) + 1, r[3], r[3] + r[5])
            else:
                waiting.append(r)
    return out


def paid_of(starts, prices, budget, cost):
    """The calls that are paid, by the money out and promised at each start."""
    events = sorted([(s, 1, p, k, j) for (p, j), (k, s, e) in starts.items()] + [(e, 0, p, k, j) for (p, j), (k, s, e) in starts.items()])
    spent, flying, out = 0.0, set(), set()
    for _, begins, p, _, j in events:
        if not begins:
            if (p, j) in out:
                flying.discard((p, j))
                spent += prices[j]
        elif spent + len(flying) * cost + cost > budget + 1e-9:
            break
        else:
            flying.add((p, j))
            out.add((p, j))
    return out


def made(seed, gap):
    rng, at, rows = random.Random(seed), 0.0, []
    for k in range(240):
        at += rng.choice([0.0, gap, 2 * gap])
        rows.append(("east" if k % 3 else "west", f"call{k}", k, at, float(rng.randint(0, 3)), rng.randint(1, 16) / 4, rng.randint(0, 20) / 100))
    return rows


@pytest.mark.parametrize(("gap", "mode", "budget"), [(0.5, "priority", None), (0.25, "fifo", 9.0), (0.125, "priority", 9.0), (2.0, "priority", 1e6)])
def test_admission_over_time_equals_an_event_loop(spark, gap, mode, budget):
    rows, slots = made(7, gap), {"east": 3, "west": 1}
    windows = spark.createDataFrame(list(slots.items()), "provider string, window long")
    got = admitted_over_time(spark.createDataFrame(rows, JOBS), windows, mode, budget, 0.05, parts=6).collect()
    want = {(p, j): v for p, n in slots.items() for j, v in line_of([r for r in rows if r[0] == p], n, mode == "fifo").items()}
    assert {(r.provider, r.job): (r.place, r.started, r.ends) for r in got} == want and len(got) == 240
    paid = set(want) if budget is None else paid_of(want, {r[1]: r[6] for r in rows}, budget, 0.05)
    assert {(r.provider, r.job) for r in got if r.paid} == paid
    assert budget not in (9.0,) or 0 < len(paid) < 240


def test_a_freed_slot_goes_to_the_most_urgent(spark):
    windows = spark.createDataFrame([("p", 1)], "provider string, window long")
    rows = [("p", n, k, 0.0, pr, 1.0, 0.0) for k, (n, pr) in enumerate([("a", 1.0), ("b", 0.1), ("c", 9.0), ("d", 5.0)])]
    line = lambda mode: [r.job for r in admitted_over_time(spark.createDataFrame(rows, JOBS), windows, mode).orderBy("place").collect()]
    assert line("priority") == ["a", "c", "d", "b"] and line("fifo") == ["a", "b", "c", "d"]


def test_blocks_are_bounded_by_their_calls(spark, monkeypatch):
    seen, written = [], admission.written
    monkeypatch.setattr(admission, "ARRIVALS", 50)
    monkeypatch.setattr(admission, "written", lambda df, name: seen.append((name, written(df, name))) or seen[-1][1])
    windows = spark.createDataFrame([("east", 3), ("west", 1)], "provider string, window long")
    got = admitted_over_time(spark.createDataFrame(made(7, 0.5), JOBS), windows).count()
    assert got == 240 and dict(seen)["blocks"].count() >= 5


def test_odd_rows_have_a_defined_place(spark):
    windows = spark.createDataFrame([("p", 1), (None, 5)], "provider string, window long")
    rows = [(None, "x", 1, 0.0, 1.0, 2.0, None), (None, None, 2, 0.0, None, None, 0.1), ("p", "y", None, None, float("nan"), 1.0, 0.0), ("p", "z", 3, 0.5, None, 1.0, 0.0), ("p", "z", 3, 0.5, None, 1.0, 0.0), ("other", "w", 9, 4.0, 1.0, 0.0, 0.0)]
    got = admitted_over_time(spark.createDataFrame(rows, JOBS).withColumn("extra", F.lit(1)), windows, budget=100.0).collect()
    assert sorted(((r.provider or ""), r.place, r.job or "", r.started, r.paid) for r in got) == [("", 1, "x", 0.0, True), ("", 2, "", 2.0, True), ("other", 1, "w", 4.0, True), ("p", 1, "y", 0.0, True), ("p", 2, "z", 1.0, True), ("p", 3, "z", 2.0, True)]
    assert admitted_over_time(spark.createDataFrame([], JOBS), windows, budget=1.0).count() == 0


def test_the_query_equals_an_event_loop(spark, sf_dir):
    calls, windows = timed_calls(Domain(spark, sf_dir))
    rows, slots = [tuple(r) for r in calls.collect()], {r.provider: r.window for r in windows.collect()}
    want = {(p, j): (k, round(s, 5), round(e, 5)) for p, n in slots.items() for j, (k, s, e) in line_of([r for r in rows if r[0] == p], n, False).items()}
    got = catalogue.queries()["f12_admission_over_time"](spark, sf_dir).collect()
    assert {(r.provider, r.job): (r.place, r.started, r.ends) for r in got} == {k: (v[0], pytest.approx(v[1], abs=1e-4), pytest.approx(v[2], abs=1e-4)) for k, v in want.items()}
    assert 0.7 < sum(r.paid for r in got) / len(got) < 0.8
