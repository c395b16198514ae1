"""Admission, rate limits, speculation, grading and scenes on small cases with known answers."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibron.operators import grading, policy, spatial


JOBS = "provider string, job string, seq long, priority double, cost double"


def queue_of(rows, window, cost, mode, budget):
    """The same rules by a plain loop: (job, place, started)."""
    rows = sorted(rows, key=lambda r: r[2])
    line = rows[:window] + sorted(rows[window:], key=lambda r: (0 if mode == "fifo" else -r[3], r[2]))
    out, stopped = [], False
    for k, r in enumerate(line):
        back = sum(x[4] for x in line[: max(0, k - window + 1)])
        stopped = stopped or (budget is not None and back + min(k, window - 1) * cost + cost > budget)
        out.append((r[1], k + 1, not stopped))
    return out


@pytest.mark.parametrize("mode", ["priority", "fifo"])
@pytest.mark.parametrize("budget", [None, 2.0, 0.1])
def test_admission_equals_a_plain_loop(spark, mode, budget):
    import random

    rng = random.Random(3)
    rows = [("east" if k % 3 else "west", f"call{k}", k, float(rng.randint(0, 4)), rng.random() / 10) for k in range(90)]
    got = policy.admitted(spark.createDataFrame(rows, JOBS), 4, 0.05, mode, budget).collect()
    for provider in ("east", "west"):
        want = queue_of([r for r in rows if r[0] == provider], 4, 0.05, mode, budget)
        assert sorted((r.place, r.job, r.started) for r in got if r.provider == provider) == [(p, j, s) for j, p, s in want]


def test_running_sums_over_parts(spark):
    rows = [("k" if n % 5 else "other", n, float(n)) for n in range(400)]
    got = policy.running(spark.createDataFrame(rows, "k string, n long, x double").withColumnRenamed("k", "name"), "name", ["n"], "x", parts=7).collect()
    for name in ("k", "other"):
        mine = sorted((r.n, r.place, r.upto) for r in got if r.name == name)
        assert [p for _, p, _ in mine] == list(range(1, len(mine) + 1))
        assert [u for *_, u in mine] == [sum(n for n, *_ in mine[: k + 1]) for k in range(len(mine))]


def buckets(requests, rpm, tpm, burst):
    """The levels of both buckets followed from request to request."""
    rate, rate_tok = rpm / 60, tpm / 60
    cap, cap_tok = max(1.0, rate * burst), rate_tok * burst
    level, level_tok, now, out = cap, cap_tok, 0.0, {}
    for at, request, n in sorted(requests):
        if n > cap_tok:
            out[request] = None
            continue
        t = max(at, now)
        level, level_tok = min(cap, level + (t - now) * rate), min(cap_tok, level_tok + (t - now) * rate_tok)
        wait = max(0.0, (1 - level) / rate, (n - level_tok) / rate_tok)
        level, level_tok, now = min(cap, level + wait * rate) - 1, min(cap_tok, level_tok + wait * rate_tok) - n, t + wait
        out[request] = now
    return out


@pytest.mark.parametrize("parts", [1, 9])
def test_token_bucket_in_blocks_equals_plain_loop(spark, parts):
    rng = np.random.default_rng(6)
    limits = {"hot": (600.0, 60_000.0), "slow": (120.0, 9_000.0)}
    rows = [("hot" if k % 6 else "slow", k, float(round(rng.uniform(0, 40), 1)), int(rng.integers(1, 1100))) for k in range(600)]
    providers = spark.createDataFrame([(p, *v) for p, v in limits.items()], "provider string, rpm double, tpm double")
    requests = spark.createDataFrame(rows, "provider string, request long, at double, tokens long")
    got = policy.rate_limited(requests, providers, 1.0, parts).collect()
    assert len(got) == 600
    for p, (rpm, tpm) in limits.items():
        want = buckets([(at, k, n) for q, k, at, n in rows if q == p], rpm, tpm, 1.0)
        assert {r.request: r.granted for r in got if r.provider == p} == {k: g if g is None else pytest.approx(g, abs=1e-9) for k, g in want.items()}
        assert any(g is None for g in want.values())
    burst = spark.createDataFrame([("hot", k, 0.0, 1) for k in range(15)], requests.schema)
    times = sorted(r.granted for r in policy.rate_limited(burst, providers, 0.5).collect())
    assert times[:5] == [0.0] * 5 and times[-1] == pytest.approx(1.0)


def test_blocks_of_requests_are_bounded_by_their_rows(spark, monkeypatch):
    seen, written = [], policy.written
    monkeypatch.setattr(policy, "BLOCK_ROWS", 50)
    monkeypatch.setattr(policy, "written", lambda df, name: seen.append((name, written(df, name))) or seen[-1][1])
    providers = spark.createDataFrame([("hot", 600.0, 60_000.0)], "provider string, rpm double, tpm double")
    requests = spark.range(600).select(F.lit("hot").alias("provider"), F.col("id").alias("request"), (F.col("id") / 5).alias("at"), F.lit(9).cast("long").alias("tokens"))
    assert policy.rate_limited(requests, providers).count() == 600
    assert dict(seen)["requests"].groupBy("part").count().agg(F.max("count")).first()[0] <= 150


def test_speculation_guards_in_order(spark):
    branches = spark.createDataFrame(
        [("s1", "east", 0, 1, "new1"), ("s1", "east", 0, 0, None), ("s1", "east", 1, 1, "busy"), ("s1", "east", 1, 0, "known"), ("s1", "east", 2, 1, "new2"), ("s2", "full", 0, 1, "new3"), ("s3", "east", 0, 1, "new4")],
        "session_id string, provider string, step long, correct int, key string",
    )
    flying = spark.createDataFrame([("busy",), ("busy",)], "key string")
    cached = spark.createDataFrame([("known",), ("busy",)], "key string")
    free = spark.createDataFrame([("east", 0.9), ("full", 0.1)], "provider string, room double")
    spent = spark.createDataFrame([("s1", 5.0)], "session_id string, paid double")
    got = {(r.session_id, r.step, r.correct): r.outcome for r in policy.speculation(branches, flying, cached, free, spent, 1.0).collect()}
    # the second call of s1 would bring 2 of 7 dollars; s3 has paid nothing yet
    assert got == {("s1", 0, 1): "made", ("s1", 0, 0): "stop", ("s1", 1, 1): "inflight", ("s1", 1, 0): "cached", ("s1", 2, 1): "cap", ("s2", 0, 1): "headroom", ("s3", 0, 1): "cap"}


CASES = [
    ("Oslo!", "Oslo", [], [], True),
    ("Bergen", "Oslo", [], [], False),
    ("seven", "7", [], ["seven"], True),
    ("There are 9 birds, or rather 8", "8", [], [], True),
    ("There are 9 birds, or rather 8", "9", [], [], False),
    ("All of them are green", "green", ["green", "white"], [], True),
    ("green is behind, white in front", "green", ["green", "white"], [], False),
    ("   ", "11", [], [], False),
    ("cannot tell", "11", [], [], False),
    ("orange", "green", ["green", "white"], [], False),
    ("Twelve", "12", [], [], True),
    ("2.5", "25", [], [], True),
    ("-6", "6", [], [], True),
    ("table salt", "nacl", [], ["table salt"], False),
    ("09", "9", [], [], False),
    ("x y  Oslo", "Oslo", [], [], True),
]


def test_grading_cases(spark):
    rows = spark.createDataFrame([(k, t, a, o, x) for k, (t, a, o, x, _) in enumerate(CASES)], "k int, text string, answer string, options array<string>, aliases array<string>")
    got = {r.k: r.ok for r in rows.select("k", grading.graded(F.col("text"), F.col("answer"), F.col("options"), F.col("aliases")).alias("ok")).collect()}
    assert [got[k] for k in range(len(CASES))] == [c[-1] for c in CASES]


def drawn(heights):
    """Visible cubes by sampling the hexagon of each cube, nearest last."""
    owner = {}
    for x, y, z in sorted(((x, y, z) for (x, y), h in heights.items() for z in range(h)), key=sum):
        for i, j in itertools.product(range(-24, 25), repeat=2):
            px, py = (i + 0.5) / 24, (j + 0.5) / 24
            if abs(py) <= 1 - abs(px) / 2:  # the outline of a cube, one unit wide to each side
                owner[round(((x - y) + px) * 24 - 0.5), round(((x + y) / 2 - z + py) * 24 - 0.5)] = (x, y, z)
    return set(owner.values())


def test_visible_cubes_equal_a_raster(spark):
    import random

    rng = random.Random(0)
    scenes = {0: {(x, y): 2 for x in range(2) for y in range(2)}, 1: {(0, 0): 3}}
    scenes |= {k: {(x, y): rng.randint(0, 4) for x in range(4) for y in range(4)} for k in range(2, 12)}
    heights = spark.createDataFrame([(s, x, y, h) for s, c in scenes.items() for (x, y), h in c.items()], "scene int, x int, y int, h int")
    got = {}
    for r in spatial.visible(spatial.cubes(heights)).collect():
        got.setdefault(r.scene, set()).add((r.x, r.y, r.z))
    for s, c in scenes.items():
        assert got.get(s, set()) == drawn(c), s
    assert len(got[0]) == 7 and (0, 0, 0) not in got[0] and len(got[1]) == 3
