"""Rank agreement by inversion counting against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibron.operators import agreement as G


def all_pairs(rows):
    out = dict.fromkeys(("n_pairs", "concordant", "discordant", "tied_x", "tied_y", "tied_both"), 0)
    for i, (x, y) in enumerate(rows):
        for u, v in rows[:i]:
            s, t = (x > u) - (x < u), (y > v) - (y < v)
            out["n_pairs"] += 1
            out["concordant"] += s * t > 0
            out["discordant"] += s * t < 0
            out["tied_x"] += s == 0
            out["tied_y"] += t == 0
            out["tied_both"] += s == t == 0
    return out


def test_inversions_by_bits():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 300):
        codes, left, right = rng.integers(0, 40, n), rng.integers(0, 5, n), rng.integers(0, 5, n)
        assert G.inversions(codes, left, right) == sum(left[i] * right[j] for j in range(n) for i in range(j) if codes[i] > codes[j])


@pytest.mark.parametrize("part_rows", [100_000, 20])
def test_pair_order_is_brute_force(spark, monkeypatch, part_rows):
    """Ties, a hot value on either side, a constant side, one row, repeated rows and nulls; with one part and with many."""
    monkeypatch.setattr(G, "PART_ROWS", part_rows)
    rng = np.random.default_rng(4)
    boards = {
        "ties": [(float(a), float(b)) for a, b in zip(rng.integers(0, 9, 150), rng.integers(0, 9, 150), strict=True)],
        "free": [(float(a), float(b)) for a, b in rng.normal(size=(120, 2))],
        "hot_x": [(1.0, float(k % 37)) for k in range(60)] + [(float(k), float(-k)) for k in range(40)],
        "hot_y": [(float(k % 37), 2.0) for k in range(60)] + [(float(k), float(k * 7 % 11)) for k in range(40)],
        "flat": [(float(k), 3.0) for k in range(15)],
        "single": [(1.0, 1.0)],
        "minus": [(0.0, 1.0), (-0.0, 2.0), (0.0, 2.0), (float("inf"), -5.0)],
    }
    rows = [(b, *r) for b, v in boards.items() for r in v] + [("ties", None, 1.0), ("free", 1.0, None)]
    df = spark.createDataFrame(rows, "board string, x double, y double")
    got = {r["board"]: r.asDict() for r in G.pair_order(df, "x", "y", ["board"]).collect()}
    for board, pairs in boards.items():
        want = all_pairs(pairs)
        assert {k: got[board][k] for k in want} == want, board
    tau = {r.board: r.tau for r in G.tau_b(G.pair_order(df, "x", "y", ["board"]), ["board"]).collect()}
    assert tau["flat"] is None and tau["single"] is None
    want = all_pairs(boards["ties"])
    assert tau["ties"] == pytest.approx((want["concordant"] - want["discordant"]) / ((want["n_pairs"] - want["tied_x"]) * (want["n_pairs"] - want["tied_y"])) ** 0.5)
    assert G.pair_order(df.where("board = 'none'"), "x", "y", ["board"]).collect() == []


@pytest.mark.parametrize("part_rows", [100_000, 20])
def test_distant_pairs_as_subtraction_gives_them(spark, monkeypatch, part_rows):
    monkeypatch.setattr(G, "PART_ROWS", part_rows)
    rng = np.random.default_rng(6)
    rows = [(float(a) / 10, float(b) / 20) for a, b in zip(rng.integers(0, 8, 90), rng.integers(0, 20, 90), strict=True)]
    got = G.distant_pairs(spark.createDataFrame(rows, "x double, y double"), "x", "y", 0.05).first()
    far = [(x, y, u, v) for i, (x, y) in enumerate(rows) for u, v in rows[:i] if abs(y - v) >= 0.05]
    assert (got.n_far, got.n_right) == (len(far), sum((x > u) - (x < u) == (y > v) - (y < v) for x, y, u, v in far))


def test_a_million_models(spark):
    """The number of inversions of a known permutation: blocks of ten, each reversed."""
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("x"), (F.floor(F.col("id") / 10) * 10 + 9 - F.col("id") % 10).alias("y"))
    got = G.pair_order(df, "x", "y").first()
    assert (got.n_pairs, got.discordant, got.concordant) == (n * (n - 1) // 2, 45 * n // 10, n * (n - 1) // 2 - 45 * n // 10)
