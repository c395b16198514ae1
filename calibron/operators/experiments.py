"""Allocation runs that depend on their own answers: one group for each replicate of a grid."""

from __future__ import annotations

from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibron.operators.abilities import placed
from calibron.operators.ranking import LOOKAHEAD, expected_fall, variance_path


class Lane:
    """One model's answers over a weighted bank: score, variance, and the variance after each open item."""

    def __init__(self, a: np.ndarray, b: np.ndarray, dim: np.ndarray, w: np.ndarray):
        self.a, self.b, self.dim, self.w = a, b, dim, w
        self.answers: dict[int, int] = {}
        self.turn = 0
        self.refresh()

    def fresh(self) -> Lane:
        """Another lane over the same bank, from a lane without answers."""
        other = copy(self)
        other.answers = {}
        return other

    def refresh(self) -> None:
        n = len(self.a)
        theta, var = np.zeros(self.dim.max() + 1), np.ones(self.dim.max() + 1)
        for d in np.unique(self.dim):
            at = np.array([i for i in self.answers if self.dim[i] == d], int)
            y = np.array([self.answers[i] for i in at], float)
            t = 0.0
            for _ in range(50 if len(at) else 0):
                p = 1 / (1 + np.exp(-(self.a[at] * t - self.b[at])))
                move = ((self.a[at] * (y - p)).sum() - t) / ((self.a[at] ** 2 * p * (1 - p)).sum() + 1)
                t = float(np.clip(t + move, -6, 6))
                if abs(move) < 1e-8:
                    break
            p = 1 / (1 + np.exp(-(self.a[at] * t - self.b[at])))
            theta[d], var[d] = t, 1 / ((self.a[at] ** 2 * p * (1 - p)).sum() + 1)
        p = 1 / (1 + np.exp(-(self.a * theta[self.dim] - self.b)))
        q = p * (1 - p)
        un = np.ones(n, bool)
        un[list(self.answers)] = False
        self.s = float(sum(self.w[i] * y for i, y in self.answers.items()) + (self.w * p)[un].sum())
        pull = self.w * q * self.a
        g = np.bincount(self.dim[un], weights=pull[un], minlength=len(theta))
        bern = float((self.w**2 * q)[un].sum())
        self.v = max(float((g**2 * var).sum()) + bern, 1e-12)
        own = (g[self.dim] - pull) ** 2 * var[self.dim] / (1 + q * self.a**2 * var[self.dim])
        after = (g**2 * var).sum() - (g**2 * var)[self.dim] + own + bern - self.w**2 * q
        self.v_new = np.where(un, np.maximum(after, 1e-12), np.inf)
        self._best = None
        self.turn += 1

    def best(self, allowed: np.ndarray) -> tuple[int, float, int] | None:
        """Item of least variance among the allowed open ones (ties: the lowest), that variance, and how many are open.

        Kept until the next refresh for the same array ``allowed``.
        """
        if self._best is None or self._best[0] is not allowed:
            self._best = allowed, self._found(allowed)
        return self._best[1]

    def _found(self, allowed: np.ndarray) -> tuple[int, float, int] | None:
        v = np.where(allowed, self.v_new, np.inf)
        i = int(np.argmin(v))
        return (i, float(v[i]), int(np.isfinite(v).sum())) if np.isfinite(v[i]) else None


def gains(lanes: list[Lane], best: list[tuple[int, float, int] | None], askable: list[int], zone: float = 0.0, lookahead: tuple[int, ...] = LOOKAHEAD, known: dict | None = None) -> np.ndarray:
    """Expected fall of misordered pairs a call, of each of the models ``askable``, over all pairs at once.

    ``known``, empty at first, keeps the falls of pairs between calls over the same lanes, zone and lookahead; a pair is
    worked out again once one of its two lanes has been refreshed.
    """
    s, v = (np.array([getattr(x, c) for x in lanes]) for c in "sv")
    turn, n = np.array([x.turn for x in lanes]), len(lanes)
    later, allowed = variance_path(v[askable], np.array([best[m][1] for m in askable]), np.array([best[m][2] for m in askable], float), lookahead)
    at, other = np.nonzero(np.array(askable)[:, None] != np.arange(n)[None, :])
    own = np.array(askable)[at]
    known = {} if known is None else known
    pairs, done = known.setdefault("falls", np.zeros((n, n, len(lookahead)))), known.setdefault("turns", np.zeros((2, n, n), int))
    due = np.flatnonzero((done[0, own, other] != turn[own]) | (done[1, own, other] != turn[other]))
    if due.size:
        i, j = own[due], other[due]
        pairs[i, j] = expected_fall(s[i] - s[j], v[i], v[j], later[at[due]], zone)
        done[0, i, j], done[1, i, j] = turn[i], turn[j]
    falls = np.zeros((len(askable), len(lookahead)))
    np.add.at(falls, at, pairs[own, other])
    return np.where(allowed, falls / np.array(lookahead), -np.inf).max(axis=1)


def run(method: str, y: np.ndarray, a: np.ndarray, b: np.ndarray, dim: np.ndarray, w: np.ndarray, calls: int, seed: int = 0, idle: float = 0.0) -> list[tuple[int, int, int, float]]:
    """(call, model, item, gain) of one allocation run over answers y (models x items, NaN: not askable).

    random and independent go round the models; coupled asks where the gain is largest, and stops if none is
    left or, with ``idle``, if the gain falls below that share of the largest so far.
    """
    first = Lane(a, b, dim, w)
    lanes, allowed = [first.fresh() for _ in range(len(y))], list(~np.isnan(y))
    rng = np.random.default_rng(seed)
    out, top, known = [], 0.0, {}
    for call in range(calls):
        best = [x.best(allowed[m]) for m, x in enumerate(lanes)]
        if method == "coupled":
            askable = [m for m, b in enumerate(best) if b is not None]
            if not askable:
                break
            worth = gains(lanes, best, askable, known=known)
            m, g = askable[int(np.argmax(worth))], float(worth.max())
            i, top = best[m][0], max(top, g)
            if g < idle * top:
                break
        else:
            m, g = call % len(lanes), 0.0
            if best[m] is None:
                continue
            i = best[m][0] if method == "independent" else int(rng.choice(np.flatnonzero(allowed[m] & np.isfinite(lanes[m].v_new))))
        lanes[m].answers[i] = int(y[m, i])
        lanes[m].refresh()
        out.append((call, m, i, float(g)))
    return out


def board_arrays(pdf: pd.DataFrame, *columns: str) -> tuple[np.ndarray, pd.DataFrame, list[np.ndarray]]:
    """(models, bank, arrays of models x items) of the cells of a board; NaN where a model lacks the item, else the largest value."""
    models, at = np.unique(pdf["model_idx"].to_numpy(), return_inverse=True)
    items, first, of = np.unique(pdf["item_idx"].to_numpy(), return_index=True, return_inverse=True)
    wide = []
    for c in columns:
        w = np.full((len(models), len(items)), np.nan)
        np.fmax.at(w, (at, of), pdf[c].to_numpy(float))
        wide.append(w)
    return models, pdf.iloc[first][["item_idx", "a", "b", "dim"]], wide


def model_split(models: DataFrame, train_frac: float, seed: int) -> DataFrame:
    """(model, part): the given share of ``models(model)`` is for training, in the order of a hash of seed and name."""
    hashed = models.select("model", F.md5(F.concat(F.lit(f"{seed}/"), "model").cast("binary")).alias("drawn"))
    rows = placed(hashed, "drawn", "model").crossJoin(models.agg(F.count(F.lit(1)).alias("n")))
    return rows.select("model", F.when(F.col("place") <= F.round(F.lit(train_frac) * F.col("n")), "train").otherwise("test").alias("part"))


def allocation_runs(cells: DataFrame, grid: DataFrame, calls: int, idle: float = 0.0) -> DataFrame:
    """For each row of ``grid(run, method, seed)`` and each board the allocations over ``cells(board, model_idx, item_idx, a, b, dim, y)``.

    Boards and replicates run side by side; within one every call depends on the last. A task holds the
    cells of one board, whose few models compete.
    """

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        models, bank, (y,) = board_arrays(pdf, "y")
        dim = bank["dim"].to_numpy().astype(int)
        w = np.where(dim == 0, 0.5 / max(1, (dim == 0).sum()), 0.5 / max(1, (dim == 1).sum()))
        rows = run(pdf["method"].iloc[0], y, bank["a"].to_numpy(), bank["b"].to_numpy(), dim, w, calls, int(pdf["seed"].iloc[0]), idle)
        items, same = bank["item_idx"].to_numpy(), (int(pdf["board"].iloc[0]), int(pdf["run"].iloc[0]), pdf["method"].iloc[0])
        return pd.DataFrame([(*same, c, int(models[m]), int(items[i]), g) for c, m, i, g in rows], columns=["board", "run", "method", "call", "model_idx", "item_idx", "gain"])

    return cells.crossJoin(grid).groupBy("board", "run").applyInPandas(each, "board long, run int, method string, call long, model_idx long, item_idx long, gain double")
