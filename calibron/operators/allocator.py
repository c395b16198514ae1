"""Coupled allocation with calls in flight: windows, budget, cost, the floor under idle slots, and when to stop."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibron.operators.experiments import Lane, board_arrays, gains
from calibron.operators.ranking import LOOKAHEAD, wrong_order

TOO_FEW, SETTLED, MOST_CALLS, OVER_BUDGET, NO_GAIN = "fewer than two models", "settled", "most calls", "budget", "no gain"


@dataclass(frozen=True)
class Policy:
    """What a run may do. None: no such limit.

    most_calls and budget bound a board; in_flight bounds its open calls, beside the window of each provider.
    settled: it stops below so many expected misordered pairs. floor: with calls in flight a slot stays free if
    its best call gains less than this share of the best call anywhere, which may be had soon. by_cost: gains
    are divided by what a call is expected to cost. zone: scores that are so near don't count as misordered.
    """

    most_calls: int | None = None
    budget: float | None = None
    in_flight: int | None = None
    settled: float = 0.0
    floor: float = 0.0
    by_cost: bool = False
    zone: float = 0.0
    one_step: bool = False


def misordered(lanes: list[Lane], zone: float) -> float:
    """Expected number of pairs of lanes that stand the wrong way round."""
    i, j = np.triu_indices(len(lanes), 1)
    s, v = (np.array([getattr(x, c) for x in lanes]) for c in "sv")
    return float(wrong_order(s[i] - s[j], v[i] + v[j], zone).sum())


class Board:
    """Models that compete for calls, followed from return to return."""

    def __init__(self, policy: Policy, lanes: list[Lane], allowed: list[np.ndarray], provider: list[str], window: dict[str, int], guess: dict[str, float]):
        self.policy, self.lanes, self.allowed, self.provider, self.window = policy, lanes, allowed, provider, window
        self.mean, self.paid = dict(guess), dict.fromkeys(guess, 0)
        self.pending: dict[int, int] = {}
        self.known: dict = {}
        self.spent, self.made, self.idle, self.reason = 0.0, 0, 0, None

    def affordable(self, m: int) -> bool:
        promised = sum(self.mean[self.provider[k]] for k in self.pending)
        return self.policy.budget is None or self.spent + promised + self.mean[self.provider[m]] <= self.policy.budget

    def choice(self) -> tuple[int, int, float] | None:
        """The next call (model, item, gain), or None: nothing is asked before the next return, or at all (reason)."""
        p, n = self.policy, len(self.lanes)
        if n < 2:
            self.reason = TOO_FEW
        elif misordered(self.lanes, p.zone) < p.settled:
            self.reason = SETTLED
        elif p.most_calls is not None and self.made >= p.most_calls:
            self.reason = MOST_CALLS
        if self.reason or (p.in_flight is not None and len(self.pending) >= p.in_flight):
            return None
        best = [x.best(self.allowed[m]) for m, x in enumerate(self.lanes)]
        free = [m for m in range(n) if best[m] is not None and m not in self.pending]
        busy = [self.provider[m] for m in self.pending]
        ready = [m for m in free if busy.count(self.provider[m]) < self.window[self.provider[m]] and self.affordable(m)]
        worth = np.full(n, -np.inf)
        if free:
            worth[free] = gains(self.lanes, best, free, p.zone, (1,) if p.one_step else LOOKAHEAD, self.known)
            if p.by_cost:
                worth[free] /= np.array([max(self.mean[self.provider[m]], 1e-9) for m in free])
        m = max(ready, key=lambda k: (worth[k], -k), default=-1)
        if m >= 0 and self.pending and worth[m] < p.floor * worth.max():
            self.idle += 1
            return None
        if m < 0 or not worth[m] > 0:
            if not self.pending:
                self.reason = OVER_BUDGET if any(not self.affordable(k) for k in range(n)) else NO_GAIN
            return None
        return m, best[m][0], float(worth[m])

    def ask(self, m: int, i: int) -> None:
        self.pending[m] = i
        self.made += 1

    def answered(self, m: int, y: int, cost: float) -> None:
        lane, who = self.lanes[m], self.provider[m]
        lane.answers[self.pending.pop(m)] = y
        lane.refresh()
        self.spent += cost
        self.paid[who] += 1
        self.mean[who] += (cost - self.mean[who]) / self.paid[who]


def play(board: Board, y: np.ndarray, took: np.ndarray, cost: np.ndarray) -> list[tuple[int, int, int, float, float, float]]:
    """(seq, model, item, gain, started, ended): the calls of a board; returns of one time are heard in the order of their calls."""
    out, flying, now = [], [], 0.0
    while True:
        while (call := board.choice()) is not None:
            m, i, gain = call
            board.ask(m, i)
            heapq.heappush(flying, (now + float(took[m, i]), len(out), m, i))
            out.append((len(out), m, i, gain, now, now + float(took[m, i])))
        if not flying:
            return out
        now, _, m, i = heapq.heappop(flying)
        board.answered(m, int(y[m, i]), float(cost[m, i]))


OUT = "board long, run int, seq long, model_idx long, item_idx long, gain double, started double, ended double, spent double, left_idle long, reason string"


def concurrent_runs(cells: DataFrame, providers: DataFrame, policies: dict[int, Policy]) -> DataFrame:
    """The calls of each board under each policy, over ``cells(board, model_idx, provider, item_idx, a, b, dim, y, took, cost)``.

    ``providers(provider, window, guess)``: open calls at a time, and the cost of a call before the first has
    returned; then it is the mean of what its calls have cost. spent, left_idle (how often a slot stayed free
    below the floor) and reason (why the run stopped) are the board's, the same in all its rows; a board
    without a call has one row without seq. A call in flight when a run stops is still heard.

    Boards run side by side; within a board each choice depends on the returns before it. A task holds the cells
    of one board, whose few models compete, and runs it under each policy.
    """
    limits = providers.select(F.col("provider").alias("named"), "window", "guess")
    known = cells.join(limits, F.col("provider") == F.col("named"), "left").withColumns({"provider": F.coalesce("provider", F.lit("")), "window": F.coalesce("window", F.lit(1)), "guess": F.coalesce("guess", F.lit(0.0))})

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        models, bank, (y, took, cost) = board_arrays(pdf, "y", "took", "cost")
        items, dim = bank["item_idx"].to_numpy(), bank["dim"].to_numpy().astype(int)
        w = np.where(dim == 0, 0.5 / max(1, (dim == 0).sum()), 0.5 / max(1, (dim == 1).sum()))
        of = pdf.drop_duplicates("model_idx").set_index("model_idx").loc[models, "provider"].tolist()
        known = pdf.drop_duplicates("provider").set_index("provider")
        first = Lane(bank["a"].to_numpy(), bank["b"].to_numpy(), dim, w)
        out = []
        for run, policy in policies.items():
            board = Board(policy, [first.fresh() for _ in models], list(~np.isnan(y)), of, known["window"].astype(int).to_dict(), known["guess"].to_dict())
            calls = [(k, int(models[m]), int(items[i]), *rest) for k, m, i, *rest in play(board, y, took, cost)] or [(None,) * 6]
            made = pd.DataFrame(calls, columns=["seq", "model_idx", "item_idx", "gain", "started", "ended"])
            made = made.astype({**dict.fromkeys(("seq", "model_idx", "item_idx"), "Int64"), **dict.fromkeys(("gain", "started", "ended"), "Float64")})
            out.append(made.assign(board=int(pdf["board"].iloc[0]), run=run, spent=board.spent, left_idle=board.idle, reason=board.reason))
        return pd.concat(out)[[c.split()[0] for c in OUT.split(", ")]]

    return known.groupBy("board").applyInPandas(each, OUT)
