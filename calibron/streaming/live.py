"""Live sessions whose state comes back from the event log.

Every session is a key of ``transformWithState``. A query that starts without a checkpoint takes its first state
from the log (what was answered, which item is pending), so the log alone is enough to go on. A pending item
that nobody answers in time is offered again by a timer; state that nothing has touched for ``ttl_ms`` goes, as
the log still has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from calibron.operators.eventlog import session_states
from calibron.operators.sessions import ability, pick

NEXT = "session_id string, step long, item_idx long, theta double, se double, stale long, reason string"
STATE = "items array<long>, answers array<int>, pending long, stale long, pool array<long>"
DONE = -1
#: The provider that keeps timers, several values and their times to live.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LiveSession(StatefulProcessor):
    """One session: answers so far, the pending item (-1: finished), and how many results were for neither."""

    def __init__(self, bank: pd.DataFrame, max_items: int, min_items: int, se_target: float, idle_ms: int | None, ttl_ms: int | None):
        bank = bank.sort_values("item_idx")
        self.idx, self.a, self.b = (bank[c].to_numpy() for c in ("item_idx", "a", "b"))
        self.place = {int(i): k for k, i in enumerate(self.idx)}
        self.limits, self.idle_ms, self.ttl_ms = (max_items, min_items, se_target), idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", STATE, self.ttl_ms)

    def _ability(self, used: list[int], answers: list[int], start: float = 0.0) -> tuple[float, float]:
        return ability(self.a[used], self.b[used], np.array(answers, float), start=start) if used else (0.0, 1.0)

    def _open(self, used: list[int], pool: list[int] | None) -> tuple[np.ndarray, int]:
        """Whether each item of the bank may still be asked, and how many the session may be asked at all."""
        may = np.full(len(self.idx), pool is None)
        may[[self.place[i] for i in pool or ()]] = True
        n = int(may.sum())
        may[used] = False
        return may, n

    def _next(self, session_id: str, n: int, may: np.ndarray, n_pool: int, theta: float, se: float) -> int:
        most, least, target = self.limits
        if n >= min(most, n_pool) or (n >= least and se < target):
            return DONE
        open_ = np.flatnonzero(may)
        return int(self.idx[open_[pick("max_info", theta, self.idx[open_], self.a[open_], self.b[open_], session_id, n)]])

    def _wait(self, pending: int, timers) -> None:
        """One timer for the pending item, none for a finished session."""
        if self.idle_ms is None:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if pending != DONE:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            items, answers = [int(i) for i in r.items_], [int(c) for c in r.answers]
            pool = None if r.pool is None else [int(i) for i in r.pool]
            pending = None if pd.isna(r.pending) else int(r.pending)
            if pending is None and items:
                used = [self.place[i] for i in items]
                pending = self._next(key[0], len(items), *self._open(used, pool), *self._ability(used, answers))
            self.session.update((items, answers, pending, 0, pool))
            self._wait(DONE if pending is None else pending, timerValues)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items, answers, pending, stale, pool = self.session.get() if self.session.exists() else ([], [], None, 0, None)
        items, answers = list(items), list(answers)
        used = [self.place[i] for i in items]
        theta, se = self._ability(used, answers)
        may, n_pool = self._open(used, pool)
        for r in pd.concat(list(rows)).sort_values("step", kind="stable").itertuples():
            if pending == DONE or r.step != len(items) or (pending is not None and r.item_idx != pending) or int(r.item_idx) not in self.place:
                stale += 1
                continue
            items.append(int(r.item_idx))
            answers.append(int(r.correct))
            used.append(self.place[items[-1]])
            may[used[-1]] = False
            theta, se = self._ability(used, answers, theta)
            pending = self._next(key[0], len(items), may, n_pool, theta, se)
        self.session.update((items, answers, pending, stale, pool))
        self._wait(DONE if pending is None else pending, timerValues)
        yield self._row(key[0], len(items), pending, theta, se, stale, "result")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.session.exists():
            items, answers, pending, stale, _ = self.session.get()
            if pending not in (None, DONE):
                self._wait(pending, timerValues)
                yield self._row(key[0], len(items), pending, *self._ability([self.place[i] for i in items], list(answers)), stale, "idle")

    @staticmethod
    def _row(session_id: str, step: int, pending: int | None, theta: float, se: float, stale: int, reason: str) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [session_id], "step": [step], "item_idx": pd.array([pending], "Int64"), "theta": [theta], "se": [se], "stale": [stale], "reason": [reason]})


def states_of_log(log: DataFrame, pools: DataFrame | None = None) -> DataFrame:
    """(session_id, items_, answers, pending, pool) of ``log(session_id, step, type, item_idx, correct)``: what a session goes on from.

    ``pools(session_id, item_idx)`` are the items that a session may be asked (none named: the whole bank). The
    answers and the pool of one session are gathered, at most one for each item of the bank.
    """
    state = session_states(log.withColumnRenamed("item_idx", "item_id"))
    finished = log.where("type = 'finished'").select("session_id", F.lit(DONE).cast("long").alias("done")).distinct()
    rows = state.join(finished, "session_id", "left")
    if pools is None:
        rows = rows.withColumn("pool", F.lit(None).cast("array<long>"))
    else:
        rows = rows.join(pools.groupBy("session_id").agg(F.collect_set(F.col("item_idx").cast("long")).alias("pool")), "session_id", "left")
    return rows.select("session_id", F.transform("answered", lambda r: r["item_id"].cast("long")).alias("items_"), F.transform("answered", lambda r: r["correct"].cast("int")).alias("answers"), F.coalesce("done", F.col("pending_item").cast("long")).alias("pending"), "pool")


def live_sessions(results: DataFrame, bank: pd.DataFrame, log: DataFrame | None = None, pools: DataFrame | None = None, max_items: int = 100, min_items: int = 5, se_target: float = 0.3, idle_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The next item of each session after a stream of ``results(session_id, step, item_idx, correct)``.

    ``log`` and ``pools`` give the state of the first batch of a query without a checkpoint. A result that isn't for the
    pending step and item is dropped and counted as stale. The bank is of bounded size (a row for each item). The
    session must use the store ``STORE``.
    """
    processor = LiveSession(bank, max_items, min_items, se_target, idle_ms, ttl_ms)
    first = None if log is None else states_of_log(log, pools).groupBy("session_id")
    return results.select("session_id", "step", "item_idx", "correct").groupBy("session_id").transformWithStateInPandas(processor, NEXT, "Update", "ProcessingTime" if idle_ms or ttl_ms else "None", initialState=first)
