"""Limited-memory BFGS over partitioned vectors.

A point is a table (run, key, x): many minimisations (runs: folds, splits, variants) go side by side in the
same jobs. The two-loop recursion needs nothing but the products of the stored vectors with each other, one
aggregation an iteration; the direction is a linear combination of them, added up row by row. The steps of all
runs are found together by bisection to the weak Wolfe conditions, so an objective never rises. At the
driver are a few numbers for each run, never a vector.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibron.sources.scratch import written

#: Pairs of steps and gradient changes that are remembered, and trials of a line search.
MEMORY, TRIALS = 6, 30
DECREASE, CURVATURE = 1e-4, 0.9


@dataclass
class Trace:
    """What became of a run: objective and largest gradient entry after each round, and whether it went below the tolerance."""

    objective: list[float] = field(default_factory=list)
    gradient: list[float] = field(default_factory=list)
    converged: bool = False

    @property
    def rounds(self) -> int:
        return len(self.objective) - 1


def direction(gram: np.ndarray, pairs: int) -> np.ndarray:
    """Coefficients of the quasi-Newton direction over the vectors s_1.., y_1.., g whose products are ``gram``."""
    g = 2 * pairs
    out = np.zeros(2 * pairs + 1)
    out[g] = -1.0
    alpha = np.zeros(pairs)
    for i in reversed(range(pairs)):
        alpha[i] = out @ gram[:, i] / gram[i, pairs + i]
        out[pairs + i] -= alpha[i]
    if pairs:
        out *= gram[pairs - 1, 2 * pairs - 1] / gram[2 * pairs - 1, 2 * pairs - 1]
    for i in range(pairs):
        out[i] += alpha[i] - out @ gram[:, pairs + i] / gram[i, pairs + i]
    return out


def _grams(state: DataFrame, pairs: int) -> dict[int, tuple[np.ndarray, float]]:
    """For each run the products of its stored vectors with each other, and its largest gradient entry."""
    basis = F.concat("s", "y", F.array(F.col("g") / F.sqrt("h")))
    n = 2 * pairs + 1
    cells = [(i, j) for i in range(n) for j in range(i + 1)]
    rows = state.select("run", "g", basis.alias("v")).groupBy("run").agg(F.max(F.abs("g")).alias("top"), *(F.sum(F.get("v", F.lit(i)) * F.get("v", F.lit(j))).alias(f"p{k}") for k, (i, j) in enumerate(cells)))
    out = {}
    for r in rows.collect():
        gram = np.zeros((n, n))
        for k, (i, j) in enumerate(cells):
            gram[i, j] = gram[j, i] = r[f"p{k}"]
        out[r["run"]] = (gram, float(r["top"]))
    return out


def minimise(start: DataFrame, evaluate: Callable[[DataFrame], DataFrame], tol: float = 1e-5, most: int = 100) -> tuple[DataFrame, dict[int, Trace]]:
    """(run, key, x) where the objective of each run has no gradient entry over ``tol``, and the trace of each run.

    ``start(run, key, x, h)``: h over 0 is about the curvature along the key, by whose root keys are scaled; ``evaluate`` gives (run, key, g), the gradient at such a table, and in rows of null key
    parts of the objective. A run whose line search finds no lower value in double precision stays where it is.
    """
    spark = start.sparkSession
    none = F.array().cast("array<double>")

    def evaluated(points: DataFrame) -> DataFrame:
        """``points(run, key, x, ...)`` with g; one more row a run, of null key, has the objective as g."""
        found = evaluate(points.select("run", "key", "x"))
        g = found.where("key is not null").select(F.col("run").alias("r"), F.col("key").alias("k"), "g")
        rows = points.join(g, (F.col("run") == F.col("r")) & (F.col("key") == F.col("k")), "left").drop("r", "k").withColumn("g", F.coalesce("g", F.lit(0.0)))
        return rows.unionByName(found.where("key is null").groupBy("run").agg(F.sum("g").alias("g")), allowMissingColumns=True)

    first = written(evaluated(start.select("run", "key", F.col("x").cast("double").alias("x"), F.col("h").cast("double").alias("h"))), "minimum")
    value = {r["run"]: r["g"] for r in first.where("key is null").collect()}
    trace = {run: Trace([v]) for run, v in value.items()}
    state = first.where("key is not null").withColumns({"s": none, "y": none})
    pairs, stalled = 0, set()
    for _ in range(most + 1):
        grams = _grams(state, pairs)
        coefficients, slope, step, still = {}, {}, {}, set()
        for run, (gram, top) in grams.items():
            trace[run].gradient.append(top)
            trace[run].converged = top <= tol
            if top <= tol or run in stalled:
                still.add(run)
                coefficients[run], slope[run] = np.zeros(2 * pairs + 1), 0.0
                continue
            known = [i for i in range(pairs) if gram[i, pairs + i] > 0]  # a run that stood still has a pair of zeros
            keep = [*known, *(pairs + i for i in known), 2 * pairs]
            c = np.zeros(2 * pairs + 1)
            c[keep] = direction(gram[np.ix_(keep, keep)], len(known))
            coefficients[run], slope[run] = c, float(c @ gram[:, -1])
            step[run] = 1.0 if known else min(1.0, 1 / math.sqrt(gram[-1, -1]))
        if not step or len(trace[next(iter(trace))].gradient) > most:
            break
        table = spark.createDataFrame([(r, c.tolist()) for r, c in coefficients.items()], "run int, c array<double>")
        along = F.aggregate(F.zip_with(F.concat("s", "y", F.array(F.col("g") / F.sqrt("h"))), "c", lambda v, w: v * w), F.lit(0.0), lambda a, b: a + b) / F.sqrt("h")
        here = state.join(F.broadcast(table), "run").select("run", "key", "x", "h", "g", "s", "y", along.alias("d"))
        low, high, accepted = dict.fromkeys(step, 0.0), dict.fromkeys(step, math.inf), dict.fromkeys(still, 0.0)
        for _ in range(TRIALS):
            steps = spark.createDataFrame([(r, accepted.get(r, step.get(r, 0.0))) for r in grams], "run int, t double")
            moved = here.join(F.broadcast(steps), "run").select("run", "key", (F.col("x") + F.col("t") * F.col("d")).alias("x"), "h", "t", "d", F.col("g").alias("g0"), "s", "y")
            trial = written(evaluated(moved), "minimum")
            seen = {r["run"]: r for r in trial.groupBy("run").agg(F.sum(F.when(F.col("key").isNull(), F.col("g"))).alias("f"), F.sum(F.when(F.col("key").isNotNull(), F.col("g") * F.col("d"))).alias("slope")).collect()}
            for run in step:
                if run in accepted:
                    continue
                f, t = seen[run]["f"], step[run]
                if not f <= value[run] + DECREASE * t * slope[run]:  # also where f is no number
                    high[run] = t
                elif seen[run]["slope"] < CURVATURE * slope[run]:
                    low[run] = t
                else:
                    accepted[run] = t
                    continue
                step[run] = 2 * low[run] if high[run] == math.inf else (low[run] + high[run]) / 2
            if len(accepted) == len(grams):
                break
        else:
            stalled |= set(step) - set(accepted)
            accepted |= dict.fromkeys(set(step) - set(accepted), 0.0)
            steps = spark.createDataFrame(list(accepted.items()), "run int, t double")
            moved = here.join(F.broadcast(steps), "run").select("run", "key", (F.col("x") + F.col("t") * F.col("d")).alias("x"), "h", "t", "d", F.col("g").alias("g0"), "s", "y")
            trial = written(evaluated(moved), "minimum")
            seen = {r["run"]: r for r in trial.where("key is null").select("run", F.col("g").alias("f")).collect()}
        for run in grams:
            if run not in still:
                value[run] = seen[run]["f"]
                trace[run].objective.append(value[run])
        new = lambda past, v: F.concat(F.slice(past, pairs - MEMORY + 2, MEMORY - 1) if pairs >= MEMORY else F.col(past), F.array(v))
        state = trial.where("key is not null").select("run", "key", "x", "h", "g", new("s", F.col("t") * F.col("d") * F.sqrt("h")).alias("s"), new("y", (F.col("g") - F.col("g0")) / F.sqrt("h")).alias("y"))
        pairs = min(MEMORY, pairs + 1)
    return state.select("run", "key", "x"), trace


def minimise_small(x: np.ndarray, h: np.ndarray, evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], tol: float = 1e-5, most: int = 100) -> tuple[np.ndarray, Trace]:
    """:func:`minimise` of one run whose vector is small enough for the driver; only ``evaluate``, (objective, gradient) at x, is distributed."""
    scale = np.sqrt(h)
    f, g = evaluate(x)
    trace = Trace([f])
    s, y = [], []
    while True:
        trace.gradient.append(float(np.abs(g).max(initial=0.0)))
        trace.converged = trace.gradient[-1] <= tol
        if trace.converged or len(trace.gradient) > most:
            return x, trace
        basis = np.array([*s, *y, g / scale])
        gram = basis @ basis.T
        c = direction(gram, len(s))
        d, slope = c @ basis / scale, float(c @ gram[:, -1])
        t, low, high = 1.0 if s else min(1.0, 1 / math.sqrt(gram[-1, -1])), 0.0, math.inf
        for _ in range(TRIALS):
            f_new, g_new = evaluate(x + t * d)
            if not f_new <= f + DECREASE * t * slope:  # also where it is no number
                high = t
            elif g_new @ d < CURVATURE * slope:
                low = t
            else:
                break
            t = 2 * low if high == math.inf else (low + high) / 2
        else:
            return x, trace
        if t * d @ (g_new - g) > 0:
            s, y = [*s, t * d * scale][-MEMORY:], [*y, (g_new - g) / scale][-MEMORY:]
        x, f, g = x + t * d, f_new, g_new
        trace.objective.append(f)
