"""Joint MAP fits. 2PL: item parameters by L-BFGS over partitioned vectors, abilities solved in each evaluation.
Explanatory: abilities by model and scoring steps for the design in turn.

For given items the ability of a model has one best value, which Newton steps find in the model's row; with it
put in, the objective depends on the items alone and its gradient is that of the cells at these abilities. The
answers to one item are never gathered: its part of the gradient is two sums, which Spark aggregates partially
before the shuffle. Only one model's answers, at most one for each item, meet in a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibron.functions.irt import BOUND, SMALL, map_ability, sigmoid
from calibron.operators.lbfgs import Trace, minimise, minimise_small
from calibron.sources.scratch import BANK_ROWS, written

#: No scoring step of the explanatory fit moves a log slope or a weight further than this.
REACH = 1.0
#: Newton steps for an ability, as in ``map_ability``.
NEWTON = 25
#: Models that are worked on at a time.
ROWS = 256
#: Log slopes are kept within +-6 of 0 where they enter a probability.
STEEPEST = 6.0
#: What an answer is taken to add to the curvature along its item, to scale the search by.
TYPICAL = 0.2


def _softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def item_sums(cells: DataFrame, bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums over the answers at the best abilities, and these abilities.

    ``cells(run, model, item_idx, y)``, ``bank(run, item_idx, dim, a, b)`` with logit a * theta[dim] - b, theta ~ N(0, 1).
    Gives (run, item_idx, r, u): sums of p - y and of (p - y) * a * theta, and in rows of null item_idx as r the
    models' parts of the objective; and (run, model, dim, theta).
    """
    packed = cells.join(bank, ["run", "item_idx"]).groupBy("run", "model", "dim").agg(F.collect_list(F.struct("a", "b", "y", "item_idx")).alias("c"))
    solved = packed.withColumn("theta", map_ability(F.col("c"), offset=True)["theta"])
    z = lambda x: x["a"] * F.col("theta") - x["b"]
    lost = F.aggregate(F.transform("c", lambda x: _softplus(z(x)) - x["y"] * z(x)), F.col("theta") * F.col("theta") / 2, lambda s, v: s + v)
    miss = lambda x: sigmoid(z(x)) - x["y"]
    parts = F.concat(F.transform("c", lambda x: F.struct(x["item_idx"].alias("item_idx"), miss(x).alias("r"), (miss(x) * x["a"] * F.col("theta")).alias("u"))), F.array(F.struct(F.lit(None).cast("int").alias("item_idx"), lost.alias("r"), F.lit(0.0).alias("u"))))
    each = solved.select("run", F.explode(parts).alias("p")).select("run", F.col("p.item_idx").cast("long").alias("item_idx"), "p.r", "p.u")
    return each.groupBy("run", "item_idx").agg(F.sum("r").alias("r"), F.sum("u").alias("u")), solved.select("run", "model", "dim", "theta")


def _steep(log_a: Column) -> Column:
    return F.exp(F.greatest(F.lit(-STEEPEST), F.least(F.lit(STEEPEST), log_a)))


def fit_2pl(cells: DataFrame, sigma_log_a: float = 0.5, sigma_b: float = 2.0, rounds: int = 100, tol: float = 1e-5) -> tuple[DataFrame, DataFrame, Trace]:
    """(bank(item_idx, a, b), abilities(model, theta), trace) of ``cells(model, item_idx, y)``; null answers don't count.

    Priors: theta ~ N(0, 1), log a ~ N(0, sigma_log_a), b ~ N(0, sigma_b). Ends once no entry of the gradient is
    over ``tol``; keys 2 i and 2 i + 1 are log a and b of item i.
    """
    cells = written(cells.where("y is not null").select(F.lit(0).alias("run"), "model", "item_idx", F.col("y").cast("double").alias("y")), "fit_cells")
    rate = F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.avg("y")))
    begin = cells.groupBy("run", "item_idx").agg(rate.alias("p"), (TYPICAL * F.count("y")).alias("h"))
    of = lambda odd, x, h: F.struct((F.col("item_idx") * 2 + odd).cast("long").alias("key"), x.alias("x"), h.alias("h"))
    keys = F.array(of(0, F.lit(0.0), F.col("h") + 1 / sigma_log_a**2), of(1, -F.ln(F.col("p") / (1 - F.col("p"))), F.col("h") + 1 / sigma_b**2))
    start = written(begin.select("run", F.explode(keys).alias("k")).select("run", "k.*"), "fit_start")
    if start.count() <= 2 * BANK_ROWS:
        return _fit_2pl_small(cells, start, sigma_log_a, sigma_b, rounds, tol)

    def bank_of(points: DataFrame) -> DataFrame:
        at = lambda odd: F.max(F.when(F.col("key") % 2 == odd, F.col("x")))
        rows = points.groupBy("run", F.expr("key div 2").alias("item_idx")).agg(at(0).alias("log_a"), at(1).alias("b"))
        return rows.select("run", "item_idx", F.lit(0).alias("dim"), "log_a", _steep(F.col("log_a")).alias("a"), F.col("b").alias("hard"), (_steep(F.col("log_a")) * F.col("b")).alias("b"))

    def evaluate(points: DataFrame) -> DataFrame:
        bank = bank_of(points)
        sums, _ = item_sums(cells, bank.select("run", "item_idx", "dim", "a", "b"))
        rows = sums.where("item_idx is not null").join(bank, ["run", "item_idx"])
        prior = F.col("log_a") ** 2 / (2 * sigma_log_a**2) + F.col("hard") ** 2 / (2 * sigma_b**2)
        of_a = F.col("u") - F.col("b") * F.col("r") + F.col("log_a") / sigma_log_a**2
        of_b = -F.col("a") * F.col("r") + F.col("hard") / sigma_b**2
        parts = F.array(F.struct((F.col("item_idx") * 2).alias("key"), of_a.alias("g")), F.struct((F.col("item_idx") * 2 + 1).alias("key"), of_b.alias("g")), F.struct(F.lit(None).cast("long").alias("key"), prior.alias("g")))
        return rows.select("run", F.explode(parts).alias("p")).select("run", "p.key", "p.g").unionByName(sums.where("item_idx is null").select("run", F.lit(None).cast("long").alias("key"), F.col("r").alias("g")))

    points, trace = minimise(start, evaluate, tol, rounds)
    bank = written(bank_of(points).select("run", "item_idx", "dim", "a", "b", "hard"), "fit_bank")
    _, theta = item_sums(cells, bank.drop("hard"))
    return bank.select("item_idx", "a", F.col("hard").alias("b")), written(theta.select("model", "theta"), "fit_theta"), trace.get(0, Trace())


def _fit_2pl_small(cells: DataFrame, start: DataFrame, sigma_log_a: float, sigma_b: float, rounds: int, tol: float) -> tuple[DataFrame, DataFrame, Trace]:
    """:func:`fit_2pl` of a bank that every task may hold: an evaluation is one pass over the models, the steps are at the driver."""
    spark = cells.sparkSession
    table = start.toPandas().sort_values("key")
    items = table["key"].to_numpy()[::2] // 2
    none = spark.createDataFrame([], "item_idx long, a double, b double"), spark.createDataFrame([], "model string, theta double"), Trace()
    if not len(items):
        return none
    packed = packed_answers(cells, runs=F.lit(1).cast("long"))

    def at(x: np.ndarray) -> Banks:
        a = np.exp(np.clip(x[::2], -STEEPEST, STEEPEST))
        return Banks(items, np.zeros((1, len(items)), int), a[None], (a * x[1::2])[None])

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        bank, log_a, hard = at(x), x[::2], x[1::2]
        sums, lost = bank_sums(packed, bank)
        r, u = sums[0, :, 0], sums[0, :, 2]
        g = np.empty_like(x)
        g[::2] = u - bank.b[0] * r + log_a / sigma_log_a**2
        g[1::2] = -bank.a[0] * r + hard / sigma_b**2
        return float(lost[0] + (log_a**2).sum() / (2 * sigma_log_a**2) + (hard**2).sum() / (2 * sigma_b**2)), g

    x, trace = minimise_small(table["x"].to_numpy(float), table["h"].to_numpy(float), evaluate, tol, rounds)
    bank = at(x)
    out = spark.createDataFrame(pd.DataFrame({"item_idx": items, "a": bank.a[0], "b": x[1::2]}), "item_idx long, a double, b double")
    return out, written(bank_abilities(packed, bank).select("model", "theta"), "fit_theta"), trace


def packed_answers(cells: DataFrame, **masks: Column) -> DataFrame:
    """One row for each model of ``cells(model, item_idx, y)``: its items, answers and, for each name, a long whose bit r tells of run r."""
    of = {"item_idx": F.col("item_idx").cast("long"), "y": F.col("y").cast("double"), **masks}
    rows = cells.where("y is not null").select("model", F.struct(*(c.alias(n) for n, c in of.items())).alias("c"))
    # many small passes over few rows: as many parts as there are cores, whatever their bytes
    rows = rows.repartition(2 * cells.sparkSession.sparkContext.defaultParallelism, "model")
    return written(rows.groupBy("model").agg(F.collect_list("c").alias("c")).select("model", *(F.col(f"c.{n}").alias(n) for n in of)), "answers")


def _slices(batches):
    """The batches in pieces whose answers stay in a core's cache."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


@dataclass
class Banks:
    """The banks of all runs at one point, each (runs x items) in the order of ``items``: logit = a * theta[dim] - b."""

    items: np.ndarray
    dim: np.ndarray
    a: np.ndarray
    b: np.ndarray

    def flat(self, batch: pa.RecordBatch, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place of the item, y, mask) of the answers to items of the bank in a batch of :func:`packed_answers`."""
        lists = batch.column(batch.schema.get_field_index("item_idx"))
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        item, y, bits = (batch.column(batch.schema.get_field_index(n)).flatten().to_numpy(zero_copy_only=False) for n in ("item_idx", "y", mask))
        at = np.minimum(np.searchsorted(self.items, item), len(self.items) - 1)
        known = self.items[at] == item
        return row[known], at[known], y[known], bits[known]

    def solve(self, run: int, n: int, row: np.ndarray, item: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """theta (n x dims) by the Newton steps of ``map_ability``, with each answer's place in it and which of it have answers."""
        dims = int(self.dim.max()) + 1
        key, a, b = row * dims + self.dim[run, item], self.a[run, item], self.b[run, item]
        has = np.bincount(key, minlength=n * dims) > 0
        theta, open_ = np.zeros(n * dims), has.copy()
        for _ in range(NEWTON):
            p = _sigmoid(a * theta[key] - b)
            g = np.bincount(key, a * (y - p), n * dims) - theta
            move = np.clip(theta + g / (np.bincount(key, a * a * p * (1 - p), n * dims) + 1), -BOUND, BOUND)
            move, theta = np.abs(move - theta), np.where(open_, move, theta)
            open_ &= ~(move < SMALL)
            if not open_.any():
                break
        return theta, key, has


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1, e) / (1 + e)


#: Sums for each item: p - y, p (1 - p), and these times a theta, and p (1 - p) times its square.
SUMS = ("r", "q", "u", "c", "uu")


def bank_sums(packed: DataFrame, banks: Banks) -> tuple[np.ndarray, np.ndarray]:
    """(runs x items x SUMS) at the best abilities, and the models' part of the objective of each run.

    One pass over the models; each task adds up its own, and Spark adds those of the tasks. What arrives has the size of the banks.
    """
    runs, n = banks.a.shape

    def partial(batches):
        sums, lost = np.zeros((runs, len(SUMS), n)), np.zeros(runs)
        for batch in _slices(batches):
            row, item, y, mask = banks.flat(batch, "runs")
            for run in range(runs):
                on = np.flatnonzero((mask >> run) & 1)
                r, i, v = row[on], item[on], y[on]
                theta, key, _ = banks.solve(run, batch.num_rows, r, i, v)
                u = banks.a[run, i] * theta[key]
                z = u - banks.b[run, i]
                p = _sigmoid(z)
                q = p * (1 - p)
                for k, x in enumerate((p - v, q, (p - v) * u, q * u, q * u * u)):
                    sums[run, k] += np.bincount(i, x, n)
                lost[run] += (np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - v * z).sum() + (theta * theta).sum() / 2
        at = np.arange(runs * n)
        yield pa.RecordBatch.from_pydict({"at": np.r_[at, -1 - np.arange(runs)], **{c: np.r_[sums[:, k].ravel(), lost if k == 0 else np.zeros(runs)] for k, c in enumerate(SUMS)}})

    each = packed.select("item_idx", "y", "runs").mapInArrow(partial, "at long, " + ", ".join(f"{c} double" for c in SUMS))
    rows = each.groupBy("at").agg(*(F.sum(c).alias(c) for c in SUMS)).toPandas()
    out, lost = np.zeros((runs * n, len(SUMS))), np.zeros(runs)
    real = rows["at"].to_numpy() >= 0
    out[rows["at"].to_numpy()[real]] = rows.loc[real, list(SUMS)].to_numpy()
    lost[-1 - rows["at"].to_numpy()[~real]] = rows.loc[~real, "r"].to_numpy()
    return out.reshape(runs, n, len(SUMS)), lost


def bank_abilities(packed: DataFrame, banks: Banks) -> DataFrame:
    """(run, model, dim, theta) of the models that have answers."""

    def each(batches):
        dims = int(banks.dim.max()) + 1
        for batch in _slices(batches):
            row, item, y, mask = banks.flat(batch, "runs")
            models = np.array(batch.column(batch.schema.get_field_index("model")).to_pylist(), object)
            for run in range(len(banks.a)):
                on = np.flatnonzero((mask >> run) & 1)
                theta, _, has = banks.solve(run, batch.num_rows, row[on], item[on], y[on])
                at = np.flatnonzero(has)
                yield pa.RecordBatch.from_pydict({"run": np.full(len(at), run, np.int32), "model": pa.array(models[at // dims], pa.string()), "dim": (at % dims).astype(np.int32), "theta": theta[at]})

    return packed.select("model", "item_idx", "y", "runs").mapInArrow(each, "run int, model string, dim int, theta double")


def held_out_scores(packed: DataFrame, banks: Banks, final: Banks) -> DataFrame:
    """:func:`held_out_loss` of the answers whose bit of ``held`` is set, with abilities as ``banks`` gives them under the bank ``final``."""

    def each(batches):
        out = np.zeros((len(banks.a), 3))
        for batch in _slices(batches):
            row, item, y, mask = banks.flat(batch, "runs")
            held = banks.flat(batch, "held")[3]
            for run in range(len(banks.a)):
                on, off = np.flatnonzero((mask >> run) & 1), np.flatnonzero((held >> run) & 1)
                theta, _, _ = banks.solve(run, batch.num_rows, row[on], item[on], y[on])
                i = item[off]
                key = row[off] * (int(banks.dim.max()) + 1) + banks.dim[run, i]
                p = np.clip(_sigmoid(final.a[run, i] * theta[key] - final.b[run, i]), 1e-9, 1 - 1e-9)
                right = y[off] == 1
                out[run] += len(off), -np.log(np.where(right, p, 1 - p)).sum(), ((p > 0.5) == right).sum()
        yield pa.RecordBatch.from_pydict({"run": np.arange(len(out), dtype=np.int32), "n": out[:, 0].astype(np.int64), "loss": out[:, 1], "right": out[:, 2]})

    sums = packed.select("item_idx", "y", "runs", "held").mapInArrow(each, "run int, n long, loss double, right double").groupBy("run").agg(*(F.sum(c).alias(c) for c in ("n", "loss", "right")))
    return sums.where("n > 0").select("run", "n", (F.col("loss") / F.col("n")).alias("loss"), (F.col("right") / F.col("n")).alias("accuracy"))


def explain(packed: DataFrame, features: DataFrame, groups: int, width: int, tau: float | None = 0.5, sigma_log_a: float = 0.5, sigma_beta: float = 2.0, rounds: int = 8) -> tuple[DataFrame, Banks, Banks, dict[int, dict[str, list[float]]]]:
    """:func:`fit_explanatory` over ``packed`` answers with ``runs``, and features whose runs are 0, 1, ...

    Gives the items, the banks at which the abilities were solved last and the final ones, and slopes and beta.
    A round is one pass over the answers; the banks of the runs, which every task needs, are at the driver.
    """
    table = features.select(F.col("run").cast("int"), F.col("item_idx").cast("long"), F.col("grp").cast("int"), F.col("dim").cast("int"), "x").toPandas().sort_values(["run", "item_idx"], ignore_index=True)
    runs, items = int(table["run"].max()) + 1 if len(table) else 0, np.sort(table["item_idx"].unique())
    at = (table["run"].to_numpy(), np.searchsorted(items, table["item_idx"].to_numpy()))
    grp, dim, x, known = np.zeros((runs, len(items)), int), np.zeros((runs, len(items)), int), np.zeros((runs, len(items), width)), np.zeros((runs, len(items)))
    grp[at], dim[at], known[at] = table["grp"], table["dim"], 1
    if len(table):
        x[at] = np.stack(table["x"].to_numpy())
    slope = np.zeros((runs, len(items), groups))
    slope[(*at, grp[at])] = 1
    beta, log_a, eps = np.zeros((runs, width)), np.zeros((runs, groups)), np.zeros((runs, len(items)))
    both = np.concatenate([x, slope], axis=2)

    def banks() -> Banks:
        return Banks(items, dim, np.take_along_axis(np.exp(log_a), grp, axis=1), (x @ beta[:, :, None])[:, :, 0] + eps)

    before = banks()
    for _ in range(rounds if runs else 0):
        before = banks()
        r, q, u, c, uu = np.moveaxis(bank_sums(packed, before)[0] * known[:, :, None], 2, 0)
        for run in range(runs):
            # design and slopes; with residuals these are eliminated item by item, so that the step is that of all together
            v = np.concatenate([x[run] * q[run][:, None], -slope[run] * c[run][:, None]], axis=1)
            h = both[run].T @ v
            h[width:] = np.concatenate([-(slope[run] * c[run][:, None]).T @ x[run], (slope[run] * uu[run][:, None]).T @ slope[run]], axis=1)
            g = np.concatenate([-x[run].T @ r[run], slope[run].T @ u[run]])
            own = q[run] + (1 / tau**2 if tau is not None else 0)
            if tau is not None:
                h, g = h - (v / own[:, None]).T @ v, g - v.T @ ((eps[run] / tau**2 - r[run]) / own)
            h += np.diag([1 / sigma_beta**2] * width + [1 / sigma_log_a**2] * groups)
            g += np.concatenate([beta[run] / sigma_beta**2, log_a[run] / sigma_log_a**2])
            move = np.clip(-np.linalg.solve(h, g), -REACH, REACH)
            if tau is not None:
                step = (r[run] - eps[run] / tau**2 - q[run] * (x[run] @ move[:width]) + c[run] * move[width:][grp[run]]) / own
                eps[run] += np.clip(step, -REACH, REACH) * known[run]
            beta[run] += move[:width]
            log_a[run] += move[width:]
    final = banks()
    rows = pd.DataFrame({"run": at[0], "item_idx": table["item_idx"], "grp": grp[at], "dim": dim[at], "a": final.a[at], "fixed": (final.b - eps)[at], "eps": eps[at]})
    out = packed.sparkSession.createDataFrame(rows, "run int, item_idx long, grp int, dim int, a double, fixed double, eps double") if len(rows) else packed.sparkSession.createDataFrame([], "run int, item_idx long, grp int, dim int, a double, fixed double, eps double")
    return out, before, final, {k: {"slopes": np.exp(log_a[k]).tolist(), "beta": beta[k].tolist()} for k in range(runs)}


def fit_explanatory(cells: DataFrame, features: DataFrame, groups: int, width: int, tau: float | None = 0.5, sigma_log_a: float = 0.5, sigma_beta: float = 2.0, rounds: int = 8) -> tuple[DataFrame, DataFrame, dict[int, dict[str, list[float]]]]:
    """Item difficulties explained by features: logit = a[grp] * theta[dim] - (x . beta + eps).

    ``cells(run, model, item_idx, y)`` holds one table of answers for each run (folds, splits, variants: up to 63
    are fitted side by side), numbered from 0, ``features(run, item_idx, grp, dim, x)`` the items: grp below ``groups`` shares
    a slope, dim is the ability it loads on, x has ``width`` values. ``tau`` is the spread of the residuals
    eps, None for none. Null answers don't count.
    Returns items(run, item_idx, grp, dim, a, fixed, eps) for all items and runs, an item without answers
    having eps 0; abilities(run, model, dim, theta); and for each run its slopes and beta.
    """
    packed = packed_answers(cells, runs=F.expr("shiftleft(1L, CAST(run AS INT))"))
    items, before, _, values = explain(packed, features, groups, width, tau, sigma_log_a, sigma_beta, rounds)
    return items, bank_abilities(packed, before), values


def held_out_loss(cells: DataFrame, items: DataFrame, theta: DataFrame) -> DataFrame:
    """(run, n, loss, accuracy) of the answers ``cells(run, model, item_idx, y)`` under a fit of other answers.

    A model or dimension without answers in the fit has ability 0; probabilities are cut at 1e-9.
    """
    rows = cells.where("y is not null").join(items, ["run", "item_idx"]).join(theta, ["run", "model", "dim"], "left")
    p = sigmoid(F.col("a") * F.coalesce("theta", F.lit(0.0)) - F.col("fixed") - F.col("eps"))
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    scored = rows.select("run", "y", p.alias("p"))
    loss = -F.avg(F.when(F.col("y") == 1, F.ln("p")).otherwise(F.ln(1 - F.col("p"))))
    return scored.groupBy("run").agg(F.count(F.lit(1)).alias("n"), loss.alias("loss"), F.avg(((F.col("p") > 0.5) == (F.col("y") == 1)).cast("double")).alias("accuracy"))
