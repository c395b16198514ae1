"""Fits that explain item difficulties by features, their cross-validation, exports and calibrated halves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibron.operators import fitting
from calibron.plans.more_queries import scratch
from calibron.plans.registry import query
from calibron.sources import files
from calibron.sources.scratch import written

#: Features of the size: standardised, its standardised logarithm, and both for items of dimension 0 only.
SIZES = 4


def design(items: DataFrame) -> tuple[DataFrame, list[str]]:
    """(item_idx, scene, grp, dim, x) and the names of x: one value for each subtask, then the sizes.

    The number of subtasks is the width of the design, so their names may be at the driver.
    """
    subtasks = sorted(r["subtask"] for r in items.select("subtask").distinct().collect())
    stats = items.agg(*(f(c).alias(f"{k}{n}") for n, c in enumerate((F.col("p_size"), F.ln("p_size"))) for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    z, log_z = (F.col("p_size") - F.col("m0")) / F.col("s0"), (F.ln("p_size") - F.col("m1")) / F.col("s1")
    zero = (F.col("dim") == 0).cast("double")
    x = F.array(*((F.col("subtask") == s).cast("double") for s in subtasks), z, log_z, z * zero, log_z * zero)
    grp = (F.array_position(F.array(*(F.lit(s) for s in subtasks)), F.col("subtask")) - 1).cast("int")
    rows = items.crossJoin(F.broadcast(stats)).select("item_idx", F.col("p_size").alias("scene"), grp.alias("grp"), F.col("dim").cast("int").alias("dim"), x.alias("x"))
    return written(rows, "design"), [*subtasks, "size", "log_size", "size_dim0", "log_size_dim0"]


def fitted(d, split=None, splits: int = 1):
    """Design, names and fit with residuals of all answers, or for each split of those that ``split(run)`` names."""
    features, names = design(d.items)
    runs = d.spark.range(splits).select(F.col("id").cast("int").alias("run"))
    cells = d.responses.select("model", "item_idx", "y").join(features.select("item_idx", "scene"), "item_idx").crossJoin(F.broadcast(runs))
    cells = (cells if split is None else cells.where(split)).select("run", "model", "item_idx", "y")
    return features, names, fitting.fit_explanatory(cells, features.crossJoin(F.broadcast(runs)), len(names) - SIZES, len(names))


@query("m25_explanatory_fit")
def m25(d):
    """Slopes, weights of the features and the spread of the residuals of the two-dimensional fit."""
    _, names, (items, _, values) = fitted(d)
    rows = [("weight", n, v) for n, v in zip(names, values[0]["beta"], strict=True)] + [("slope", n, v) for n, v in zip(names, values[0]["slopes"], strict=False)]
    known = d.spark.createDataFrame(rows, "kind string, name string, value double")
    spread = items.select(F.lit("residual").alias("kind"), F.lit("sd").alias("name"), "eps").groupBy("kind", "name").agg(F.stddev_pop("eps").alias("value"))
    return known.unionByName(spread).withColumn("value", F.round("value", 4))


@query("x9_bank_export")
def x9(d):
    """The fit written as item banks, with the residuals and by features alone, and read back."""
    _, _, (items, _, _) = fitted(d)
    out = None
    for only in (False, True):
        path = scratch(d, "export")
        b = F.col("fixed") if only else F.col("fixed") + F.col("eps")
        files.write_bank(items.join(d.items.select("item_idx", "item_id"), "item_idx").select("item_idx", "item_id", "a", b.alias("b"), "dim"), path)
        bank = files.item_bank(d.spark, path).select("item_idx", "item_id", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), "dim", F.lit(only).alias("features_only"))
        out = bank if out is None else out.unionByName(bank)
    return out


def drawn(*keys) -> F.Column:
    """A number below 2**31 drawn by a hash of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(2**31))


def pool_half() -> F.Column:
    """Whether a scene belongs to the pool of its split; the other half calibrates."""
    return drawn("run", "scene") % 2 == 0


@query("e8_half_split")
def e8(d):
    """Three splits of the scenes: the bank of each pool as the answers to the other half calibrate it."""
    features, _, (items, _, _) = fitted(d, ~pool_half(), 3)
    pool = items.join(features.select("item_idx", "scene"), "item_idx").where(pool_half())
    return pool.select(F.col("run").alias("split"), "item_idx", F.round("a", 4).alias("a"), F.round(F.col("fixed") + F.col("eps"), 4).alias("b"), "dim")


FOLDS = 5
#: name -> (dimensions, features of the size, residuals).
VARIANTS = {
    "subtask": (1, False, None),
    "features": (1, True, None),
    "features, two dimensions": (2, True, None),
    "features and residuals": (1, True, 0.5),
    "features and residuals, two dimensions": (2, True, 0.5),
}


@query("e7_explanatory_folds")
def e7x(d):
    """Held-out loss of the variants over five folds, by cell and by scene; the folds and variants with the
    same kind of residuals are one fit, a run each."""
    features, names = design(d.items)
    cells = d.responses.select("model", "item_idx", "y").join(features.select("item_idx", "scene"), "item_idx")
    folds = {"cells": drawn("model", "item_idx") % FOLDS, "scenes": drawn(F.lit("fold"), "scene") % FOLDS}
    plain = F.transform("x", lambda v, i: F.when(i < len(names) - SIZES, v).otherwise(F.lit(0.0)))
    out = None
    for tau in (None, 0.5):
        runs = [(n, v, s, f) for n, (v, s, f) in enumerate((v, s, f) for v, (_, _, t) in VARIANTS.items() if t == tau for s in ("cells", "scenes") for f in range(FOLDS))]
        table = F.broadcast(d.spark.createDataFrame([(*r, VARIANTS[r[1]][0], VARIANTS[r[1]][1]) for r in runs], "run int, variant string, split string, fold int, dims int, sizes boolean"))
        bits = {(s, f): sum(1 << n for n, _, s2, f2 in runs if (s2, f2) == (s, f)) for s in folds for f in range(FOLDS)}
        held = reduce(Column.bitwiseOR, (F.element_at(F.array(*(F.lit(bits[s, f]).cast("long") for f in range(FOLDS))), (fold + 1).cast("int")) for s, fold in folds.items()))
        packed = fitting.packed_answers(cells, held=held, runs=held.bitwiseXOR(F.lit((1 << len(runs)) - 1).cast("long")))
        x = features.crossJoin(table).select("run", "item_idx", "grp", F.when(F.col("dims") == 2, F.col("dim")).otherwise(F.lit(0)).alias("dim"), F.when(F.col("sizes"), F.col("x")).otherwise(plain).alias("x"))
        _, solved, final, _ = fitting.explain(packed, x, len(names) - SIZES, len(names), tau, rounds=6)
        scored = fitting.held_out_scores(packed, solved, final).join(table, "run")
        out = scored if out is None else out.unionByName(scored)
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 4).alias(c)
    return out.groupBy("variant", "split").agg(F.sum("n").alias("n"), mean("loss"), mean("accuracy"))
