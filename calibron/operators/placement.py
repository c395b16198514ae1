"""Placement of new models among fixed anchors, judged over resampled scenes.

Anchors stand at their measured scores, new models at the scores that their few answers lead to one to expect. A
replicate keeps a share of the scenes, drawn by a hash, the same ones for all models. All replicates of a model
are worked out side by side from one copy of its answers; pairs are counted by order, not formed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibron.operators.agreement import pair_order
from calibron.sources.scratch import written


def kept_scenes(scenes: list[int], replicates: int, share: float) -> np.ndarray:
    """replicates x scenes: whether a replicate keeps a scene."""
    return np.array([[zlib.crc32(f"{r}/{s}".encode()) % 100_000 < share * 100_000 for s in scenes] for r in range(replicates)], bool).reshape(replicates, len(scenes))


def weights(kept: np.ndarray, dim: np.ndarray) -> np.ndarray:
    """replicates x items: both families share the weight, each spreads its part over the items that are kept."""
    w = np.zeros(kept.shape)
    for d in (0, 1):
        mine = kept & (dim == d)
        w += mine * (0.5 / np.maximum(mine.sum(axis=1, keepdims=True), 1))
    return w


def expected_scores(kept: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, dim: np.ndarray, asked: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each replicate the score of the kept items: answers where asked, else chances at the MAP ability of the item's dimension (logit a theta - b)."""
    p = np.zeros(kept.shape)
    for d in (0, 1):
        mine, seen = dim == d, asked[dim[asked] == d]
        theta, use = np.zeros(len(kept)), kept[:, seen]
        for _ in range(50):
            q = 1 / (1 + np.exp(-(theta[:, None] * a[seen] - b[seen])))
            move = ((use * a[seen] * (y[seen] - q)).sum(axis=1) - theta) / ((use * a[seen] ** 2 * q * (1 - q)).sum(axis=1) + 1)
            theta = np.clip(theta + move, -6, 6)
            if np.abs(move).max(initial=0) < 1e-9:
                break
        p[:, mine] = 1 / (1 + np.exp(-(theta[:, None] * a[mine] - b[mine])))
    p[:, asked] = y[asked]
    return (w * p).sum(axis=1)


def placements(cells: DataFrame, asked: DataFrame, bank: pd.DataFrame, budgets: tuple[int, ...], replicates: int = 100, share: float = 0.8) -> DataFrame:
    """(method, budget, replicate, model, is_new, truth, est) for all models.

    ``cells(model, is_new, item_idx, y)`` are all answers; the truth of a model is its weighted score of the kept
    items that it has answered, each family by its mean. ``asked(model, method, item_idx, step)`` are
    the calls to new models; budget 0 stands for none, all of them at the prior's score. ``bank`` (item_idx, scene, dim,
    a, b; dim 0 or 1) is of bounded size. A task holds the answers of one model at a time.
    """
    bank = bank.sort_values("item_idx")
    scenes = sorted(set(bank["scene"]))
    items, dim, a, b = (bank[c].to_numpy() for c in ("item_idx", "dim", "a", "b"))
    kept = kept_scenes(scenes, replicates, share)[:, np.searchsorted(scenes, bank["scene"])]
    w = weights(kept, dim)
    methods = sorted(r["method"] for r in asked.select("method").distinct().collect())

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        have = pdf[pdf["method"].isna()]
        y = np.full(len(items), np.nan)
        y[np.searchsorted(items, have["item_idx"])] = have["y"]
        known = ~np.isnan(y)
        truth = np.zeros(replicates)
        for d in (0, 1):
            mine = kept & known & (dim == d)
            n = mine.sum(axis=1)
            truth += np.where(n > 0, 0.5 * (mine * np.nan_to_num(y)).sum(axis=1) / np.maximum(n, 1), 0.25)
        new, out = bool(have["is_new"].iloc[0]), []
        for method in methods:
            order = pdf[pdf["method"] == method].sort_values("step")["item_idx"].to_numpy()
            order = np.searchsorted(items, order)
            for budget in (0, *budgets):
                est = expected_scores(kept, w, a, b, dim, order[:budget], y) if new else truth
                out.append(pd.DataFrame({"method": method, "budget": budget, "replicate": range(replicates), "model": have["model"].iloc[0], "is_new": new, "truth": truth.round(9), "est": np.asarray(est).round(9)}))
        return pd.concat(out)

    every = cells.select("model", "is_new", "item_idx", F.col("y").cast("double").alias("y"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("long").alias("step"))
    calls = asked.select("model", F.lit(True).alias("is_new"), "item_idx", F.lit(None).cast("double").alias("y"), "method", F.col("step").cast("long").alias("step"))
    return every.unionByName(calls).groupBy("model").applyInPandas(each, "method string, budget int, replicate int, model string, is_new boolean, truth double, est double")


def right_pairs(placed: DataFrame) -> DataFrame:
    """(method, budget, replicate, n_pairs, n_right) of the pairs with a new model in them.

    Anchors stand at their truth, so their pairs among themselves are all right and are taken off the count.
    """
    keys = ["method", "budget", "replicate"]
    placed = written(placed, "placements")
    anchors = placed.groupBy(*keys).agg(F.count_if(~F.col("is_new")).alias("anchors"))
    order = pair_order(placed, "est", "truth", keys).join(anchors, keys)
    own = (F.col("anchors") * (F.col("anchors") - 1) / 2).cast("long")
    return order.select(*keys, (F.col("n_pairs") - own).alias("n_pairs"), (F.col("concordant") + F.col("tied_both") - own).alias("n_right"))
