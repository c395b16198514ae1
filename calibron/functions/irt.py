"""Item response theory as Column expressions (2PL: logit = a * (theta - b))."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUND = 6.0
#: Newton stops after a step shorter than this.
SMALL = 1e-9


def sigmoid(z: Column) -> Column:
    """Stable at both ends: exp is only taken of what is not positive."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def prob(theta: Column, a: Column, b: Column) -> Column:
    return sigmoid(a * (theta - b))


def information(theta: Column, a: Column, b: Column) -> Column:
    p = prob(theta, a, b)
    return a * a * p * (1 - p)


def _sums(cells: Column, theta: Column, offset: bool) -> Column:
    """Gradient and information of a cell list (a, b, y) at theta; ``offset``: logit = a * theta - b."""
    zero = F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("i"))

    def add(acc: Column, c: Column) -> Column:
        p = sigmoid(c["a"] * theta - c["b"]) if offset else prob(theta, c["a"], c["b"])
        return F.struct((acc["g"] + c["a"] * (c["y"] - p)).alias("g"), (acc["i"] + c["a"] * c["a"] * p * (1 - p)).alias("i"))

    return F.aggregate(cells, zero, add)


def map_ability(cells: Column, prior_sd: float = 1.0, steps: int = 25, offset: bool = False) -> Column:
    """struct(theta, se): the MAP ability of an array of (a, b, y) under N(0, prior_sd), by Newton steps
    from 0, clipped to +-6. An empty array gives (0, prior_sd). A step after one of less than ``SMALL`` costs nothing."""
    w = 1 / prior_sd**2

    def move(th: Column) -> Column:
        return F.transform(F.array(_sums(cells, th, offset)), lambda s: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), th + (s["g"] - th * w) / (s["i"] + w))))[0]

    def step(now: Column, _: Column) -> Column:
        moved = F.transform(F.array(move(now["theta"])), lambda th: F.struct(th.alias("theta"), (F.abs(th - now["theta"]) < SMALL).alias("still")))[0]
        return F.when(now["still"], now).otherwise(moved)

    start = F.struct(F.lit(0.0).alias("theta"), F.lit(False).alias("still"))
    theta = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda now: now["theta"])
    return F.transform(F.array(theta), lambda th: F.struct(th.alias("theta"), (1 / F.sqrt(_sums(cells, th, offset)["i"] + w)).alias("se")))[0]


def se_reduction(se: Column, info: Column) -> Column:
    """Expected drop of the standard error from one more item of this information."""
    return se - 1 / F.sqrt(1 / (se * se) + info)


def nearest_priority(n: Column, se: Column, info: Column, min_items: int, se_target: float) -> Column:
    """Minus the calls that a session still needs, as far as this item's information tells."""
    return -F.greatest(F.lit(float(min_items)) - n, F.greatest(F.lit(0.0), F.lit(1 / se_target**2) - 1 / (se * se)) / F.greatest(info, F.lit(1e-9)))


def stops(n: Column, pool: Column, se: Column, min_items: int = 5, max_items: int = 100, se_target: float = 0.3) -> Column:
    """Whether a session stops: the pool or the limit is used up, or the error is strictly below its target."""
    return (n >= F.least(F.lit(max_items), pool)) | ((n >= min_items) & (se < se_target))
