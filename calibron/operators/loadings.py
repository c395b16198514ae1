"""Posteriors, scores and variances for items that load on several dimensions at once.

An item has a loading vector and an intercept, its logit is loadings . theta - b. The normal equations of a model
are one pass over its packed answers: gradient and lower triangle of the information as one struct, solved by
a Cholesky factor written out as Column expressions (``dims`` is a small number of the design). One more answer
is a rank-one change of the inverse, so its effect on the score's variance is a closed form in each row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibron.functions.irt import BOUND, SMALL, sigmoid
from calibron.sources.scratch import with_every_item, written

#: Loading vectors longer than this make expressions that are too large to be worth compiling.
MOST_DIMS = 6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _lower(dims: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(dims) for j in range(i + 1)]


def _dot(a: list[Column], b: list[Column]) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        total = total + x * y
    return total


def _vector(c: Column, dims: int, name: str) -> list[Column]:
    return [c[f"{name}{d}"] for d in range(dims)]


def _normal_sums(cells: Column, theta: list[Column], dims: int) -> Column:
    """struct(g0.., h00, h10, h11, ..): gradient of the likelihood, and information plus the prior's identity."""
    start = F.struct(*(F.lit(0.0).alias(f"g{d}") for d in range(dims)), *(F.lit(1.0 if i == j else 0.0).alias(f"h{i}{j}") for i, j in _lower(dims)))

    def add(acc: Column, c: Column) -> Column:
        load = [c["l"][d] for d in range(dims)]

        def of(p: Column) -> Column:
            q = p * (1 - p)
            return F.struct(*((acc[f"g{d}"] + load[d] * (c["y"] - p)).alias(f"g{d}") for d in range(dims)), *((acc[f"h{i}{j}"] + q * load[i] * load[j]).alias(f"h{i}{j}") for i, j in _lower(dims)))

        return let(sigmoid(_dot(load, theta) - c["b"]), of)

    return F.aggregate(cells, start, add)


def cholesky(h: Column, dims: int, body: Callable[[dict[tuple[int, int], Column]], Column]) -> Column:
    """``body(L)`` for the lower factor L of the positive definite matrix whose lower triangle h has as h00, h10, h11, ..."""

    def entry(k: int, known: dict) -> Column:
        cells = _lower(dims)
        if k == len(cells):
            return body(known)
        i, j = cells[k]
        value = h[f"h{i}{j}"]
        for m in range(j):
            value = value - known[i, m] * known[j, m]
        value = F.sqrt(value) if i == j else value / known[j, j]
        return let(value, lambda x: entry(k + 1, known | {(i, j): x}))

    return entry(0, {})


def solved(low: dict[tuple[int, int], Column], right: list[Column], body: Callable[[list[Column]], Column]) -> Column:
    """``body(x)`` for L L' x = right, by forward and backward substitution."""
    dims = len(right)

    def forward(i: int, y: list[Column]) -> Column:
        if i == dims:
            return backward(dims - 1, y, {})
        value = right[i]
        for m in range(i):
            value = value - low[i, m] * y[m]
        return let(value / low[i, i], lambda v: forward(i + 1, [*y, v]))

    def backward(i: int, y: list[Column], x: dict[int, Column]) -> Column:
        if i < 0:
            return body([x[d] for d in range(dims)])
        value = y[i]
        for m in range(i + 1, dims):
            value = value - low[m, i] * x[m]
        return let(value / low[i, i], lambda v: backward(i - 1, y, x | {i: v}))

    return forward(0, [])


def _newton(cells: Column, dims: int, steps: int) -> Column:
    """The MAP abilities of packed cells (l, b, y) as struct(t0, ..)."""

    def step(now: Column, _: Column) -> Column:
        theta = _vector(now, dims, "t")

        def moved(sums: Column) -> Column:
            grad = [sums[f"g{d}"] - theta[d] for d in range(dims)]

            def to(x: list[Column]) -> Column:
                still = F.abs(x[0]) < SMALL
                for v in x[1:]:
                    still = still & (F.abs(v) < SMALL)
                return F.struct(*(F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), theta[d] + x[d])).alias(f"t{d}") for d in range(dims)), still.alias("still"))

            return cholesky(sums, dims, lambda low: solved(low, grad, to))

        return F.when(now["still"], now).otherwise(let(_normal_sums(cells, theta, dims), moved))

    start = F.struct(*(F.lit(0.0).alias(f"t{d}") for d in range(dims)), F.lit(False).alias("still"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def _inverse(h: Column, dims: int) -> Column:
    """struct(s00, s10, s11, ..): the lower triangle of the inverse, a column of it for each unit vector."""
    unit = lambda j: [F.lit(1.0 if i == j else 0.0) for i in range(dims)]

    def columns(low: dict, j: int, made: dict) -> Column:
        if j == dims:
            return F.struct(*(made[i, k].alias(f"s{i}{k}") for i, k in _lower(dims)))
        return solved(low, unit(j), lambda x: columns(low, j + 1, made | {(i, j): x[i] for i in range(j, dims)}))

    return cholesky(h, dims, lambda low: columns(low, 0, {}))


def posteriors(answers: DataFrame, dims: int, steps: int = 50) -> DataFrame:
    """(model, theta, cov) of ``answers(model, loadings, b, y)``: MAP under N(0, I), clipped to +-6, and the Laplace covariance.

    ``theta`` has ``dims`` entries, ``cov`` the rows of the lower triangle. What is gathered for a model is its
    answers, at most one for each item of the bank.
    """
    if not 1 <= dims <= MOST_DIMS:
        raise ValueError(f"dims is 1 to {MOST_DIMS}, not {dims}")
    packed = answers.groupBy("model").agg(F.collect_list(F.struct(F.col("loadings").alias("l"), "b", F.col("y").cast("double").alias("y"))).alias("cells"))
    fitted = packed.withColumn("t", _newton(F.col("cells"), dims, steps))
    theta = _vector(F.col("t"), dims, "t")
    cov = let(_normal_sums(F.col("cells"), theta, dims), lambda h: let(_inverse(h, dims), lambda s: F.array(*(s[f"s{i}{j}"] for i, j in _lower(dims)))))
    return fitted.select("model", F.array(*theta).alias("theta"), cov.alias("cov"))


def _cov(dims: int) -> list[list[Column]]:
    place = {c: k for k, c in enumerate(_lower(dims))}
    return [[F.col("cov")[place[max(i, j), min(i, j)]] for j in range(dims)] for i in range(dims)]


def pool_rows(bank: DataFrame, answers: DataFrame, dims: int) -> DataFrame:
    """Each model's row for each item of ``bank(item_idx, loadings, b, w)``: y (null: unanswered), p, q = p (1 - p), theta and cov.

    The answers are read twice, so they should be written.
    """
    post = posteriors(answers, dims)
    rows = with_every_item(post, bank.select("item_idx", "loadings", "b", "w")).join(answers.select("model", "item_idx", "y"), ["model", "item_idx"], "left")
    z = _dot([F.col("loadings")[d] for d in range(dims)], [F.col("theta")[d] for d in range(dims)]) - F.col("b")
    return rows.withColumn("p", sigmoid(z)).withColumn("q", F.col("p") * (1 - F.col("p")))


def _pulls(rows: DataFrame, dims: int) -> DataFrame:
    un = F.col("y").isNull()
    pull = [F.coalesce(F.sum(F.when(un, F.col("w") * F.col("q") * F.col("loadings")[d])), F.lit(0.0)) for d in range(dims)]
    score = F.sum(F.col("w") * F.coalesce(F.col("y").cast("double"), F.col("p")))
    own = F.coalesce(F.sum(F.when(un, F.col("w") * F.col("w") * F.col("q"))), F.lit(0.0))
    return rows.groupBy("model").agg(score.alias("s"), F.array(*pull).alias("g"), own.alias("bern"), F.any_value("cov").alias("cov"))


def scores(rows: DataFrame, dims: int) -> DataFrame:
    """(model, s, v): the expected pool score and its variance from :func:`pool_rows`."""
    g, cov = [F.col("g")[d] for d in range(dims)], _cov(dims)
    v = _dot(g, [_dot(cov[i], g) for i in range(dims)]) + F.col("bern")
    return _pulls(rows, dims).select("model", "s", F.greatest(v, F.lit(1e-12)).alias("v"))


def variances_after(rows: DataFrame, dims: int) -> DataFrame:
    """(model, item_idx, v_new) for each unanswered item: the score's variance once it is answered.

    The item leaves the pull of the open items, and its answer changes the covariance by one rank.
    """
    sums = _pulls(rows, dims).select("model", "g", "bern")
    open_ = rows.where("y is null").join(sums, "model")
    cov, load = _cov(dims), [F.col("loadings")[d] for d in range(dims)]
    named = open_.withColumn("u", F.array(*(_dot(cov[i], load) for i in range(dims)))).withColumn("left", F.array(*(F.col("g")[d] - F.col("w") * F.col("q") * load[d] for d in range(dims))))
    left, u = [F.col("left")[d] for d in range(dims)], [F.col("u")[d] for d in range(dims)]
    spread = _dot(left, [_dot(cov[i], left) for i in range(dims)])
    along, length = _dot(left, u), _dot(load, u)
    v = spread - F.col("q") * along * along / (1 + F.col("q") * length) + F.col("bern") - F.col("w") * F.col("w") * F.col("q")
    return named.select("model", "item_idx", F.greatest(v, F.lit(1e-12)).alias("v_new"))


def pooled(bank: DataFrame, answers: DataFrame, dims: int) -> DataFrame:
    """:func:`pool_rows` of answers and a result that are written once, as scores and variances both read them."""
    return written(pool_rows(bank, written(answers, "answers"), dims), "pool")
