"""Embedding whitening by a tall-skinny QR.

The entries of a vector become whole numbers x = floor(64 c) + 1000000, so their sums are exact and every
row is centred, (n x - S) / n, before anything is multiplied. The distinct x vectors are the rows of a tall
matrix: each task reduces its rows to an R factor, R factors are merged in a tree of ``FAN`` at a time, and
the singular values and right vectors of the last R are those of the whole matrix. No covariance is formed.

What reaches the driver is bounded by the dimension d of the vectors: d sums, one R of d x d and the sums of
one covariance of the whitened columns.

Defined results: rows whose vector is null or holds a null or a non-finite entry are dropped; a vector shorter
than the longest counts as ending in zeros (x = 1000000), a vector without entries too; 64 c beyond 2**53 in
size counts as 2**53; repeated rows stay repeated and weigh once in the fit, equal vectors get equal results;
components without variance (a singular value that is zero in double precision) don't exist, so a table
whose vectors are all equal, a table of one vector and an empty table give no rows; a deviation beyond 64 bits
is null; vec_id may be null; further columns, whatever their names, are ignored by :func:`whitened`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibron.llm.common import columns_of, written

#: R factors that one task of the tree merges.
FAN = 16
#: Rows that meet an R factor at a time.
ROWS = 4096
SHIFT, STEPS, LARGEST = 1_000_000, 64.0, float(1 << 53)


@dataclass(frozen=True)
class Whitening:
    """What the fit found: ``n`` distinct vectors, their exact ``sums``, unit ``components`` (one a row) by falling ``variance``."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variance: np.ndarray
    total: float


def quantised(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``x``, the whole numbers of each usable vector, instead of ``vector``; the other columns stay."""
    e = F.col(f"`{vector}`")
    usable = e.isNotNull() & ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    step = lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double") * STEPS))).cast("long") + SHIFT
    return rows.where(usable).select(*(F.col(f"`{c}`") for c in rows.columns if c != vector), F.transform(e, step).alias("x"))


def padded(rows: DataFrame, width: int) -> DataFrame:
    """``x`` brought to ``width`` entries."""
    return rows.withColumn("x", F.when(F.size("x") < width, F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x")))).otherwise(F.col("x")))


def _matrix(column, width: int) -> np.ndarray:
    """The rows of an Arrow list column of ``width`` entries each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _off(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, as 64-bit integers where these hold it, else as Python integers."""
    most = int(np.abs(x).max(initial=0))
    fits = n * most + max(map(abs, sums), default=0) < 1 << 62
    kind = np.int64 if fits else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def _deviation(off: np.ndarray) -> list[int | None]:
    most = max(map(abs, (int(off.max(initial=0)), int(off.min(initial=0)))))
    if off.dtype != object and most * most * off.shape[1] < 1 << 63:
        return (off * off).sum(axis=1).tolist()
    return [d if d < 1 << 63 else None for d in ((row.astype(object) ** 2).sum() for row in off)]


def _centred(off: np.ndarray, n: int) -> np.ndarray:
    return (off / n).astype(float)


def _sums(fit: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    """The number of rows and the exact sum of each dimension: one row a task, then ``width`` rows."""
    import pyarrow as pa

    def part(batches):
        n, total = 0, [0] * width
        for b in batches:
            x = _matrix(b.column(0), width)
            n += len(x)
            wide = int(np.abs(x).max(initial=0)) * len(x) >= 1 << 63
            total = [t + int(s) for t, s in zip(total, (x.astype(object) if wide else x).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([list(map(str, total))], pa.list_(pa.string()))], names=["n", "sums"])

    parts = fit.mapInArrow(part, "n long, sums array<string>")
    found = parts.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    return (int(found[0]["n"]) if found else 0), tuple(int(r["s"]) for r in found)


def _reduced(blocks) -> np.ndarray | None:
    """R of all rows of ``blocks``, which are taken ``ROWS`` at a time."""
    r = None
    for block in blocks:
        for at in range(0, len(block), ROWS):
            part = block[at : at + ROWS]
            r = np.linalg.qr(part if r is None else np.vstack((r, part)), mode="r")
    return r


def _r_factor(fit: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """The R factor of all centred rows: one a task, then merged ``FAN`` at a time."""
    import pyarrow as pa

    width = len(sums)

    def row(node: int, r: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["node", "r"])

    def part(batches):
        r = _reduced(_centred(_off(_matrix(b.column(0), width), n, sums), n) for b in batches if b.num_rows)
        if r is not None:
            yield row(TaskContext.get().partitionId(), r)

    def merge(table):
        order = np.argsort(table.column("node").to_numpy())
        factors = table.column("r").to_pylist()
        r = _reduced(np.frombuffer(factors[k]).reshape(-1, width) for k in order)
        return pa.Table.from_batches([row(table.column("up")[0].as_py(), r)])

    nodes = written(fit.mapInArrow(part, "node long, r binary"), "whitening_r")
    while nodes.agg(F.count(F.lit(1))).first()[0] > 1:
        up = nodes.withColumn("up", F.floor(F.col("node") / FAN))
        nodes = written(up.groupBy("up").applyInArrow(merge, "node long, r binary"), "whitening_r")
    return np.frombuffer(nodes.first()["r"]).reshape(-1, width)


def fitted(fit: DataFrame, width: int, most: int = 16) -> Whitening:
    """The whitening of the rows of ``fit(x)``, up to ``most`` components."""
    n, sums = _sums(fit, width) if width else (0, ())
    if not n:
        return Whitening(0, sums, np.zeros((0, width)), np.zeros(0), 0.0)
    _, s, components = np.linalg.svd(_r_factor(fit, n, sums), full_matrices=False)
    real = int((s > s[0] * np.finfo(float).eps * max(n, width)).sum()) if len(s) else 0
    return Whitening(n, sums, components[: min(real, most)], s[: min(real, most)] ** 2 / n, float((s**2).sum() / n))


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """The largest entry, in size, of the whitened fit list's covariance minus the identity."""
    import pyarrow as pa

    width, k = len(w.sums), len(w.variance)
    scale = w.components.T / np.sqrt(w.variance)

    def part(batches):
        total = np.zeros(k + k * k)
        for b in batches:
            z = _centred(_off(_matrix(b.column(0), width), w.n, w.sums), w.n) @ scale
            total += np.concatenate((z.sum(axis=0), (z.T @ z).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["t"])

    rows = fit.mapInArrow(part, "t array<double>").select(F.posexplode("t").alias("at", "t")).groupBy("at").agg(F.sum("t").alias("t")).orderBy("at").collect()
    total = np.array([r["t"] for r in rows]) / w.n
    mean, second = total[:k], total[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whitened(embeddings: DataFrame, most: int = 16, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Whitening, float]:
    """(``key``, deviation, whitened array) of every usable row, the whitening, and its identity error."""
    import pyarrow as pa

    rows = quantised(columns_of(embeddings, key, vector), vector)
    width = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    rows = padded(rows, width)
    fit = written(rows.select("x").distinct(), "whitening_fit")
    w = fitted(fit, width, most)
    error = identity_error(fit, w) if len(w.variance) else 0.0
    schema = f"`{key}` {embeddings.schema[key].dataType.simpleString()}, deviation long, whitened array<double>"
    if not len(w.variance):
        return embeddings.sparkSession.createDataFrame([], schema), w, error
    scale = w.components.T / np.sqrt(w.variance)

    def apply(batches):
        for b in batches:
            off = _off(_matrix(b.column("x"), width), w.n, w.sums)
            z = _centred(off, w.n) @ scale
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(_deviation(off), pa.int64()), pa.array(list(z), pa.list_(pa.float64()))], names=[key, "deviation", "whitened"])

    return rows.mapInArrow(apply, schema), w, error


def whitening_query(embeddings: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    rows, w, error = whitened(embeddings)
    share = F.array(*(F.lit(float(e / w.total)) for e in w.variance)).cast("array<double>")
    each = rows.select("vec_id", F.lit(w.n).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
