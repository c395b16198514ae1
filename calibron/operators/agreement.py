"""Agreement of two orders of the same rows without pairs of rows: distributed inversion counting.

Rows are range-partitioned by the first order into parts and by the second into ranges. An inversion is
counted where it is seen: inside its part, inside its range, or, if the two rows share neither, in the table
of part-by-range counts. So a task holds one part, one range or that table (at most ``MOST_PARTS``
squared), whatever the number of rows; ties are sums of equal values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibron.sources.scratch import written

#: Rows of a part that are aimed at, and the most parts.
PART_ROWS, MOST_PARTS = 100_000, 2048


def inversions(codes: np.ndarray, left: np.ndarray, right: np.ndarray) -> int:
    """The sum of left[i] * right[j] over i < j with codes[i] > codes[j]: bit by bit from the highest,
    each time among the rows whose higher bits agree."""
    total = 0
    for bit in range(int(codes.max(initial=0)).bit_length() - 1, -1, -1):
        group = codes >> (bit + 1)
        ones = (codes >> bit) & 1
        before = np.cumsum(left * ones) - left * ones
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        base = np.repeat(before[first], np.diff(np.append(first, len(codes))))
        total += int((right * (1 - ones) * (before - base)).sum())
        order = np.argsort(codes >> bit, kind="stable")
        codes, left, right = codes[order], left[order], right[order]
    return total


def _codes(values) -> np.ndarray:
    return np.unique(np.asarray(values, float), return_inverse=True)[1].astype(np.int64)


def crossings(rows: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, crossings): the sum of wl[i] * wr[j] over pairs of rows with i before j by (p, tie) and q[i] > q[j].

    ``rows(groups, p, tie, q, wl, wr)`` are read several times, so they should be written. Of rows with equal
    (p, tie) and different q none may weigh as i and another as j.
    """
    n = rows.count()
    parts = min(MOST_PARTS, max(1, -(-n // PART_ROWS)))
    first = written(rows.repartitionByRange(parts, *groups, "p", "tie", "q").withColumn("part", F.spark_partition_id()), "order_parts") if parts > 1 else rows.withColumn("part", F.lit(0))
    both = written(first.repartitionByRange(parts, *groups, "q", "p", "tie").withColumn("range", F.spark_partition_id()), "order_ranges") if parts > 1 else first.withColumn("range", F.lit(0))
    key = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in groups) + (", " if groups else "")

    def counted(order: list[str]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, kind="stable")
            found = inversions(_codes(pdf["q"]), pdf["wl"].to_numpy(np.int64), pdf["wr"].to_numpy(np.int64))
            return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in groups}, "found": [found]})

        return run

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros((2, parts, parts), object if pdf["wl"].sum() * float(pdf["wr"].sum()) > 2.0**62 else np.int64)
        cells[0, pdf["part"], pdf["range"]], cells[1, pdf["part"], pdf["range"]] = pdf["wl"], pdf["wr"]
        before = np.cumsum(cells[0], axis=0) - cells[0]
        above = np.cumsum(before[:, ::-1], axis=1)[:, ::-1] - before
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in groups}, "found": [int((above * cells[1]).sum())]})

    schema = f"{key}found long"
    own = both.groupBy(*groups, "part").applyInPandas(counted(["p", "tie", "q"]), schema)
    if parts > 1:
        # inside a range only pairs of different parts are new: within one part, by rising q, nothing is inverted
        same = both.groupBy(*groups, "range").applyInPandas(counted(["part", "q"]), schema)
        cells = both.groupBy(*groups, "part", "range").agg(F.sum("wl").alias("wl"), F.sum("wr").alias("wr"))
        own = own.unionByName(same).unionByName(cells.groupBy(*groups).applyInPandas(table, schema))
    return own.groupBy(*groups).agg(F.sum("found").alias("crossings"))


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def pair_order(rows: DataFrame, x: str, y: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, n_pairs, concordant, discordant, tied_x, tied_y, tied_both) over all pairs of rows of a group.

    A row with a null on either side has no place and is left out; NaN is the largest value and equals itself.
    """
    groups = groups or []
    w = F.count(F.lit(1)).alias("w")
    placed = rows.select(*groups, F.col(x).cast("double").alias("p"), F.col(y).cast("double").alias("q")).where("p is not null and q is not null")
    points = written(placed.groupBy(*groups, "p", "q").agg(w).select(*groups, "p", F.col("q").alias("tie"), "q", F.col("w").alias("wl"), F.col("w").alias("wr")), "order_points")
    tied = lambda *by: points.groupBy(*groups, *by).agg(F.sum("wl").alias("w")).groupBy(*groups).agg(F.sum(_pairs(F.col("w"))).alias("tied_" + ("both" if len(by) > 1 else {"p": "x", "q": "y"}[by[0]])))
    out = points.groupBy(*groups).agg(_pairs(F.sum("wl")).alias("n_pairs"))
    for part in (tied("p"), tied("q"), tied("p", "q"), crossings(points, groups)):
        out = out.join(part, groups) if groups else out.crossJoin(part)
    out = out.withColumn("discordant", F.coalesce("crossings", F.lit(0).cast("long")))
    straight = F.col("n_pairs") - F.col("tied_x") - F.col("tied_y") + F.col("tied_both") - F.col("discordant")
    return out.select(*groups, "n_pairs", straight.alias("concordant"), "discordant", "tied_x", "tied_y", "tied_both")


def tau_b(pairs: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """(groups, n_pairs, tau) of :func:`pair_order`; tau is null if a side is constant."""
    free = lambda tied: (F.col("n_pairs") - F.col(tied)).cast("double")
    return pairs.select(*(groups or []), "n_pairs", F.try_divide((F.col("concordant") - F.col("discordant")).cast("double"), F.sqrt(free("tied_x") * free("tied_y"))).alias("tau"))


def kendall_tau(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n_pairs, tau): tau-b of two columns over all pairs of rows."""
    return tau_b(pair_order(rows, x, y))


def _reached(z: pd.Series, gap: float) -> pd.Series:
    """The least number whose distance above each z, as subtraction gives it, is the gap or more."""
    z = z.to_numpy(float)
    t = z + gap
    for _ in range(4):
        t = np.where(t - z < gap, np.nextafter(t, np.inf), t)
    for _ in range(4):
        below = np.nextafter(t, -np.inf)
        t = np.where(below - z >= gap, below, t)
    return pd.Series(t)


def distant_pairs(rows: DataFrame, x: str, y: str, gap: float) -> DataFrame:
    """(n_far, n_right): the pairs whose y lie ``gap`` (over 0) or more apart, and those of them that x orders alike."""
    if gap <= 0:
        raise ValueError("gap must be over 0")
    reached = F.pandas_udf(lambda z: _reached(z, gap), "double")
    w = F.count(F.lit(1)).alias("w")
    points = written(rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(w), "order_points")
    none = F.lit(0).cast("long")
    lower = points.select(reached("y").alias("p"), F.lit(0.0).alias("tie"), (-F.col("x")).alias("q"), F.col("w").alias("wl"), none.alias("wr"))
    upper = points.select(F.col("y").alias("p"), F.lit(1.0).alias("tie"), (-F.col("x")).alias("q"), none.alias("wl"), F.col("w").alias("wr"))
    sides = written(lower.unionByName(upper), "order_sides")
    right = crossings(sides, []).select(F.coalesce("crossings", none).alias("n_right"))
    far = crossings(sides.withColumn("q", 1 - F.col("tie")), []).select(F.coalesce("crossings", none).alias("n_far"))
    return far.crossJoin(right)


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(keys, share, quantile): exact quantiles with linear interpolation between neighbours; nulls don't count.

    Rows are range-partitioned by key and value once. Counts by part tell which parts hold the wanted ranks, and
    only those are numbered, so no buffer holds the values of a key and several shares cost one pass.
    """
    rows = written(rows.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null"), "quantile_rows")
    parts = min(MOST_PARTS, max(1, -(-rows.count() // PART_ROWS)))
    ranged = written(rows.repartitionByRange(parts, *keys, "v").withColumn("part", F.spark_partition_id()), "quantile_parts") if parts > 1 else rows.withColumn("part", F.lit(0))
    counts = ranged.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    per = Window.partitionBy(*keys)
    ends = F.sum("n").over(per.orderBy("part"))
    counts = counts.withColumns({"before": ends - F.col("n"), "upto": ends, "all": F.sum("n").over(per)})
    at = F.explode(F.array(*(F.lit(float(s)) for s in shares)))
    wanted = counts.withColumn("share", at).withColumn("rank", F.col("share") * (F.col("all") - 1))
    low = F.floor("rank")
    places = F.array(F.struct(low.alias("place"), (1 - (F.col("rank") - low)).alias("weight")), F.struct((low + 1).alias("place"), (F.col("rank") - low).alias("weight")))
    wanted = wanted.withColumn("w", F.explode(places)).where("w.place >= before and w.place < upto").select(*keys, "part", "share", "before", F.col("w.place").alias("place"), F.col("w.weight").alias("weight"))
    wanted = written(wanted, "quantile_ranks")
    held = ranged.join(wanted.select(*keys, "part", "before").distinct(), [*keys, "part"])
    nth = held.withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy(*keys, "part").orderBy("v")) - 1)
    found = nth.select(*keys, "part", "place", "v").join(wanted.drop("before"), [*keys, "part", "place"])
    return found.groupBy(*keys, "share").agg(F.sum(F.col("v") * F.col("weight")).alias("quantile"))


def quantile_columns(rows: DataFrame, keys: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """:func:`quantiles` with a column for each name of ``named``."""
    each = quantiles(rows, keys, value, tuple(named.values()))
    return each.groupBy(*keys).agg(*(F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n) for n, s in named.items()))
