"""Placement of new models, and queries in SQL text over registered functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibron.functions import sql as functions
from calibron.operators import placement as P
from calibron.plans.registry import query
from calibron.sources.scratch import written

BUDGETS = (5, 10, 20)


@query("e12_placement")
def e12(d):
    """New models (every fourth) among the others: share of right pairs by method and calls a model, over 100 sets of scenes drawn by a hash."""
    from calibron.operators import sessions as X

    is_new = (F.col("model_idx") % 4 == 0).alias("is_new")
    cells = written(d.responses.select("model", is_new, "item_idx", "a", "b", "y"), "cells")
    asked = None
    for method, selector in (("independent", "max_info"), ("random", "random")):
        rows = X.sessions(cells.where("is_new"), method, selector, max_items=max(BUDGETS), se_target=None)
        rows = rows.where("type = 'item_selected'").select("model", F.lit(method).alias("method"), "item_idx", "step")
        asked = rows if asked is None else asked.unionByName(rows)
    bank = d.items.select("item_idx", F.col("p_size").alias("scene"), F.col("dim").cast("int").alias("dim"), "a", (F.col("a") * F.col("b")).alias("b")).toPandas()
    pairs = P.right_pairs(P.placements(cells, written(asked, "asked"), bank, BUDGETS))
    share = F.col("n_right") / F.col("n_pairs")
    rows = pairs.groupBy("method", "budget").agg(F.count(F.lit(1)).alias("replicates"), F.max("n_pairs").alias("n_pairs"), F.round(F.avg("n_right"), 4).alias("n_right"), F.round(F.avg(share), 6).alias("right_share"), F.round(F.stddev_samp(share), 6).alias("sd"))
    return rows


@query("sx_curve_peaks", "SELECT item_id, round(max(a * a * (1 / (1 + exp(-a * (t - b)))) * (1 - 1 / (1 + exp(-a * (t - b))))), 9) AS info, count(*) AS n FROM items CROSS JOIN (SELECT -4 + 8 * k / 40e0 AS t FROM range(41) r(k)) GROUP BY 1")
def curve_peaks(d):
    """The most that each item tells at 41 abilities, by the registered table function."""
    functions.register(d.spark)
    return d.spark.sql("SELECT item_id, round(max(c.info), 9) AS info, count(*) AS n FROM {items} items, LATERAL item_curve(a, b, -4D, 4D, 41) c GROUP BY item_id", items=d.items)


SCORED = "SELECT model, avg(y) AS s, avg(y) * (1 - avg(y)) / count(*) + 1e-6 AS v FROM responses GROUP BY 1"


@query(
    "m15_neighbour_order",
    f"WITH n AS (SELECT model, s, v, lead(s) OVER o AS s2, lead(v) OVER o AS v2 FROM ({SCORED}) WINDOW o AS (ORDER BY round(s, 9), model)) SELECT model, round({functions.normal_cdf('(-(abs(s - s2) + 0.01e0) / sqrt(v + v2))')}, 9) AS wrong FROM n WHERE s2 IS NOT NULL",
)
def m15(d):
    """The chance that each model and the next one above it stand the wrong way round by more than 0.01, in SQL over registered functions."""
    from calibron.operators import abilities as A

    functions.register(d.spark)
    scored = d.responses.groupBy("model").agg(F.avg("y").alias("s"), (F.avg("y") * (1 - F.avg("y")) / F.count("y") + 1e-6).alias("v"))
    rows = written(A.placed(scored.withColumn("low", F.round("s", 9)), "low", "model"), "placed")
    return d.spark.sql("SELECT x.model, round(wrong_order(x.s - y.s, x.v + y.v, 0.01D), 9) AS wrong FROM {rows} x JOIN {rows} y ON y.place = x.place + 1", rows=rows)
