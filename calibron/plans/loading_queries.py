"""Queries over items that load on two dimensions at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibron.operators import loadings as L
from calibron.plans.registry import query

# Loadings of the tables' items: the discrimination, split over both dimensions by the size.
LOADED = "SELECT item_idx, dim, b, a * (p_size % 5) / 4e0 AS l0, a * (4 - p_size % 5) / 4e0 AS l1 FROM items"
POST = """RECURSIVE bank AS MATERIALIZED ({LOADED}), ans AS MATERIALIZED (SELECT r.model, r.item_idx, r.y, k.l0, k.l1, k.b FROM responses r JOIN bank k USING (item_idx) {ASKED}), it(k, model, t0, t1) AS (
 SELECT 0, model, 0e0, 0e0 FROM (SELECT DISTINCT model FROM ans) UNION ALL
 SELECT k + 1, model, greatest(-6e0, least(6e0, t0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01))), greatest(-6e0, least(6e0, t1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)))
 FROM (SELECT any_value(k) AS k, model, any_value(t0) AS t0, any_value(t1) AS t1, sum(l0 * (y - p)) - any_value(t0) AS g0, sum(l1 * (y - p)) - any_value(t1) AS g1, 1 + sum(p * (1 - p) * l0 * l0) AS h00, sum(p * (1 - p) * l0 * l1) AS h01, 1 + sum(p * (1 - p) * l1 * l1) AS h11
  FROM (SELECT it.*, c.l0, c.l1, c.y, 1 / (1 + exp(-(c.l0 * it.t0 + c.l1 * it.t1 - c.b))) AS p FROM it JOIN ans c ON it.model = c.model WHERE it.k < 16) GROUP BY model)),
 info AS (SELECT model, any_value(t0) AS t0, any_value(t1) AS t1, 1 + sum(p * (1 - p) * l0 * l0) AS h00, sum(p * (1 - p) * l0 * l1) AS h01, 1 + sum(p * (1 - p) * l1 * l1) AS h11
  FROM (SELECT it.*, c.l0, c.l1, 1 / (1 + exp(-(c.l0 * it.t0 + c.l1 * it.t1 - c.b))) AS p FROM it JOIN ans c ON it.model = c.model WHERE it.k = 16) GROUP BY model),
 post AS (SELECT model, t0, t1, h11 / (h00 * h11 - h01 * h01) AS c00, -h01 / (h00 * h11 - h01 * h01) AS c01, h00 / (h00 * h11 - h01 * h01) AS c11 FROM info)""".replace("{LOADED}", LOADED)
ALL, FIFTH = POST.replace("{ASKED}", ""), POST.replace("{ASKED}", "WHERE item_idx % 5 = 0")
POOL = f"""{FIFTH}, pool AS (SELECT post.*, k.item_idx, k.l0, k.l1, c.y, 0.5e0 / count(*) OVER (PARTITION BY post.model, k.dim) AS w, 1 / (1 + exp(-(k.l0 * t0 + k.l1 * t1 - k.b))) AS p FROM post CROSS JOIN bank k LEFT JOIN ans c ON c.model = post.model AND c.item_idx = k.item_idx),
 sums AS (SELECT model, sum(w * coalesce(y, p)) AS s, coalesce(sum(w * p * (1 - p) * l0) FILTER (WHERE y IS NULL), 0) AS g0, coalesce(sum(w * p * (1 - p) * l1) FILTER (WHERE y IS NULL), 0) AS g1, coalesce(sum(w * w * p * (1 - p)) FILTER (WHERE y IS NULL), 0) AS bern FROM pool GROUP BY 1),
 part AS (SELECT pool.*, p * (1 - p) AS q, s.bern, g0 - w * p * (1 - p) * l0 AS d0, g1 - w * p * (1 - p) * l1 AS d1, c00 * l0 + c01 * l1 AS u0, c01 * l0 + c11 * l1 AS u1 FROM pool JOIN sums s USING (model) WHERE y IS NULL),
 after AS (SELECT model, item_idx, greatest(1e-12, c00 * d0 * d0 + 2 * c01 * d0 * d1 + c11 * d1 * d1 - q * (d0 * u0 + d1 * u1) * (d0 * u0 + d1 * u1) / (1 + q * (l0 * u0 + l1 * u1)) + bern - w * w * q) AS v_new FROM part)"""


def loaded(d):
    """The bank with two loadings and the weight of each item."""
    from calibron.operators.ranking import family_weights

    share = lambda k: F.col("a") * k / 4
    bank = d.items.withColumn("loadings", F.array(share(F.col("p_size") % 5), share(4 - F.col("p_size") % 5)))
    return family_weights(bank).select("item_idx", "loadings", "b", "w")


def answered(d, asked: str = "true"):
    return d.responses.where(asked).select("model", "item_idx", "y").join(loaded(d).select("item_idx", "loadings", "b"), "item_idx")


def pool(d):
    """Scores need open items: every fifth item is what has been asked so far, a feature of these queries."""
    return L.pooled(loaded(d), answered(d, "item_idx % 5 = 0"), 2)


@query("m12_posteriors_2d", f"WITH {ALL} SELECT model, round(t0, 6) AS t0, round(t1, 6) AS t1, round(c00, 6) AS c00, round(c01, 6) AS c01, round(c11, 6) AS c11 FROM post")
def m12(d):
    """Abilities on two dimensions and their covariance, from all answers."""
    post = L.posteriors(answered(d), 2)
    at = lambda c, k, name: F.round(F.col(c)[k], 6).alias(name)
    return post.select("model", at("theta", 0, "t0"), at("theta", 1, "t1"), at("cov", 0, "c00"), at("cov", 1, "c01"), at("cov", 2, "c11"))


@query("m13_pool_scores_2d", f"WITH {POOL} SELECT model, round(s, 6) AS s, round(greatest(c00 * g0 * g0 + 2 * c01 * g0 * g1 + c11 * g1 * g1 + bern, 1e-12), 9) AS v FROM sums JOIN post USING (model)")
def m13(d):
    return L.scores(pool(d), 2).select("model", F.round("s", 6).alias("s"), F.round("v", 9).alias("v"))


@query("m14_variances_after_2d", f"WITH {POOL} SELECT model, item_idx, round(v_new, 9) AS v_new FROM after")
def m14(d):
    return L.variances_after(pool(d), 2).select("model", "item_idx", F.round("v_new", 9).alias("v_new"))


@query("k2_least_variance_item_2d", f"WITH {POOL} SELECT model, item_idx FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(v_new, 9), item_idx) AS k FROM after) WHERE k = 1")
def k2(d):
    best = F.min(F.struct(F.round("v_new", 9).alias("v"), "item_idx"))
    return L.variances_after(pool(d), 2).groupBy("model").agg(best.alias("b")).select("model", "b.item_idx")
