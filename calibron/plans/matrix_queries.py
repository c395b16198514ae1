"""Queries over the response matrix, the item bank and model scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibron.functions import irt
from calibron.operators import abilities as A
from calibron.operators.agreement import distant_pairs, kendall_tau, pair_order, quantile_columns, tau_b
from calibron.operators.pairs import ordered_pairs, rounded
from calibron.plans.registry import query
from calibron.sources.scratch import with_every_item, written

def newton(cells: str) -> str:
    """``th(model, theta)``: the Newton steps of NEWTON over other cells (model, a, b, y)."""
    return NEWTON.replace("SELECT model, a, b, y FROM responses", cells)


NEWTON = """RECURSIVE cells AS MATERIALIZED (SELECT model, a, b, y FROM responses), it(k, model, theta) AS (
 SELECT 0, model, 0e0 FROM (SELECT DISTINCT model FROM cells) UNION ALL
 SELECT any_value(k) + 1, model, greatest(-6e0, least(6e0, any_value(theta) + (sum(a * (y - p)) - any_value(theta)) / (sum(a * a * p * (1 - p)) + 1)))
 FROM (SELECT it.k, it.model, it.theta, c.a, c.y, 1 / (1 + exp(-c.a * (it.theta - c.b))) AS p FROM it JOIN cells c ON it.model = c.model WHERE it.k < 14) GROUP BY model),
 th AS (SELECT model, theta FROM it WHERE k = 14)"""
ABILITY = f"{NEWTON}, ability AS (SELECT c.model, count(*) AS n_items, avg(c.y) AS accuracy, any_value(theta) AS theta, 1 / sqrt(1 + sum(a * a * (1 / (1 + exp(-a * (theta - b)))) * (1 - 1 / (1 + exp(-a * (theta - b)))))) AS se FROM cells c JOIN th USING (model) GROUP BY 1)"


def leaderboard(d):
    board = A.abilities(d.responses).withColumns({c: F.round(c, 6) for c in ("accuracy", "theta", "se")})
    placed = A.placed(board.withColumn("worse", -F.col("theta")), "worse", "model")
    return placed.withColumn("rank", F.col("place").cast("long")).drop("worse", "place")


@query("k4_leaderboard", f"WITH {ABILITY} SELECT model, n_items, round(accuracy, 6) AS accuracy, round(theta, 6) AS theta, round(se, 6) AS se, row_number() OVER (ORDER BY round(theta, 6) DESC, model) AS rank FROM ability")
def k4(d):
    return leaderboard(d)


@query("m3_estimate_ability", f"WITH {ABILITY} SELECT model, round(theta, 6) AS theta, round(se, 6) AS se FROM ability")
def m3(d):
    return A.abilities(d.responses).select("model", F.round("theta", 6).alias("theta"), F.round("se", 6).alias("se"))


@query("a17_kendall_tau", f"WITH {ABILITY} SELECT count(*) AS n_pairs, round(sum(sign(l.theta - r.theta) * sign(l.accuracy - r.accuracy)) / sqrt(count(*) FILTER (WHERE l.theta <> r.theta)::DOUBLE * count(*) FILTER (WHERE l.accuracy <> r.accuracy)), 6) AS tau FROM (SELECT model, round(theta, 6) AS theta, round(accuracy, 6) AS accuracy FROM ability) l JOIN (SELECT model, round(theta, 6) AS theta, round(accuracy, 6) AS accuracy FROM ability) r ON l.model < r.model")
def a17(d):
    board = A.abilities(d.responses).select("model", F.round("theta", 6).alias("theta"), F.round("accuracy", 6).alias("accuracy"))
    return kendall_tau(board, "theta", "accuracy").select("n_pairs", F.round("tau", 6).alias("tau"))


@query("e1_full_reference", f"WITH {ABILITY} SELECT model, round(theta, 6) AS theta, round(accuracy, 6) AS accuracy FROM ability")
def e1(d):
    return A.abilities(d.responses).select("model", F.round("theta", 6).alias("theta"), F.round("accuracy", 6).alias("accuracy"))


@query("k1_next_item_max_info", f"WITH {NEWTON}, used AS (SELECT model, item_idx FROM responses WHERE item_idx % 4 = 0), cand AS (SELECT th.model, i.item_idx, i.item_id, i.a * i.a * (1 / (1 + exp(-i.a * (round(theta, 6) - i.b)))) * (1 - 1 / (1 + exp(-i.a * (round(theta, 6) - i.b)))) AS info FROM th CROSS JOIN items i WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.model = th.model AND u.item_idx = i.item_idx)) SELECT model, item_idx, item_id FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(info, 9) DESC, item_idx) AS k FROM cand) WHERE k = 1")
def k1(d):
    responses = written(d.responses.select("model", "item_idx", "a", "b", "y"), "responses")
    state = A.abilities(responses).select("model", F.round("theta", 6).alias("theta"))
    used = responses.where("item_idx % 4 = 0")
    open_items = with_every_item(state, d.items.select("item_idx", "item_id", "a", "b")).join(used.select("model", "item_idx"), ["model", "item_idx"], "left_anti")
    info = F.round(irt.information(F.col("theta"), F.col("a"), F.col("b")), 9)
    best = open_items.groupBy("model").agg(F.min(F.struct((-info).alias("minus"), "item_idx", "item_id")).alias("b"))
    return best.select("model", "b.item_idx", "b.item_id")


@query("m1_probability_information", "SELECT item_id, t.theta, round(1 / (1 + exp(-a * (t.theta - b))), 9) AS p, round(a * a * (1 / (1 + exp(-a * (t.theta - b)))) * (1 - 1 / (1 + exp(-a * (t.theta - b)))), 9) AS info FROM items CROSS JOIN (VALUES (-2e0), (0e0), (1.5e0)) t(theta)")
def m1(d):
    rows = d.items.withColumn("theta", F.explode(F.array(F.lit(-2.0), F.lit(0.0), F.lit(1.5))))
    args = (F.col("theta"), F.col("a"), F.col("b"))
    return rows.select("item_id", "theta", F.round(irt.prob(*args), 9).alias("p"), F.round(irt.information(*args), 9).alias("info"))


@query("m6_priorities", "SELECT item_id, round(0.5 - 1 / sqrt(4 + a * a / 4), 9) AS gain, round(-greatest(5e0 - p_size % 7, greatest(0e0, 1 / 0.09 - 4) / greatest(a * a / 4, 1e-9)), 6) AS nearest, round((0.5 - 1 / sqrt(4 + a * a / 4)) / greatest(0.0009, 1e-9), 6) AS priority FROM items")
def m6(d):
    info, se, n = F.col("a") * F.col("a") / 4, F.lit(0.5), (F.col("p_size") % 7).cast("double")
    gain = irt.se_reduction(se, info)
    return d.items.select("item_id", F.round(gain, 9).alias("gain"), F.round(irt.nearest_priority(n, se, info, 5, 0.3), 6).alias("nearest"), F.round(gain / F.greatest(F.lit(0.0009), F.lit(1e-9)), 6).alias("priority"))


MEASURED = "SELECT provider, avg(latency) AS latency, avg(tokens) AS tokens FROM attempts JOIN sessions USING (session_id) GROUP BY 1"


def measured(d):
    """Mean latency and tokens of each provider's attempts."""
    rows = d.attempts.join(d.sessions.select("session_id", "provider"), "session_id")
    return rows.groupBy("provider").agg(F.avg("latency").alias("latency"), F.avg("tokens").alias("tokens"))


@query("m9_windows", f"SELECT provider, CAST(greatest(1, ceil(round(rpm / 60 * latency * 1.5e0, 6))) AS BIGINT) AS slots FROM providers JOIN ({MEASURED}) USING (provider)")
def m9(d):
    """Calls that a provider can have in flight at its rate and its measured latency."""
    calls = F.round(F.col("rpm") / 60 * F.col("latency") * F.lit(1.5), 6)
    return d.providers.join(measured(d), "provider").select("provider", F.greatest(F.lit(1), F.ceil(calls)).cast("long").alias("slots"))


@query("m10_family_weights", "SELECT item_idx, round(CASE WHEN dim = 0 THEN 0.5e0 / count(*) OVER (PARTITION BY dim) ELSE 0.5e0 / count(*) OVER (PARTITION BY dim) END, 9) AS w FROM items")
def m10(d):
    from calibron.operators.ranking import family_weights

    return family_weights(d.items).select("item_idx", F.round("w", 9).alias("w"))


@query("m11_loadings", "SELECT item_idx, CASE WHEN dim = 0 THEN a ELSE 0e0 END AS l0, CASE WHEN dim = 1 THEN a ELSE 0e0 END AS l1 FROM items")
def m11(d):
    return d.items.select("item_idx", *(F.when(F.col("dim") == k, F.col("a")).otherwise(0.0).alias(f"l{k}") for k in (0, 1)))


@query("m22_expected_costs", "SELECT p.provider, round(coalesce(m.cost, p.est_tokens / 1000 * p.usd_in, 0.002), 9) AS expected FROM providers p LEFT JOIN (SELECT provider, avg(cost) AS cost FROM log JOIN sessions USING (session_id) WHERE cached = 0 AND provider <> 'gamma' GROUP BY 1) m USING (provider)")
def m22(d):
    measured = d.log.where("cached = 0").join(d.sessions.where("provider <> 'gamma'"), "session_id").groupBy("provider").agg(F.avg("cost").alias("cost"))
    return d.providers.join(measured, "provider", "left").select("provider", F.round(F.coalesce("cost", F.col("est_tokens") / 1000 * F.col("usd_in"), F.lit(0.002)), 9).alias("expected"))


@query("m23_call_costs", f"SELECT provider, round(tokens / 1000e0 * usd_in + 20 / 1000e0 * usd_out, 9) AS cost FROM providers JOIN ({MEASURED}) USING (provider)")
def m23(d):
    """Cost of a call at the tokens that calls were measured to take, and 20 tokens of reply."""
    return d.providers.join(measured(d), "provider").select("provider", F.round(F.col("tokens") / 1000 * F.col("usd_in") + F.lit(20) / 1000 * F.col("usd_out"), 9).alias("cost"))


@query("m26_item_features", "SELECT item_idx, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS z, round(ln(p_size), 6) AS log_size, CASE WHEN subtask = 'PROMO' THEN 1 ELSE 0 END AS is_promo FROM items")
def m26(d):
    stats = d.items.agg(F.avg("p_size").alias("m"), F.stddev_pop("p_size").alias("s"))
    return d.items.crossJoin(F.broadcast(stats)).select("item_idx", F.round((F.col("p_size") - F.col("m")) / F.col("s"), 6).alias("z"), F.round(F.ln("p_size"), 6).alias("log_size"), F.when(F.col("subtask") == "PROMO", 1).otherwise(0).alias("is_promo"))


@query("s2_observed_cells", "SELECT model, item_id, y = 1 AS correct FROM responses")
def s2(d):
    return d.responses.where("y is not null").select("model", "item_id", (F.col("y") == 1).alias("correct"))


@query("s13_full_models", "SELECT model FROM responses JOIN items USING (item_idx) WHERE p_size = 25 GROUP BY model HAVING count(y) = (SELECT count(*) FROM items WHERE p_size = 25)")
def s13(d):
    """Models that have answered every item of the anchors' pool."""
    pool = d.items.where("p_size = 25").select("item_idx")
    per = d.responses.where("y is not null").join(pool, "item_idx", "left_semi").groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(pool.agg(F.count(F.lit(1)).alias("all"))).where("n = all").select("model")


@query("s14_available_items", "SELECT r.model, count(*) AS n, sum(r.item_idx)::BIGINT AS idx_sum FROM responses r JOIN items i ON r.item_idx = i.item_idx GROUP BY 1")
def s14(d):
    return d.responses.select("model", "item_idx").join(d.items.select("item_idx"), "item_idx").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("item_idx").cast("long").alias("idx_sum"))


@query("w8_matrix_pivot", "SELECT m.model, string_agg(coalesce(CAST(r.y AS STRING), '-'), '' ORDER BY i.item_idx) AS results FROM (SELECT DISTINCT model FROM responses) m CROSS JOIN items i LEFT JOIN responses r ON r.model = m.model AND r.item_idx = i.item_idx GROUP BY 1")
def w8(d):
    responses = written(d.responses.select("model", "item_idx", "y"), "responses")
    grid = with_every_item(responses.select("model").distinct(), d.items.select("item_idx"))
    cells = grid.join(responses, ["model", "item_idx"], "left")
    packed = cells.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("item_idx", "y"))).alias("c"))
    return packed.select("model", F.array_join(F.transform("c", lambda c: F.coalesce(c["y"].cast("string"), F.lit("-"))), "").alias("results"))


@query("p1_matrix_subset", "SELECT model, item_idx, y FROM responses WHERE model_idx IN (1, 5, 9) AND item_idx IN (0, 10, 20, 30)")
def p1(d):
    return d.responses.where(F.col("model_idx").isin(1, 5, 9) & F.col("item_idx").isin(0, 10, 20, 30)).select("model", "item_idx", "y")


@query("p2_candidates", "SELECT m.model, count(*) AS open FROM (SELECT DISTINCT model FROM responses) m CROSS JOIN items i WHERE NOT EXISTS (SELECT 1 FROM responses r WHERE r.model = m.model AND r.item_idx = i.item_idx) GROUP BY 1")
def p2(d):
    grid = d.responses.select("model").distinct().crossJoin(F.broadcast(d.items.select("item_idx")))
    return grid.join(d.responses.select("model", "item_idx"), ["model", "item_idx"], "left_anti").groupBy("model").agg(F.count(F.lit(1)).alias("open"))


@query("p3_model_prefix", "SELECT model, count(*) AS n FROM responses WHERE model LIKE 'model-1%' GROUP BY 1")
def p3(d):
    return d.responses.where(F.col("model").startswith("model-1")).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("p4_named_models", "SELECT name, EXISTS (SELECT 1 FROM responses WHERE model = name) AS known FROM (SELECT unnest(string_split('model-1,model-2,nobody', ',')) AS name)")
def p4(d):
    wanted = d.spark.range(1).select(F.explode(F.split(F.lit("model-1,model-2,nobody"), ",")).alias("name"))
    known = d.responses.select(F.col("model").alias("name")).distinct().withColumn("known", F.lit(True))
    return wanted.join(known, "name", "left").select("name", F.coalesce("known", F.lit(False)).alias("known"))


@query("p6_complete_models", "SELECT model, count(*) = (SELECT count(*) FROM items) AS complete FROM responses GROUP BY 1")
def p6(d):
    n = d.items.agg(F.count(F.lit(1)).alias("all"))
    return d.responses.groupBy("model").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).select("model", (F.col("n") == F.col("all")).alias("complete"))


@query("p8_stop_rule", f"WITH {ABILITY} SELECT model, n_items >= least(100, (SELECT count(*) FROM items)) OR (n_items >= 5 AND round(se, 6) < 0.3) AS stop FROM ability")
def p8(d):
    """Whether each model's session would stop after all its answers."""
    pool = d.items.agg(F.count(F.lit(1)).alias("pool"))
    return A.abilities(d.responses).crossJoin(pool).select("model", irt.stops(F.col("n_items"), F.col("pool"), F.round("se", 6)).alias("stop"))


@query("j4_item_indices", "SELECT r.model, i.item_idx, i.p_size FROM responses r JOIN items i ON r.item_id = i.item_id WHERE r.y = 1")
def j4(d):
    return d.responses.where("y = 1").select("model", "item_id").join(d.items.select("item_id", "item_idx", "p_size"), "item_id").select("model", "item_idx", "p_size")


@query("j6_model_pairs", "SELECT l.model AS lo, r.model AS hi, round(l.acc - r.acc, 6) AS gap FROM (SELECT model, avg(y) AS acc FROM responses GROUP BY 1) l JOIN (SELECT model, avg(y) AS acc FROM responses GROUP BY 1) r ON l.model < r.model")
def j6(d):
    pairs = ordered_pairs(A.accuracies(d), "model", "acc")
    return pairs.select("lo", "hi", rounded(F.col("x") - F.col("y")).alias("gap"))


@query("j8_agreement", "SELECT l.model AS model, count(*) AS n, round(avg(CASE WHEN l.y = r.y THEN 1 ELSE 0 END), 6) AS agree FROM responses l JOIN responses r ON l.item_idx = r.item_idx AND r.model_idx = l.model_idx + 1 GROUP BY 1")
def j8(d):
    a = d.responses.select("model", "model_idx", "item_idx", "y")
    b = d.responses.select((F.col("model_idx") - 1).alias("model_idx"), "item_idx", F.col("y").alias("other"))
    return a.join(b, ["model_idx", "item_idx"]).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("y") == F.col("other")).cast("int")), 6).alias("agree"))


@query("a8_accuracy", "SELECT item_id, count(*) AS n, round(avg(y), 6) AS accuracy FROM responses GROUP BY 1")
def a8(d):
    return d.responses.groupBy("item_id").agg(F.count("y").alias("n"), F.round(F.avg("y"), 6).alias("accuracy"))


@query("a9_coverage", "SELECT model, count(*) AS answered, (SELECT count(*) FROM items) - count(*) AS missing, round(count(*) / (SELECT count(*) FROM items)::DOUBLE, 6) AS coverage, round(avg(y), 6) AS accuracy FROM responses GROUP BY 1")
def a9(d):
    n = d.items.agg(F.count(F.lit(1)).alias("all"))
    per = d.responses.groupBy("model").agg(F.count("y").alias("answered"), F.avg("y").alias("acc")).crossJoin(F.broadcast(n))
    return per.select("model", "answered", (F.col("all") - F.col("answered")).alias("missing"), F.round(F.col("answered") / F.col("all"), 6).alias("coverage"), F.round("acc", 6).alias("accuracy"))


@query("a10_accuracy_by_subtask", "SELECT subtask, count(*) AS n, round(avg(y), 2) AS accuracy FROM responses GROUP BY 1 ORDER BY 3 DESC, 1")
def a10(d):
    return d.responses.groupBy("subtask").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 2).alias("accuracy")).orderBy(F.desc("accuracy"), "subtask")


@query("a11_items_by_subtask", "SELECT subtask, count(*) AS n FROM items GROUP BY 1 ORDER BY 1")
def a11(d):
    return d.items.groupBy("subtask").agg(F.count(F.lit(1)).alias("n")).orderBy("subtask")


@query("a12_mean_sd", "SELECT subtask, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS sd_sample, round(stddev_pop(acc), 6) AS sd_population FROM (SELECT subtask, model, avg(y) AS acc FROM responses GROUP BY 1, 2) GROUP BY 1")
def a12(d):
    acc = d.responses.groupBy("subtask", "model").agg(F.avg("y").alias("acc"))
    return acc.groupBy("subtask").agg(F.round(F.avg("acc"), 6).alias("mean"), F.round(F.stddev_samp("acc"), 6).alias("sd_sample"), F.round(F.stddev_pop("acc"), 6).alias("sd_population"))


PAIRED = "SELECT model, avg(y) FILTER (WHERE dim = 0) AS x, avg(y) FILTER (WHERE dim = 1) AS z FROM responses GROUP BY 1"


def paired(d):
    return d.responses.groupBy("model").pivot("dim", [0, 1]).agg(F.avg("y")).select("model", F.col("0").alias("x"), F.col("1").alias("z"))


@query("a13_paired_difference", f"SELECT round(avg(x - z), 6) AS mean, round(avg(x - z) - 1.96 * stddev_samp(x - z) / sqrt(count(*)), 6) AS low, round(avg(x - z) + 1.96 * stddev_samp(x - z) / sqrt(count(*)), 6) AS high FROM ({PAIRED})")
def a13(d):
    diff = F.col("x") - F.col("z")
    half = 1.96 * F.stddev_samp(diff) / F.sqrt(F.count(diff))
    return paired(d).agg(F.round(F.avg(diff), 6).alias("mean"), F.round(F.avg(diff) - half, 6).alias("low"), F.round(F.avg(diff) + half, 6).alias("high"))


@query("a14_won_tied_lost", f"SELECT count(*) FILTER (WHERE x - z > 1e-9) AS won, count(*) FILTER (WHERE abs(x - z) <= 1e-9) AS tied, count(*) FILTER (WHERE x - z < -1e-9) AS lost FROM ({PAIRED})")
def a14(d):
    diff = F.col("x") - F.col("z")
    return paired(d).agg(F.count_if(diff > 1e-9).alias("won"), F.count_if(F.abs(diff) <= 1e-9).alias("tied"), F.count_if(diff < -1e-9).alias("lost"))


@query("a15_spread", "SELECT round(min(acc), 6) AS lo, round(max(acc), 6) AS hi, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS sd FROM (SELECT model, avg(y) AS acc FROM responses GROUP BY 1)")
def a15(d):
    acc = d.responses.groupBy("model").agg(F.avg("y").alias("acc"))
    return acc.agg(*(F.round(f("acc"), 6).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"), (F.avg, "mean"), (F.stddev_pop, "sd"))))


@query("a16_correlation", "SELECT round(corr(b, 1 - acc), 6) AS r FROM (SELECT item_idx, any_value(b) AS b, avg(y) AS acc FROM responses GROUP BY 1)")
def a16(d):
    acc = d.responses.groupBy("item_idx").agg(F.max("b").alias("b"), F.avg("y").alias("acc"))
    return acc.agg(F.round(F.corr("b", 1 - F.col("acc")), 6).alias("r"))


HALVES = "SELECT subtask, model, round(avg(y) FILTER (WHERE item_idx % 2 = 0), 9) AS x, round(avg(y) FILTER (WHERE item_idx % 2 = 1), 9) AS z FROM responses GROUP BY 1, 2 HAVING count(*) FILTER (WHERE item_idx % 2 = 0) > 0 AND count(*) FILTER (WHERE item_idx % 2 = 1) > 0"


@query(
    "a18_misordered_pairs",
    f"WITH h AS ({HALVES}), t AS (SELECT l.subtask, sum(sign(l.x - r.x) * sign(l.z - r.z)) / sqrt(count(*) FILTER (WHERE l.x <> r.x)::DOUBLE * count(*) FILTER (WHERE l.z <> r.z)) AS tau FROM h l JOIN h r ON l.subtask = r.subtask AND l.model < r.model GROUP BY 1) SELECT subtask, n, round(tau, 6) AS tau, CAST(round_even((1 - round(tau, 6)) * n * (n - 1) / 4, 0) AS BIGINT) AS misordered FROM t JOIN (SELECT subtask, count(*) AS n FROM h GROUP BY 1) USING (subtask)",
)
def a18(d):
    """Pairs of models that two halves of a subtask's items order differently, as their rank agreement tells."""
    half = lambda k: F.round(F.avg(F.when(F.col("item_idx") % 2 == k, F.col("y"))), 9)
    rows = written(d.responses.groupBy("subtask", "model").agg(half(0).alias("x"), half(1).alias("z")).where("x is not null and z is not null"), "halves")
    tau = tau_b(pair_order(rows, "x", "z", ["subtask"]), ["subtask"]).select("subtask", F.round("tau", 6).alias("tau"))
    n = rows.groupBy("subtask").agg(F.count(F.lit(1)).alias("n"))
    return tau.join(n, "subtask").withColumn("misordered", F.bround((1 - F.col("tau")) * F.col("n") * (F.col("n") - 1) / 4, 0).cast("long"))


@query("a19_pair_accuracy", f"SELECT round(avg(CASE WHEN sign(l.x - r.x) = sign(l.z - r.z) THEN 1 ELSE 0 END), 6) AS right_pairs, round(coalesce(avg(CASE WHEN abs(l.z - r.z) >= 0.05 THEN CASE WHEN sign(l.x - r.x) = sign(l.z - r.z) THEN 1 ELSE 0 END END), 1), 6) AS resolvable FROM ({PAIRED}) l JOIN ({PAIRED}) r ON l.model < r.model")
def a19(d):
    board = written(paired(d), "paired")
    near = pair_order(board, "x", "z").select((F.col("concordant") + F.col("tied_both")).alias("right"), "n_pairs")
    far = distant_pairs(board, "x", "z", 0.05)
    return near.crossJoin(far).select(F.round(F.col("right") / F.col("n_pairs"), 6).alias("right_pairs"), F.round(F.when(F.col("n_far") > 0, F.col("n_right") / F.col("n_far")).otherwise(1.0), 6).alias("resolvable"))


@query("a21_rank_error", f"SELECT round(avg(abs(rx - rz)), 6) AS error FROM (SELECT row_number() OVER (ORDER BY x, model) AS rx, row_number() OVER (ORDER BY z, model) AS rz FROM ({PAIRED}))")
def a21(d):
    by_x = A.placed(paired(d).select("model", "x", "z"), "x", "model").withColumnRenamed("place", "rx")
    both = A.placed(by_x, "z", "model").withColumnRenamed("place", "rz")
    return both.select(F.abs(F.col("rx") - F.col("rz")).alias("e")).agg(F.round(F.avg("e"), 6).alias("error"))


FOLDS = newton("SELECT CAST(v.fold AS STRING) || '|' || model AS model, a, b, y FROM responses CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(fold) WHERE item_idx % 5 <> v.fold")
HELD_OUT = f"""{FOLDS}, p AS (SELECT r.item_idx % 5 AS fold, r.y, greatest(1e-9, least(1 - 1e-9, 1 / (1 + exp(-r.a * (th.theta - r.b))))) AS p FROM responses r JOIN th ON th.model = CAST(r.item_idx % 5 AS STRING) || '|' || r.model),
 folds AS (SELECT fold, count(*) AS n, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS loss, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END) AS accuracy FROM p GROUP BY 1)"""


def held_out(d):
    """(fold, n, loss, accuracy): answers of every fifth item, predicted by abilities from the other four folds."""
    fold = F.col("item_idx") % 5
    name = lambda f: F.concat_ws("|", f.cast("string"), "model")
    seen = d.responses.withColumn("fold", F.explode(F.array(*map(F.lit, range(5))))).where(fold != F.col("fold"))
    theta = A.abilities(seen.select(name(F.col("fold")).alias("model"), "a", "b", "y")).select(F.col("model").alias("fit"), "theta")
    rows = d.responses.withColumn("fit", name(fold)).join(theta, "fit")
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), irt.prob(F.col("theta"), F.col("a"), F.col("b"))))
    rows = rows.select(fold.alias("fold"), "y", p.alias("p"))
    loss = -(F.col("y") * F.ln("p") + (1 - F.col("y")) * F.ln(1 - F.col("p")))
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"), F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int")).alias("accuracy"))


@query("a22_log_loss", f"WITH {HELD_OUT} SELECT round(sum(n * loss) / sum(n), 6) AS loss, round(sum(n * accuracy) / sum(n), 6) AS accuracy FROM folds")
def a22(d):
    """Held-out loss and accuracy, weighted by the sizes of the folds."""
    mean = lambda c: F.round(F.sum(F.col("n") * F.col(c)) / F.sum("n"), 6).alias(c)
    return held_out(d).agg(mean("loss"), mean("accuracy"))


@query("e7_cross_validation", f"WITH {HELD_OUT} SELECT fold, n, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy FROM folds")
def e7(d):
    """Five-fold cross-validation by cell; abilities are fitted anew for each fold."""
    return held_out(d).select("fold", "n", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query("a23_constant_loss", "SELECT round(-(p * ln(p) + (1 - p) * ln(1 - p)), 6) AS loss FROM (SELECT avg(y) AS p FROM responses)")
def a23(d):
    p = F.col("p")
    return d.responses.agg(F.avg("y").alias("p")).select(F.round(-(p * F.ln(p) + (1 - p) * F.ln(1 - p)), 6).alias("loss"))


@query("a25_median_gap", "SELECT round(quantile_cont(gap, 0.5), 6) AS gap FROM (SELECT acc - lag(acc) OVER (ORDER BY acc, model) AS gap FROM (SELECT model, avg(y) AS acc FROM responses GROUP BY 1))")
def a25(d):
    acc = d.responses.groupBy("model").agg(F.avg("y").alias("acc"))
    rows = A.placed(acc, "acc", "model").select("place", "acc")
    before = rows.select((F.col("place") + 1).alias("place"), F.col("acc").alias("below"))
    return rows.join(before, "place").select((F.col("acc") - F.col("below")).alias("step")).transform(lambda r: quantile_columns(r, [], "step", {"gap": 0.5})).select(F.round("gap", 6).alias("gap"))


@query("a26_mean_covariance", f"SELECT round(avg(x), 6) AS mx, round(avg(z), 6) AS mz, round(var_samp(x), 6) AS vx, round(covar_samp(x, z), 6) AS cxz, round(var_samp(z), 6) AS vz FROM ({PAIRED})")
def a26(d):
    return paired(d).agg(F.round(F.avg("x"), 6).alias("mx"), F.round(F.avg("z"), 6).alias("mz"), F.round(F.var_samp("x"), 6).alias("vx"), F.round(F.covar_samp("x", "z"), 6).alias("cxz"), F.round(F.var_samp("z"), 6).alias("vz"))


@query("a28_distinct_groups", "SELECT DISTINCT subtask, dim FROM items")
def a28(d):
    return d.items.select("subtask", "dim").distinct()


@query("k5_placement_rank", "SELECT model, 1 + (SELECT count(*) FROM (SELECT model AS m2, round(avg(y), 6) AS acc2 FROM responses GROUP BY 1) o WHERE o.acc2 > s.acc) AS rank FROM (SELECT model, round(avg(y), 6) AS acc FROM responses GROUP BY 1) s")
def k5(d):
    acc = d.responses.groupBy("model").agg(F.round(F.avg("y"), 6).alias("acc"))
    return A.placement_ranks(acc, "acc").select("model", F.col("rank").cast("long").alias("rank"))


@query("k6_dense_positions", "SELECT model, CAST(row_number() OVER (ORDER BY acc, model) - 1 AS BIGINT) AS place FROM (SELECT model, round(avg(y), 6) AS acc FROM responses GROUP BY 1)")
def k6(d):
    acc = d.responses.groupBy("model").agg(F.round(F.avg("y"), 6).alias("acc"))
    return A.placed(acc, "acc", "model").select("model", (F.col("place") - 1).cast("long").alias("place"))


@query("k8_items_needed", "SELECT subtask, min(p_size)::BIGINT AS needed FROM (SELECT i.subtask, i.p_size, avg(y) AS acc FROM responses r JOIN items i USING (item_idx) GROUP BY 1, 2) WHERE acc >= 0.5 GROUP BY 1")
def k8(d):
    acc = d.responses.select("item_idx", "y").join(d.items, "item_idx").groupBy("subtask", "p_size").agg(F.avg("y").alias("acc"))
    return acc.where("acc >= 0.5").groupBy("subtask").agg(F.min("p_size").cast("long").alias("needed"))


@query("u3_item_union", "SELECT item_id FROM responses WHERE model_idx = 1 UNION SELECT item_id FROM responses WHERE model_idx = 2 ORDER BY 1")
def u3(d):
    of = lambda k: d.responses.where(F.col("model_idx") == k).select("item_id")
    return of(1).union(of(2)).distinct().orderBy("item_id")


@query("u4_anchors_minus_ranked", "SELECT DISTINCT model FROM responses WHERE model_idx % 4 <> 0")
def u4(d):
    ranked = d.responses.where("model_idx % 4 = 0").select("model").distinct()
    return d.responses.select("model").distinct().join(ranked, "model", "left_anti")


@query("e17_weighted_score", "SELECT model, round(sum(w * y), 6) AS score FROM responses JOIN (SELECT item_idx, 0.5e0 / count(*) OVER (PARTITION BY dim) AS w FROM items) USING (item_idx) GROUP BY 1")
def e17(d):
    from calibron.operators.ranking import family_weights

    w = family_weights(d.items).select("item_idx", "w")
    return d.responses.select("model", "item_idx", "y").join(w, "item_idx").groupBy("model").agg(F.round(F.sum(F.col("w") * F.col("y")), 6).alias("score"))


@query("f1_adaptive_sessions")
def f1(d):
    from calibron.operators import sessions as X

    return X.sessions(d.responses).select("session_id", "step", "type", "item_idx", "correct", F.round("theta", 6).alias("theta"), F.round("se", 6).alias("se"))


@query("e3_offline_curve")
def e3(d):
    from calibron.operators import sessions as X

    return X.offline_curve(d.responses, A.abilities(d.responses), (5, 10, 20, 40))


@query("k8_curve_items_needed")
def k8_curve(d):
    """Per selector the first budget that reaches the target, null where none does."""
    from calibron.operators import sessions as X

    curve = X.offline_curve(d.responses, A.abilities(d.responses), (5, 10, 20, 40))
    return curve.groupBy("selector").agg(F.min(F.when(F.col("tau") >= 0.5, F.col("budget"))).alias("needed"))


@query("f11_rate_limited_grants")
def f11(d):
    from calibron.operators.policy import rate_limited

    jobs = d.attempts.join(d.sessions.select("session_id", "provider"), "session_id").where("attempt = 0")
    start = d.attempts.agg(F.min("micros").alias("m0"))
    requests = jobs.crossJoin(F.broadcast(start)).select("provider", F.col("event_id").alias("request"), ((F.col("micros") - F.col("m0")) / 1e6 / 600).alias("at"), "tokens")
    return rate_limited(requests, d.providers)


ADMISSION = """WITH j AS (SELECT provider, job_id AS job, event_id AS seq, latency AS priority, cost, row_number() OVER (PARTITION BY provider ORDER BY event_id) > 8 AS waits FROM attempts JOIN sessions USING (session_id) WHERE attempt = 0),
 q AS (SELECT *, row_number() OVER o AS place, sum(cost) OVER (o ROWS UNBOUNDED PRECEDING) AS upto FROM j WINDOW o AS (PARTITION BY provider ORDER BY waits, CASE WHEN waits THEN -priority ELSE 0 END, seq)),
 c AS (SELECT q.provider, q.job, q.place, coalesce(r.upto, 0) + least(q.place - 1, 7) * 0.05e0 AS committed FROM q LEFT JOIN q r ON r.provider = q.provider AND r.place + 8 = q.place)
 SELECT c.provider, job, place, round(committed, 6) AS committed, coalesce(place < s.stop, true) AS started FROM c LEFT JOIN (SELECT provider, min(place) AS stop FROM c WHERE committed + 0.05e0 > 20 GROUP BY 1) s ON s.provider = c.provider"""


@query("f12_admission_order", ADMISSION)
def f12(d):
    from calibron.operators.policy import admitted

    jobs = d.attempts.where("attempt = 0").join(d.sessions.select("session_id", "provider"), "session_id")
    rows = admitted(jobs.select("provider", F.col("job_id").alias("job"), F.col("event_id").alias("seq"), F.col("latency").alias("priority"), "cost"), 8, 0.05, budget=20.0)
    return rows.withColumn("committed", F.round("committed", 6))


def timed_calls(d):
    """First attempts with their arrivals, time run sixty times as fast, and the slots of each provider: a tenth
    more than it needs on average (arrivals for each second times the mean duration)."""
    jobs = d.attempts.where("attempt = 0").join(d.sessions.select("session_id", "provider"), "session_id")
    start = d.attempts.agg(F.min("micros").alias("m0"))
    calls = jobs.crossJoin(F.broadcast(start)).select("provider", F.col("job_id").alias("job"), F.col("event_id").alias("seq"), ((F.col("micros") - F.col("m0")) / 1e6 / 60).alias("at"), F.col("tokens").cast("double").alias("priority"), F.col("latency").alias("took"), "cost")
    calls = written(calls, "calls")
    load = F.sum("took") / (F.max("at") - F.min("at"))
    return calls, calls.groupBy("provider").agg(F.greatest(F.lit(1), F.ceil(load * 1.1)).alias("window"))


@query("f12_admission_over_time")
def f12_over_time(d):
    """Calls that arrive while others return, for three quarters of what all of them cost."""
    from calibron.operators.admission import admitted_over_time

    calls, windows = timed_calls(d)
    cost = calls.agg(F.sum("cost").alias("all")).first()["all"] or 0.0
    rows = admitted_over_time(calls, windows, budget=cost * 0.75)
    return rows.withColumns({c: F.round(c, 5) for c in ("at", "started", "ends")})


@query(
    "x17_routed_allocations",
    f"""SELECT a.session_id, CAST(split_part(a.job_id, ':', 3) AS BIGINT) AS step, 'allocation' AS type, a.item_id, CASE WHEN s.provider = 'alpha' THEN 'direct' ELSE 'priority' END AS mode, a.latency AS priority, s.provider
 FROM attempts a JOIN sessions s USING (session_id) LEFT JOIN ({ADMISSION}) g ON g.job = a.job_id
 WHERE a.attempt = 0 AND (s.provider = 'alpha' OR g.started) AND NOT EXISTS (SELECT 1 FROM log l WHERE l.session_id = a.session_id AND l.step = CAST(split_part(a.job_id, ':', 3) AS BIGINT) AND l.type = 'allocation')""",
)
def x17_routed(d):
    """Calls of one provider go straight to the workers, all others through admission; each that gets a slot leaves one
    allocation row, unless the log has it already."""
    from calibron.operators.eventlog import KEY, insertable
    from calibron.operators.policy import admitted

    calls = d.attempts.where("attempt = 0").join(d.sessions.select("session_id", "provider"), "session_id")
    queued = calls.where("provider <> 'alpha'").select("provider", F.col("job_id").alias("job"), F.col("event_id").alias("seq"), F.col("latency").alias("priority"), "cost")
    started = admitted(queued, 8, 0.05, budget=20.0).where("started").select(F.col("job").alias("job_id"))
    direct = calls.where("provider = 'alpha'").withColumn("mode", F.lit("direct"))
    routed = direct.unionByName(calls.join(started, "job_id", "left_semi").withColumn("mode", F.lit("priority")))
    rows = routed.select("session_id", F.substring_index("job_id", ":", -1).cast("long").alias("step"), F.lit("allocation").alias("type"), "item_id", "mode", F.col("latency").alias("priority"), "provider")
    return insertable(rows, d.log, KEY, ("item_id",))
