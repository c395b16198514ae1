"""Further queries: file round trips, posteriors and scores, policies, replay and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from calibron.functions import irt
from calibron.functions.sql import normal_cdf
from calibron.operators import abilities as A
from calibron.operators import eventlog as E
from calibron.operators import experiments as X
from calibron.operators import ranking as R
from calibron.operators.agreement import pair_order, quantile_columns, tau_b
from calibron.plans.registry import query
from calibron.sources import files
from calibron.sources.scratch import root, written

# Every fifth item is the part of the bank that has been asked so far; the others are open. All models take part.
ANSWERS = "SELECT model, item_idx, dim, a, b, y FROM responses WHERE item_idx % 5 = 0"
POST = f"""RECURSIVE ans AS MATERIALIZED ({ANSWERS}), it(k, model, dim, theta) AS (
 SELECT 0, model, dim, 0e0 FROM (SELECT DISTINCT model, dim FROM ans) UNION ALL
 SELECT any_value(k) + 1, model, dim, greatest(-6e0, least(6e0, any_value(theta) + (sum(a * (y - p)) - any_value(theta)) / (sum(a * a * p * (1 - p)) + 1)))
 FROM (SELECT it.k, it.model, it.dim, it.theta, c.a, c.y, 1 / (1 + exp(-(c.a * it.theta - c.b))) AS p FROM it JOIN ans c ON it.model = c.model AND it.dim = c.dim WHERE it.k < 16) GROUP BY model, dim),
 post AS (SELECT c.model, c.dim, any_value(theta) AS theta, 1 / (1 + sum(a * a * (1 / (1 + exp(-(a * theta - b)))) * (1 - 1 / (1 + exp(-(a * theta - b)))))) AS var FROM ans c JOIN it ON it.model = c.model AND it.dim = c.dim AND it.k = 16 GROUP BY 1, 2),
 pool AS (SELECT m.model, i.item_idx, i.dim, i.a, 0.5e0 / count(*) OVER (PARTITION BY m.model, i.dim) AS w, 1 / (1 + exp(-(i.a * coalesce(p.theta, 0) - i.b))) AS p, coalesce(p.var, 1) AS var, c.y
   FROM (SELECT DISTINCT model FROM ans) m CROSS JOIN items i LEFT JOIN post p ON p.model = m.model AND p.dim = i.dim LEFT JOIN ans c ON c.model = m.model AND c.item_idx = i.item_idx),
 dims AS (SELECT model, dim, sum(w * coalesce(y, p)) AS s, coalesce(sum(w * p * (1 - p) * a) FILTER (WHERE y IS NULL), 0) AS g, coalesce(sum(w * w * p * (1 - p)) FILTER (WHERE y IS NULL), 0) AS bern, max(var) AS var FROM pool GROUP BY 1, 2),
 score AS (SELECT model, sum(s) AS s, greatest(sum(g * g * var + bern), 1e-12) AS v, sum(g * g * var) AS part, sum(bern) AS bern FROM dims GROUP BY 1),
 after AS (SELECT pool.model, pool.item_idx, greatest(1e-12, s.part - d.g * d.g * d.var + (d.g - w * p * (1 - p) * a) * (d.g - w * p * (1 - p) * a) * d.var / (1 + p * (1 - p) * a * a * d.var) + s.bern - w * w * p * (1 - p)) AS v_new
   FROM pool JOIN dims d ON d.model = pool.model AND d.dim = pool.dim JOIN score s ON s.model = pool.model WHERE y IS NULL)"""


def answers(d):
    return d.responses.where("item_idx % 5 = 0").select("model", "item_idx", "dim", "a", "b", "y")


def pool(d):
    return R.pool_rows(answers(d), R.family_weights(d.items.select("item_idx", "a", "b", "dim")), answers(d))


@query("m12_posteriors", f"WITH {POST} SELECT model, dim, round(theta, 6) AS theta, round(var, 6) AS var FROM post")
def m12(d):
    return R.posteriors(answers(d)).select("model", "dim", F.round("theta", 6).alias("theta"), F.round("var", 6).alias("var"))


@query("m13_pool_scores", f"WITH {POST} SELECT model, round(s, 6) AS s, round(v, 9) AS v FROM score")
def m13(d):
    return R.scores(pool(d)).select("model", F.round("s", 6).alias("s"), F.round("v", 9).alias("v"))


@query("m14_variances_after", f"WITH {POST} SELECT model, item_idx, round(v_new, 9) AS v_new FROM after")
def m14(d):
    return R.variances_after(pool(d)).select("model", "item_idx", F.round("v_new", 9).alias("v_new"))


@query("k2_least_variance_item", f"WITH {POST} SELECT model, item_idx FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(v_new, 9), item_idx) AS k FROM after) WHERE k = 1")
def k2(d):
    k = F.row_number().over(Window.partitionBy("model").orderBy(F.round("v_new", 9), "item_idx"))
    return R.variances_after(pool(d)).withColumn("k", k).where("k = 1").select("model", "item_idx")


@query("m20_pool_score_sd", "SELECT round(sqrt(sum(ww * acc * (1 - acc))), 9) AS sd FROM (SELECT dim, sum(w * w) AS ww FROM (SELECT dim, 0.5e0 / count(*) OVER (PARTITION BY dim) AS w FROM items) GROUP BY 1) JOIN (SELECT dim, avg(y) AS acc FROM responses GROUP BY 1) USING (dim)")
def m20(d):
    """How far a full score would move on a fresh draw of items, at the measured accuracies of both families."""
    weight = R.family_weights(d.items).groupBy("dim").agg(F.sum(F.col("w") * F.col("w")).alias("ww"))
    acc = d.responses.groupBy("dim").agg(F.avg("y").alias("acc"))
    return weight.join(acc, "dim").agg(F.round(F.sqrt(F.sum(F.col("ww") * F.col("acc") * (1 - F.col("acc")))), 9).alias("sd"))


CONTENT = """SELECT m.model, g.subtask, round(g.weight / t.weight * (m.n + 1) - coalesce(c.got, 0), 9) AS deficit
 FROM (SELECT model, count(*) AS n FROM responses WHERE item_idx % 5 = 0 GROUP BY 1) m
 CROSS JOIN (SELECT subtask, sum(w) AS weight, count(*) AS size FROM (SELECT subtask, 0.5e0 / count(*) OVER (PARTITION BY dim) AS w FROM items) GROUP BY 1) g
 CROSS JOIN (SELECT sum(w) AS weight FROM (SELECT 0.5e0 / count(*) OVER (PARTITION BY dim) AS w FROM items)) t
 LEFT JOIN (SELECT model, subtask, count(*) AS got FROM responses WHERE item_idx % 5 = 0 GROUP BY 1, 2) c ON c.model = m.model AND c.subtask = g.subtask
 WHERE g.size > coalesce(c.got, 0)"""


@query("m21_content_group", f"SELECT model, subtask FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY deficit DESC, subtask) AS k FROM ({CONTENT})) WHERE k = 1")
def m21(d):
    """Each model's group with the largest lag behind its share of the score weight, among groups with an open item."""
    asked = d.responses.where("item_idx % 5 = 0")
    weights = R.family_weights(d.items)
    return R.content_group(asked, weights).select("model", "subtask")


@query("m27_parameter_range", "SELECT round(min(a), 6) AS a_lo, round(max(a), 6) AS a_hi, round(min(b), 6) AS b_lo, round(max(b), 6) AS b_hi, round(corr(b, 1 - acc), 6) AS hardness FROM items LEFT JOIN (SELECT item_idx, avg(y) AS acc FROM responses GROUP BY 1) USING (item_idx)")
def m27(d):
    """Range of the parameters, and how far difficulty agrees with the share of wrong answers."""
    acc = d.responses.groupBy("item_idx").agg(F.avg("y").alias("acc"))
    ranges = (F.round(f(c), 6).alias(f"{c}_{n}") for c in "ab" for f, n in ((F.min, "lo"), (F.max, "hi")))
    return d.items.join(acc, "item_idx", "left").agg(*ranges, F.round(F.corr("b", 1 - F.col("acc")), 6).alias("hardness"))


WAIT = "least(8e0, 0.1e0 * pow(2, attempt)) * (0.5e0 + ('0x' || substr(md5(job_id || '/' || CAST(attempt AS STRING)), 1, 7))::BIGINT / 268435456e0)"


def wait():
    """Seconds before the next attempt: doubled each time up to 8, times a factor in [0.5, 1.5) drawn from the job and attempt."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("/", "job_id", F.col("attempt").cast("string")).cast("binary")), 1, 7), 16, 10).cast("double") / 268435456
    return F.least(F.lit(8.0), F.lit(0.1) * F.pow(F.lit(2.0), F.col("attempt"))) * (F.lit(0.5) + drawn)


@query("m24_backoff_waits", f"SELECT job_id, attempt, event_id, round({WAIT}, 6) AS wait FROM attempts WHERE status = 'transient'")
def m24(d):
    return d.attempts.where("status = 'transient'").select("job_id", "attempt", "event_id", F.round(wait(), 6).alias("wait"))


@query("m4_fit_2pl")
def m4(d):
    from calibron.operators.fitting import fit_2pl

    bank, _, _ = fit_2pl(d.responses.select("model", "item_idx", "y"))
    return bank.select("item_idx", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


def _wrong(zone: str) -> str:
    return normal_cdf(f"(-(abs(l.s - r.s) + {zone}) / sqrt(l.v + r.v))")


@query(
    "m16_expected_misordered",
    f"WITH {POST} SELECT (SELECT count(*) FROM score) AS n_models, round(coalesce(sum({_wrong('0e0')}), 0), 6) AS misordered, round(coalesce(sum({_wrong('0.02e0')}), 0), 6) AS resolvable FROM score l JOIN score r ON l.model < r.model",
)
def m16(d):
    """Expected misordered pairs of all models, in all and by more than 0.02; every fifth item has been asked."""
    rows = written(R.scores(pool(d)), "scores")
    both = R.expected_misordered(rows).join(R.expected_misordered(rows, 0.02).withColumnRenamed("misordered", "resolvable"), "n_models")
    return both.select("n_models", F.round("misordered", 6).alias("misordered"), F.round("resolvable", 6).alias("resolvable"))


BRANCHES = """SELECT ev.session_id, s.provider, ev.step, v.correct, CASE WHEN event_type <> 'error' THEN 'm' || CAST(user_id AS STRING) || '/i' || CAST((event_id + v.correct * 13) % 97 AS STRING) END AS key
 FROM ev JOIN sessions s USING (session_id) CROSS JOIN (VALUES (1), (0)) v(correct)"""
SPECULATION = f"""WITH b AS ({BRANCHES}), j AS (SELECT b.*, CASE WHEN b.key IS NULL THEN 'stop' WHEN f.key IS NOT NULL THEN 'inflight' WHEN c.key IS NOT NULL THEN 'cached' WHEN r.room < 0.3e0 THEN 'headroom' END AS why, coalesce(p.paid, 0) AS paid
  FROM b LEFT JOIN (SELECT DISTINCT model || '/' || item_id AS key FROM attempts WHERE status = 'transient') f ON f.key = b.key LEFT JOIN cache c ON c.key = b.key
  LEFT JOIN (SELECT provider, 1 - count(*) FILTER (WHERE status = 'running') / count(*)::DOUBLE AS room FROM sessions GROUP BY 1) r ON r.provider = b.provider
  LEFT JOIN (SELECT session_id, sum(cost) AS paid FROM log WHERE cached = 0 GROUP BY 1) p ON p.session_id = b.session_id),
 k AS (SELECT *, count(*) FILTER (WHERE why IS NULL) OVER (PARTITION BY session_id ORDER BY step, correct DESC ROWS UNBOUNDED PRECEDING) * 0.005e0 AS ahead FROM j)
 SELECT session_id, step, correct, key, coalesce(why, CASE WHEN ahead > 0.2e0 * (paid + ahead) THEN 'cap' ELSE 'made' END) AS outcome FROM k"""


@query("f13_speculative_branches", SPECULATION)
def f13(d):
    from calibron.operators.policy import speculation

    branches = d.ev.join(d.sessions.select("session_id", "provider"), "session_id").withColumn("correct", F.explode(F.array(F.lit(1), F.lit(0))))
    key = F.concat(F.lit("m"), F.col("user_id").cast("string"), F.lit("/i"), ((F.col("event_id") + F.col("correct") * 13) % 97).cast("string"))
    branches = branches.select("session_id", "provider", "step", "correct", F.when(F.col("event_type") != "error", key).alias("key"))
    flying = d.attempts.where("status = 'transient'").select(F.concat_ws("/", "model", "item_id").alias("key"))
    free = d.sessions.groupBy("provider").agg((1 - F.count_if(F.col("status") == "running") / F.count(F.lit(1))).alias("room"))
    spent = d.log.where("cached = 0").groupBy("session_id").agg(F.sum("cost").alias("paid"))
    return speculation(branches, flying, d.cache.select("key"), free, spent, 0.005)


JOBS = f"""SELECT session_id, job_id, coalesce(arg_min(status, attempt) FILTER (WHERE status <> 'transient'), 'exhausted') AS outcome, coalesce(min(attempt) FILTER (WHERE status <> 'transient'), max(attempt)) + 1 AS tried
 FROM (SELECT DISTINCT session_id, job_id, attempt, status FROM attempts) GROUP BY 1, 2"""


def jobs(d):
    """Each call after its retries: the first outcome that isn't transient, and how many attempts it took."""
    decided = F.col("status") != "transient"
    rows = d.attempts.select("session_id", "job_id", "attempt", "status").distinct().groupBy("session_id", "job_id")
    first = F.min(F.when(decided, F.struct("attempt", "status")))
    return rows.agg(F.coalesce(first["status"], F.lit("exhausted")).alias("outcome"), (F.coalesce(first["attempt"], F.max("attempt")) + 1).alias("tried"))



@query("f2_failures_isolated", f"""SELECT s.session_id, CASE WHEN f.step IS NULL THEN 'done' ELSE 'failed' END AS status, f.step AS failed_at, count(j.step) FILTER (WHERE j.outcome = 'ok' AND (f.step IS NULL OR j.step < f.step)) AS answers
 FROM sessions s LEFT JOIN (SELECT session_id, outcome, CAST(split_part(job_id, ':', 3) AS BIGINT) AS step FROM ({JOBS})) j ON j.session_id = s.session_id
 LEFT JOIN (SELECT session_id, min(CAST(split_part(job_id, ':', 3) AS BIGINT)) AS step FROM ({JOBS}) WHERE outcome <> 'ok' GROUP BY 1) f ON f.session_id = s.session_id GROUP BY s.session_id, f.step""")
def f2(d):
    """A session ends at its first call that fails for good and keeps the answers before it; no other session notices."""
    calls = jobs(d).select("session_id", F.struct(F.substring_index("job_id", ":", -1).cast("long").alias("step"), "outcome").alias("c"))
    per = calls.groupBy("session_id").agg(F.min(F.when(F.col("c.outcome") != "ok", F.col("c.step"))).alias("failed_at"))
    rows = calls.join(per, "session_id").groupBy("session_id", "failed_at").agg(F.count_if((F.col("c.outcome") == "ok") & (F.col("failed_at").isNull() | (F.col("c.step") < F.col("failed_at")))).alias("answers"))
    out = d.sessions.select("session_id").join(rows, "session_id", "left")
    return out.select("session_id", F.when(F.col("failed_at").isNull(), "done").otherwise("failed").alias("status"), "failed_at", F.coalesce("answers", F.lit(0)).alias("answers"))


@query("f7_deduplicated_results", "SELECT session_id, min(step) AS first_step, count(*) AS n FROM (SELECT DISTINCT session_id, step FROM log WHERE type = 'answer_recorded') GROUP BY 1")
def f7(d):
    rows = d.log.where("type = 'answer_recorded'").dropDuplicates(["session_id", "step"])
    return rows.groupBy("session_id").agg(F.min("step").alias("first_step"), F.count(F.lit(1)).alias("n"))


@query("f9_call_outcomes", f"""SELECT j.job_id, j.tried, j.outcome, round(coalesce(w.waited, 0), 6) AS waited FROM ({JOBS}) j LEFT JOIN
 (SELECT j.job_id, sum(a.wait) AS waited FROM ({JOBS}) j JOIN (SELECT DISTINCT job_id, attempt, {WAIT} AS wait FROM attempts WHERE status = 'transient') a ON a.job_id = j.job_id AND a.attempt + 1 < j.tried GROUP BY 1) w ON w.job_id = j.job_id""")
def f9(d):
    """Calls with their attempts, outcome and the seconds waited between attempts."""
    calls = jobs(d)
    waits = d.attempts.where("status = 'transient'").select("job_id", "attempt", wait().alias("wait")).distinct()
    waited = waits.join(calls.select("job_id", "tried"), "job_id").where("attempt + 1 < tried").groupBy("job_id").agg(F.sum("wait").alias("waited"))
    return calls.join(waited, "job_id", "left").select("job_id", "tried", "outcome", F.round(F.coalesce("waited", F.lit(0.0)), 6).alias("waited"))


def boards(d):
    """All models, in leaderboards of eight that compete for calls among themselves."""
    return d.responses.select(F.expr("model_idx div 8").alias("board"), "model_idx", "item_idx", "a", "b", "dim", "y")


@query("f15_coupled_allocator")
def f15(d):
    grid = d.spark.createDataFrame([(0, "coupled", 0)], "run int, method string, seed int")
    return X.allocation_runs(boards(d), grid, 30).select("board", "run", "call", "model_idx", "item_idx", F.round("gain", 9).alias("gain"))


@query("f16_idle_rule")
def f16(d):
    """Calls of the coupled allocator that stops a board once the gain is under half of its largest so far."""
    grid = d.spark.createDataFrame([(0, "coupled", 0)], "run int, method string, seed int")
    return X.allocation_runs(boards(d), grid, 30, idle=0.5).groupBy("board").agg(F.count(F.lit(1)).alias("calls"), F.round(F.min("gain"), 9).alias("least_gain"))


@query("f15_concurrent_allocator")
def f15_concurrent(d):
    """Boards of eight with calls in flight under five policies: one call at a time, windows alone, windows with a floor
    under idle slots and gains by cost, a budget, and one step ahead with an indifference zone."""
    from calibron.operators.allocator import Policy, concurrent_runs

    usual = F.col("est_tokens") / 1000 * F.col("usd_in")
    limits = d.providers.select("provider", F.when(F.col("rpm") > 100, 2).otherwise(1).alias("window"), usual.alias("guess"))
    named = F.element_at(F.array(*(F.lit(p) for p in ("alpha", "beta", "gamma"))), (F.col("model_idx") % 3 + 1).cast("int"))
    cells = boards(d).withColumn("provider", named).join(limits.select("provider", "guess"), "provider")
    cells = cells.select("board", "model_idx", "provider", "item_idx", "a", "b", "dim", "y", (0.5 + F.col("item_idx") % 7 / 4).alias("took"), (F.col("guess") * (0.5 + F.col("item_idx") % 5 / 4)).alias("cost"))
    policies = {0: Policy(most_calls=30, in_flight=1), 1: Policy(most_calls=30), 2: Policy(most_calls=30, floor=0.5, by_cost=True), 3: Policy(most_calls=30, budget=0.02), 4: Policy(most_calls=30, zone=0.02, one_step=True, settled=1.0)}
    rows = concurrent_runs(cells, limits, policies).groupBy("board", "run", "spent", "left_idle", "reason")
    return rows.agg(F.count("seq").alias("calls"), F.round(F.max("ended"), 6).alias("took"), F.round(F.sum("gain"), 9).alias("gained")).withColumn("spent", F.round("spent", 9))


@query("e9_ranking_runs")
def e9(d):
    grid = d.spark.createDataFrame([(0, "random", 1), (1, "random", 2), (2, "independent", 0), (3, "coupled", 0)], "run int, method string, seed int")
    return X.allocation_runs(boards(d), grid, 20).groupBy("board", "run", "method", "model_idx").agg(F.count(F.lit(1)).alias("calls"))


@query("f18_scaled_providers", "SELECT p.provider, p.rpm * 4 AS rpm, round(avg(a.latency) / 4, 6) AS latency, round(greatest(1, ceil(any_value(p.rpm) * 4 / 60 * (avg(a.latency) / 4))), 0) AS calls_in_flight FROM providers p JOIN sessions s ON s.provider = p.provider JOIN attempts a ON a.session_id = s.session_id WHERE a.status = 'ok' GROUP BY p.provider, p.rpm")
def f18(d):
    """Providers four times as fast: limits, mean latency of good calls, and the window that keeps them busy."""
    calls = d.attempts.where("status = 'ok'").join(d.sessions.select("session_id", "provider"), "session_id").groupBy("provider").agg((F.avg("latency") / 4).alias("latency"))
    rpm = F.col("rpm") * 4
    window = F.greatest(F.lit(1.0), F.ceil(rpm / 60 * F.col("latency")).cast("double"))
    return d.providers.join(calls, "provider").select("provider", rpm.alias("rpm"), F.round("latency", 6).alias("latency"), window.alias("calls_in_flight"))


@query("f19_replayed_calls", "SELECT i.item_id, CASE WHEN r.y IS NULL THEN 'fatal' ELSE 'ok' END AS outcome, r.y AS correct FROM items i LEFT JOIN (SELECT item_idx, y FROM responses WHERE model_idx = 3) r USING (item_idx)")
def f19(d):
    own = d.responses.where("model_idx = 3").select("item_idx", F.col("y").alias("correct"))
    return d.items.select("item_idx", "item_id").join(own, "item_idx", "left").select("item_id", F.when(F.col("correct").isNull(), "fatal").otherwise("ok").alias("outcome"), "correct")


EARLY = "SELECT run_name, session_id, round(avg(correct), 9) AS full_acc, round(avg(correct) FILTER (WHERE k <= 10), 9) AS early FROM (SELECT s.run_name, l.session_id, l.correct, row_number() OVER (PARTITION BY l.session_id ORDER BY l.step) AS k FROM log l JOIN sessions s USING (session_id) WHERE type = 'answer_recorded') GROUP BY 1, 2"


@query(
    "e2_run_report",
    f"""WITH acc AS ({EARLY}), t AS (SELECT l.run_name, sum(sign(l.early - r.early) * sign(l.full_acc - r.full_acc)) / sqrt(nullif(count(*) FILTER (WHERE l.early <> r.early)::DOUBLE * count(*) FILTER (WHERE l.full_acc <> r.full_acc), 0)) AS tau FROM acc l JOIN acc r ON l.run_name = r.run_name AND l.session_id < r.session_id GROUP BY 1)
 SELECT q.run_name, sessions, calls, paid, round(cost, 6) AS cost, round(wall_s, 6) AS wall_s, round(1 - calls / (sessions * 97e0), 6) AS call_reduction, round(tau, 6) AS tau FROM (SELECT s.run_name, count(DISTINCT s.session_id) AS sessions, count(*) AS calls, count(*) FILTER (WHERE cached = 0) AS paid, sum(cost) AS cost, max(finished_at) - min(started_at) AS wall_s FROM log l JOIN sessions s USING (session_id) WHERE type = 'answer_recorded' GROUP BY 1) q LEFT JOIN t USING (run_name)""",
)
def e2(d):
    """Each run's sessions, calls, cost and time, the share of all session-item pairs that it didn't call, and how far
    ten answers a session rank the sessions as all their answers do."""
    rows = d.log.where("type = 'answer_recorded'").join(d.sessions, "session_id")
    sums = rows.groupBy("run_name").agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("calls"), F.count_if(F.col("cached") == 0).alias("paid"), F.round(F.sum("cost"), 6).alias("cost"), F.round(F.max("finished_at") - F.min("started_at"), 6).alias("wall_s"))
    nth = rows.select("run_name", "session_id", "correct", F.row_number().over(Window.partitionBy("session_id").orderBy("step")).alias("k"))
    acc = nth.groupBy("run_name", "session_id").agg(F.round(F.avg("correct"), 9).alias("full_acc"), F.round(F.avg(F.when(F.col("k") <= 10, F.col("correct"))), 9).alias("early"))
    tau = tau_b(pair_order(written(acc, "early"), "early", "full_acc", ["run_name"]), ["run_name"]).select("run_name", F.round("tau", 6).alias("tau"))
    reduction = F.round(1 - F.col("calls") / (F.col("sessions") * F.lit(97.0)), 6)
    return sums.join(tau, "run_name", "left").select("run_name", "sessions", "calls", "paid", "cost", "wall_s", reduction.alias("call_reduction"), "tau")


@query("e4_model_split", "SELECT model, CASE WHEN row_number() OVER (ORDER BY md5('1/' || model), model) <= round(0.7e0 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part FROM (SELECT DISTINCT model FROM responses)")
def e4(d):
    return X.model_split(d.responses.select("model").distinct(), 0.7, 1)


@query("e5_random_subsets")
def e5(d):
    """Abilities from random halves of the answers, one for each seed."""
    seeded = d.responses.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where(F.pmod(F.xxhash64("seed", "item_idx"), F.lit(2)) == 0)
    rows = seeded.select(F.concat_ws("|", F.col("seed").cast("string"), "model").alias("model"), "a", "b", "y")
    return A.abilities(rows).select(F.substring_index("model", "|", 1).alias("seed"), F.substring_index("model", "|", -1).alias("model"), F.round("theta", 6).alias("theta"))


@query("e15_scaling_summary", "SELECT size, round(avg(x - z), 6) AS mean, round(1.96e0 * stddev_samp(x - z) / sqrt(count(x - z)), 6) AS half_width, count(*) FILTER (WHERE x - z > 1e-9) AS won, count(*) FILTER (WHERE abs(x - z) <= 1e-9) AS tied, count(*) FILTER (WHERE x - z < -1e-9) AS lost FROM (SELECT model_idx % 4 AS size, model, avg(y) FILTER (WHERE dim = 0) AS x, avg(y) FILTER (WHERE dim = 1) AS z FROM responses GROUP BY 1, 2) GROUP BY 1")
def e15(d):
    """Paired differences by size, with a 95 % interval, and how often each side won."""
    per = d.responses.groupBy((F.col("model_idx") % 4).alias("size"), "model").pivot("dim", [0, 1]).agg(F.avg("y"))
    diff = F.col("0") - F.col("1")
    half = F.lit(1.96) * F.stddev_samp(diff) / F.sqrt(F.count(diff))
    return per.groupBy("size").agg(F.round(F.avg(diff), 6).alias("mean"), F.round(half, 6).alias("half_width"), F.count_if(diff > 1e-9).alias("won"), F.count_if(F.abs(diff) <= 1e-9).alias("tied"), F.count_if(diff < -1e-9).alias("lost"))


LIVE = "SELECT s.model, avg(l.correct) AS accuracy, count(*) AS calls FROM log l JOIN sessions s USING (session_id) WHERE l.type = 'answer_recorded' GROUP BY 1"


@query("e16_live_report", f"""SELECT m.model, m.calls, round(m.accuracy, 6) AS accuracy, round(t.p50, 6) AS p50, round(t.p95, 6) AS p95, round(g.agreement, 6) AS agreement,
 1 + (SELECT count(*) FROM (SELECT round(accuracy, 6) AS acc FROM ({LIVE}) WHERE CAST(substr(model, 2) AS BIGINT) % 4 = 0) o WHERE o.acc > round(m.accuracy, 6)) AS rank
 FROM ({LIVE}) m JOIN (SELECT model, quantile_cont(latency, 0.5) AS p50, quantile_cont(latency, 0.95) AS p95 FROM attempts WHERE status = 'ok' GROUP BY 1) t ON t.model = m.model
 JOIN (SELECT s.model, avg(CASE WHEN (i.acc >= 0.5) = (l.correct = 1) THEN 1 ELSE 0 END) AS agreement FROM log l JOIN sessions s USING (session_id) JOIN (SELECT item_id, avg(correct) AS acc FROM log WHERE type = 'answer_recorded' GROUP BY 1) i ON i.item_id = l.item_id WHERE l.type = 'answer_recorded' GROUP BY 1) g ON g.model = m.model""")
def e16(d):
    """Live models: calls, accuracy, latency, agreement with most answers to each item, and place among the anchors (every fourth)."""
    live = d.log.where("type = 'answer_recorded'").join(d.sessions.select("session_id", "model"), "session_id").select("model", "item_id", "correct")
    usual = live.groupBy("item_id").agg((F.avg("correct") >= 0.5).alias("usual"))
    rows = live.join(usual, "item_id").groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.avg((F.col("usual") == (F.col("correct") == 1)).cast("int")), 6).alias("agreement"))
    times = quantile_columns(d.attempts.where("status = 'ok'"), ["model"], "latency", {"p50": 0.5, "p95": 0.95}).select("model", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
    anchor = F.substring("model", 2, 20).cast("long") % 4 == 0
    return A.place_among(rows, "accuracy", anchor).join(times, "model").select("model", "calls", "accuracy", "p50", "p95", "agreement", "rank")


@query("j9_alignment", "SELECT count(*) AS differing FROM (SELECT item_idx, item_id FROM items EXCEPT SELECT DISTINCT item_idx, item_id FROM responses WHERE model_idx % 2 = 0)")
def j9(d):
    have = d.responses.where("model_idx % 2 = 0").select("item_idx", "item_id")
    return d.items.select("item_idx", "item_id").subtract(have).agg(F.count(F.lit(1)).alias("differing"))


@query("u5_holdout_difference", "SELECT DISTINCT model FROM responses EXCEPT SELECT DISTINCT model FROM responses WHERE model LIKE '%7'")
def u5(d):
    every = d.responses.select("model").distinct()
    return every.join(every.where(F.col("model").endswith("7")), "model", "left_anti")


def scratch(d, name: str) -> str:
    return f"{root(d.spark)}/{name}-{uuid.uuid4().hex}"


GRID = "SELECT CAST(m.model_idx AS INT) AS model_idx, m.model, i.item_idx, i.item_id, r.y AS correct FROM (SELECT DISTINCT model_idx, model FROM responses) m CROSS JOIN items i LEFT JOIN responses r ON r.model = m.model AND r.item_idx = i.item_idx"


@query("s1_matrix_json", GRID)
def s1(d):
    """The whole matrix written as JSON and read back, missing cells as null."""
    models = d.responses.select(F.col("model_idx").cast("int").alias("model_idx"), "model").distinct()
    grid = models.crossJoin(d.items.select("item_idx", "item_id")).join(d.responses.select("model", "item_idx", F.col("y").alias("correct")), ["model", "item_idx"], "left")
    path = scratch(d, "matrix")
    files.write_matrix(grid.select("model_idx", "model", "item_idx", "item_id", "correct"), path)
    return files.response_matrix(d.spark, path)


@query("s6_item_bank_json", "SELECT item_idx, item_id, a, b, dim FROM items")
def s6(d):
    path = scratch(d, "bank")
    files.write_bank(d.items.select("item_idx", "item_id", "a", "b", "dim"), path)
    return files.item_bank(d.spark, path)


@query("s4_checkpoint_files", "SELECT 'part/' || v.c AS model, item_id, CAST(CASE v.c WHEN 's1' THEN p_size % 2 ELSE 1 - p_size % 2 END AS INT) AS correct, v.c = 's2' AS held_out FROM items CROSS JOIN (VALUES ('s1'), ('s2')) v(c)")
def s4(d):
    """Results in several files, one checkpoint held out and one (s3) without any result, which is left out."""
    path = scratch(d, "checkpoints")
    odd = F.col("p_size") % 2
    wide = d.items.select(F.col("item_id").alias("id"), odd.alias("s1"), (1 - odd).alias("s2"), F.lit(None).cast("int").alias("s3"), "dim")
    wide.write.partitionBy("dim").option("header", True).csv(path)
    stem = F.concat(F.lit("part/"), F.substring_index("model", "/", -1))
    rows = files.checkpoint_set(d.spark, f"{path}/dim=*")
    return rows.select(stem.alias("model"), "item_id", "correct", stem.endswith("s2").alias("held_out"))


@query("s5_items_json", "SELECT item_id, 'how large is ' || item_id AS question, CAST(p_size AS STRING) AS answer, subtask FROM items")
def s5(d):
    """Items written as JSON maps, one for each group, and read back."""
    path = scratch(d, "items")
    rows = d.items.select("item_id", F.concat(F.lit("how large is "), "item_id").alias("question"), F.col("p_size").cast("string").alias("answer"), "subtask", F.col("subtask").alias("part"))
    files.write_items(rows, path, "part")
    return files.items_json(d.spark, path).select("item_id", "question", "answer", "subtask")


@query("x1_model_list", "SELECT DISTINCT model FROM responses WHERE model_idx % 4 IN (1, 2)")
def x1(d):
    """A list of models with comments, blanks and padded names, read back."""
    path = scratch(d, "models")
    kind = F.col("model_idx") % 4
    line = F.when(kind == 0, F.concat(F.lit("# "), "model")).when(kind == 1, F.concat(F.lit("  "), "model", F.lit(" "))).when(kind == 2, F.col("model")).otherwise("")
    d.responses.select("model_idx", "model").distinct().select(line.alias("value")).write.text(path)
    return files.model_list(d.spark, path)


@query("x22_item_hashed_keys", """SELECT DISTINCT model, item_id, sha256('{"item": "' || substr(sha256('{"answer": "' || CAST(p_size AS STRING) || '", "question": "' || subtask || '"}'), 1, 16) || '", "item_id": "' || item_id || '", "model": "' || model || '"}') AS key FROM responses JOIN (SELECT item_idx, p_size FROM items) USING (item_idx)""")
def x22(d):
    """Cache keys that change with the content of the item: its hash stands in the key."""
    content = F.sha2(F.format_string('{"answer": "%d", "question": "%s"}', "p_size", "subtask").cast("binary"), 256)
    rows = d.responses.select("model", "item_idx", "item_id", "subtask").join(d.items.select("item_idx", "p_size"), "item_idx")
    text = F.format_string('{"item": "%s", "item_id": "%s", "model": "%s"}', F.substring(content, 1, 16), "item_id", "model")
    return rows.select("model", "item_id", F.sha2(text.cast("binary"), 256).alias("key")).distinct()


@query("e6_prior_sweep", "WITH RECURSIVE cells AS MATERIALIZED (SELECT CAST(v.sd AS STRING) || '|' || model AS model, v.sd, a, b, y FROM responses CROSS JOIN (VALUES (0.5e0), (1e0), (2e0)) v(sd) WHERE dim = 0), it(k, model, theta) AS (SELECT 0, model, 0e0 FROM (SELECT DISTINCT model FROM cells) UNION ALL SELECT any_value(k) + 1, model, greatest(-6e0, least(6e0, any_value(theta) + (sum(a * (y - p)) - any_value(theta) / any_value(sd * sd)) / (sum(a * a * p * (1 - p)) + any_value(1 / (sd * sd))))) FROM (SELECT it.k, it.model, it.theta, c.a, c.y, c.sd, 1 / (1 + exp(-c.a * (it.theta - c.b))) AS p FROM it JOIN cells c ON it.model = c.model WHERE it.k < 20) GROUP BY model), p AS (SELECT v.sd, y, greatest(1e-9, least(1 - 1e-9, 1 / (1 + exp(-a * (theta - b))))) AS p FROM responses r CROSS JOIN (VALUES (0.5e0), (1e0), (2e0)) v(sd) JOIN it ON it.k = 20 AND it.model = CAST(v.sd AS STRING) || '|' || r.model WHERE dim = 1) SELECT sd, count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS loss FROM p GROUP BY 1")
def e6(d):
    """Loss on the family that wasn't fitted, for each width of the ability's prior."""
    grid = (0.5, 1.0, 2.0)
    packed = d.responses.where("dim = 0").groupBy("model").agg(F.collect_list(F.struct("a", "b", F.col("y").cast("double").alias("y"))).alias("cells"))
    fits = F.array(*(F.struct(F.lit(sd).alias("sd"), irt.map_ability(F.col("cells"), sd)["theta"].alias("theta")) for sd in grid))
    theta = packed.select("model", F.explode(fits).alias("f")).select("model", "f.sd", "f.theta")
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), irt.prob(F.col("theta"), F.col("a"), F.col("b"))))
    rows = d.responses.where("dim = 1").join(theta, "model").select("sd", "y", p.alias("p"))
    return rows.groupBy("sd").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(-(F.col("y") * F.ln("p") + (1 - F.col("y")) * F.ln(1 - F.col("p")))), 6).alias("loss"))


@query("s3_checkpoint_csv", "SELECT 'part/' || v.c AS model, item_id, CASE v.c WHEN 's1' THEN p_size % 2 ELSE p_size % 3 END AS correct FROM items CROSS JOIN (VALUES ('s1'), ('s2')) v(c) WHERE item_id LIKE 'PROMO%' AND NOT (v.c = 's2' AND p_size % 3 = 2)")
def s3(d):
    """Checkpoints as CSV columns; empty cells are left out."""
    path = scratch(d, "csv")
    wide = d.items.select(F.col("item_id").alias("id"), (F.col("p_size") % 2).alias("s1"), F.when(F.col("p_size") % 3 < 2, F.col("p_size") % 3).alias("s2"))
    wide.coalesce(1).write.option("header", True).csv(path)
    return files.checkpoint_csv(d.spark, path, "PROMO").select(F.concat(F.lit("part/"), F.substring_index("model", "/", -1)).alias("model"), "item_id", "correct")


UNIT = "((CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0)"


def unit(text):
    """A number between 0 and 1 that the text alone decides."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0


@query(
    "s12_synthetic_world",
    f"""SELECT model, round(theta, 9) AS theta, count(*) AS n, count(*) FILTER (WHERE {UNIT.format("model || '/' || item_id")} < 1 / (1 + exp(-a * (theta - b)))) AS n_right
 FROM responses JOIN (SELECT DISTINCT model, sqrt(-2 * ln({UNIT.format("'r/' || model")})) * cos(2 * pi() * {UNIT.format("'w/' || model")}) AS theta FROM responses) USING (model) GROUP BY model, theta""",
)
def s12(d):
    """Answers drawn for every observed cell: abilities are normal and answers follow the curve, both by a hash of names."""
    cells = d.responses.select("model", "item_id", "a", "b")
    theta = F.sqrt(-2 * F.log(unit(F.concat(F.lit("r/"), "model")))) * F.cos(2 * F.pi() * unit(F.concat(F.lit("w/"), "model")))
    drawn = cells.withColumn("theta", theta)
    right = unit(F.concat("model", F.lit("/"), "item_id")) < 1 / (1 + F.exp(-F.col("a") * (F.col("theta") - F.col("b"))))
    return drawn.groupBy("model").agg(F.round(F.any_value("theta"), 9).alias("theta"), F.count(F.lit(1)).alias("n"), F.count_if(right).alias("n_right"))


@query("s15_smoke_bank", "SELECT item_idx, item_id, round(-1.5e0 + 3e0 * (row_number() OVER w - 1) / greatest(count(*) OVER (PARTITION BY subtask) - 1, 1), 9) AS b FROM items WINDOW w AS (PARTITION BY subtask ORDER BY item_idx)")
def s15(d):
    """Each subtask's items with difficulties in equal steps from -1.5 to 1.5, in their order."""
    own = Window.partitionBy("subtask")
    place = F.row_number().over(own.orderBy("item_idx")) - 1
    steps = F.greatest(F.count(F.lit(1)).over(own) - 1, F.lit(1))
    return d.items.select("item_idx", "item_id", F.round(F.lit(-1.5) + F.lit(3.0) * place / steps, 9).alias("b"))


PENDING = "SELECT s.run_name, s.status = 'running' AS flying FROM log l JOIN sessions s USING (session_id) WHERE l.type = 'item_selected' AND NOT EXISTS (SELECT 1 FROM log r WHERE r.session_id = l.session_id AND r.step = l.step AND r.type = 'answer_recorded')"


def pending(d):
    """Calls without an answer: in flight where their session runs, else waiting."""
    asked = d.log.where("type = 'item_selected'").select("session_id", "step")
    answered = d.log.where("type = 'answer_recorded'").select("session_id", "step")
    return asked.join(answered, ["session_id", "step"], "left_anti").join(d.sessions.select("session_id", "run_name", (F.col("status") == "running").alias("flying")), "session_id")


@query("x12_budget_exhausted", f"SELECT r.run_name, coalesce(p.waiting, 0) > 0 AND coalesce(p.flying, 0) = 0 AND r.spent + r.expected > 2.0 AS exhausted FROM (SELECT s.run_name, coalesce(sum(l.cost), 0) AS spent, coalesce(avg(l.cost) FILTER (WHERE l.cached = 0), 0) AS expected FROM log l JOIN sessions s USING (session_id) GROUP BY 1) r LEFT JOIN (SELECT run_name, count(*) FILTER (WHERE NOT flying) AS waiting, count(*) FILTER (WHERE flying) AS flying FROM ({PENDING}) GROUP BY 1) p ON p.run_name = r.run_name")
def x12(d):
    """Work waits, none is in flight, and the budget of 2 has no room for a call of mean cost."""
    spent = d.log.join(d.sessions.select("session_id", "run_name"), "session_id").groupBy("run_name").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spent"), F.coalesce(F.avg(F.when(F.col("cached") == 0, F.col("cost"))), F.lit(0.0)).alias("expected"))
    open_ = pending(d).groupBy("run_name").agg(F.count_if(~F.col("flying")).alias("waiting"), F.count_if("flying").alias("flying"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return spent.join(open_, "run_name", "left").select("run_name", ((zero("waiting") > 0) & (zero("flying") == 0) & (F.col("spent") + F.col("expected") > 2.0)).alias("exhausted"))


@query("x17_allocation_rows", "SELECT session_id, step, item_id FROM log WHERE type = 'allocation'")
def x17(d):
    """One allocation row for each admitted job, as an idempotent append sees it."""
    rows = d.log.where("type = 'allocation'")
    return E.first_of(rows, E.KEY, ("t_s",)).select("session_id", "step", "item_id")


@query("x20_lane_totals", f"SELECT r.run_name, r.live, r.closed, r.calls, coalesce(p.inflight, 0) AS inflight, round(coalesce(p.inflight, 0) * 0.005e0, 6) AS committed FROM (SELECT run_name, count(*) FILTER (WHERE status = 'running') AS live, count(*) FILTER (WHERE status <> 'running') AS closed, CAST(sum(coalesce(n, 0)) AS BIGINT) AS calls FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS n FROM log WHERE type = 'answer_recorded' GROUP BY 1) l ON l.session_id = s.session_id AND CAST(substr(s.model, 2) AS BIGINT) % 4 <> 0 GROUP BY 1) r LEFT JOIN (SELECT run_name, count(*) FILTER (WHERE flying) AS inflight FROM ({PENDING}) GROUP BY 1) p ON p.run_name = r.run_name")
def x20(d):
    """Lanes by state, calls made (those of anchors left out), calls in flight and what they are expected to cost."""
    answered = d.log.where("type = 'answer_recorded'").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.substring("model", 2, 20).cast("long") % 4 != 0, F.col("n")).otherwise(0)
    runs = d.sessions.join(answered, "session_id", "left").groupBy("run_name").agg(F.count_if(F.col("status") == "running").alias("live"), F.count_if(F.col("status") != "running").alias("closed"), F.sum(F.coalesce(own, F.lit(0))).alias("calls"))
    flying = pending(d).groupBy("run_name").agg(F.count_if("flying").alias("inflight"))
    n = F.coalesce("inflight", F.lit(0))
    return runs.join(flying, "run_name", "left").select("run_name", "live", "closed", "calls", n.alias("inflight"), F.round(n * 0.005, 6).alias("committed"))


@query("m2_information", "SELECT item_idx, round(a * a * (1 / (1 + exp(-a * (0.7e0 - b)))) * (1 - 1 / (1 + exp(-a * (0.7e0 - b)))), 9) AS info FROM items")
def m2(d):
    return d.items.select("item_idx", F.round(irt.information(F.lit(0.7), F.col("a"), F.col("b")), 9).alias("info"))
