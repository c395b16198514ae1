"""Queries over the event log, attempts and cache."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from calibron.operators import eventlog as E
from calibron.operators.agreement import quantile_columns
from calibron.plans.registry import query

big = lambda c: F.col(c).cast("long").alias(c)


@query("s8_cache_lookup", "SELECT count(*) FILTER (WHERE c.key IS NOT NULL) AS hits, count(*) FILTER (WHERE c.key IS NULL) AS misses FROM (SELECT session_id, 'm' || CAST(user_id AS STRING) || '/i' || CAST((event_id * 7) % 97 AS STRING) AS key FROM ev) j LEFT JOIN cache c ON c.key = j.key")
def s8(d):
    jobs = d.ev.select(F.concat(F.lit("m"), F.col("user_id").cast("string"), F.lit("/i"), ((F.col("event_id") * 7) % 97).cast("string")).alias("key"))
    return E.cache_lookup(jobs, d.cache).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("s9_session_scan", "SELECT session_id, count(*) AS n, string_agg(item_id, '|' ORDER BY step) AS items FROM log WHERE type = 'item_selected' GROUP BY session_id")
def s9(d):
    rows = d.log.where("type = 'item_selected'").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("step", "item_id"))).alias("rows"))
    return rows.select("session_id", "n", F.array_join(F.transform("rows", lambda r: r["item_id"]), "|").alias("items"))


BATCH = "SELECT session_id, step + (CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1000 END) AS step, 'item_selected' AS type, item_id, t_s FROM ev UNION ALL SELECT session_id, step + 1000, 'item_selected', 'dup', t_s + 1 FROM ev WHERE event_id % 4 = 1"


def batch(d):
    shifted = d.ev.select("session_id", (F.col("step") + F.when(F.col("event_id") % 2 == 0, 0).otherwise(1000)).alias("step"), F.lit("item_selected").alias("type"), "item_id", "t_s")
    return shifted.unionByName(d.ev.where("event_id % 4 = 1").select("session_id", (F.col("step") + 1000).alias("step"), F.lit("item_selected").alias("type"), F.lit("dup").alias("item_id"), (F.col("t_s") + 1).alias("t_s")))


@query("w1_idempotent_append", f"SELECT session_id, step, type, item_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, step, type ORDER BY t_s) AS k FROM ({BATCH}) b WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.session_id = b.session_id AND l.step = b.step AND l.type = b.type)) WHERE k = 1")
def w1(d):
    return E.insertable(batch(d), d.log).select("session_id", "step", "type", "item_id")


@query("w2_batched_append_results", f"SELECT inserted, count(*) AS n FROM (SELECT NOT EXISTS (SELECT 1 FROM log l WHERE l.session_id = b.session_id AND l.step = b.step AND l.type = b.type) AS inserted FROM ({BATCH}) b) GROUP BY 1")
def w2(d):
    return E.append_results(batch(d), d.log).groupBy("inserted").agg(F.count(F.lit(1)).alias("n"))


@query("w3_insert_absent_sessions", "SELECT session_id, run_name FROM sessions WHERE status = 'done' UNION ALL SELECT session_id, 'new' FROM sessions WHERE status <> 'done'")
def w3(d):
    have = d.sessions.where("status = 'done'").select("session_id", "run_name")
    wanted = d.sessions.select("session_id", F.lit("new").alias("run_name"))
    return have.unionByName(wanted.join(have, "session_id", "left_anti"))


@query("w4_cache_put_first_wins", "SELECT key, first_event FROM cache")
def w4(d):
    puts = d.ev.where("event_type <> 'error'").select(F.concat(F.lit("m"), F.col("user_id").cast("string"), F.lit("/"), "item_id").alias("key"), "event_id")
    return E.first_of(puts, ("key",), ("event_id",)).select("key", F.col("event_id").alias("first_event"))


@query("w5_attempt_log", "SELECT CASE status WHEN 'ok' THEN 'ok' WHEN 'transient' THEN 'transient_error' ELSE 'error' END AS outcome, count(*) AS n FROM (SELECT DISTINCT job_id, attempt, status FROM attempts) GROUP BY 1")
def w5(d):
    names = F.create_map(*(F.lit(x) for pair in (("ok", "ok"), ("transient", "transient_error"), ("fatal", "error")) for x in pair))
    return E.first_of(d.attempts, ("job_id", "attempt"), ("event_id",)).select(names[F.col("status")].alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("w6_current_status", "SELECT session_id, status FROM (SELECT session_id, status, row_number() OVER (PARTITION BY session_id ORDER BY t_s DESC) AS k FROM (SELECT session_id, 'running' AS status, started_at AS t_s FROM sessions UNION ALL SELECT session_id, status, finished_at + 1 FROM sessions WHERE status <> 'running') u) WHERE k = 1")
def w6(d):
    s = d.sessions
    changes = s.select("session_id", F.lit("running").alias("status"), F.col("started_at").alias("t_s")).unionByName(s.where("status <> 'running'").select("session_id", "status", (F.col("finished_at") + 1).alias("t_s")))
    return E.first_of(changes.withColumn("late", -F.col("t_s")), ("session_id",), ("late",)).select("session_id", "status")


@query("w9_import_steps", "SELECT model, item_id, CAST(step AS BIGINT) AS step, correct FROM (SELECT model, item_id, row_number() OVER (PARTITION BY model ORDER BY item_id) - 1 AS step, y AS correct FROM responses) WHERE item_id NOT LIKE 'SMALL%'")
def w9(d):
    ranked = d.responses.withColumn("step", (F.row_number().over(Window.partitionBy("model").orderBy("item_id")) - 1).cast("long"))
    return ranked.where(~F.col("item_id").startswith("SMALL")).select("model", "item_id", "step", F.col("y").alias("correct"))


KEY_SQL = """sha256('{"item_id": "' || item_id || '", "model": "' || model || '", "sample_idx": ' || CAST(attempt AS STRING) || '}')"""


@query("w12_cache_keys", f"SELECT DISTINCT job_id, attempt, {KEY_SQL} AS key FROM attempts")
def w12(d):
    text = F.format_string('{"item_id": "%s", "model": "%s", "sample_idx": %d}', "item_id", "model", "attempt")
    return d.attempts.select("job_id", "attempt", F.sha2(text.cast("binary"), 256).alias("key")).distinct()


@query("w13_item_hashes", """SELECT item_id, substr(sha256('{"answer": "' || CAST(p_size AS STRING) || '", "question": "' || subtask || '"}'), 1, 16) AS hash FROM items""")
def w13(d):
    text = F.format_string('{"answer": "%d", "question": "%s"}', "p_size", "subtask")
    return d.items.select("item_id", F.substring(F.sha2(text.cast("binary"), 256), 1, 16).alias("hash"))


@query("j1_events_sessions", "SELECT run_name, type, count(*) AS n FROM log JOIN sessions USING (session_id) GROUP BY 1, 2")
def j1(d):
    return d.log.join(d.sessions, "session_id").groupBy("run_name", "type").agg(F.count(F.lit(1)).alias("n"))


@query("j2_answers_by_model", "SELECT model, l.step AS step, item_id, correct FROM log l JOIN sessions USING (session_id) WHERE type = 'answer_recorded' AND run_name = 'run1'")
def j2(d):
    return d.log.where("type = 'answer_recorded'").join(d.sessions.where("run_name = 'run1'"), "session_id").select("model", "step", "item_id", "correct")


@query("j3_wasted_speculation", "SELECT count(*) AS n, round(sum(cost), 6) AS cost FROM attempts a WHERE speculative AND status = 'ok' AND NOT EXISTS (SELECT 1 FROM log l JOIN sessions s USING (session_id) WHERE l.type = 'answer_recorded' AND l.correct = 1 AND s.model = a.model AND l.item_id = a.item_id)")
def j3(d):
    answers = d.log.where("type = 'answer_recorded' and correct = 1").join(d.sessions, "session_id").select("model", "item_id").distinct()
    return E.wasted_speculation(d.attempts, answers).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query("j10_lookup_or_call", "SELECT coalesce(CAST(c.first_event AS STRING), 'call') AS value, count(*) AS n FROM attempts a LEFT JOIN cache c ON c.key = a.model || '/' || a.item_id WHERE a.attempt = 0 GROUP BY 1")
def j10(d):
    a = d.attempts.where("attempt = 0").withColumn("key", F.concat("model", F.lit("/"), "item_id"))
    return a.join(d.cache, "key", "left").groupBy(F.coalesce(F.col("first_event").cast("string"), F.lit("call")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("a1_run_costs", "SELECT run_name, count(*) AS n, coalesce(sum(cached), 0)::BIGINT AS cached, round(coalesce(sum(cost), 0), 6) AS cost FROM log JOIN sessions USING (session_id) WHERE type = 'answer_recorded' GROUP BY 1")
def a1(d):
    rows = d.log.where("type = 'answer_recorded'").join(d.sessions, "session_id")
    return rows.groupBy("run_name").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cached"), F.lit(0)).cast("long").alias("cached"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"))


@query("a2_filtered_counts", "SELECT count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running FROM sessions")
def a2(d):
    return d.sessions.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("done", "failed", "running")))


@query("a3_paid_calls", "SELECT count(*) FILTER (WHERE cached = 0) AS paid, round(coalesce(sum(cost) FILTER (WHERE cached = 0), 0), 6) AS paid_cost FROM log WHERE type = 'answer_recorded'")
def a3(d):
    paid = d.log.where("type = 'answer_recorded' and cached = 0")
    return paid.agg(F.count(F.lit(1)).alias("paid"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("paid_cost"))


@query("a4_attempts_by_speculation", "SELECT speculative, count(*) AS n, round(sum(cost), 6) AS cost FROM attempts WHERE status = 'ok' GROUP BY 1")
def a4(d):
    return d.attempts.where("status = 'ok'").groupBy("speculative").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query("a5_median_session_latency", "SELECT round(quantile_cont(finished_at - started_at, 0.5), 6) AS median_s FROM sessions WHERE status = 'done'")
def a5(d):
    rows = d.sessions.where("status = 'done'").select((F.col("finished_at") - F.col("started_at")).alias("took"))
    return quantile_columns(rows, [], "took", {"median_s": 0.5}).select(F.round("median_s", 6).alias("median_s"))


@query("a6_latency_percentiles", "SELECT status, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95 FROM attempts GROUP BY 1")
def a6(d):
    return quantile_columns(d.attempts, ["status"], "latency", {"p50": 0.5, "p95": 0.95}).select("status", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("a7_wall_clock", "SELECT model, count(*) AS calls, round((max(micros) - min(micros)) / 1e6, 6) AS wall_s, round(count(*) / nullif((max(micros) - min(micros)) / 1e6, 0), 9) AS per_s FROM attempts GROUP BY 1")
def a7(d):
    span = (F.max("micros") - F.min("micros")) / F.lit(1e6)
    return d.attempts.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(span, 6).alias("wall_s"), F.round(F.try_divide(F.count(F.lit(1)), span), 9).alias("per_s"))


@query("a24_running_mean_cost", "SELECT job_id, attempt, event_id, round(coalesce(avg(cost) OVER (PARTITION BY model ORDER BY event_id, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0009) + 3e-10, 9) AS expected FROM attempts")
def a24(d):
    before = Window.partitionBy("model").orderBy("event_id", "attempt").rowsBetween(Window.unboundedPreceding, -1)
    return d.attempts.select("job_id", "attempt", "event_id", F.round(F.coalesce(F.avg("cost").over(before), F.lit(0.0009)) + 3e-10, 9).alias("expected"))


@query("a27_summary_ratios", "SELECT run_name, round(1 - count(*) / 7200e0, 4) AS call_reduction, round(sum(cached) / nullif(count(*), 0)::DOUBLE, 4) AS cache_hit_rate FROM log JOIN sessions USING (session_id) WHERE type = 'answer_recorded' GROUP BY 1")
def a27(d):
    rows = d.log.where("type = 'answer_recorded'").join(d.sessions, "session_id").groupBy("run_name").agg(F.count(F.lit(1)).alias("n"), F.sum("cached").alias("hits"))
    return rows.select("run_name", F.round(1 - F.col("n") / 7200, 4).alias("call_reduction"), F.round(F.try_divide("hits", "n"), 4).alias("cache_hit_rate"))


@query("a29_session_states", "SELECT s.session_id, count(r.item_id) AS n_answered, max(CASE WHEN r.item_id IS NULL THEN s.step END) AS pending_step, arg_max(s.item_id, s.step) FILTER (WHERE r.item_id IS NULL) AS pending_item, string_agg(r.item_id || '=' || CAST(r.correct AS STRING), '|' ORDER BY s.step) AS answered FROM (SELECT * FROM log WHERE type = 'item_selected') s LEFT JOIN (SELECT * FROM log WHERE type = 'answer_recorded') r ON s.session_id = r.session_id AND s.step = r.step GROUP BY 1")
def a29(d):
    s = E.session_states(d.log)
    text = F.nullif(F.array_join(F.transform("answered", lambda r: F.concat(r["item_id"], F.lit("="), r["correct"].cast("string"))), "|"), F.lit(""))
    return s.select("session_id", "n_answered", "pending_step", "pending_item", text.alias("answered"))


@query("u1_orphans", "SELECT session_id, step FROM log WHERE type = 'item_selected' EXCEPT SELECT session_id, step FROM log WHERE type = 'answer_recorded'")
def u1(d):
    return E.orphans(d.log)


@query("u2_answered_within_allocated", "SELECT count(*) AS outside FROM (SELECT session_id, step FROM log WHERE type = 'answer_recorded' EXCEPT SELECT session_id, step FROM log WHERE type = 'allocation')")
def u2(d):
    pick = lambda t: d.log.where(F.col("type") == t).select("session_id", "step")
    return pick("answer_recorded").subtract(pick("allocation")).agg(F.count(F.lit(1)).alias("outside"))


@query("k7_priority_queue", "SELECT provider, job_id, CAST(k AS BIGINT) AS place FROM (SELECT s.provider, a.job_id, row_number() OVER (PARTITION BY s.provider ORDER BY -a.latency, a.event_id) AS k FROM attempts a JOIN sessions s USING (session_id) WHERE a.attempt = 0) WHERE k <= 8")
def k7(d):
    jobs = d.attempts.where("attempt = 0").join(d.sessions.select("session_id", "provider"), "session_id")
    k = F.row_number().over(Window.partitionBy("provider").orderBy(-F.col("latency"), "event_id"))
    return jobs.select("provider", "job_id", k.cast("long").alias("place")).where("place <= 8")


@query("k9_step_numbers", "SELECT session_id, item_id, t_s, CAST(row_number() OVER (PARTITION BY session_id ORDER BY step) - 1 AS BIGINT) AS nth FROM log WHERE type = 'answer_recorded'")
def k9(d):
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("step")) - 1
    return d.log.where("type = 'answer_recorded'").select("session_id", "item_id", "t_s", nth.cast("long").alias("nth"))


@query("k10_allocation_seq", "SELECT session_id, step, CAST(row_number() OVER (PARTITION BY session_id ORDER BY t_s, step) - 1 AS BIGINT) AS seq FROM log WHERE type = 'allocation'")
def k10(d):
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("t_s", "step")) - 1
    return d.log.where("type = 'allocation'").select("session_id", "step", seq.cast("long").alias("seq"))


@query("k11_first_items", "SELECT item_id FROM items ORDER BY item_idx LIMIT 20")
def k11(d):
    return d.items.orderBy("item_idx").limit(20).select("item_id")


@query("k12_attempt_numbers", "SELECT job_id, event_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY attempt) AS BIGINT) AS delivery FROM attempts")
def k12(d):
    return d.attempts.select("job_id", "event_id", F.row_number().over(Window.partitionBy("job_id").orderBy("attempt")).cast("long").alias("delivery"))


@query("p7_stale_results", "SELECT a.job_id, a.attempt, s.session_id IS NULL OR s.status <> 'running' OR p.step IS NULL OR p.step <> a.step + a.attempt AS stale FROM (SELECT *, CAST(regexp_extract(job_id, ':([^:]*)$', 1) AS BIGINT) AS step FROM attempts) a LEFT JOIN sessions s ON s.session_id = a.session_id LEFT JOIN (SELECT session_id, max(step) AS step FROM log l WHERE type = 'item_selected' AND NOT EXISTS (SELECT 1 FROM log r WHERE r.session_id = l.session_id AND r.step = l.step AND r.type = 'answer_recorded') GROUP BY 1) p ON p.session_id = a.session_id")
def p7(d):
    states = E.session_states(d.log).select("session_id", "pending_step")
    a = d.attempts.withColumn("step", F.regexp_extract("job_id", ":([^:]*)$", 1).cast("long"))
    joined = a.join(d.sessions.select("session_id", F.col("status").alias("state")), "session_id", "left").join(states, "session_id", "left")
    stale = F.col("state").isNull() | (F.col("state") != "running") | F.col("pending_step").isNull() | (F.col("pending_step") != F.col("step") + F.col("attempt"))
    return joined.select("job_id", "attempt", F.coalesce(stale, F.lit(True)).alias("stale"))


@query("t7_split_ids", "SELECT DISTINCT job_id, regexp_extract(job_id, '^(.*):([^:]*)$', 1) AS session_id, CAST(regexp_extract(job_id, '^(.*):([^:]*)$', 2) AS BIGINT) AS step FROM attempts")
def t7(d):
    part = lambda k: F.regexp_extract("job_id", r"^(.*):([^:]*)$", k)
    return d.attempts.select("job_id", part(1).alias("session_id"), part(2).cast("long").alias("step")).distinct()


@query("t8_allocation_detail", """SELECT session_id, step, '{"seq":' || CAST(step AS STRING) || ',"item":"' || item_id || '"}' AS detail, step AS seq FROM log WHERE type = 'allocation'""")
def t8(d):
    detail = F.to_json(F.struct(F.col("step").alias("seq"), F.col("item_id").alias("item")))
    made = d.log.where("type = 'allocation'").select("session_id", "step", detail.alias("detail"))
    return made.withColumn("seq", F.from_json("detail", "seq long, item string")["seq"])


@query("f4_recovery", "SELECT session_id, CASE WHEN p.step IS NULL THEN 'advance' ELSE 'enqueue' END AS action, session_id || ':' || CAST(p.step AS STRING) AS job_id FROM (SELECT session_id FROM sessions WHERE status = 'running') s LEFT JOIN (SELECT session_id, max(step) AS step FROM log l WHERE type = 'item_selected' AND NOT EXISTS (SELECT 1 FROM log r WHERE r.session_id = l.session_id AND r.step = l.step AND r.type = 'answer_recorded') GROUP BY 1) p USING (session_id)")
def f4(d):
    live = d.sessions.where("status = 'running'").select("session_id")
    s = live.join(E.session_states(d.log), "session_id", "left")
    return s.select("session_id", F.when(F.col("pending_step").isNull(), "advance").otherwise("enqueue").alias("action"), F.concat("session_id", F.lit(":"), F.col("pending_step").cast("string")).alias("job_id"))


@query("f5_deliver_once", "SELECT job_id, min(event_id) AS event_id FROM attempts WHERE status = 'ok' GROUP BY 1")
def f5(d):
    return E.first_of(d.attempts.where("status = 'ok'"), ("job_id",), ("event_id", "attempt")).select("job_id", "event_id")


@query("f8_pay_once", "SELECT model, item_id, min(event_id) AS payer, count(*) - 1 AS followers FROM attempts WHERE attempt = 0 GROUP BY 1, 2")
def f8(d):
    return d.attempts.where("attempt = 0").groupBy("model", "item_id").agg(F.min("event_id").alias("payer"), (F.count(F.lit(1)) - 1).alias("followers"))


@query("f14_speculation_hit_rate", "SELECT round(count(*) FILTER (WHERE speculative) / nullif(count(*), 0)::DOUBLE, 6) AS hit_rate FROM attempts WHERE status = 'ok' AND attempt = 0 AND NOT job_id LIKE '%:0'")
def f14(d):
    rows = d.attempts.where("status = 'ok' and attempt = 0").where(~F.col("job_id").endswith(":0"))
    return rows.agg(F.round(F.try_divide(F.count_if("speculative"), F.count(F.lit(1))), 6).alias("hit_rate"))


@query("x2_model_error_sweep", "SELECT model, count(*) AS n, count(*) FILTER (WHERE status <> 'ok') AS bad, count(*) FILTER (WHERE status <> 'ok') * 2 > count(*) AS warn FROM attempts GROUP BY 1")
def x2(d):
    out = d.attempts.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "ok").alias("bad"))
    return out.withColumn("warn", F.col("bad") * 2 > F.col("n"))


@query("x4_status_classes", "SELECT CASE WHEN code = 429 OR code >= 500 THEN 'transient' WHEN code >= 400 THEN 'fatal' ELSE 'ok' END AS class, count(*) AS n FROM (SELECT 200 + (event_id % 7) * 57 AS code FROM ev UNION ALL SELECT 429 FROM ev WHERE event_id % 50 = 0) GROUP BY 1")
def x4(d):
    codes = d.ev.select((200 + (F.col("event_id") % 7) * 57).alias("code")).unionByName(d.ev.where("event_id % 50 = 0").select(F.lit(429).cast("long").alias("code")))
    kind = F.when((F.col("code") == 429) | (F.col("code") >= 500), "transient").when(F.col("code") >= 400, "fatal").otherwise("ok")
    return codes.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("x11_model_providers", "SELECT DISTINCT model, CASE model_idx % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS provider FROM responses")
def x11(d):
    names = F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"))
    return d.responses.select("model", F.get(names, (F.col("model_idx") % 3).cast("int")).alias("provider")).distinct()


@query("x14_job_records", "SELECT job_id, attempt, event_id, CAST(tokens AS STRING) AS tokens, CASE WHEN speculative THEN '1' ELSE '0' END AS speculative FROM attempts")
def x14(d):
    fields = F.create_map(F.lit("tokens"), F.col("tokens").cast("string"), F.lit("speculative"), F.when(F.col("speculative"), "1").otherwise("0"))
    return d.attempts.select("job_id", "attempt", "event_id", fields["tokens"].alias("tokens"), fields["speculative"].alias("speculative"))
