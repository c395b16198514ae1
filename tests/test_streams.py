"""Job lanes as a source, and live sessions restored from the log."""

import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calibron.plans.stream_queries import drained, setting
from calibron.streaming import lanes, live

JOBS = "seq long, speculative boolean, job_id string, model string"


def batches_of(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.batch, []).append((r.lane, r.place, r.job_id))
    return [sorted(v) for _, v in sorted(out.items())]


def test_real_jobs_come_first_and_batches_are_bounded(spark, tmp_path):
    uri = f"file://{tmp_path}/lanes"
    jobs = [(k, k % 3 == 0, f"j{k}", None if k == 4 else "m") for k in range(10)]
    assert lanes.publish(spark.createDataFrame(jobs, JOBS), uri) == {"real": 6, "spec": 4}
    got = batches_of(drained(lanes.read_lanes(spark, uri, 4), "append", "lanes", available_now=False))
    real, spec = [f"j{k}" for k in range(10) if k % 3], [f"j{k}" for k in range(10) if k % 3 == 0]
    assert got == [sorted(("real", p, real[p]) for p in range(4)), [("real", 4, real[4]), ("real", 5, real[5])], sorted(("spec", p, spec[p]) for p in range(4))]
    fields = {r.job_id: json.loads(r.fields) for r in spark.read.parquet(f"{uri}/jobs/00000000").collect()}
    assert fields["j3"] == {"seq": "3", "speculative": "true", "job_id": "j3", "model": "m"} and "model" not in fields["j4"]


def test_lanes_go_on_after_a_restart(spark, tmp_path):
    """A checkpointed query that stops goes on where it was; real jobs that came meanwhile go before waiting speculative ones."""
    uri, out = f"file://{tmp_path}/lanes", []

    def run(most):
        started = lanes.read_lanes(spark, uri, 2).writeStream.foreachBatch(lambda df, k: out.append((k, sorted(r.job_id for r in df.collect())))).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
        until = time.time() + 60
        while len(out) < most and time.time() < until and started.isActive:
            time.sleep(0.02)
        started.processAllAvailable() if most > 90 else None
        started.stop()

    lanes.publish(spark.createDataFrame([(k, k > 1, f"a{k}", "m") for k in range(6)], JOBS), uri)
    run(1)
    lanes.publish(spark.createDataFrame([(k, False, f"b{k}", "m") for k in range(3)], JOBS), uri)
    spark.read.parquet(f"{uri}/jobs/00000000").limit(1).collect()
    started = lanes.read_lanes(spark, uri, 2).writeStream.foreachBatch(lambda df, k: out.append((k, sorted(r.job_id for r in df.collect())))).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
    started.processAllAvailable()
    started.stop()
    by_batch = dict(out)  # a batch that was cut off by the stop is run again under its number
    assert by_batch[0] == ["a0", "a1"]
    assert sorted(j for jobs in by_batch.values() for j in jobs) == sorted([f"a{k}" for k in range(6)] + [f"b{k}" for k in range(3)])


def test_an_append_without_marker_has_no_effect(spark, tmp_path):
    uri = f"file://{tmp_path}/lanes"
    lanes.publish(spark.createDataFrame([(1, False, "a", "m")], JOBS), uri)
    spark.createDataFrame([("real", 1, "ghost", "{}")], lanes.SCHEMA).write.partitionBy("lane").parquet(f"{uri}/jobs/00000001")
    assert lanes.published(uri) == {"real": 1, "spec": 0}
    lanes.publish(spark.createDataFrame([(2, False, "b", "m")], JOBS), uri)
    got = batches_of(drained(lanes.read_lanes(spark, uri, 9), "append", "lanes", available_now=False))
    assert [j for batch in got for _, _, j in batch] == ["a", "b"]
    assert lanes.publish(spark.createDataFrame([], JOBS), uri) == {"real": 2, "spec": 0}


def test_restored_sessions_end_as_those_never_stopped(spark, sf_dir):
    from calibron.plans import catalogue

    got = {r.session_id: r for r in catalogue.queries()["f4_restored_sessions"](spark, sf_dir).collect()}
    want = {r.session_id: r for r in catalogue.queries()["f1_adaptive_sessions"](spark, sf_dir).where("type = 'finished'").collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert (got[k].step, got[k].finished) == (r.step, True)
        assert got[k].theta == pytest.approx(r.theta, abs=2e-5) and got[k].se == pytest.approx(r.se, abs=2e-5)
        assert got[k].stale == (1 if r.step > 1 else 0)


BANK = pd.DataFrame({"item_idx": range(6), "a": [1.0, 2.0, 1.5, 1.0, 0.5, 1.2], "b": [0.0, -1.0, 1.0, 0.5, 0.0, 0.3]})
RESULTS = "session_id string, step long, item_idx long, correct int"
LOG = "session_id string, step long, type string, item_idx long, correct int"


def test_idle_items_are_offered_again_and_foreign_results_counted(spark, tmp_path):
    log = spark.createDataFrame([("s", 0, "item_selected", 1, None), ("s", 0, "answer_recorded", 1, 1), ("s", 1, "item_selected", 2, None), ("f", 0, "item_selected", 3, None), ("f", 0, "answer_recorded", 3, 0), ("f", 1, "finished", None, None)], LOG)
    feed, rows = tmp_path / "feed", []
    feed.mkdir()
    send = lambda n, results: spark.createDataFrame(results, RESULTS).write.mode("overwrite").json(str(feed / f"{n}"))
    send(0, [("s", 1, 5, 1), ("s", 0, 1, 1), ("f", 1, 2, 1), ("new", 0, 4, 1)])
    with setting(spark, *live.STORE):
        stream = live.live_sessions(spark.readStream.schema(RESULTS).json(str(feed / "*")), BANK, log, max_items=4, se_target=0.0, idle_ms=300)
        started = stream.writeStream.outputMode("update").foreachBatch(lambda df, k: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    until = time.time() + 90
    while time.time() < until and started.isActive and not {("s", "idle"), ("new", "idle")} <= {(r.session_id, r.reason) for r in rows}:
        time.sleep(0.1)
    send(1, [("s", 1, 2, 0)])
    while time.time() < until and started.isActive and not any(r.session_id == "s" and r.step == 2 for r in rows):
        time.sleep(0.1)
    started.stop()
    first = {r.session_id: r for r in reversed(rows) if r.reason == "result"}
    assert (first["s"].step, first["s"].item_idx, first["s"].stale) == (1, 2, 2)
    assert (first["f"].step, first["f"].item_idx, first["f"].stale) == (1, live.DONE, 1)
    assert first["new"].step == 1 and first["new"].item_idx not in (4, live.DONE)
    idle = [r for r in rows if r.reason == "idle"]
    assert {r.item_idx for r in idle if r.session_id == "s" and r.step == 1} == {2} and "f" not in {r.session_id for r in idle}
    assert any(r.session_id == "s" and r.step == 2 and r.stale == 2 for r in rows)


def test_next_items_of_a_pool(spark):
    p = live.LiveSession(BANK, 4, 2, 0.0, None, None)
    assert p._next("s", [0], [0, 4], 0.0, 1.0) == 4 and p._next("s", [0, 4], [0, 4], 0.0, 1.0) == live.DONE
    theta, se = p._ability([1, 2], [1, 0])
    info = sum(a * a * q * (1 - q) for a, b in ((2.0, -1.0), (1.5, 1.0)) for q in (1 / (1 + np.exp(-a * (theta - b))),))
    assert se == pytest.approx(1 / np.sqrt(1 + info))
    log = spark.createDataFrame([("s", 0, "item_selected", 3, None)], LOG)
    state = live.states_of_log(log, spark.createDataFrame([("s", 3), ("s", 5)], "session_id string, item_idx long")).first()
    assert (state.items_, state.answers, state.pending, sorted(state.pool)) == ([], [], 3, [3, 5])
    assert live.states_of_log(log.where(F.lit(False))).collect() == []


def test_appends_read_their_own_buckets_and_replay_without_effect(spark, tmp_path):
    from calibron.streaming import ledger

    schema = "session_id string, step long, type string, t_s double"
    path, feed = f"file://{tmp_path}/log", tmp_path / "in"
    feed.mkdir()

    def append(n, rows, checkpoint):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(feed / f"{n}"))
        ledger.append_to_buckets(spark.readStream.schema(schema).json(str(feed / "*")), path, str(tmp_path / checkpoint), buckets=8).awaitTermination()

    first = [(f"s{k}", 0, "a", float(k)) for k in range(30)]
    append(0, [*first, first[3]], "ck")
    append(1, [("s1", 0, "a", 9.0), ("s1", 1, "a", 9.5), ("s1", 1, "a", 9.6)], "ck")
    rows = ledger.committed_rows(spark, path, spark.createDataFrame([], schema).schema)
    want = sorted([*first, ("s1", 1, "a", 9.5)])
    assert sorted(map(tuple, rows.collect())) == want
    bucket = spark.createDataFrame([("s1",)], "session_id string").select(ledger.bucket_of(8).alias("b")).first().b
    seen = ledger.bucket_rows(spark, path, rows.schema, [bucket], 1)
    assert seen.count() < 30 and {f"bucket={bucket}" in f for f in seen.inputFiles()} == {True}
    # the last batch dies before its marker, leaves rows behind, and is run again by a query that starts from its checkpoint
    (tmp_path / "log/_committed/0000000001.json").unlink()
    assert sorted(map(tuple, ledger.committed_rows(spark, path, rows.schema).collect())) == sorted(first)
    for name in ("1", ".1.crc"):
        (tmp_path / "ck/commits" / name).unlink(missing_ok=True)
    ledger.append_to_buckets(spark.readStream.schema(schema).json(str(feed / "*")), path, str(tmp_path / "ck"), buckets=8).awaitTermination()
    assert sorted(map(tuple, ledger.committed_rows(spark, path, rows.schema).collect())) == want
