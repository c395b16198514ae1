"""Queries that run a stream over the tables to its end: job lanes, and sessions that go on from the log."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibron.plans.registry import query
from calibron.sources.scratch import root, written


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for as long as a stream starts."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drained(stream: DataFrame, mode: str, name: str, available_now: bool) -> DataFrame:
    """All rows that a stream gives until it has read what is there, with the batch that gave each."""
    spark = stream.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, batch: int) -> None:
        # a batch that is run again after a failure replaces itself
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint")
    running = writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="0 seconds").start()
    try:
        running.awaitTermination() if available_now else running.processAllAvailable()
    finally:
        running.stop()
    if (error := running.exception()) is not None:
        raise error
    return spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")


#: Batches that the real jobs of a folder fill.
BATCHES = 4


@query(
    "s10_lane_batches",
    f"""WITH j AS (SELECT job_id, event_id, speculative, row_number() OVER (PARTITION BY speculative ORDER BY event_id, job_id) - 1 AS place FROM attempts WHERE attempt = 0),
 n AS (SELECT CAST(ceil(count(*) FILTER (WHERE NOT speculative) / {BATCHES}e0) AS BIGINT) AS slots, count(*) FILTER (WHERE NOT speculative) AS n_real FROM j)
 SELECT CAST(CASE WHEN speculative THEN (n_real + slots - 1) // slots + place // slots ELSE place // slots END AS BIGINT) AS batch, CASE WHEN speculative THEN 'spec' ELSE 'real' END AS lane, place, job_id, CAST(event_id AS STRING) AS seq FROM j CROSS JOIN n""",
)
def s10(d):
    """The jobs of each micro-batch of the lanes: real ones first, speculative ones where no real one waits."""
    from calibron.streaming.lanes import publish, read_lanes

    jobs = d.attempts.where("attempt = 0").select(F.col("event_id").alias("seq"), "speculative", "job_id", "model", "item_id")
    uri = f"{root(d.spark)}/lanes-{uuid.uuid4().hex}"
    n_real = publish(jobs, uri)["real"]
    rows = drained(read_lanes(d.spark, uri, max(1, -(-n_real // BATCHES))), "append", "lane_batches", available_now=False)
    return rows.select("batch", "lane", "place", "job_id", F.get_json_object("fields", "$.seq").alias("seq"))


@query("f4_restored_sessions")
def f4_restored(d):
    """Adaptive sessions stopped half-way and gone on from the log alone, with a redelivered result each.

    The ends equal those of sessions that were never stopped; every session counts its redelivery as stale.
    """
    from calibron.operators import sessions as X
    from calibron.streaming import live

    events = written(X.sessions(d.responses), "session_events")
    half = events.where("type = 'finished'").select("session_id", F.floor(F.col("step") / 2).alias("half"))
    both = written(events.join(half, "session_id"), "session_events")
    log = both.where("step < half or (step = half and type = 'item_selected')").select("session_id", "step", "type", "item_idx", "correct")
    results = both.where("type = 'answer_recorded' and step >= half - 1").select("session_id", "step", "item_idx", "correct")
    path = f"{root(d.spark)}/results-{uuid.uuid4().hex}"
    results.write.parquet(path)
    bank = d.items.select("item_idx", "a", "b").toPandas()
    pools = d.responses.select(F.concat(F.lit("run:"), "model").alias("session_id"), "item_idx")
    with setting(d.spark, *live.STORE):
        rows = drained(live.live_sessions(d.spark.readStream.schema(results.schema).parquet(path), bank, log, pools), "update", "live", available_now=True)
    last = F.max_by(F.struct("step", "item_idx", "theta", "se", "stale"), F.struct("batch", "step"))
    ended = rows.groupBy("session_id").agg(last.alias("s"))
    return ended.select("session_id", "s.step", (F.col("s.item_idx") == live.DONE).alias("finished"), F.round("s.theta", 5).alias("theta"), F.round("s.se", 5).alias("se"), "s.stale")


@query("w1_log_in_buckets", "SELECT session_id, step, type, any_value(item_id) AS item_id FROM log GROUP BY 1, 2, 3")
def w1_buckets(d):
    """The log appended by a stream in several batches, each row delivered twice, as committed at the end."""
    from calibron.streaming.ledger import append_to_buckets, committed_rows

    path = f"{root(d.spark)}/log-{uuid.uuid4().hex}"
    rows = d.log.select("session_id", "step", "type", "item_id", "t_s")
    rows.union(rows.where("step % 2 = 0")).repartition(3, "step").write.parquet(f"{path}/in")
    stream = d.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    append_to_buckets(stream, path, f"{path}/checkpoint", buckets=16).awaitTermination()
    return committed_rows(d.spark, path, rows.schema).select("session_id", "step", "type", "item_id")
