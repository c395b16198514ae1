"""Streams of results: idempotent appends and live sessions on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from calibron.operators.eventlog import KEY, insertable
from calibron.operators.sessions import ability, pick
from calibron.sources.scratch import read_json, write_json, written


def append_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of log rows; a row whose (session_id, step, type) is there already is dropped.

    The checkpoint and the anti-join together make redelivered batches harmless.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(batch.schema).option("ignoreMissingFiles", "true")
        try:
            existing = known.parquet(path)
        except Exception as error:  # the first batch: nothing is there
            if "PATH_NOT_FOUND" not in str(error):
                raise
            existing = spark.createDataFrame([], batch.schema)
        insertable(batch, existing, KEY).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


NEXT = "session_id string, step long, item_idx long, theta double, se double, stale long"
STATE = "items array<long>, answers array<int>, pending long, stale long"


def live_sessions(results: DataFrame, bank: pd.DataFrame, max_items: int = 100, min_items: int = 5, se_target: float = 0.3) -> DataFrame:
    """The next item of each session after a stream of ``results(session_id, step, item_idx, correct)``.

    The state is the answers so far and the pending item (-1: finished); a result that isn't for the
    pending step is dropped and counted. A session's first result names its own first item. The bank is
    of bounded size (one row for each item).
    """
    idx, a, b = (bank[c].to_numpy() for c in ("item_idx", "a", "b"))
    place = {int(i): k for k, i in enumerate(idx)}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, answers, pending, stale = state.get if state.exists else ([], [], None, 0)
        items, answers = list(items), list(answers)
        rows = pd.concat(list(batches)).sort_values("step")
        for r in rows.itertuples():
            if r.step != len(items) or (pending is not None and r.item_idx != pending) or pending == -1:
                stale += 1
                continue
            items.append(int(r.item_idx))
            answers.append(int(r.correct))
            used = [place[i] for i in items]
            theta, se = ability(a[used], b[used], np.array(answers, float))
            if len(items) >= min(max_items, len(idx)) or (len(items) >= min_items and se < se_target):
                pending = -1
            else:
                open_ = np.setdiff1d(np.arange(len(idx)), used)
                pending = int(idx[open_[pick("max_info", theta, idx[open_], a[open_], b[open_], key[0], len(items))]])
        used = [place[i] for i in items]
        theta, se = ability(a[used], b[used], np.array(answers, float)) if used else (0.0, 1.0)
        state.update((items, answers, pending, stale))
        yield pd.DataFrame({"session_id": [key[0]], "step": [len(items)], "item_idx": [pending], "theta": [theta], "se": [se], "stale": [stale]})

    return results.groupBy("session_id").applyInPandasWithState(step, NEXT, STATE, "update", GroupStateTimeout.NoTimeout)


def deduplicated(stream: DataFrame) -> DataFrame:
    """A stream of results with each (session_id, step) once."""
    return stream.dropDuplicates(["session_id", "step"])


def lanes(batch: DataFrame, slots: int) -> DataFrame:
    """Of a micro-batch of jobs at most ``slots``, real ones before speculative ones."""
    return batch.orderBy(F.col("speculative").cast("int"), "seq").limit(slots)


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")


def bucket_rows(spark, path: str, schema, wanted: list[int], before: int) -> DataFrame:
    """The rows of the named buckets that batches below ``before`` have written; other buckets' files aren't listed."""
    try:
        rows = spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/bucket={b}" for b in wanted))
    except Exception as error:  # a bucket that has no file yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        if len(wanted) == 1:
            return spark.createDataFrame([], schema)
        out = None
        for b in wanted:
            one = bucket_rows(spark, path, schema, [b], before)
            out = one if out is None else out.unionByName(one)
        return out
    return rows.where(F.col("batch") < before).select(*(f.name for f in schema))


def append_to_buckets(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """:func:`append_once` for a log that grows: rows lie by hash bucket of their session and by batch.

    A batch reads the buckets of its own sessions only, written by batches before it; if it is run again it
    replaces what it wrote. Once all its rows are there a marker makes the batch visible to :func:`committed_rows`.
    At the driver are at most ``buckets`` numbers.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        rows = written(batch.withColumn("bucket", bucket_of(buckets)), "log_batch")
        wanted = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())
        if wanted:
            new = insertable(rows.drop("bucket"), bucket_rows(spark, path, schema, wanted, batch_id), KEY)
            placed = new.withColumns({"bucket": bucket_of(buckets), "batch": F.lit(batch_id).cast("long")}).repartition("bucket")
            placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{path}/rows")
        write_json(path, f"_committed/{batch_id:010d}.json", {"batch": batch_id})

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed_rows(spark, path: str, schema) -> DataFrame:
    """The rows of all batches that are wholly there."""
    done = max((m["batch"] for m in read_json(path, "_committed")), default=-1)
    if done < 0:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    return rows.where(F.col("batch") <= done).select(*(f.name for f in schema))
