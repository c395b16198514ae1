"""The append-only event log as set operations: idempotent writes, session state, recovery checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("session_id", "step", "type")


def first_of(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def insertable(batch: DataFrame, existing: DataFrame, keys: tuple[str, ...] = KEY, order: tuple[str, ...] = ("t_s",)) -> DataFrame:
    """Rows of ``batch`` that an idempotent append inserts: new keys, the first row of each."""
    return first_of(batch.join(existing.select(*keys), list(keys), "left_anti"), keys, order)


def append_results(batch: DataFrame, existing: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """``batch`` with ``inserted``, whether its key is new."""
    seen = existing.select(*keys).distinct().withColumn("__seen", F.lit(True))
    return batch.join(seen, list(keys), "left").withColumn("inserted", F.col("__seen").isNull()).drop("__seen")


def session_states(log: DataFrame) -> DataFrame:
    """(session_id, n_answered, answered, pending_step, pending_item): the fold of the log.

    Only recorded answers count; pending is the last selected step without one. The answers of one
    session are gathered, at most one for each item.
    """
    selected = log.where("type = 'item_selected'").select("session_id", "step", F.col("item_id").alias("selected_item"))
    recorded = log.where("type = 'answer_recorded'").select("session_id", "step", "item_id", "correct")
    both = selected.join(recorded, ["session_id", "step"], "full")
    answered = F.array_sort(F.collect_list(F.when(F.col("item_id").isNotNull(), F.struct("step", "item_id", "correct"))))
    pending = F.max(F.when(F.col("item_id").isNull(), F.struct("step", "selected_item")))
    out = both.groupBy("session_id").agg(F.count("item_id").alias("n_answered"), answered.alias("answered"), pending.alias("p"))
    return out.select("session_id", "n_answered", "answered", F.col("p.step").alias("pending_step"), F.col("p.selected_item").alias("pending_item"))


def orphans(log: DataFrame) -> DataFrame:
    """Selected (session, step) without an answer."""
    pick = lambda t: log.where(F.col("type") == t).select("session_id", "step")
    return pick("item_selected").subtract(pick("answer_recorded"))


def wasted_speculation(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """Successful speculative attempts whose (model, item) was never answered."""
    return attempts.where("speculative and status = 'ok'").join(answers.select("model", "item_id"), ["model", "item_id"], "left_anti")


def cache_lookup(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """``jobs(key, ...)`` with ``hit``."""
    return jobs.join(cache.select("key", F.lit(True).alias("hit")), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
