"""Admission over time: calls arrive while others return, and a freed slot goes to the most urgent call that waits."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibron.operators.policy import blocks_of, running
from calibron.sources.scratch import root, written

#: A row is a job of the block (arrival, wait: it waits already), the end of a call in flight (fly) or, in
#: what a block gives, a start or the digest of the state that it leaves (state).
ROW = "block long, kind string, provider string, job string, seq long, at double, priority double, took double, cost double, started double, nth long, used string, digest string"
#: Arrivals of a block: what a task holds is bounded by it, and a longer block forgets more of the state before it.
ARRIVALS = 100_000
FIELDS = ["block", "kind", "provider", "job", "seq", "at", "priority", "took", "cost", "started", "nth", "used", "digest"]


def digest_of(flying: list[float], waiting: list[tuple]) -> str:
    """A digest of a state; the empty text for the empty state."""
    return hashlib.sha256(repr((flying, waiting)).encode()).hexdigest() if flying or waiting else ""


def serve(arrivals, flying: list[float], waiting: list[tuple], window: int, until: float) -> tuple[list[tuple], list[float], list[tuple]]:
    """(starts, ends in flight, waiting) after ``arrivals`` and all returns up to ``until``.

    A call is a tuple that begins with (key, seq, at, took), smaller ones first; a start is a call and its time. Calls
    that return at a time free their slots before a call of that time arrives.
    """
    starts: list[tuple] = []
    heapq.heapify(flying)
    heapq.heapify(waiting)

    def start(call: tuple, now: float) -> None:
        starts.append((call, now))
        heapq.heappush(flying, now + call[3])

    def returns(now: float) -> None:
        while flying and flying[0] <= now:
            end = heapq.heappop(flying)
            if waiting:
                start(heapq.heappop(waiting), end)

    for call in arrivals:
        returns(call[2])
        if len(flying) < window:
            start(call, call[2])
        else:
            heapq.heappush(waiting, call)
    returns(until)
    return starts, sorted(flying), sorted(waiting)


def _block(pdf: pd.DataFrame, fifo: bool) -> pd.DataFrame:
    """The starts of a block and the state that it leaves, from its arrivals and the state before it."""
    head = pdf.iloc[0]

    def calls(kind: str) -> list[tuple]:
        r = pdf[pdf["kind"] == kind]
        key = [0.0] * len(r) if fifo else (-r["priority"].astype(float)).tolist()
        numbers = (r[c].astype(float).tolist() for c in ("at", "took", "cost", "priority"))
        return list(zip(key, r["seq"].astype(int).tolist(), *numbers, r["job"].notna().tolist(), r["job"].fillna("").tolist(), strict=True))

    arrivals = sorted(calls("arrival"), key=lambda c: (c[2], c[1], c))
    flying, waiting = sorted(pdf.loc[pdf["kind"] == "fly", "at"].tolist()), sorted(calls("wait"))
    used = digest_of(flying, waiting)
    starts, flying, waiting = serve(arrivals, flying, waiting, int(head["window"]), float(head["until"]))

    def rows(kind: str, found: list[tuple], **more) -> pd.DataFrame:
        _, seq, at, took, cost, priority, named, job = zip(*found, strict=True) if found else [()] * 8
        return pd.DataFrame({"kind": kind, "job": [j if k else None for j, k in zip(job, named, strict=True)], "seq": seq, "at": at, "priority": priority, "took": took, "cost": cost, "nth": 0, **more})

    state = {"seq": 0, "nth": [len(starts)], "used": used, "digest": digest_of(flying, waiting)}
    parts = [pd.DataFrame({"kind": "state", **state})]
    if starts:
        parts.append(rows("start", [c for c, _ in starts], started=[now for _, now in starts]).assign(nth=range(1, len(starts) + 1)))
    if flying:
        parts.append(pd.DataFrame({"kind": "fly", "seq": 0, "at": flying, "nth": 0}))
    if waiting:
        parts.append(rows("wait", waiting))
    out = pd.concat(parts, ignore_index=True).reindex(columns=FIELDS).assign(block=int(head["block"]), provider=head["provider"])
    return out.astype(dict.fromkeys(("at", "priority", "took", "cost", "started"), "Float64"))


def admitted_over_time(jobs: DataFrame, windows: DataFrame, mode: str = "priority", budget: float | None = None, cost: float = 0.05, parts: int | None = None) -> DataFrame:
    """(provider, job, place, at, started, ends, paid) of ``jobs(provider, job, seq, at, priority, took, cost)``.

    A provider has ``windows(provider, window)`` slots. A call that arrives while one is free starts at once;
    the others wait, and each return starts the waiting call of the highest priority (``fifo``: the first to
    arrive), ties by seq. Place is the order of starts within the provider. With a budget, shared by all
    providers, a call is paid as long as neither it nor one that starts before it would take what the
    returned calls have cost and those in flight are expected to (``cost`` each) over the budget; the
    calls after it stay in the line that they would have had. Calls that return at a time are paid before
    calls of that time start; one without duration is paid after all of them have started.

    Arrivals are range-partitioned by provider and time into blocks of about ``ARRIVALS``, so a busy provider has many. All blocks are run at
    first from an empty state. A block is run again whenever the state left by the block before it isn't the
    one that it started from: where a slot is free now and then, what is in flight soon no longer depends
    on how the block began, and two or three rounds do; a line that never ends takes up to a
    round for each block of its provider, because each start then depends on all before. Rounds are written,
    so a lost executor repeats its blocks only. A task holds one block and the calls that wait at its start.

    Null provider: a provider of its own, with one slot (as each that ``windows`` lacks); null arrival or
    duration: zero; null priority: after all others; null cost: zero; NaN counts as null. An empty table gives an empty result.
    """
    number = lambda c, other=0.0: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(other)).alias(c)
    clean = jobs.select("provider", "job", F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), number("at"), number("priority", float("-inf")), number("took"), number("cost"))
    clean = written(clean, "unranged")
    ranged = written(clean.repartitionByRange(blocks_of(clean, parts, ARRIVALS), "provider", "at", "seq").withColumn("part", F.spark_partition_id()), "arrivals")
    ordered = Window.orderBy("provider", "part")  # one row for each block
    own = Window.partitionBy("provider").orderBy("part")
    blocks = ranged.groupBy("provider", "part").agg(F.min("at").alias("first"))
    blocks = blocks.select("provider", "part", F.row_number().over(ordered).cast("long").alias("block"), (F.row_number().over(own) == 1).alias("head"), F.coalesce(F.lead("first").over(own), F.lit(float("inf"))).alias("until"))
    slots = windows.where("provider is not null").groupBy("provider").agg(F.max("window").alias("window")).withColumnRenamed("provider", "named")
    blocks = written(blocks.join(slots, F.col("provider") == F.col("named"), "left").select("provider", "part", "block", "head", "until", F.coalesce(F.col("window").cast("long"), F.lit(1)).alias("window")), "blocks")
    at_block = blocks.select(F.col("provider").alias("p"), F.col("part").alias("n"), "block")
    arrivals = written(ranged.join(at_block, F.col("provider").eqNullSafe(F.col("p")) & (F.col("part") == F.col("n"))).select("block", F.lit("arrival").alias("kind"), "provider", "job", "seq", "at", "priority", "took", "cost"), "arrivals")
    given = ["block", "kind", "provider", "job", "seq", "at", "priority", "took", "cost"]

    spark, path = jobs.sparkSession, f"{root(jobs.sparkSession)}/admission-{uuid.uuid4().hex}"
    results = lambda: spark.read.schema(f"{ROW}, round int").parquet(path)
    rows, due, current = arrivals, blocks.select("block"), None
    for turn in itertools.count():
        todo = rows.join(due, "block", "left_semi").join(blocks.select("block", "until", "window"), "block")
        todo.groupBy("block").applyInPandas(lambda pdf: _block(pdf, mode == "fifo"), ROW).write.mode("overwrite").parquet(f"{path}/round={turn}")
        # one row for each block: the round that it ran in last, the states before and after it, its number of starts
        ran = results().where(f"round = {turn} and kind = 'state'").select("block", "round", "used", "digest", "nth")
        current = written(ran if current is None else current.join(due, "block", "left_anti").unionByName(ran), "admission_current")
        left = current.select((F.col("block") + 1).alias("block"), F.col("digest").alias("left"), F.col("round").alias("before"))
        due = written(current.join(blocks.where("not head").select("block"), "block").join(left, "block").where("used != left").select("block", "before"), "admission_due")
        if due.isEmpty():
            break
        state = due.select((F.col("block") - 1).alias("block"), F.col("before").alias("round"))
        before = results().where("kind in ('fly', 'wait')").join(state, ["block", "round"], "left_semi").withColumn("block", F.col("block") + 1)
        rows = arrivals.unionByName(before.select(given))
    latest = results().join(current.select("block", "round"), ["block", "round"], "left_semi")

    earlier = Window.partitionBy("provider").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    named = current.join(blocks.select("block", "provider"), "block")
    counts = named.select("block", F.coalesce(F.sum("nth").over(earlier), F.lit(0)).alias("earlier"))
    starts = latest.where("kind = 'start'").join(counts, "block")
    out = starts.select("provider", "job", (F.col("earlier") + F.col("nth")).alias("place"), "at", "started", (F.col("started") + F.col("took")).alias("ends"), F.col("cost").alias("price"))
    plain = ["provider", "job", "place", "at", "started", "ends"]
    if budget is None:
        return out.select(*plain, F.lit(True).alias("paid"))
    out = written(out, "admission_starts")
    event = lambda time, turn, change: F.struct(F.col(time).alias("time"), turn.alias("turn"), change.alias("change"))
    begin = event("started", F.lit(1), F.lit(cost))
    back = event("ends", F.when(F.col("ends") > F.col("started"), 0).otherwise(2), F.col("price") - F.lit(cost))
    events = out.select(F.lit("all").alias("shared"), "provider", F.col("place").alias("nth"), F.explode(F.array(begin, back)).alias("e"))
    summed = running(events.select("shared", "provider", "nth", "e.*"), "shared", ["time", "turn", "provider", "nth"], "change", parts)
    summed = written(summed.where("turn = 1"), "admission_sums")
    stop = summed.where(F.col("upto") > F.lit(budget + 1e-9)).agg(F.min("place").alias("stop"))  # one row
    paid = summed.crossJoin(F.broadcast(stop)).select(F.col("provider").alias("p"), F.col("nth").alias("n"), (F.col("stop").isNull() | (F.col("place") < F.col("stop"))).alias("paid"))
    return out.join(paid, F.col("provider").eqNullSafe(F.col("p")) & (F.col("place") == F.col("n"))).select(*plain, "paid")
