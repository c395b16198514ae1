"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

A source's words form a stream: its documents in the order of the md5 of their doc_id, again from the
start for every further pass. Its target is its share of all words, by weight, at most ``MOST_PASSES``
times its size; the target says how far into the stream the mix reads. Its weight schedule over training
time (piecewise linear, integrated and scaled to one) turns cumulative demand into time; inverting it
gives each pass over a document its training position in [0, 1], and rows are range-sorted by it.

Cumulative sizes come in two levels (sums of hash buckets of a source, then a window within a bucket),
so a source with most of the rows is still spread over many tasks.

Defined results: a null text has size 0; a document of size 0 is never taken and has no position; a
null source is a source of its own, after all others; documents of equal md5 and doc_id follow each
other by size, so repeated rows give the same set of results; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibron.llm.common import WORD, columns_of, written

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Weight schedules, as (time, relative rate) knots, of the sources of each weight: heavy sources early, light ones late.
SCHEDULES = {5: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.5), (1.0, 1.5))}
#: Leading hex digits of the md5 that make a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3


def with_stream_keys(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, source, text, ...)`` with the size, a sortable source key and the place in the stream."""
    return docs.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("__size"),
        F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("__key"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("__order"),
    ).withColumn("__bucket", F.substring("__order", 1, BUCKET_DIGITS))


def targets(sizes: DataFrame) -> DataFrame:
    """(__key, __weight, __source_size, __target) from rows with __key and __size.

    Water-filling in one pass: by ascending limit per weight, a source is held at its limit as long as
    the level that the rest would get is above it; the others share what is left by weight. The windows
    over all sources see one row for each source.
    """
    per = sizes.groupBy("__key").agg(F.sum("__size").alias("__source_size"))
    everything = Window.partitionBy()
    ranked = per.withColumn("__weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(everything.orderBy("__key")) - 1) % len(WEIGHTS) + 1))
    ranked = ranked.withColumn("limit", MOST_PASSES * F.col("__source_size")).withColumn("all", F.sum("__source_size").over(everything))
    by_limit = everything.orderBy(F.col("limit") / F.col("__weight"), "__key")
    before = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("__weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    held = ranked.withColumn("held", F.col("limit") * rest < (F.col("all") - before) * F.col("__weight"))
    left = F.max("all").over(everything) - F.coalesce(F.sum(F.when(F.col("held"), F.col("limit"))).over(everything), F.lit(0))
    share = F.sum(F.when(~F.col("held"), F.col("__weight"))).over(everything)
    level = left * F.col("__weight") / share
    return held.select("__key", "__weight", "__source_size", F.when(F.col("held"), F.col("limit").cast("double")).otherwise(level.cast("double")).alias("__target"))


def position(demand, weight) -> F.Column:
    """Time at which the schedule of a source of this weight has asked for a share ``demand`` of its target."""
    cases = None
    for w, knots in SCHEDULES.items():
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
        whole, done = sum(areas), 0.0
        inverse = None
        for (a, b), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
            v = demand * F.lit(whole) - F.lit(done)
            slope = (b[1] - a[1]) / (b[0] - a[0])
            t = F.lit(a[0]) + 2 * v / (F.lit(a[1]) + F.sqrt(F.greatest(F.lit(a[1] ** 2) + F.lit(2 * slope) * v, F.lit(0.0))))
            done += area
            hit = demand * F.lit(whole) <= F.lit(done)
            inverse = F.when(hit, t) if inverse is None else inverse.when(hit, t)
        inverse = inverse.otherwise(F.lit(knots[-1][0]))
        cases = F.when(weight == w, inverse) if cases is None else cases.when(weight == w, inverse)
    return cases


def assigned(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` of :func:`with_stream_keys` with __source_size, __target, __weight, __goal and __start.

    ``sizes`` holds the same keys and sizes without the texts; its sums by source and bucket are the only
    thing that is aggregated.
    """
    buckets = sizes.groupBy("__key", "__bucket").agg(F.sum("__size").alias("__in_bucket"))
    ahead = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("__ahead", F.coalesce(F.sum("__in_bucket").over(ahead), F.lit(0))).drop("__in_bucket")
    offsets = offsets.join(targets(sizes), "__key").select(F.col("__key").alias("__k"), F.col("__bucket").alias("__b"), "__ahead", "__weight", "__source_size", "__target", F.round("__target").cast("long").alias("__goal"))
    within = Window.partitionBy("__key", "__bucket").orderBy("__order", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets, (rows["__key"] == offsets["__k"]) & (rows["__bucket"] == offsets["__b"])).drop("__k", "__b")
    return joined.withColumn("__start", F.col("__ahead") + F.sum("__size").over(within) - F.col("__size"))


def words_in_pass(e: int) -> F.Column:
    """Words of a document that pass ``e`` over its source takes."""
    return F.least(F.col("__size"), F.greatest(F.lit(0), F.col("__goal") - e * F.col("__source_size") - F.col("__start")))


def scheduled(placed: DataFrame) -> DataFrame:
    """``placed`` of :func:`assigned`, each row once for every pass that takes words of it, with pass, words and position."""
    passes = F.array(*(F.struct(F.lit(e).alias("pass"), words_in_pass(e).alias("words")) for e in range(MOST_PASSES)))
    each = placed.select("*", F.explode(F.filter(passes, lambda p: p["words"] > 0)).alias("__taken"))
    at = position((F.col("__taken.pass") * F.col("__source_size") + F.col("__start")) / F.col("__goal"), F.col("__weight"))
    return each.select(*placed.columns, "__taken.pass", "__taken.words", at.alias("position"))


def in_order(taken: DataFrame) -> DataFrame:
    """Rows of :func:`scheduled` in the order of training."""
    return taken.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


def mixture(docs: DataFrame) -> DataFrame:
    """The training rows in order of position: each document once for every pass that takes at least half of it.

    All columns of ``docs`` stay, ``position`` and ``pass`` are added. Whole documents only: of the one
    document in which a source's target ends, half or more counts as all of it.
    """
    return _mixed(docs).select("row.*", "pass", "position")


def _mixed(docs: DataFrame) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, which so can't clash with those of the operator, with pass and position, in order of position."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = with_stream_keys(docs.select(whole).select("row", *(F.col(f"row.{c}").alias(c) for c in ("doc_id", "text", "source")))).drop("text", "source")
    placed = assigned(rows, rows.select("__key", "__bucket", "__size"))
    taken = scheduled(placed).where(2 * F.col("words") >= F.col("__size"))
    return in_order(taken.select("row", "doc_id", "pass", "position")).drop("doc_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """:func:`mixture` with the columns of ``docs`` alone."""
    return _mixed(docs).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def mixing_query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position (null: not taken).

    The mix is made and written in the order of training; what it takes of a document, and where first, is read from it.
    """
    keyed = written(with_stream_keys(columns_of(docs, "doc_id", "source", "text")).drop("text", "source").withColumn("__row", F.monotonically_increasing_id()), "mix_sizes")
    placed = written(assigned(keyed, keyed.select("__key", "__bucket", "__size")), "mix_places")
    mix = written(in_order(scheduled(placed).select("__row", "doc_id", "pass", "words", "position")), "mix")
    per = mix.groupBy("__row").agg(F.sum("words").alias("taken"), F.min("position").alias("first"))
    out = placed.join(per, "__row", "left")
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.round("__target", 6).alias("target"), F.coalesce("taken", F.lit(0)).alias("taken"), F.round("first", 9).alias("first_position"))


MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w, 3 * source_size AS lim, sum(source_size) OVER () AS total FROM s),
h AS (SELECT *, lim * sum(w) OVER (ORDER BY lim / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      < (total - coalesce(sum(lim) OVER (ORDER BY lim / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS held FROM r),
t AS (SELECT source, source_size, w, CASE WHEN held THEN lim::DOUBLE ELSE
      (total - coalesce(sum(CASE WHEN held THEN lim END) OVER (), 0))::DOUBLE * w / sum(CASE WHEN NOT held THEN w END) OVER () END AS target FROM h),
c AS (SELECT d.doc_id, d.size, t.source_size, t.w, t.target, round(t.target)::BIGINT AS goal,
      (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (least(size, greatest(0, goal - start)) + least(size, greatest(0, goal - source_size - start)) + least(size, greatest(0, goal - 2 * source_size - start)))::BIGINT AS taken,
      start::DOUBLE / nullif(goal, 0) AS u FROM c)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken,
  CASE WHEN taken > 0 THEN round(CASE w WHEN 5 THEN 2 * u / (1.5 + sqrt(2.25 - 2 * u)) WHEN 2 THEN u ELSE 2 * u / (0.5 + sqrt(0.25 + 2 * u)) END, 9) END AS first_position
FROM k
"""
