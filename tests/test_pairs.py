"""All pairs of rows by blocks against plain loops, and the rounding of their gaps."""

import math
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from calibron.operators import abilities as A
from calibron.operators import pairs as P
from calibron.plans import catalogue
from calibron.sources.domain import Domain


@pytest.mark.parametrize("block_rows", [2048, 7, 1])
def test_ordered_pairs_are_all_pairs(spark, monkeypatch, block_rows):
    """One block, several, and one a row; with a repeated key, a null key and a null value."""
    monkeypatch.setattr(P, "BLOCK_ROWS", block_rows)
    rows = [(f"model-{k}", k * 7 % 11 / 11) for k in range(40)] + [("model-5", 0.5)] * 3 + [("model-é", None), (None, 0.25)]
    random.Random(1).shuffle(rows)
    got = P.ordered_pairs(spark.createDataFrame(rows, "k string, v double"), "k", "v")
    want = [(a, b, u, v) for a, u in rows for b, v in rows if a is not None and b is not None and a.encode() < b.encode()]
    assert got.columns == ["lo", "hi", "x", "y"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_no_rows_and_one(spark):
    for rows in ([], [("a", 1.0)], [(None, 1.0)]):
        assert P.ordered_pairs(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect() == []


def test_model_pairs_meet_in_blocks(spark, monkeypatch):
    """Blocks meet by key in many tasks, and neither the answers are averaged again for each side nor all models go to all."""
    monkeypatch.setattr(P, "BLOCK_ROWS", 16)
    got = catalogue.queries()["j6_model_pairs"](spark, "/root/testdata/sf0.01")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("CartesianProduct", "NestedLoopJoin", "Aggregate", "Broadcast")) and "SortMergeJoin" in plan
    sizes = [n for n in got.groupBy(F.spark_partition_id()).count().select("count").toPandas()["count"]]
    assert sum(sizes) == 4950 and len(sizes) > 4 and max(sizes) < 4950 / 2


def test_rounded_is_round(spark):
    """Quotients, exact halves of the last place and their neighbours, small, large and special numbers."""
    rng = random.Random(3)
    values = [a / rng.randint(1, 400) - b / rng.randint(1, 400) for a, b in ((rng.randint(0, 400), rng.randint(0, 400)) for _ in range(20_000))]
    halves = [(2 * k + 1) / 2e6 for k in (*range(200), *(rng.randint(0, 999_999) for _ in range(3000)))]
    values += [s * math.nextafter(h, to) for h in halves for s in (1, -1) for to in (0, h, 1)]
    values += [s * (2 * rng.randint(0, 2**12) + 1) / 2**k for k in range(7, 25) for s in (1, -1)]
    values += [0.0, -0.0, 1e-9, -1e-9, 1.0, -1.0, 1.0000005, 123456.7890125, 1e17, 5e-324, math.nan, math.inf, -math.inf, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(P.rounded(F.col("v")).alias("a"), F.round("v", 6).alias("b"))
    assert all(repr(r.a) == repr(r.b) for r in df.collect())


def test_pairs_are_small_in_a_file(spark, tmp_path):
    """2,000 models of 50 accuracies: a file keeps a pair in about a byte, names and gap, and not in the gap's eight."""
    rng = random.Random(4)
    rows = [(f"model-{k}", rng.randrange(50) / 263 + 0.3) for k in rng.sample(range(10**6), 2000)]
    pairs = P.ordered_pairs(spark.createDataFrame(rows, "k string, v double"), "k", "v")
    pairs.select("lo", "hi", P.rounded(F.col("x") - F.col("y")).alias("gap")).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 1999 * 1000
    assert sum(p.stat().st_size for p in Path(f"{tmp_path}/pairs").glob("*.parquet")) < 1999 * 1000


def test_pairs_of_blocks_that_differ_much(spark, monkeypatch):
    """Equal values that fill several blocks, strips shorter than a block, and blocks of unlike sizes."""
    monkeypatch.setattr(P, "BLOCK_ROWS", 16)
    monkeypatch.setattr(P, "STRIP_ROWS", 3)
    rows = [(f"m{k}", 0.5) for k in range(70)] + [(f"m{k}", k / 1000) for k in range(50, 120)]
    got = P.ordered_pairs(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()
    assert sorted(map(tuple, got)) == sorted((a, b, u, v) for a, u in rows for b, v in rows if a < b)


def test_accuracies_are_means_of_responses(spark, monkeypatch, tmp_path):
    """Over a table and over odd rows: unknown parts, parts twice, nulls; in one task and in several."""
    spark.sql("SELECT * FROM VALUES (1L, 'A', 5), (2L, 'A', 6), (2L, 'A', 6), (3L, NULL, 6), (4L, 'B', NULL), (5L, 'B', 5) AS t(p_partkey, p_type, p_size)").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(p, s, f) for p in (1, 2, 2, 3, 4, 5, 9, None) for s in (*range(12), None) for f in ("N", "A", None) if (p or 0) * (s or 1) % 5 != 3 or f == "N"]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    for sf_dir in ("/root/testdata/sf0.01", str(tmp_path)):
        d = Domain(spark, sf_dir)
        want = sorted(map(tuple, d.responses.where("model is not null").groupBy("model").agg(F.avg("y")).collect()))
        for rows in (500_000, 50):
            monkeypatch.setattr(A, "ANSWER_ROWS", rows)
            assert sorted(map(tuple, A.accuracies(d).collect())) == want and len(want) > 9
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = catalogue.queries()["j6_model_pairs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalogue.oracle_sql()["j6_model_pairs"]).fetchall()) and len(got) == 66


def test_accuracies_shuffle_no_columns_of_items(spark):
    """After the answers meet their items, only keys and the answer are shuffled."""
    plan = A.accuracies(Domain(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan()
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "RepartitionByExpression":
            assert sorted(a.split("#")[0] for a in node.output().mkString(",").split(",")) == ["item_idx", "l_suppkey", "y"]
            return
    raise AssertionError("answers are not dealt out")
