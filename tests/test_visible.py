"""Visible cubes against the SQL, and that no task sorts the triangles of its scenes."""

import duckdb

from calibron.operators import spatial
from calibron.plans import catalogue
from calibron.sources.domain import RAW, Domain


def test_scene_queries_equal_their_sql_and_shuffle_cubes_only(spark, sf_dir):
    con = duckdb.connect()
    for t in RAW:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in ("g5_visible_cubes", "g2_scene_totals", "g8_relation_questions", "g12_scene_items"):
        got = catalogue.queries()[name](spark, sf_dir)
        want = con.sql(catalogue.oracle_sql()[name])
        want = want.project(", ".join(f'"{c}"' for c in got.columns))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
    seen = spatial.visible(spatial.cubes(Domain(spark, sf_dir).heights))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
