"""Stacked-cube scenes: cubes, visibility on the triangular lattice, questions."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cubes(heights: DataFrame) -> DataFrame:
    """(scene, x, y, z): the cubes of (scene, x, y, h) columns."""
    return heights.where("h > 0").select("scene", "x", "y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("z"))


def projected(cubes_: DataFrame, size: int = 28) -> DataFrame:
    """Screen position of each cube's upper centre in the isometric view (origin 0)."""
    return cubes_.withColumns({"px": (F.col("x") - F.col("y")) * size, "py": F.floor((F.col("x") + F.col("y")) * size / 2) - F.col("z") * size})


def visible(cubes_: DataFrame) -> DataFrame:
    """(scene, x, y, z, cells): cubes that own at least one of the six lattice cells that they cover.

    Moving by (1, 1, 1) leaves the picture unchanged, so with u = x - y and v = x + y - 2z a cube covers
    six triangles of the lattice, and the cube with the largest x + y + z owns a triangle. The cubes of a scene
    meet in its row, where one map keeps the largest depth of each triangle; only cubes are shuffled, and no
    task sorts their triangles.
    """
    packed = cubes_.select("scene", F.struct("x", "y", "z").alias("c")).repartition("scene").groupBy("scene").agg(F.collect_list("c").alias("c"))
    kind = {n: cubes_.schema[n].dataType.simpleString() for n in ("scene", "x", "y", "z")}

    def owned(batches):
        for pdf in batches:
            rows = []
            for scene, found in zip(pdf["scene"], pdf["c"], strict=True):
                found = [(c["x"], c["y"], c["z"]) for c in found]
                top: dict[tuple[int, int], tuple[int, tuple[int, int, int]]] = {}
                for x, y, z in found:
                    u, v = x - y, x + y - 2 * z
                    for at in ((u + du, v + dv) for du in (0, -1) for dv in (-1, 0, 1)):
                        if at not in top or top[at][0] < x + y + z:
                            top[at] = x + y + z, (x, y, z)
                cells = Counter(cube for _, cube in top.values())
                rows += [(scene, *cube, n) for cube, n in cells.items()]
            yield pd.DataFrame(rows, columns=["scene", "x", "y", "z", "cells"])

    return packed.mapInPandas(owned, ", ".join(f"{n} {k}" for n, k in kind.items()) + ", cells long")


def totals(heights: DataFrame, visible_cubes: DataFrame) -> DataFrame:
    """(scene, total, tallest, footprint, n_visible, n_hidden)."""
    per = heights.groupBy("scene").agg(F.sum("h").alias("total"), F.max("h").alias("tallest"), F.count_if(F.col("h") > 0).alias("footprint"))
    seen = visible_cubes.groupBy("scene").agg(F.count(F.lit(1)).alias("n_visible"))
    out = per.join(seen, "scene", "left").withColumn("n_visible", F.coalesce("n_visible", F.lit(0)))
    return out.withColumn("n_hidden", F.col("total") - F.col("n_visible"))


def counting_questions(t: DataFrame) -> DataFrame:
    """(scene, subtask, answer): one row for each counting question."""
    asked = {"count_visible": "n_visible", "count_total": "total", "count_hidden": "n_hidden", "tallest_column": "tallest", "count_ground": "footprint"}
    rows = F.array(*(F.struct(F.lit(k).alias("subtask"), F.col(c).cast("string").alias("answer")) for k, c in asked.items()))
    return t.select("scene", F.explode(rows).alias("q")).select("scene", "q.subtask", "q.answer")


def relation_questions(marks: DataFrame) -> DataFrame:
    """(scene, subtask, answer) of red and blue cubes (rx, ry, rz, bx, by, bz), as the viewer sees them; ties are skipped."""
    side = lambda c: F.col(f"{c}x") - F.col(f"{c}y")
    near = lambda c: F.col(f"{c}x") + F.col(f"{c}y")
    rows = F.array(
        F.struct(F.lit("relation_height").alias("subtask"), F.when(F.col("rz") > F.col("bz"), "red").when(F.col("rz") < F.col("bz"), "blue").alias("answer")),
        F.struct(F.lit("relation_left_right").alias("subtask"), F.when(side("r") < side("b"), "left").when(side("r") > side("b"), "right").alias("answer")),
        F.struct(F.lit("relation_near_far").alias("subtask"), F.when(near("r") > near("b"), "red").when(near("r") < near("b"), "blue").alias("answer")),
    )
    return marks.select("scene", F.explode(rows).alias("q")).select("scene", "q.subtask", "q.answer").where("answer is not null")


def support_questions(marks: DataFrame, heights: DataFrame) -> DataFrame:
    """(scene, subtask, answer): whether the red cube stands on the ground, and how many stand on it."""
    h = heights.select(F.col("scene").alias("s"), F.col("x").alias("hx"), F.col("y").alias("hy"), "h")
    on = marks.join(h, (F.col("scene") == F.col("s")) & (F.col("rx") == F.col("hx")) & (F.col("ry") == F.col("hy")))
    rows = F.array(
        F.struct(F.lit("support_on_ground").alias("subtask"), F.when(F.col("rz") == 0, "yes").otherwise("no").alias("answer")),
        F.struct(F.lit("count_above_red").alias("subtask"), (F.col("h") - F.col("rz") - 1).cast("string").alias("answer")),
    )
    return on.select("scene", F.explode(rows).alias("q")).select("scene", "q.subtask", "q.answer")


def triple_questions(marks3: DataFrame) -> DataFrame:
    """(scene, subtask, answer) of three marked cubes in rows (scene, colour, x, y, z): a unique winner only."""
    values = F.array(
        F.struct(F.lit("triple_leftmost").alias("subtask"), (F.col("y") - F.col("x")).alias("value")),
        F.struct(F.lit("triple_highest").alias("subtask"), F.col("z").alias("value")),
        F.struct(F.lit("triple_nearest").alias("subtask"), (F.col("x") + F.col("y")).alias("value")),
    )
    rows = marks3.select("scene", "colour", F.explode(values).alias("q")).select("scene", "colour", "q.*")
    best = Window.partitionBy("scene", "subtask")
    won = rows.withColumn("top", F.max("value").over(best)).where("value = top")
    return won.groupBy("scene", "subtask").agg(F.count(F.lit(1)).alias("n"), F.min("colour").alias("answer")).where("n = 1").drop("n")


#: Colours of marks in their order.
MARKS = ("red", "blue", "green")


def chosen(candidates: list[tuple[int, int, int]], n: int, hard: bool) -> tuple[int, list[tuple[int, int, int]]] | None:
    """(spread, cubes): n of the sorted candidates with the largest, or if ``hard`` the smallest, distance between their
    furthest two on screen. Three or more differ on every axis that questions ask about, two in their place on screen.
    Of equal spreads the first in the order of the candidates; None if there is no such set.

    Branch and bound: a set that grows keeps its spread or widens it, and can't exceed the widest pair with any
    of the candidates that are left.
    """
    at = [(x - y, z, x + y) for x, y, z in candidates]
    apart = [[abs(p[0] - q[0]) + abs(p[1] - q[1]) for q in at] for p in at]
    fits = [[all(a != b for a, b in zip(p, q, strict=True)) if n > 2 else p[:2] != q[:2] for q in at] for p in at]
    reach = max((max(row) for row in apart), default=0)
    best: list = [None, None]

    def better(spread: int) -> bool:
        return best[0] is None or (spread < best[0] if hard else spread > best[0])

    def grow(first: int, taken: list[int], spread: int) -> None:
        if len(taken) == n:
            if better(spread):
                best[:] = [spread, list(taken)]
            return
        if not better(spread if hard else reach):
            return
        for k in range(first, len(at) - (n - len(taken)) + 1):
            if all(fits[k][t] for t in taken):
                grow(k + 1, [*taken, k], max([spread, *(apart[k][t] for t in taken)]))

    grow(0, [], 0)
    return None if best[0] is None else (best[0], [candidates[k] for k in best[1]])


def marked(visible_cubes: DataFrame, n: int = 2, hard: bool = False, min_share: float = 0.5) -> DataFrame:
    """(scene, spread, colour, x, y, z): the marks of each scene; a scene without enough clearly visible cubes has none.

    A cube shows clearly if its share of the picture (``cells`` of :func:`visible`) is ``min_share`` of the largest
    or more. The candidates of a scene meet in its row, so a scene is searched in one task.
    """
    if not 2 <= n <= len(MARKS):
        raise ValueError(f"2 to {len(MARKS)} cubes can be marked, not {n}")
    cube = F.struct("x", "y", "z", "cells")
    packed = visible_cubes.groupBy("scene").agg(F.collect_list(cube).alias("c"), F.max("cells").alias("most"))
    clear = packed.select("scene", F.array_sort(F.transform(F.filter("c", lambda c: c["cells"] >= min_share * F.col("most")), lambda c: F.array(c["x"].cast("int"), c["y"].cast("int"), c["z"].cast("int")))).alias("clear")).where(F.size("clear") >= n)

    def search(batches):
        for pdf in batches:
            rows = []
            for scene, cubes_ in zip(pdf["scene"], pdf["clear"], strict=True):
                if (found := chosen([tuple(map(int, c)) for c in cubes_], n, hard)) is not None:
                    rows += [(scene, found[0], MARKS[k], *c) for k, c in enumerate(found[1])]
            yield pd.DataFrame(rows, columns=["scene", "spread", "colour", "x", "y", "z"])

    return clear.mapInPandas(search, f"scene {visible_cubes.schema['scene'].dataType.simpleString()}, spread int, colour string, x int, y int, z int")


#: What each subtask asks.
WORDING = {
    "count_visible": "How many cubes can be seen?",
    "count_total": "How many cubes does the scene have, hidden ones among them?",
    "count_hidden": "How many cubes are hidden?",
    "tallest_column": "How many cubes does the tallest column have?",
    "count_ground": "How many cubes stand on the ground?",
    "relation_height": "Is the red or the blue cube higher up?",
    "relation_left_right": "Is the red cube left or right of the blue one?",
    "relation_near_far": "Is the red or the blue cube nearer?",
    "support_on_ground": "Does the red cube stand on the ground?",
    "count_above_red": "How many cubes stand on the red one?",
}


def scene_items(questions: DataFrame, heights: DataFrame, totals: DataFrame, prefix: str) -> DataFrame:
    """(item_id, scene, subtask, question, answer, heights, max_h, hidden_share) of ``questions(scene, subtask, answer)``.

    item_id is prefix-scene-subtask, scenes in at least four digits. heights lists the columns of the scene as
    ``x,y:h`` in the order of x and y, and hidden_share is the share of its cubes that can't be seen (null without
    cubes). A subtask without a wording keeps a null question. Columns of a scene are few; they meet in one row.
    """
    column = F.struct("x", "y", "h")
    plan = heights.groupBy("scene").agg(F.array_sort(F.collect_list(column)).alias("c"), F.max("h").cast("int").alias("max_h"))
    cell = lambda c: F.concat(c["x"].cast("string"), F.lit(","), c["y"].cast("string"), F.lit(":"), c["h"].cast("string"))
    plan = plan.select("scene", F.array_join(F.transform("c", cell), " ").alias("heights"), "max_h")
    seen = totals.select("scene", F.when(F.col("total") > 0, 1 - F.col("n_visible") / F.col("total")).alias("hidden_share"))
    wording = F.create_map(*(F.lit(v) for pair in WORDING.items() for v in pair))
    name = F.format_string(f"{prefix}-%04d-%s", "scene", "subtask")
    rows = questions.join(plan, "scene", "left").join(seen, "scene", "left")
    return rows.select(name.alias("item_id"), "scene", "subtask", F.try_element_at(wording, F.col("subtask")).alias("question"), "answer", "heights", "max_h", "hidden_share")
