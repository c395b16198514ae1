"""Queries over replies, scenes and ranking states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibron.operators import grading as G
from calibron.operators import ranking as R
from calibron.operators import spatial as S
from calibron.plans.registry import query
from calibron.sources.scratch import written

NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g'))"
WORDS = "['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen','twenty']"
TOKENS = f"list_filter(string_split({NORM.format('reply')}, ' '), lambda t : t <> '')"
EXTRACT = f"""CASE WHEN regexp_full_match(answer, '\\d+') THEN (CASE WHEN list_contains({WORDS}, num) THEN CAST(list_position({WORDS}, num) - 1 AS STRING) ELSE num END) ELSE opt END"""
GRADED = f"""SELECT *, {EXTRACT} AS got FROM (SELECT *, list_filter(toks, lambda t : regexp_full_match(t, '\\d+') OR list_contains({WORDS}, t))[-1] AS num,
 list_filter(toks, lambda t : list_contains(string_split(CASE WHEN options = '' THEN answer ELSE options END, ','), t))[-1] AS opt FROM (SELECT *, {TOKENS} AS toks FROM replies))"""


def options(c: str = "options"):
    return F.filter(F.split(c, ","), lambda x: x != "")


@query("t1_normalize", f"SELECT conv_id, turn, md5({NORM.format('reply')}) AS norm FROM replies")
def t1(d):
    return d.replies.select("conv_id", "turn", F.md5(G.normalized(F.col("reply")).cast("binary")).alias("norm"))


@query("t2_tokens", f"SELECT conv_id, turn, len({TOKENS}) AS n FROM replies")
def t2(d):
    return d.replies.select("conv_id", "turn", F.size(G.tokens(F.col("reply"))).cast("long").alias("n"))


@query("t3_extract", f"SELECT conv_id, turn, got FROM ({GRADED})")
def t3(d):
    return d.replies.select("conv_id", "turn", G.extracted(F.col("reply"), F.col("answer"), options()).alias("got"))


ALIASED = GRADED.replace("CASE WHEN options = '' THEN answer ELSE options END", "answer || ',' || options")


@query("t3_extract_aliases", f"SELECT conv_id, turn, got FROM ({ALIASED})")
def t3_aliases(d):
    """What is extracted where the words of ``options`` are aliases of the answer and no options are named."""
    none = F.array().cast("array<string>")
    return d.replies.select("conv_id", "turn", G.extracted(F.col("reply"), F.col("answer"), none, options()).alias("got"))


@query("t4_grade", f"SELECT conv_id, turn, coalesce(got = answer, false) AS correct FROM ({GRADED})")
def t4(d):
    return d.replies.select("conv_id", "turn", G.graded(F.col("reply"), F.col("answer"), options()).alias("correct"))


@query("t5_number_alias", f"SELECT DISTINCT turn, ({WORDS})[turn + 1] AS alias FROM replies")
def t5(d):
    return d.replies.select("turn", G.number_alias(F.col("turn").cast("int")).alias("alias")).distinct()


@query("t6_prompts", "SELECT item_id, 'Question: ' || subtask || '\n' || 'Answer with a number. data:text/plain;base64,' || to_base64(item_id::BLOB) AS prompt FROM items")
def t6(d):
    return d.items.select("item_id", F.concat(F.lit("Question: "), "subtask", F.lit("\nAnswer with a number. data:text/plain;base64,"), F.base64(F.col("item_id").cast("binary"))).alias("prompt"))


@query("s7_replies_by_role", "SELECT role, count(*) AS n, count(*) FILTER (WHERE trim(text) = '') AS empty FROM conversations GROUP BY 1")
def s7(d):
    return d.conversations.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim("text") == "").alias("empty"))


@query("x3_unparseable", f"SELECT conv_id % 5 AS kind, count(*) AS n, count(*) FILTER (WHERE got IS NULL) AS unparseable, round(avg(CASE WHEN coalesce(got = answer, false) THEN 1 ELSE 0 END), 6) AS accuracy FROM ({GRADED}) GROUP BY 1")
def x3(d):
    got = G.extracted(F.col("reply"), F.col("answer"), options())
    rows = d.replies.select((F.col("conv_id") % 5).alias("kind"), got.alias("got"), G.graded(F.col("reply"), F.col("answer"), options()).cast("int").alias("ok"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("got").isNull()).alias("unparseable"), F.round(F.avg("ok"), 6).alias("accuracy"))


CUBES = "SELECT scene, x, y, CAST(u.z AS INT) AS z FROM heights, unnest(range(0, h)) AS u(z)"
SEEN = f"SELECT scene, x, y, z, count(*) AS cells FROM (SELECT *, row_number() OVER (PARTITION BY scene, u, v ORDER BY x + y + z DESC) AS k FROM (SELECT c.*, x - y + du AS u, x + y - 2 * z + dv AS v FROM ({CUBES}) c CROSS JOIN (VALUES (0), (-1)) p(du) CROSS JOIN (VALUES (-1), (0), (1)) q(dv))) WHERE k = 1 GROUP BY 1, 2, 3, 4"
TOTALS = f"SELECT t.scene, total, tallest, footprint, coalesce(n, 0) AS n_visible, total - coalesce(n, 0) AS n_hidden FROM (SELECT scene, sum(h)::BIGINT AS total, max(h) AS tallest, count(*) FILTER (WHERE h > 0) AS footprint FROM heights GROUP BY 1) t LEFT JOIN (SELECT scene, count(*) AS n FROM ({SEEN}) GROUP BY 1) s USING (scene)"
MARKS = f"SELECT scene, min(x * 10000 + y * 100 + z) AS r, max(x * 10000 + y * 100 + z) AS b FROM ({SEEN}) GROUP BY 1 HAVING count(*) > 1"
MARKED = f"SELECT scene, r // 10000 AS rx, r % 10000 // 100 AS ry, r % 100 AS rz, b // 10000 AS bx, b % 10000 // 100 AS \"by\", b % 100 AS bz FROM ({MARKS})"


def cubes(d):
    return S.cubes(d.heights)


def totals(d):
    return S.totals(d.heights, S.visible(cubes(d)))


def marks(d):
    code = F.col("x") * 10000 + F.col("y") * 100 + F.col("z")
    m = S.visible(cubes(d)).groupBy("scene").agg(F.min(code).alias("r"), F.max(code).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    part = lambda c: (F.floor(F.col(c) / 10000).cast("int"), F.floor(F.col(c) % 10000 / 100).cast("int"), F.col(c) % 100)
    return m.select("scene", *(e.alias(f"{c}{a}") for c in "rb" for a, e in zip("xyz", part(c), strict=True)))


@query("g2_cubes", CUBES)
def g2(d):
    return cubes(d)


@query("g2_scene_totals", TOTALS)
def g2_totals(d):
    return totals(d)


@query("g3_projection", f"SELECT scene, x, y, z, (x - y) * 28 AS px, CAST((x + y) * 28 // 2 - z * 28 AS BIGINT) AS py FROM ({CUBES})")
def g3(d):
    return S.projected(cubes(d))


@query("g5_visible_cubes", SEEN)
def g5(d):
    return S.visible(cubes(d))


COUNTING = f"SELECT scene, u.subtask, u.answer FROM ({TOTALS}), LATERAL (VALUES ('count_visible', CAST(n_visible AS STRING)), ('count_total', CAST(total AS STRING)), ('count_hidden', CAST(n_hidden AS STRING)), ('tallest_column', CAST(tallest AS STRING)), ('count_ground', CAST(footprint AS STRING))) u(subtask, answer)"


@query("g7_counting_questions", COUNTING)
def g7(d):
    return S.counting_questions(totals(d))


RELATIONS = f"SELECT scene, u.subtask, u.answer FROM ({MARKED}), LATERAL (VALUES ('relation_height', CASE WHEN rz > bz THEN 'red' WHEN rz < bz THEN 'blue' END), ('relation_left_right', CASE WHEN rx - ry < bx - \"by\" THEN 'left' WHEN rx - ry > bx - \"by\" THEN 'right' END), ('relation_near_far', CASE WHEN rx + ry > bx + \"by\" THEN 'red' WHEN rx + ry < bx + \"by\" THEN 'blue' END)) u(subtask, answer) WHERE u.answer IS NOT NULL"


@query("g8_relation_questions", RELATIONS)
def g8(d):
    return S.relation_questions(marks(d))


SUPPORT = f"SELECT m.scene, u.subtask, u.answer FROM ({MARKED}) m JOIN heights h ON h.scene = m.scene AND h.x = rx AND h.y = ry, LATERAL (VALUES ('support_on_ground', CASE WHEN rz = 0 THEN 'yes' ELSE 'no' END), ('count_above_red', CAST(h.h - rz - 1 AS STRING))) u(subtask, answer)"


@query("g9_support_questions", SUPPORT)
def g9(d):
    return S.support_questions(marks(d), d.heights)


@query("g10_triple_questions", f"SELECT scene, subtask, min(colour) AS answer FROM (SELECT *, max(value) OVER (PARTITION BY scene, subtask) AS top FROM (SELECT c.scene, c.colour, u.subtask, u.value FROM (SELECT *, CASE (x + y + z) % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE 'green' END || CAST(x AS STRING) || CAST(y AS STRING) AS colour FROM ({CUBES})) c, LATERAL (VALUES ('triple_leftmost', y - x), ('triple_highest', z), ('triple_nearest', x + y)) u(subtask, value))) WHERE value = top GROUP BY 1, 2 HAVING count(*) = 1")
def g10(d):
    name = F.get(F.array(F.lit("red"), F.lit("blue"), F.lit("green")), ((F.col("x") + F.col("y") + F.col("z")) % 3).cast("int"))
    return S.triple_questions(cubes(d).withColumn("colour", F.concat(name, F.col("x").cast("string"), F.col("y").cast("string"))))


@query("x10_occupied_cells", f"SELECT p.scene, p.x, p.y, p.z FROM (SELECT scene, x, y, z + 1 AS z FROM ({CUBES})) p WHERE EXISTS (SELECT 1 FROM ({CUBES}) c WHERE c.scene = p.scene AND c.x = p.x AND c.y = p.y AND c.z = p.z)")
def x10(d):
    probes = cubes(d).withColumn("z", F.col("z") + 1)
    return probes.join(cubes(d), ["scene", "x", "y", "z"], "left_semi")


def lanes(d):
    """Score, variance, least variance after one more answer and open items of every model; every fifth item has been asked."""
    answers = d.responses.where("item_idx % 5 = 0").select("model", "item_idx", "dim", "a", "b", "y")
    pool = written(R.pool_rows(answers, R.family_weights(d.items.select("item_idx", "a", "b", "dim")), answers), "pool")
    best = R.variances_after(pool).groupBy("model").agg(F.min(F.struct("v_new", "item_idx")).alias("b"), F.count(F.lit(1)).alias("n_open"))
    return written(R.scores(pool).join(best, "model", "left").select("model", "s", "v", F.col("b.item_idx").cast("long").alias("item_idx"), "b.v_new", "n_open"), "lanes")


@query("m18_next_allocation")
def m18(d):
    """The next call over all models, and the misordered pairs expected before it."""
    rows = lanes(d)
    return R.next_call(rows).crossJoin(R.expected_misordered(rows).select("misordered"))


@query("e11_lookahead_sets")
def e11(d):
    """The next call under shorter and longer lookahead."""
    sets = {"one": (1,), "short": (1, 2, 4), "default": R.LOOKAHEAD, "long": (*R.LOOKAHEAD, 128, 256)}
    falls = written(R.call_falls(lanes(d), lookahead=sets["long"]), "falls")  # those of the other sets are among them
    named = [R.largest(R.best_gains(falls, steps)).withColumn("steps", F.lit(name)) for name, steps in sets.items()]
    return reduce(DataFrame.unionByName, named)


@query("f17_anchors_never_asked")
def f17(d):
    """Gains where every fourth model is an anchor: it counts in the ranking of the others, and is never asked."""
    anchor = F.substring_index("model", "-", -1).cast("long") % 4 == 0
    rows = lanes(d)
    shut = rows.select("model", "s", "v", *(F.when(~anchor, F.col(c)).alias(c) for c in ("item_idx", "v_new", "n_open")))
    return R.call_gains(shut).select("model", "item_idx", F.round("gain", 9).alias("gain"))


@query("g6_marked_cubes")
def g6(d):
    """Two and three coloured cubes of each scene, as far apart and as close together as its visible cubes allow."""
    seen = written(S.visible(cubes(d)), "visible")
    out = None
    for n in (2, 3):
        for hard in (False, True):
            rows = S.marked(seen, n, hard).withColumns({"n": F.lit(n), "hard": F.lit(hard)})
            out = rows if out is None else out.unionByName(rows)
    return out


WORDINGS = ", ".join(f"('{k}', '{v}')" for k, v in S.WORDING.items())


@query("g12_scene_items", f"""WITH q AS (SELECT scene, subtask, answer FROM ({COUNTING}) UNION ALL SELECT scene, subtask, answer FROM ({RELATIONS}) UNION ALL SELECT scene, subtask, answer FROM ({SUPPORT})),
 m AS (SELECT scene, string_agg(CAST(x AS STRING) || ',' || CAST(y AS STRING) || ':' || CAST(h AS STRING), ' ' ORDER BY x, y) AS heights, CAST(max(h) AS INT) AS max_h FROM heights GROUP BY scene)
 SELECT printf('sc-%04d-%s', q.scene, q.subtask) AS item_id, q.scene, q.subtask, w.question, q.answer, m.heights, m.max_h, round(1 - t.n_visible / CAST(t.total AS DOUBLE), 6) AS hidden_share
 FROM q JOIN m ON m.scene = q.scene JOIN ({TOTALS}) t ON t.scene = q.scene JOIN (VALUES {WORDINGS}) w(subtask, question) ON w.subtask = q.subtask""")
def g12(d):
    """Scenes as items: every counting, relation and support question with its wording, answer and the scene it belongs to."""
    sums, two = written(totals(d), "totals"), written(marks(d), "marks")
    questions = S.counting_questions(sums).unionByName(S.relation_questions(two)).unionByName(S.support_questions(two, d.heights))
    return S.scene_items(questions, d.heights, sums, "sc").withColumn("hidden_share", F.round("hidden_share", 6))
