"""License scans: sparse TF-IDF cosine of header blocks and licence files to templates, inherited by directory.

Units that are compared are, of every text, the lines that name a licence (by ``MARKER``), the blocks of
adjacent lines with such a line (a line without letter or digit ends a block, so a comment's ``*`` does),
all these blocks together and, of a licence file (LICENSE, COPYING ...), the whole text. A unit's vector
holds tf * idf of its terms; the idf counts in how many of all rows a term of the templates occurs, terms
outside the templates get the largest idf. A unit takes the template with the largest cosine if that is
at least ``THRESHOLD``; a row takes the best of its units, first by the template's rank (a text that names
a licence goes before one that a family shares, and both before a bare "All rights reserved."), then by
the cosine, then the smaller licence id. A file without a licence of its own inherits that of the licence
file in its nearest ancestor directory, by a join of directories with the ancestors of each distinct one.

How it is spread: the texts are scanned once. In the row a unit becomes the list of its known terms and
one number for all others, so nothing that grows with a unit stands beside each of its terms; the rows
so written carry a key of their own. All later steps join and group these small rows. DataFrame
functions only; the templates are a fixed table (:mod:`calibron.llm.license_texts`).

Defined results: every input row gives one row, also where ``file`` is null or repeated; each is judged
by its own text. Null and empty texts have no licence of their own and inherit; very long texts are
scanned whole, in time proportional to their length (sorting of unknown terms aside); if a directory has
several licence files the same order decides; a null path inherits nothing; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibron.llm.common import columns_of, let, written
from calibron.llm.license_texts import TEMPLATES

MARKER = r"(?i:licen[cs]e|copyright|copying|rights reserved|public domain|redistribut|permission|free software|provided .?as is|endorse or promote|creative commons|mozilla public|spdx|\bGPL|\bCC[ -]?(BY|0))"
FILE_NAME = r"(?i:(^|/)(un)?(licen[cs]e|copying|copyright)([.-][^/]*)?$)"
NOT_TERM = r"[^\p{L}0-9.]+|\.(?![0-9])"
BLANK_LINE = r"\n[^\p{L}\p{N}\n]*\n"
THRESHOLD = 0.6


def terms(text) -> F.Column:
    return F.filter(F.split(F.lower(text), NOT_TERM), lambda t: t != "")


def _literal(spark: SparkSession, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """A table of fixed rows inside the plan."""
    return spark.range(1).select(F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows))).alias("r")).select("r.*")


def templates(spark: SparkSession) -> DataFrame:
    """(template, license, rank, term, tf): a row for each term of each template."""
    rows = _literal(spark, ("template", "license", "rank", "text"), [(k, *t) for k, t in enumerate(TEMPLATES)])
    return rows.select("template", "license", "rank", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "rank", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary() -> list[str]:
    """Terms of the templates, as :func:`terms` splits them."""
    return sorted({t for _, _, text in TEMPLATES for t in re.split(r"[^a-z0-9.]+|\.(?![0-9])", text.lower()) if t})


def squares_of_counts(items) -> F.Column:
    """Sum over the distinct values of an array of the square of their number, by one pass over the sorted array."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))

    def step(s, t):
        run = F.when(s["last"].eqNullSafe(t), s["run"]).otherwise(F.lit(0.0))
        return F.struct(t.alias("last"), (run + 1).alias("run"), (s["total"] + 2 * run + 1).alias("total"))

    return F.aggregate(F.sort_array(items), start, step, lambda s: s["total"])


def units_col(text, path) -> F.Column:
    """The units of a text: marker lines, marker blocks, all marker blocks together, the whole of a licence file."""
    none = F.array().cast("array<string>")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(MARKER))
    blocks = F.filter(F.split(text, BLANK_LINE), lambda x: x.rlike(MARKER))
    together = let(blocks, lambda b: F.concat(b, F.when(F.size(b) > 1, F.array(F.array_join(b, "\n"))).otherwise(none)))
    whole = F.when(F.coalesce(path.rlike(FILE_NAME), F.lit(False)), F.array(text)).otherwise(none)
    return F.when(text.rlike(MARKER), F.array_distinct(F.concat(lines, together, whole))).otherwise(none)


def directory(path) -> F.Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def scanned(files: DataFrame) -> DataFrame:
    """One written row for each row of ``files(file, path, text)``: its key, directory, the templates' terms that
    it holds (vocab), and its units as lists of known terms with the sum of squares of the others' counts."""
    known = lambda t: t.isin(vocabulary())
    text = F.coalesce("text", F.lit(""))
    unit = lambda u: let(terms(u), lambda t: F.struct(F.filter(t, known).alias("known"), squares_of_counts(F.filter(t, lambda x: ~known(x))).alias("rest")))
    return written(
        files.select(
            F.monotonically_increasing_id().alias("key"),
            "file",
            "path",
            directory(F.col("path")).alias("dir"),
            F.array_distinct(F.filter(terms(text), known)).alias("vocab"),
            F.transform(units_col(text, F.col("path")), unit).alias("units"),
        ),
        "license_rows",
    )


def weights(rows: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(term, idf) of the templates' terms over all ``rows``; (template, license, rank, term, w) of unit length; the largest idf.

    Both tables are as large as the templates, whatever the input.
    """
    spark, n = rows.sparkSession, rows.count()
    df = rows.select(F.explode("vocab").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms_table = _literal(spark, ("term",), [(t,) for t in vocabulary()])
    idf = written(terms_table.join(df, "term", "left").select("term", (F.log((1 + F.lit(n)) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")), "license_idf")
    w = templates(spark).join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = w.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    most = float(spark.range(1).select(F.log(F.lit(1 + n)) + 1).first()[0])
    return idf, written(w.join(norms, "template").select("template", "license", "rank", "term", (F.col("w") / F.col("norm")).alias("w")), "license_weights"), most


def declared(rows: DataFrame) -> DataFrame:
    """(key, license, score, rank): the best template of each row of :func:`scanned` that reaches the threshold."""
    idf, w, most = weights(rows)
    units = rows.where(F.size("units") > 0).select("key", F.posexplode("units").alias("unit", "u"))
    counts = units.select("key", "unit", F.explode("u.known").alias("term")).groupBy("key", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    valued = counts.join(idf, "term").select("key", "unit", "term", (F.col("tf") * F.col("idf")).alias("u"))
    length = valued.groupBy("key", "unit").agg(F.sum(F.col("u") * F.col("u")).alias("squares"))
    length = length.join(units.select("key", "unit", (F.col("u.rest") * most * most).alias("others")), ["key", "unit"]).select("key", "unit", F.sqrt(F.col("squares") + F.col("others")).alias("length"))
    dots = valued.join(w, "term").groupBy("key", "unit", "template", "license", "rank").agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    best = dots.join(length, ["key", "unit"]).select("key", "license", "rank", F.round(F.col("dot") / F.col("length"), 9).alias("score")).where(F.col("score") >= THRESHOLD)
    return best.groupBy("key").agg(F.min(F.struct("rank", (-F.col("score")).alias("minus"), "license")).alias("b")).select("key", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score"), F.col("b.rank").alias("rank"))


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, from_dir, license) for each of the distinct ``directories(dir)`` below or at a row of ``licensed(dir, license)``."""
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, k), "/")))
    ancestors = directories.select("dir", F.posexplode(F.array_distinct(up)).alias("depth", "from_dir"))
    named = licensed.select(F.col("dir").alias("from_dir"), "license")
    return ancestors.join(named, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "license")).alias("m")).select("dir", F.col("m.from_dir").alias("from_dir"), F.col("m.license").alias("license"))


def scan(files: DataFrame) -> DataFrame:
    """(file, path, own_license, own_score, license, inherited_from), one row for each row of ``files(file, path, text)``."""
    rows = scanned(columns_of(files, "file", "path", "text"))
    own = written(declared(rows), "license_own")
    with_own = rows.select("key", "file", "path", "dir").join(own.select("key", F.col("license").alias("own_license"), F.col("score").alias("own_score"), "rank"), "key", "left")
    named = with_own.where(F.col("path").rlike(FILE_NAME) & F.col("own_license").isNotNull())
    licensed = named.groupBy("dir").agg(F.min(F.struct("rank", -F.col("own_score"), F.col("own_license"))).alias("b")).select("dir", F.col("b.own_license").alias("license"))
    below = inherited(rows.where("dir is not null").select("dir").distinct(), licensed)
    out = with_own.join(below.select(F.col("dir").alias("d"), "from_dir", F.col("license").alias("dir_license")), F.col("dir") == F.col("d"), "left")
    return out.select("file", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"), F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("inherited_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """``documents`` as files: a tree of source, thousands and tens, of which each first document is the LICENSE file."""
    i = F.col("doc_id")
    name = F.when(i % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc"), i.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("cast(doc_id div 1000 as string)"), F.when(i % 100 == 0, F.lit(None)).otherwise(F.expr("cast(doc_id div 10 as string)")), name)
    return docs.select(i.alias("file"), F.when(i.isNotNull(), path).alias("path"), "text")


def license_query(docs: DataFrame) -> DataFrame:
    """doc_id, path, own_license, own_score, license, inherited_from."""
    return scan(document_paths(columns_of(docs, "doc_id", "source", "text"))).withColumnRenamed("file", "doc_id")
