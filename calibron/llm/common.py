"""Helpers that the training-data operators share: table access, scratch tables, words, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of bytes other than space and \t\n\v\f\r; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
#: Maps A-Z to a-z and leaves all other bytes of UTF-8 alone.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset a local session takes a temporary
    folder of its own; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="calibron-")
    return _LOCAL_ROOTS[app]


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of any name cannot clash with an operator's own."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def words_col(text) -> F.Column:
    """Array of the words of a text column (null: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def let(value, body):
    """``body(value)`` with ``value`` evaluated once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star rounds.

    Returns (node, root), root being the smallest node of the component; only nodes with an edge to
    another node appear. Each round is a min-aggregation and a join on a node, with the edges written to
    the shared folder in between, so that no neighbour list is ever gathered in one row. Nulls are dropped.
    """
    e = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (now["n"], now["h"]) == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = (now["n"], now["h"])
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select(F.col("x").alias("a"), F.col("m").alias("b"))).distinct()
        e = written(small, name)


def map_texts(df: DataFrame, fn, schema: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns untouched (nulls and 64-bit values exact) beside those that ``fn`` makes of a batch's texts.

    ``fn`` takes a list of strings (None for null) and returns a list of columns in the order of ``schema``.
    Rows stay in the tasks that scan them.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    source = columns_of(df, *keep, text) if text not in keep else columns_of(df, *keep)
    out = T.StructType([source.schema[k] for k in keep] + list(T._parse_datatype_string(schema).fields))
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                made = fn(part.column(text).to_pylist())
                arrays = [part.column(k).cast(arrow.field(k).type) for k in keep]
                arrays += [pa.array(v, arrow.field(len(keep) + n).type) for n, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return source.mapInArrow(run, out)


#: Rows of an Arrow batch that are handled together.
TEXTS_AT_ONCE = 512


def byte_level_table() -> dict[int, str]:
    """For each byte, as a character of Latin-1, the character that stands for it in byte-level vocabularies:
    printable ones for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
