"""Readers and writers of the interchange files, and the synthetic response generator."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATRIX = "models array<string>, model_index array<int>, items array<string>, R array<array<int>>, model_provider map<string,string>, holdout_models array<string>, source string"
BANK = "item_ids array<string>, a array<double>, b array<double>, dim array<int>, n_dims int"


def response_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(model_idx, model, item_idx, item_id, correct) of a JSON matrix or a folder of them, missing cells as null.

    A model's index is its place in the file, or what ``model_index`` says there.
    """
    wide = spark.read.schema(MATRIX).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    rows = wide.select("models", "items", "model_index", F.posexplode("R").alias("at", "row"))
    named = rows.select(F.coalesce(F.get("model_index", F.col("at")), "at").alias("model_idx"), F.get("models", F.col("at")).alias("model"), "items", "row")
    cells = named.select("model_idx", "model", "items", F.posexplode("row").alias("item_idx", "correct"))
    return cells.select("model_idx", "model", "item_idx", F.get("items", F.col("item_idx")).alias("item_id"), "correct")


def write_matrix(cells: DataFrame, path: str, models_a_file: int = 64) -> None:
    """The inverse: a folder of JSON objects, each with the items in their order and so many models with their indices."""
    rows = cells.groupBy("model_idx", "model").agg(F.array_sort(F.collect_list(F.struct("item_idx", "item_id", F.struct(F.col("correct").alias("c")).alias("v")))).alias("r"))
    rows = rows.withColumn("block", F.floor(F.col("model_idx") / models_a_file))
    many = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("model_idx", "model", "r"))).alias("m"))
    of = lambda name: F.transform("m", lambda m: m[name])
    out = many.select("block", of("model_idx").alias("model_index"), of("model").alias("models"), F.transform(F.col("m")[0]["r"], lambda c: c["item_id"]).alias("items"), F.transform("m", lambda m: F.transform(m["r"], lambda c: c["v"]["c"])).alias("R"))
    out.write.mode("overwrite").partitionBy("block").option("ignoreNullFields", "false").json(path)


def item_bank(spark: SparkSession, path: str) -> DataFrame:
    """(item_idx, item_id, a, b, dim) of a JSON bank."""
    bank = spark.read.schema(BANK).option("multiLine", True).json(path)
    dim = F.coalesce("dim", F.transform("a", lambda _: F.lit(0)))
    return bank.select(F.posexplode(F.arrays_zip("item_ids", "a", "b", dim.alias("dim"))).alias("item_idx", "r")).select("item_idx", F.col("r.item_ids").alias("item_id"), "r.a", "r.b", "r.dim")


def write_bank(bank: DataFrame, path: str) -> None:
    packed = bank.agg(F.array_sort(F.collect_list(F.struct("item_idx", "item_id", "a", "b", "dim"))).alias("r"))
    out = packed.select(F.transform("r", lambda r: r["item_id"]).alias("item_ids"), *(F.col(f"r.{c}").alias(c) for c in ("a", "b", "dim")), (F.array_max(F.transform("r", lambda r: r["dim"])) + 1).alias("n_dims"))
    out.coalesce(1).write.mode("overwrite").json(path)


def checkpoint_csv(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(model, item_id, correct) of CSV files with items as rows and checkpoints as columns; model = file stem/column.

    Rows whose id doesn't start with ``prefix``, empty cells and nan are left out.
    """
    read = spark.read.option("header", True).csv(path)
    item, *columns = read.columns
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    named = read.select(stem.alias("stem"), F.col(f"`{item}`").alias("item_id"), *(F.col(f"`{c}`") for c in columns)).where(F.col("item_id").startswith(prefix))
    long = named.unpivot(["stem", "item_id"], columns, "column", "value")
    value = F.try_to_number(F.nullif(F.lower(F.trim("value")), F.lit("nan")), F.lit("999999.999999"))
    return long.select(F.concat("stem", F.lit("/"), "column").alias("model"), "item_id", value.cast("double").cast("int").alias("correct")).where("correct is not null")


def items_json(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, question, answer, aliases, options, subtask) of a JSON map of items."""
    item = "struct<question:string,answer:string,aliases:array<string>,options:array<string>,image_b64:string,media_type:string,subtask:string>"
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{item}>")).alias("item_id", "i")).select("item_id", "i.*")


def replies_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(model, item_id, text, output_tokens); blank lines are skipped."""
    return spark.read.schema("model string, item_id string, text string, output_tokens int").json(path).where("model is not null")


def model_list(spark: SparkSession, path: str) -> DataFrame:
    """Names of a list file, without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("model")).where("model <> '' and not startswith(model, '#')")


def checkpoint_set(spark: SparkSession, path: str, holdout: tuple[str, ...] = ()) -> DataFrame:
    """(model, item_id, correct, held_out) of all CSV files that ``path`` matches; models without a result are left out.

    No file is the reader's own error; files without any result, or names to hold out that aren't there, are a ValueError.
    """
    rows = checkpoint_csv(spark, path).withColumn("held_out", F.col("model").isin(*holdout))
    if rows.isEmpty():
        raise ValueError(f"no results in {path}")
    known = {r.model for r in rows.where("held_out").select("model").distinct().collect()}  # at most as many as were named
    if missing := sorted(set(holdout) - known):
        raise ValueError(f"not among the checkpoints: {', '.join(missing)}")
    return rows


def write_items(items: DataFrame, path: str, part: str) -> None:
    """``items(item_id, question, answer, ..., part)`` as JSON maps from id to item, one file for each ``part``."""
    fields = F.struct(*(F.col(c) for c in items.columns if c not in ("item_id", part)))
    maps = items.groupBy(part).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("item_id", fields.alias("item"))))).alias("value"))
    maps.write.mode("overwrite").partitionBy(part).text(path)


def synthetic_responses(spark: SparkSession, n_models: int, n_items: int, seed: int = 0, noisy: float = 0.05) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """(cells, truth) of a random 2PL world; draws in a fixed order from one numpy generator."""
    rng = np.random.default_rng(seed)
    theta = rng.normal(0, 1, n_models)
    a = rng.lognormal(0, 0.35, n_items)
    b = rng.normal(0, 1.2, n_items)
    a[rng.random(n_items) < noisy] = 0.05
    y = (rng.random((n_models, n_items)) < 1 / (1 + np.exp(-a * (theta[:, None] - b)))).astype(int)
    rows = [(m, f"model-{m:03d}", i, f"item-{i:04d}", int(y[m, i])) for m in range(n_models) for i in range(n_items)]
    return spark.createDataFrame(rows, "model_idx int, model string, item_idx int, item_id string, correct int"), {"theta": theta, "a": a, "b": b}
