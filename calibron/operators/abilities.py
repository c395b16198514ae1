"""Abilities, rank agreement and resampling-free evaluation over long response tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibron.functions.irt import information, map_ability
from calibron.operators.policy import running
from calibron.sources.scratch import with_every_item


def abilities(cells: DataFrame, prior_sd: float = 1.0) -> DataFrame:
    """(model, n_items, accuracy, theta, se) from rows (model, a, b, y): one shuffle by model.

    What is gathered for a model is its cells, at most one for each item of the bank.
    """
    packed = cells.groupBy("model").agg(F.count("y").alias("n_items"), F.avg("y").alias("accuracy"), F.collect_list(F.struct("a", "b", F.col("y").cast("double").alias("y"))).alias("cells"))
    return packed.withColumn("m", map_ability(F.col("cells"), prior_sd)).select("model", "n_items", "accuracy", F.col("m.theta").alias("theta"), F.col("m.se").alias("se"))


#: Rows of ``lineitem`` that one task makes answers of.
ANSWER_ROWS = 500_000


def accuracies(d) -> DataFrame:
    """(model, acc): the mean of each model's ``responses``, made without the items' columns, so that little is shuffled.

    The number of partitions follows the rows, so that no task spills its answers.
    """
    items = d.items.select(F.col("subtask").alias("p_type"), "p_size", "item_idx")
    asked = d.part.select("p_partkey", "p_type", "p_size").join(items, ["p_type", "p_size"]).select(F.col("p_partkey").alias("l_partkey"), "item_idx")
    right = F.when((F.col("l_returnflag") == "N") & ((F.col("l_partkey") + F.col("l_suppkey")) % 3 > 0), 1).otherwise(0)
    given = d.lineitem.where("l_suppkey is not null").select("l_partkey", "l_suppkey", right.alias("y")).join(asked, "l_partkey").select("l_suppkey", "item_idx", "y")
    tasks = max(1, -(-d.lineitem.count() // ANSWER_ROWS))
    answers = given.repartition(tasks, "l_suppkey").groupBy("l_suppkey", "item_idx").agg(F.max("y").alias("y"))
    return answers.groupBy("l_suppkey").agg(F.avg("y").alias("acc")).select(F.concat(F.lit("model-"), F.col("l_suppkey").cast("string")).alias("model"), "acc")


def next_items(state: DataFrame, bank: DataFrame, used: DataFrame) -> DataFrame:
    """For each (model, theta) of ``state`` the unused item of largest information; ties go to the lowest item_idx."""
    open_items = with_every_item(state, bank).join(used.select("model", "item_idx"), ["model", "item_idx"], "left_anti")
    info = information(F.col("theta"), F.col("a"), F.col("b"))
    best = open_items.groupBy("model").agg(F.min(F.struct((-info).alias("minus"), "item_idx")).alias("b"))
    return best.select("model", "b.item_idx", (-F.col("b.minus")).alias("info"))


def placed(board: DataFrame, *order: str) -> DataFrame:
    """``board`` with place (1, 2, ...) in the order of the columns ``order``, which must tell rows apart.

    Rows are range-partitioned and numbered within their part; no task sorts them all.
    """
    return running(board.withColumn("everything", F.lit(0)), "everything", list(order), "everything").drop("everything", "upto")


def place_among(board: DataFrame, score: str, anchor: Column) -> DataFrame:
    """Rank 1 + number of strictly better anchors, by running counts of anchors over the distinct scores."""
    each = board.groupBy(score).agg(F.count_if(anchor).alias("here")).withColumn("worse", -F.col(score)).withColumn("everything", F.lit(0))
    ranks = running(each, "everything", ["worse"], "here").select(F.col(score).alias("scored"), (F.col("upto") - F.col("here") + 1).alias("rank"))
    return board.join(ranks, F.col(score) == F.col("scored")).drop("scored")


def placement_ranks(board: DataFrame, score: str) -> DataFrame:
    """Rank 1 + number of strictly better rows."""
    return place_among(board, score, F.lit(True))
