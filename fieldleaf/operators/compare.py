"""Readings held against each other, and tallies of what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["page_id", "row_no", "ord"]


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cell by cell: (page_id, row_no, ord, left, right, outcome), a cell that one side lacks being only_left or only_right."""
    both = left.select(*CELL, F.col("text").alias("left")).join(right.select(*CELL, F.col("text").alias("right")), CELL, "full")
    outcome = F.when(F.col("left").isNull(), "only_right").when(F.col("right").isNull(), "only_left").when(F.col("left") == F.col("right"), "equal").otherwise("differing")
    return both.withColumn("outcome", outcome)


def agreement(compared: DataFrame, *by: str) -> DataFrame:
    """Cells of each outcome by key, and the share of equal ones."""
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    return compared.groupBy(*by).agg(F.count("*").alias("cells"), n("equal").alias("equal_cells"), n("differing").alias("differing"), n("only_left").alias("only_left"), n("only_right").alias("only_right"), (n("equal") / F.count("*")).alias("rate"))


def models(log: DataFrame, scores: DataFrame) -> DataFrame:
    """Runs, seconds, tokens, thinking share and mean score (of the pages that its runs read, ``scores`` (page_id, score)) of each model, and how much slower it is than the fastest on average."""
    by = log.join(scores, "page_id", "left").groupBy("model").agg(F.avg("score").alias("mean_score"), F.count("*").alias("runs"), F.min("seconds").alias("least_s"), F.avg("seconds").alias("mean_s"), F.max("seconds").alias("most_s"), F.sum("output_tokens").alias("output_tokens"), F.sum("thought_tokens").alias("thought_tokens"))
    fastest = by.agg(F.min("mean_s").alias("fastest"))  # one row
    return by.join(F.broadcast(fastest), F.lit(True)).withColumns({"thinking_share": F.col("thought_tokens") / F.col("output_tokens"), "slowdown": F.col("mean_s") / F.col("fastest")}).drop("fastest")


def tally(values: DataFrame, name: Column, k: int) -> DataFrame:
    """The ``k`` most common values that aren't blank, ties by name."""
    return values.where(name != "").groupBy(name.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def open_first(reports: DataFrame, k: int) -> DataFrame:
    """The ``k`` pages to look at first: those without a score, then the lowest."""
    return reports.orderBy(F.col("score").asc_nulls_first(), "page_id").limit(k)
