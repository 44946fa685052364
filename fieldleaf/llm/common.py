"""Helpers shared by the text operators: reading, cutting lineage, whole key groups, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long, so fewer of them than Spark's 10,000 go to a Python worker at a time; a session's own smaller number stands."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all run on one machine and none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes the rows to the shared folder as Parquet and reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Regroups the batches of a partition sorted by ``keys`` so that no key's rows are split between two frames."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        last = frame[keys].iloc[-1]
        same = (frame[keys] == last).all(axis=1).to_numpy()
        cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield pd.concat([*held, frame.iloc[:cut]], ignore_index=True) if held else frame.iloc[:cut].reset_index(drop=True)
            held = [frame.iloc[cut:]]
        elif held and (held[-1][keys].iloc[-1] != last).any():
            yield pd.concat(held, ignore_index=True)
            held = [frame]
        else:
            held.append(frame)
    if held:
        yield pd.concat(held, ignore_index=True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, component) for each node, component the smallest node.

    Alternates large-star and small-star contraction; each round is grouping and joins on
    the node, and its edges are written to the shared folder so that a lost executor costs
    one round at most. A node's neighbours are never gathered in one place.
    """
    spark = edges.sparkSession
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = stored(small.distinct())
        found = now.agg(F.count("*").alias("n"), F.countDistinct("a").alias("nodes")).first()
        if found["n"] == found["nodes"] and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():  # each node has one edge, to a node that has none
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
