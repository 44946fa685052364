"""Links between the members of groups, found without comparing all of a group's pairs.

The first pass holds every member against its group's hub (its smallest node) and takes the
components of what is verified. Later passes look only at groups that still have more than
one component: there members of different components are held against each other in the
tasks themselves, in cells of bounded size, by what their rows carry (``close``), and only
pairs that can be links leave the task for verification. One pass tries each member's best
partners, which puts most components together; the last tries every pair that is left. No
link between two members of one group is lost unless both are in one component already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldleaf.llm.common import components, stored


def shared(rows: DataFrame, node: str = "node") -> DataFrame:
    """The rows whose ``key`` at least two different nodes have. Counted with partial aggregation first, so that a hot key is one row of each task."""
    keys = rows.groupBy("key").agg(F.min(node).alias("low"), F.max(node).alias("high")).where("low < high").select("key")
    return rows.join(keys, "key", "left_semi")


def links(members: DataFrame, check: Callable[[DataFrame], DataFrame], close: Callable[[DataFrame, int | None], DataFrame], block_rows: int = 1000, passes: tuple[int | None, ...] = (2, None)) -> DataFrame:
    """What ``check(pairs(a, b))`` leaves of the pairs that share a key in ``members(key, node, ...)``: enough for the components of all such links.

    ``close(rest, partners)`` gets key, node, label, cuts and the members' other columns, for
    groups of several labels only, and returns pairs (a, b) of different labels, a < b: each
    member's best ``partners``, or all where that is None. ``cuts`` is the number of blocks
    of ``block_rows`` members that the group is to be taken in.
    """
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"))
    tried = stored(members.join(hubs, "key").where("hub < node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    found = stored(check(tried))
    for partners in passes:
        label = components(found.select("a", "b"))
        told = stored(members.join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"))
        mixed = told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high").select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("cuts"))
        fresh = stored(close(told.join(mixed, "key"), partners).distinct().join(tried, ["a", "b"], "left_anti"))
        found, tried = found.unionByName(stored(check(fresh))), tried.unionByName(fresh)
    return found


def cells(rest: DataFrame) -> DataFrame:
    """Each row of ``rest(node, cuts, ...)`` once for every pair of blocks that its own block is part of, named ``cell``."""
    part = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    return rest.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.least(o, part) * F.col("cuts") + F.greatest(o, part))))
