"""Graph operators: connected components on an edge table and what builds on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.plans.durable import durable

MAX_ROUNDS = 64
#: Members in a row of a list.
PIECE = 65_536


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; a component's id is its least node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Each round
    is two aggregates with map-side combine and two equi-joins; a hub's rows sit on
    the streamed side of a join that adaptive execution splits. Self loops make a
    node of their own; rows with a null end are dropped. No edges give no rows.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    ends = durable(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    alone = ends.where("a = b").select("a")
    stars, seen = ends.where("a < b"), None
    for _ in range(MAX_ROUNDS):
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not now[0] or now == seen:
            break
        seen = now
        stars = durable(_small_star(_large_star(stars)))
    else:
        raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")
    # At the fixpoint every edge joins a node to the least node of its component.
    leaves = stars.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = stars.select("a").union(alone).distinct().join(leaves.select(F.col("node").alias("a")), "a", "left_anti")
    return leaves.union(roots.select(F.col("a").alias("node"), F.col("a").alias("component")))


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("a"), F.least("u", "m").alias("m"))
    return stars.join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("b").agg(F.min("a").alias("m"))
    up = stars.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return up.union(least.select(F.col("m").alias("a"), "b")).distinct()


def merge_edges(parents: DataFrame, parent: str = "parent", children: str = "children") -> DataFrame:
    """(src, dst): each parent with itself and its children; a merge without children is left out."""
    some = parents.where(F.size(children) > 0)
    return some.select(F.col(parent).alias("src"), F.explode(F.array_union(F.col(children), F.array(parent))).alias("dst")).distinct()


def consolidate(sets: DataFrame, members: str = "members", key: str | None = None, size: int = PIECE) -> DataFrame:
    """(root, part, members): intersecting sets united to a fixpoint, in ``pieces``; the root is the least member.

    With ``key``, rows of one key are pieces of one set. Sets of one member alone are left out.
    """
    some = sets.where(F.size(members) > 0)
    least = F.array_min(members)
    if key is not None:
        some = some.join(some.groupBy(key).agg(F.min(least).alias("_least")), key)
        least = F.col("_least")
    return pieces(connected_components(some.select(least.alias("src"), F.explode(members).alias("dst"))), size)


def pieces(found: DataFrame, size: int = PIECE) -> DataFrame:
    """(root, part, members) of components with two nodes or more: the nodes in ascending order, ``size`` to a
    part, parts from 0. A component of any size is many rows of a bounded one.

    Ranges of (component, node) are ranked each by themselves and offset by the component's counts in the
    ranges before, so a giant component is never sorted in one task. ``found``: different nodes.
    """
    if size < 2:
        raise ValueError("a piece holds two members or more")
    key = ["root", "_range"]
    rows = durable(found.select(F.col("component").alias("root"), "node").repartitionByRange("root", "node").withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("root").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*key).agg(F.count("*").alias("_c"))  # a row a component, and one more for each range that it goes on in
    first = counts.select(*key, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"), F.sum("_c").over(Window.partitionBy("root")).alias("_n"))
    ranked = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*key).orderBy("node"))).join(first.where("_n > 1"), key)
    part = F.floor((F.col("_first") + F.col("_local") - 1) / size).cast("int").alias("part")
    return ranked.groupBy("root", part).agg(F.array_sort(F.collect_list("node")).alias("members"))
