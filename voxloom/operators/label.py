"""Labelling and relabelling of volumes; 0 is background everywhere."""

from __future__ import annotations

from functools import reduce
from itertools import count, product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators import blocks, stencil
from voxloom.operators.graph import connected_components
from voxloom.operators.regionprops import size_filter
from voxloom.plans.durable import durable


def mapped(labels: DataFrame, mapping: DataFrame, label: str = "label", old: str = "old", new: str = "new") -> DataFrame:
    """Apply an id mapping; ids that it lacks stay, and so does background, which meets no join."""
    m = mapping.select(F.col(old).alias(label), F.col(new).cast("bigint").alias("_new"))
    some = labels.where(F.col(label) > 0).join(m, label, "left").withColumn(label, F.coalesce("_new", label)).select(*labels.columns)
    return some.union(labels.where(~F.coalesce(F.col(label) > 0, F.lit(False))))


def numbered(rows: DataFrame, keys: list[str], name: str = "_n") -> DataFrame:
    """``rows`` (different in ``keys``) with their ranks from 1 in the order of ``keys``.

    Ranges of the keys are ranked each by themselves, then offset by the counts before.
    """
    parts = durable(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    n = parts.groupBy("_part").agg(F.count("*").alias("_c"))  # a row a range
    first = n.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    return local.join(first, "_part").withColumn(name, (F.col("_first") + F.col("_local")).cast("bigint")).drop("_part", "_local", "_first")


def relabel(labels: DataFrame, label: str = "label", per_slice: bool = False) -> DataFrame:
    """Labels become 1..N in the order of the old ids; with ``per_slice``, of (z, id).

    Ranks are made on the distinct labels only and joined back, never over voxels.
    """
    return renumbered(labels, label, per_slice)[0]


def renumbered(labels: DataFrame, label: str = "label", per_slice: bool = False) -> tuple[DataFrame, DataFrame]:
    """(labels 1..N, (n, bits)): N, and the bits of the narrowest unsigned integer that holds it."""
    keys = ["z", label] if per_slice else [label]
    some = labels.where(F.col(label) > 0)
    ranks = numbered(some.select(*keys).distinct(), keys)
    out = some.join(ranks, keys).withColumn(label, F.col("_n")).select(*labels.columns)
    rest = labels.where(~F.coalesce(F.col(label) > 0, F.lit(False))).withColumn(label, F.lit(0).cast("bigint")).select(*labels.columns)
    n = F.coalesce(F.max("_n"), F.lit(0).cast("bigint"))
    return out.union(rest), ranks.agg(n.alias("n"), F.when(n < 1 << 8, 8).when(n < 1 << 16, 16).otherwise(32).alias("bits"))


def half_offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """One of each pair of opposite neighbours: 4 or 8 in a slice; 6, 18 or 26 in space."""
    reach = {4: (0, 1), 8: (0, 2), 6: (1, 1), 18: (1, 2), 26: (1, 3)}[connectivity]
    z = range(2) if reach[0] else (0,)
    out = [o for o in product(z, (-1, 0, 1), (-1, 0, 1)) if o > (0, 0, 0) and sum(map(abs, o)) <= reach[1]]
    return out


def neighbours(voxels: DataFrame, connectivity: int, columns: list[str]) -> DataFrame:
    """Pairs of neighbouring voxels with their ``columns`` as a_ and b_: an equi-join on shifted coordinates."""
    shifts = F.array(*(F.struct(*(F.lit(c).alias(n) for c, n in zip(o, "zyx", strict=True))) for o in half_offsets(connectivity)))
    left = voxels.select(*(F.col(c).alias(f"a_{c}") for c in columns), F.explode(shifts).alias("o"), *(F.col(a).alias(f"_{a}") for a in "zyx"))
    left = left.select(*(f"a_{c}" for c in columns), *((F.col(f"_{a}") + F.col(f"o.{a}")).alias(a) for a in "zyx"))
    right = voxels.select("z", "y", "x", *(F.col(c).alias(f"b_{c}") for c in columns if c not in "zyx"))
    return left.join(right, ["z", "y", "x"]).withColumns({f"b_{a}": F.col(a) for a in "zyx" if a in columns}).drop("z", "y", "x")


def components(foreground: DataFrame, connectivity: int, ny: int, nx: int) -> DataFrame:
    """(z, y, x, label): connected components of the voxels given, 1..N in the order of their first voxel (z, x, y).

    Blocks find their own components; only voxels on blocks' faces meet their neighbours in a join, and
    only components that go on in another block are nodes of the graph.
    """
    own = durable(blocks.components(foreground, half_offsets(connectivity), ny, nx))
    across = neighbours(own.where(blocks.on_faces()), connectivity, ["root"]).where("a_root <> b_root").select("a_root", "b_root").distinct()
    joined = connected_components(across, "a_root", "b_root").select(F.col("node").alias("root"), "component")
    return relabel(own.join(joined, "root", "left").select("z", "y", "x", (F.coalesce("component", "root") + 1).alias("label")))


#: Rounds of filling after which their results are put together.
TOGETHER = 20


def fill_background(labels: DataFrame, r: int = 3, label: str = "label", max_rounds: int | None = None) -> DataFrame:
    """Background takes the largest label within a disk, again and again; labels never change.

    A voxel that no label reached in a round can only be reached by what that round labelled, so just this front travels, and meets
    just what is still background. Slices go in parallel; it ends when a round changes nothing, so an empty slice stays empty.
    If ``max_rounds`` are given and don't suffice, that is an error.
    """
    now = durable(labels.select("z", "y", "x", F.col(label).cast("bigint").alias(label)))
    is_label = F.coalesce(F.col(label) > 0, F.lit(False))
    front, left, filled = now.where(is_label), now.where(~is_label).select("z", "y", "x", F.lit(0).cast("bigint").alias(label)), []
    filled.append(front)
    for done in count():
        if left.isEmpty():
            break
        # Each background voxel keeps the largest label that reaches it.
        reached = stencil.gathered(front, stencil.disk(r), label).groupBy("z", "y", "x").agg(F.max("v").alias("_v"))
        met = durable(left.join(reached, ["z", "y", "x"], "left"))
        front = met.where("_v is not null").select("z", "y", "x", F.col("_v").alias(label))
        left = met.where("_v is null").drop("_v")
        if front.isEmpty():
            break
        if done + 1 == max_rounds and not left.isEmpty():
            raise RuntimeError(f"background is left after {max_rounds} rounds")
        filled.append(front)
        if len(filled) > TOGETHER:
            filled = [filled[0], durable(reduce(DataFrame.union, filled[1:]))]
    return reduce(DataFrame.union, [*filled, left])


def detect_objects(probabilities: DataFrame, ny: int, nx: int, sigma: float = 1.0, threshold: float = 0.7, low: int = 1000, high: int | None = 1_000_000, value: str = "p") -> DataFrame:
    """(z, y, x, label): smooth, threshold, label with 26 neighbours, keep objects of low..high voxels."""
    smooth = stencil.gaussian(probabilities, sigma, value)
    found = components(smooth.where(F.col(value) >= threshold), 26, ny, nx)
    return relabel(size_filter(found, low, high).where("label > 0"))
