"""Regions: boxes that tile a volume, their padding, alignment, seams, crops and coordinates.

A region is half open on each axis: ``x0 <= x < x1``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def extent(voxels: DataFrame) -> dict[str, tuple[int, int]]:
    """The half-open box that holds all voxels; empty on each axis if there are none."""
    ends = voxels.agg(*(f(a).alias(f"{a}{k}") for a in AXES for f, k in ((F.min, 0), (F.max, 1)))).first()
    return {a: (ends[f"{a}0"], ends[f"{a}1"] + 1) if ends[f"{a}0"] is not None else (0, 0) for a in AXES}


def grid(spark: SparkSession, extent: dict[str, tuple[int, int]], span: dict[str, int]) -> DataFrame:
    """(region_id, kind, z0, z1, y0, y1, x0, x1): blocks of ``span``, the last of an axis clipped."""
    out = spark.range(1).select()
    for a in AXES:
        lo, hi = extent[a]
        starts = F.explode(F.sequence(F.lit(lo), F.lit(hi - 1), F.lit(span[a]))) if hi > lo else F.explode(F.array().cast("array<int>"))
        out = out.select("*", starts.alias(f"{a}0"))
    out = out.select(*(c for a in AXES for c in (F.col(f"{a}0"), F.least(F.col(f"{a}0") + span[a], F.lit(extent[a][1])).cast("int").alias(f"{a}1"))))
    n = {a: -(-(extent[a][1] - extent[a][0]) // span[a]) for a in AXES}
    k = lambda a: ((F.col(f"{a}0") - extent[a][0]) / span[a]).cast("bigint")
    number = (k("z") * n["y"] + k("y")) * n["x"] + k("x")
    return out.select(number.alias("region_id"), F.lit("cutout").alias("kind"), "*")


def padded(regions: DataFrame, pad: dict[str, int], extent: dict[str, tuple[int, int]]) -> DataFrame:
    """Grow every region by ``pad`` on both sides, within ``extent``."""
    for a in AXES:
        lo, hi = extent[a]
        regions = regions.withColumns({f"{a}0": F.greatest(F.col(f"{a}0") - pad[a], F.lit(lo)).cast("int"), f"{a}1": F.least(F.col(f"{a}1") + pad[a], F.lit(hi)).cast("int")})
    return regions


def aligned(regions: DataFrame, cuboid: dict[str, int]) -> DataFrame:
    """Widen regions to whole storage cuboids on the axes that ``cuboid`` names."""
    for a, c in cuboid.items():
        regions = regions.withColumns({f"{a}0": (F.floor(F.col(f"{a}0") / c) * c).cast("int"), f"{a}1": (F.ceil(F.col(f"{a}1") / c) * c).cast("int")})
    return regions


def seams(regions: DataFrame) -> DataFrame:
    """Merge regions: boxes two voxels thick about each boundary of neighbouring blocks, with their axis."""
    parts = []
    for a in AXES:
        others = [f"{b}{k}" for b in AXES for k in (0, 1) if b != a]
        line = Window.partitionBy(*others).orderBy(f"{a}0")
        at = regions.withColumn("_next", F.lead(f"{a}0").over(line)).where("_next is not null")
        own = {f"{a}0": F.col("_next") - 1, f"{a}1": F.col("_next") + 1}
        parts.append(at.withColumns(own).select("region_id", F.lit("merge").alias("kind"), F.lit(a).alias("axis"), *(F.col(f"{b}{k}").cast("int").alias(f"{b}{k}") for b in AXES for k in (0, 1))))
    return reduce(DataFrame.unionByName, parts)


def shuffled(regions: DataFrame, order: Column) -> DataFrame:
    """``regions`` in a repeatable random order: by a hash of the id."""
    return regions.orderBy(order, "region_id")


def pyramid(voxels: DataFrame, level: int, value: str = "v", labels: bool = False) -> DataFrame:
    """Level ``level``: 2^level cells of y and x become one; mean of an image, mode of labels (least of ties)."""
    f = 1 << level
    cell = [F.col("z"), F.floor(F.col("y") / f).cast("int").alias("y"), F.floor(F.col("x") / f).cast("int").alias("x")]
    return voxels.groupBy(*cell).agg((F.mode(value, True) if labels else F.avg(value)).alias(value))


def inside(box: dict[str, tuple[int, int]]) -> Column:
    """Whether a voxel lies in ``box``; pushed down to the scan as ranges."""
    return reduce(lambda a, b: a & b, ((F.col(a) >= lo) & (F.col(a) < hi) for a, (lo, hi) in box.items()))


def crop(voxels: DataFrame, extent: dict[str, tuple[int, int]], amount: dict[str, int]) -> DataFrame:
    """Cut ``amount`` off both ends of each axis. Coordinates are global, so the offset moves by itself."""
    return voxels.where(inside({a: (extent[a][0] + n, extent[a][1] - n) for a, n in amount.items()}))


def in_regions(voxels: DataFrame, regions: DataFrame, span: dict[str, int], origin: dict[str, int] | None = None) -> DataFrame:
    """(region_id, voxel columns) for each voxel in each region.

    Both sides are keyed by the grid cells that they touch, so the join is an equi-join on
    cells with the box test on top; never a nested loop.
    """
    o = origin or dict.fromkeys(AXES, 0)
    cells = regions
    for a in AXES:
        first, last = (F.floor((F.col(f"{a}{k}") - d - o[a]) / span[a]).cast("int") for k, d in ((0, 0), (1, 1)))
        cells = cells.withColumn(f"_c{a}", F.explode(F.sequence(first, last)))
    own = voxels.withColumns({f"_c{a}": F.floor((F.col(a) - o[a]) / span[a]).cast("int") for a in AXES})
    box = reduce(lambda p, q: p & q, ((F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1")) for a in AXES))
    return own.join(cells, [f"_c{a}" for a in AXES]).where(box).select("region_id", *voxels.columns)


def trimmed(padded_voxels: DataFrame, regions: DataFrame, pad: dict[str, int], extent: dict[str, tuple[int, int]]) -> DataFrame:
    """Take the pad off again, except on sides that touch the volume's border.

    ``padded_voxels`` (region_id, z, y, x, ...) as cut out of the padded ``regions``; every
    side is tested by itself. A block that ends within a pad of the border keeps that pad, since
    its padded box touches the border; ``owned`` tells the two apart.
    """
    out = padded_voxels.join(regions.select("region_id", *(f"{a}{k}" for a in AXES for k in (0, 1))), "region_id")
    for a in AXES:
        lo, hi = extent[a]
        low = F.col(f"{a}0") + F.when(F.col(f"{a}0") == lo, 0).otherwise(pad[a])
        high = F.col(f"{a}1") - F.when(F.col(f"{a}1") == hi, 0).otherwise(pad[a])
        out = out.where((F.col(a) >= low) & (F.col(a) < high))
    return out.select(*padded_voxels.columns)


def owned(padded_voxels: DataFrame, regions: DataFrame) -> DataFrame:
    """Take the pad off again, by the regions as they were before padding."""
    out = padded_voxels.join(regions.select("region_id", *(f"{a}{k}" for a in AXES for k in (0, 1))), "region_id")
    box = reduce(lambda p, q: p & q, ((F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1")) for a in AXES))
    return out.where(box).select(*padded_voxels.columns)


def slices(voxels: DataFrame, wanted: list[int] | range) -> DataFrame:
    """The named z slices."""
    return voxels.where(F.col("z").isin(list(wanted)))


def to_global(voxels: DataFrame, offset: dict[str, int]) -> DataFrame:
    return voxels.withColumns({a: (F.col(a) + offset[a]).cast("int") for a in AXES})


def from_linear(index: str, ny: int, nx: int) -> list[Column]:
    """Column-major linear index (0-based) -> z, y, x."""
    i = F.col(index)
    return [F.floor(i / (ny * nx)).cast("int").alias("z"), (i % ny).cast("int").alias("y"), (F.floor(i / ny) % nx).cast("int").alias("x")]


def to_linear(ny: int, nx: int) -> Column:
    return F.col("z").cast("bigint") * ny * nx + F.col("x") * ny + F.col("y")
