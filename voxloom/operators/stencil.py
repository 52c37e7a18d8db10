"""Neighbourhood operators on voxels (z, y, x, value).

Filters work on blocks of slices with a halo (``blocks.by_slice``). For other aggregates each
voxel is sent to the cells that it neighbours (an array of shifts, exploded), and each cell
aggregates what it got: one shuffle with partial aggregation, no join.
Cells outside the volume don't exist; ``border`` says what stands for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators import blocks

Offset = tuple[int, int, int]
#: Cells of a block's tiles.
TILE_CELLS = 1 << 21


def box(r: int) -> list[Offset]:
    return [(0, dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def disk(r: int) -> list[Offset]:
    """Exact Euclidean disk."""
    return [o for o in box(r) if o[1] ** 2 + o[2] ** 2 <= r * r]


def diamond(r: int) -> list[Offset]:
    return [o for o in box(r) if abs(o[1]) + abs(o[2]) <= r]


def ball(r: int, height: float) -> list[tuple[int, int, int, float]]:
    """Half ellipsoid of intensity: offsets of a disk with their height."""
    return [(*o, height * (max(0.0, 1 - (o[1] ** 2 + o[2] ** 2) / (r * r)) ** 0.5 if r else 1.0)) for o in disk(r)]


def gathered(voxels: DataFrame, offsets: Iterable[tuple], value: str = "v", border: str = "none", extent: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(z, y, x, dz, dy, dx, w, v, own): one row for each cell and neighbour.

    ``own`` marks the voxel itself. With border 'mirror' the extent's edge voxels repeat
    (-1 reads 0, -2 reads 1, ...).
    """
    shifts = [(*o[:3], float(o[3]) if len(o) > 3 else 0.0) for o in offsets]
    table = F.array(*(F.struct(*(F.lit(c).alias(n) for c, n in zip(o, ("dz", "dy", "dx", "w"), strict=True))) for o in shifts))
    src = voxels.select("z", "y", "x", F.col(value).alias("v"))
    if border == "mirror":
        src = mirrored(src, max(max(abs(o[1]), abs(o[2])) for o in shifts), extent, keep=True)
    out = src.withColumn("o", F.explode(table))
    cell = [(F.col(a) - F.col(f"o.d{a}")).cast("int").alias(a) for a in ("z", "y", "x")]
    out = out.select(*cell, "o.dz", "o.dy", "o.dx", "o.w", "v")
    if extent:
        for a in ("y", "x") if border == "mirror" else extent:
            out = out.where(F.col(a).between(extent[a][0], extent[a][1] - 1))
    return out


def stencil(voxels: DataFrame, offsets: Iterable[tuple], agg: Column, value: str = "v", out: str = "v", border: str = "none", extent: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``agg`` over each voxel's neighbours that exist, for the voxels that exist. ``agg`` may use
    v, w, dz, dy, dx; ``offsets`` should hold (0, 0, 0) or ``agg`` not need it."""
    offsets = [*offsets]
    if not any(tuple(o[:3]) == (0, 0, 0) for o in offsets):
        raise ValueError("offsets must hold the voxel itself; leave it out in the aggregate")
    got = gathered(voxels, offsets, value, border, extent).groupBy("z", "y", "x")
    there = F.count_if((F.col("dz") == 0) & (F.col("dy") == 0) & (F.col("dx") == 0))
    return got.agg(agg.alias(out), there.alias("_there")).where("_there > 0").drop("_there")


def mirrored(voxels: DataFrame, n: int, extent: dict[str, tuple[int, int]], zero: bool = False, keep: bool = True) -> DataFrame:
    """Pad y and x by ``n``: edge voxels repeat (or, with ``zero``, the border is 0)."""
    cols = [c for c in voxels.columns if c not in ("y", "x")]
    for a in ("y", "x"):
        lo, hi = extent[a]
        images = F.array(F.col(a), *([F.when((F.col(a) - lo) < n, 2 * lo - 1 - F.col(a)), F.when((hi - 1 - F.col(a)) < n, 2 * hi - 1 - F.col(a))] if keep else []))
        voxels = voxels.withColumn("_i", F.explode(F.filter(images, lambda i: i.isNotNull()))).withColumn(a, F.col("_i").cast("int")).drop("_i")
    if zero:
        inner = F.lit(True)
        for a in ("y", "x"):
            inner &= F.col(a).between(extent[a][0], extent[a][1] - 1)
        voxels = voxels.withColumns({c: F.when(inner, F.col(c)).otherwise(0).cast(t) for c, t in voxels.dtypes if c not in ("z", "y", "x")})
    return voxels.select("z", "y", "x", *(c for c in cols if c != "z"))


def unpadded(voxels: DataFrame, n: int, extent: dict[str, tuple[int, int]]) -> DataFrame:
    """Without the outer ``n`` cells of y and x."""
    for a in ("y", "x"):
        voxels = voxels.where(F.col(a).between(extent[a][0] + n, extent[a][1] - 1 - n))
    return voxels


def median(voxels: DataFrame, r: int, value: str = "v", border: str = "zero", extent: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Median over (2r+1)^2 cells of a slice; missing cells are 0, or left out of what is mirrored."""
    if border == "mirror":
        padded = mirrored(voxels.select("z", "y", "x", value), r, extent)
        there = lambda v, t: blocks.row_by_row(blocks.windows(np.where(t, v, np.nan), r), lambda w: np.nanmedian(w, axis=2))
        return blocks.by_slice(padded, value, r, there, value, "double", extent)
    return blocks.by_slice(voxels, value, r, lambda v, t: blocks.row_by_row(blocks.windows(v, r), lambda w: np.median(w, axis=2)), value, "double")


def _reach(offsets: Iterable[tuple]) -> tuple[list[tuple], int]:
    """The offsets, all within a slice, and how far they reach."""
    offsets = [*offsets]
    if any(o[0] for o in offsets):
        raise ValueError("offsets must lie within a slice")
    return offsets, max(max(abs(o[1]), abs(o[2])) for o in offsets)


def dilate(voxels: DataFrame, offsets: Iterable[tuple], value: str = "v", top: float | None = None) -> DataFrame:
    """Grey dilation, flat or with heights; saturates at ``top``."""
    offsets, r = _reach(offsets)

    def reach(v, t):
        v, out = np.where(t, v, -np.inf), None
        for o in offsets:
            near = blocks.shifted(v, r, o[1], o[2]) + (o[3] if len(o) > 3 else 0.0)
            out = near if out is None else np.maximum(out, near)
        return out if top is None else np.minimum(out, top)

    return blocks.by_slice(voxels, value, r, reach, value, "double")


def _holding(voxels: DataFrame, offsets: Iterable[Offset], mask: str, how: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    offsets, r = _reach(offsets)

    def hold(v, t):
        out = None
        for o in offsets:
            near = blocks.shifted(v, r, o[1], o[2]) > 0
            out = near if out is None else how(out, near)
        return out

    return blocks.by_slice(voxels.withColumn(mask, F.col(mask).cast("int")), mask, r, hold, mask, "boolean")


def binary_dilate(voxels: DataFrame, offsets: Iterable[Offset], mask: str = "m") -> DataFrame:
    return _holding(voxels, offsets, mask, np.logical_or)


def binary_erode(voxels: DataFrame, offsets: Iterable[Offset], mask: str = "m") -> DataFrame:
    """True where the whole neighbourhood is; cells that don't exist are false."""
    return _holding(voxels, offsets, mask, np.logical_and)


def label_interior(labels: DataFrame, r: int, target: int, extent: dict[str, tuple[int, int]], value: str = "label") -> DataFrame:
    """True where every cell of the (2r+1)^2 box is ``target``; the border is mirrored."""
    is_target = mirrored(labels.select("z", "y", "x", (F.col(value) == target).cast("int").alias(value)), r, extent)
    inside = lambda v, t: blocks.row_by_row(blocks.windows(v, r), lambda w: w.min(2) > 0)
    return blocks.by_slice(is_target, value, r, inside, "inside", "boolean", extent)


def weighted(a: np.ndarray, sigma: float) -> np.ndarray:
    """Sums over a box of radius 2 sigma on the last two axes, by Gaussian weights; cells beyond the edge count as 0."""
    r = max(1, round(2 * sigma))
    w = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma**2))
    ny, nx = a.shape[-2:]
    a = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(r, r), (0, 0)])
    a = sum(w[k] * a[..., k : k + ny, :] for k in range(2 * r + 1))
    a = np.pad(a, [(0, 0)] * (a.ndim - 1) + [(r, r)])
    return sum(w[k] * a[..., k : k + nx] for k in range(2 * r + 1))


def smoothed(v: np.ndarray, there: np.ndarray, sigma: float, weight: np.ndarray | None = None) -> np.ndarray:
    """Gaussian means over the existing cells of a box of radius 2 sigma; cells nearer to the edge than that lack some. 0 where nothing exists.

    ``weight``: ``weighted(there)``, if it is known.
    """
    total = weighted(np.where(there, v, 0.0), sigma)
    weight = weighted(there.astype(float), sigma) if weight is None else weight
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1), 0.0)


def gaussian(voxels: DataFrame, sigma: float = 1.0, value: str = "v") -> DataFrame:
    """Gaussian smoothing within slices, over the voxels that exist."""
    r = max(1, round(2 * sigma))
    return blocks.by_slice(voxels, value, r, lambda v, t: blocks.inner(smoothed(v, t, sigma), r), value, "double")


def local_contrast(voxels: DataFrame, kernel: int = 7, value: str = "v", compat: bool = False) -> DataFrame:
    """Voxel over the population deviation of its k by k neighbours but itself (that exist).

    ``compat``: the window's first corner takes the voxel's place in the quotient.
    """
    r = kernel // 2

    def box_sums(a):
        """Sums over each inner cell's window, from running sums on both axes."""
        total = np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return total[kernel:, kernel:] - total[:-kernel, kernel:] - total[kernel:, :-kernel] + total[:-kernel, :-kernel]

    def contrast(v, t):
        # Values less their mean, so that squares stay near each other in size.
        mean = v[t].mean() if t.any() else 0.0
        near = np.where(t, v - mean, 0.0)
        own_there, own = blocks.inner(t, r).astype(float), blocks.inner(near, r)
        n, s1, s2 = (box_sums(x) for x in (t.astype(float), near, near * near))
        n, s1, s2 = n - own_there, s1 - own, s2 - own * own
        many = np.maximum(n, 1)
        variance = np.where(n > 0, np.maximum(s2 / many - (s1 / many) ** 2, 0), np.nan)
        # What running sums leave of equal values isn't a deviation.
        variance = np.where(variance <= 1e-12 * np.maximum(s2 / many, 1e-300) * max(t.size, 1) ** 0.5, 0, variance)
        deviation = np.sqrt(variance)
        at = blocks.shifted(np.where(t, v, np.nan), r, -r, -r) if compat else blocks.shifted(np.where(t, v, np.nan), r, 0, 0)
        return np.where(deviation > 0, at / np.where(deviation > 0, deviation, 1), np.nan)

    return blocks.by_slice(voxels, value, r, contrast, value, "double")


def z_neighbours(voxels: DataFrame, n: int, z_range: tuple[int, int], value: str = "v") -> DataFrame:
    """(z, y, x, channel, v): slices z-n..z+n as channels -n..n, reflected at the ends without repeating them."""
    lo, hi = z_range
    wanted = voxels.select("z", "y", "x", F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("channel"))
    at = F.col("z") + F.col("channel")
    at = F.when(at >= hi, 2 * hi - 2 - at).when(at < lo, 2 * lo - at).otherwise(at)
    src = voxels.select(F.col("z").alias("_z"), "y", "x", F.col(value).alias("v"))
    return wanted.withColumn("_z", at.cast("int")).join(src, ["_z", "y", "x"]).select("z", "y", "x", "channel", "v")


def tiles(voxels: DataFrame, r: int, value: str = "v", centres: DataFrame | None = None) -> DataFrame:
    """(z, y, x, tile): (2r+1)^2 values about each centre, rows in order; whole tiles only.

    Tiles are views of blocks with a halo, so a voxel is sent to the few blocks that see it and only tiles that are asked for are made.
    """
    n, inputs = 2 * r + 1, [value]
    if centres is not None:
        chosen = centres.select("z", "y", "x").distinct().withColumn("_centre", F.lit(1))
        voxels = voxels.join(chosen, ["z", "y", "x"], "left").withColumn("_centre", F.coalesce("_centre", F.lit(0)))
        inputs.append("_centre")
    kind = voxels.schema[value].dataType.simpleString()
    whole_numbers = kind in ("tinyint", "smallint", "int", "bigint")

    def cut(values, there, corner):
        cells = blocks.row_by_row(blocks.windows(there, r), lambda w: w.all(2))
        if len(values) > 1:
            cells &= blocks.inner(values[1], r) > 0
        found = blocks.windows(values[0], r)[cells]
        return [*blocks.places(cells, r, corner), pd.Series((found.astype(np.int64) if whole_numbers else found).tolist(), dtype=object)]

    # A block's tiles are held at once.
    size = max(8, min(blocks.BLOCK, int((TILE_CELLS / (n * n)) ** 0.5)))
    return blocks.on_slices(voxels, inputs, r, cut, f"z int, y int, x int, tile array<array<{kind}>>", size, depth=max(1, min(blocks.DEPTH, TILE_CELLS // (size * size * n * n))))


def visible_regions(labels: DataFrame, r: int, membrane: int, value: str = "label") -> DataFrame:
    """(z, y, x, n_regions): 4-connected regions of other than ``membrane`` in each whole tile."""
    size = 2 * r + 1

    def count(batches):
        for pdf in batches:
            grids = np.array([np.stack([np.asarray(row) for row in t]) for t in pdf["tile"]])
            yield pd.DataFrame({"z": pdf["z"], "y": pdf["y"], "x": pdf["x"], "n_regions": _regions(grids != membrane)})

    from voxloom.plans.ship import ship

    ship(labels.sparkSession)
    return tiles(labels, r, value).mapInPandas(count, "z int, y int, x int, n_regions int") if size else labels


def _regions(m: np.ndarray) -> np.ndarray:
    """4-connected components of each tile: least index spreads until nothing changes, all tiles at once."""
    n = m.shape[1] * m.shape[2]
    at = np.where(m, np.arange(n).reshape(1, *m.shape[1:]), n)
    while True:
        new = at.copy()
        for axis in (1, 2):
            for way in (1, -1):
                rolled = np.roll(at, way, axis)
                edge = [slice(None)] * 3
                edge[axis] = 0 if way == 1 else -1
                rolled[tuple(edge)] = n
                new = np.minimum(new, rolled)
        new[~m] = n
        if (new == at).all():
            break
        at = new
    return (at == np.arange(n).reshape(1, *m.shape[1:])).sum((1, 2)).astype(np.int32)
