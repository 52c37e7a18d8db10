"""Work on dense blocks: voxels are grouped into boxes of bounded size with a halo, and numpy does the rest.

A voxel goes to its own block and to those whose halo it lies in (at most 2 on each axis while the
halo is smaller than the block), so a neighbourhood of any size costs a few copies of a
voxel rather than one for each neighbour. Blocks are tasks' units: at most
``(BLOCK + 2 * halo)`` cells on an axis, whatever the volume's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.plans.ship import ship

BLOCK = 128
#: Slices of a block that go to a task together.
DEPTH = 16
#: Cells of the slices that a kernel of stacks sees at once.
STACK_CELLS = 1 << 18


def _with_halo(axis: str, size: int, halo: int) -> Column:
    """The numbers of the blocks that see a coordinate."""
    c = F.col(axis)
    return F.sequence(F.floor((c - halo) / size).cast("int"), F.floor((c + halo) / size).cast("int"))


def _by_block(seen: DataFrame, size: int, halo: int, columns: list[str], depth: int, one: Callable, schema: str) -> DataFrame:
    """Rows of ``schema`` from ``one(z, by, bx, y, x, values)`` on each block of a slice that holds voxels of its own.

    A task's group is ``depth`` slices of a block, so that small slices don't pay for a group each; they are worked on one by one.
    """
    seen = seen.withColumn("by", F.explode(_with_halo("y", size, halo))).withColumn("bx", F.explode(_with_halo("x", size, halo)))
    names = [f.split()[0].strip("`") for f in schema.split(", ")]

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        by, bx = int(pdf["by"].iloc[0]), int(pdf["bx"].iloc[0])
        zs, ys, xs = (pdf[c].to_numpy() for c in "zyx")
        columns_ = [pdf[c].to_numpy() for c in columns]
        own = (ys // size == by) & (xs // size == bx)
        order = np.argsort(zs, kind="stable")
        ends = np.flatnonzero(np.diff(zs[order])) + 1
        out = [one(int(zs[rows[0]]), by, bx, ys[rows], xs[rows], [c[rows] for c in columns_]) for rows in np.split(order, ends) if own[rows].any()]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({n: pd.Series([], dtype=object) for n in names})

    return seen.withColumn("_zs", F.floor(F.col("z") / depth)).groupBy("_zs", "by", "bx").applyInPandas(group, schema)


def by_slice(voxels: DataFrame, value: str, halo: int, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], out: str, kind: str, extent: dict[str, tuple[int, int]] | None = None, size: int = BLOCK) -> DataFrame:
    """(z, y, x, out): ``kernel(values, there)`` on blocks of slices, for the voxels that exist.

    ``values``: doubles, 0 where no voxel is; ``there``: which cells hold one; both with the halo.
    The kernel gives the inner cells. With ``extent``, cells beyond it are seen but not given.
    """
    ship(voxels.sparkSession)
    size = max(size, 2 * halo)
    seen = voxels.select("z", "y", "x", F.col(value).cast("double").alias("v"))
    convert = {"boolean": bool, "int": np.int32, "bigint": np.int64}.get(kind, np.float64)

    def one(z: int, by: int, bx: int, y: np.ndarray, x: np.ndarray, columns: list[np.ndarray]) -> pd.DataFrame:
        y, x = y - by * size + halo, x - bx * size + halo
        # Only the part that holds voxels is filled in.
        ny, nx = min(size + 2 * halo, int(y.max()) + 1 + halo), min(size + 2 * halo, int(x.max()) + 1 + halo)
        ny, nx = max(ny, 2 * halo + 1), max(nx, 2 * halo + 1)
        values, there = np.zeros((ny, nx)), np.zeros((ny, nx), bool)
        values[y, x], there[y, x] = columns[0], True
        got = kernel(values, there)
        own = there[halo : ny - halo, halo : nx - halo]
        yy, xx = np.nonzero(own)
        rows = pd.DataFrame({"z": np.full(len(yy), z, np.int32), "y": (yy + by * size).astype(np.int32), "x": (xx + bx * size).astype(np.int32), out: got[own]})
        if extent:
            for a in extent:
                rows = rows[(rows[a] >= extent[a][0]) & (rows[a] < extent[a][1])]
        if kind in ("boolean", "int", "bigint"):
            return rows.astype({out: convert})
        return rows.assign(**{out: rows[out].astype(object).where(~np.isnan(rows[out]), None)}) if np.isnan(rows[out].to_numpy(float)).any() else rows

    return _by_block(seen, size, halo, ["v"], DEPTH, one, f"z int, y int, x int, `{out}` {kind}")


def on_slices(voxels: DataFrame, inputs: list[str], halo: int, kernel: Callable, schema: str, size: int = BLOCK, *, depth: int | None = None) -> DataFrame:
    """Rows of ``schema`` from ``kernel(values, there, corner)`` on each block of a slice that holds voxels of its own.

    ``values``: an array of doubles for each of ``inputs``, 0 where no voxel is; ``there``: which cells hold one; both with the halo.
    ``corner``: (z, y, x) of the first cell, in the halo. The kernel gives a list of columns; inner cells are its own, cells in the halo
    belong to other blocks as well. ``depth``: slices whose rows are held at once.
    """
    ship(voxels.sparkSession)
    seen = voxels.select("z", "y", "x", *(F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(inputs)))
    names = [f.split()[0].strip("`") for f in schema.split(", ")]

    def one(z: int, by: int, bx: int, y: np.ndarray, x: np.ndarray, columns: list[np.ndarray]) -> pd.DataFrame:
        corner = (z, by * size - halo, bx * size - halo)
        y, x = y - corner[1], x - corner[2]
        # Only the part that holds voxels is filled in.
        shape = tuple(max(2 * halo + 1, min(size + 2 * halo, int(c.max()) + 1 + halo)) for c in (y, x))
        there = np.zeros(shape, bool)
        there[y, x] = True
        values = [np.zeros(shape) for _ in inputs]
        for v, c in zip(values, columns, strict=True):
            v[y, x] = np.nan_to_num(c.astype(float))
        return pd.DataFrame(dict(zip(names, kernel(values, there, corner), strict=True)))

    return _by_block(seen, size, halo, [f"v{k}" for k in range(len(inputs))], depth or DEPTH, one, schema)


def on_stacks(voxels: DataFrame, inputs: list[str], halo: int, kernel: Callable, schema: str, size: int = BLOCK) -> DataFrame:
    """As ``on_slices``, but ``kernel(values, there)`` sees some slices of a block as one array (slice, y, x), so that small slices don't pay for numpy's calls each.

    It gives the cells that get rows, without the halo, and the columns beside z, y and x; the slices must not matter to each other.
    """
    ship(voxels.sparkSession)
    seen = voxels.select("z", "y", "x", *(F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(inputs)))
    seen = seen.withColumn("by", F.explode(_with_halo("y", size, halo))).withColumn("bx", F.explode(_with_halo("x", size, halo)))
    names = [f.split()[0].strip("`") for f in schema.split(", ")]

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [int(pdf[b].iloc[0]) * size for b in ("by", "bx")]
        z, y, x = (pdf[c].to_numpy() for c in "zyx")
        own = (y // size * size == at[0]) & (x // size * size == at[1])
        if not own.any():
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
        # Only the part that holds voxels is filled in.
        low = [max(a, int(c.min())) - halo for a, c in zip(at, (y, x), strict=True)]
        shape = [min(a + size, int(c.max()) + 1) + halo - o for a, c, o in zip(at, (y, x), low, strict=True)]
        deep, place = np.unique(z, return_inverse=True)
        step, out = max(1, STACK_CELLS // (shape[0] * shape[1])), []
        for first in range(0, len(deep), step):
            rows = np.flatnonzero((place >= first) & (place < first + step))
            cells = (place[rows] - first, y[rows] - low[0], x[rows] - low[1])
            there = np.zeros((min(step, len(deep) - first), *shape), bool)
            there[cells] = True
            values = [np.zeros(there.shape) for _ in inputs]
            for k, v in enumerate(values):
                v[cells] = np.nan_to_num(pdf[f"v{k}"].to_numpy()[rows].astype(float))
            given, columns = kernel(values, there)
            zz, yy, xx = np.nonzero(given)
            places_ = [deep[first + zz].astype(np.int32), (yy + low[0] + halo).astype(np.int32), (xx + low[1] + halo).astype(np.int32)]
            out.append(pd.DataFrame(dict(zip(names, [*places_, *columns], strict=True))))
        return pd.concat(out, ignore_index=True)

    return seen.withColumn("_zs", F.floor(F.col("z") / DEPTH)).groupBy("_zs", "by", "bx").applyInPandas(group, schema)


def inner(cells: np.ndarray, halo: int) -> np.ndarray:
    """Without the halo on the last two axes."""
    return cells[..., halo : cells.shape[-2] - halo, halo : cells.shape[-1] - halo]


def places(cells: np.ndarray, halo: int, corner: tuple[int, int, int]) -> list[np.ndarray]:
    """The z, y and x of the chosen inner cells."""
    y, x = np.nonzero(cells)
    return [np.full(len(y), corner[0], np.int32), (y + corner[1] + halo).astype(np.int32), (x + corner[2] + halo).astype(np.int32)]


def on_boxes(voxels: DataFrame, columns: list[str], halo: tuple[int, int, int], kernel: Callable, schema: str, size: tuple[int, int, int]) -> DataFrame:
    """Rows of ``schema`` from ``kernel(rows, own)`` on each box of voxels: ``rows`` has z, y, x and ``columns``; ``own``: which aren't in the halo."""
    ship(voxels.sparkSession)
    seen = voxels.select("z", "y", "x", *columns)
    for a, s, h in zip("zyx", size, halo, strict=True):
        seen = seen.withColumn(f"b{a}", F.explode(_with_halo(a, s, h)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.ones(len(pdf), bool)
        for a, s in zip("zyx", size, strict=True):
            own &= pdf[a].to_numpy() // s == pdf[f"b{a}"].to_numpy()
        return kernel(pdf, own)

    return seen.groupBy("bz", "by", "bx").applyInPandas(one, schema)


def windows(values: np.ndarray, halo: int) -> np.ndarray:
    """Each inner cell's (2 halo + 1)^2 neighbourhood, as a view."""
    return np.lib.stride_tricks.sliding_window_view(values, (2 * halo + 1, 2 * halo + 1))


def row_by_row(view: np.ndarray, fn: Callable[[np.ndarray], np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """``fn`` on bands of rows of a window view, so that copies of it stay small."""
    step = max(1, cells // max(1, view.shape[1] * view.shape[2] * view.shape[3]))
    return np.concatenate([fn(view[at : at + step].reshape(*view[at : at + step].shape[:2], -1)) for at in range(0, len(view), step)])


def shifted(values: np.ndarray, halo: int, dy: int, dx: int) -> np.ndarray:
    """The inner cells' neighbours at (dy, dx)."""
    ny, nx = values.shape[-2:]
    return values[..., halo + dy : ny - halo + dy, halo + dx : nx - halo + dx]


def components(voxels: DataFrame, offsets: list[tuple[int, int, int]], ny: int, nx: int, size: tuple[int, int, int] = (32, BLOCK, BLOCK)) -> DataFrame:
    """(z, y, x, i, root): the connected components within each block, named by their least index.

    ``i`` is the column-major index of (z, y, x) in slices of ny by nx. ``offsets``: one of each pair of opposite neighbours.
    """
    ship(voxels.sparkSession)
    block = [F.floor(F.col(a) / s).cast("int").alias(f"b{a}") for a, s in zip("zyx", size, strict=True)]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["z", "y", "x"])
        z, y, x = (pdf[a].to_numpy(np.int64) for a in "zyx")
        i = z * ny * nx + x * ny + y
        order = np.argsort(i)
        low = [int(c.min()) for c in (z, y, x)]
        high = [int(c.max()) - o + 1 for c, o in zip((z, y, x), low, strict=True)]
        place = np.full([h + 2 for h in high], -1, np.int64)
        at = [c[order] - o + 1 for c, o in zip((z, y, x), low, strict=True)]
        place[tuple(at)] = np.arange(len(order))
        pairs = []
        for o in offsets:
            q = place[tuple(c + d for c, d in zip(at, o, strict=True))]
            have = np.flatnonzero(q >= 0)
            pairs.append(np.stack([have, q[have]]))
        root = least_roots(len(order), np.concatenate(pairs, 1))
        return pd.DataFrame({"z": z[order].astype(np.int32), "y": y[order].astype(np.int32), "x": x[order].astype(np.int32), "i": i[order], "root": i[order][root]})

    return voxels.select("z", "y", "x", *block).groupBy("bz", "by", "bx").applyInPandas(one, "z int, y int, x int, i bigint, root bigint")


def least_roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least node of each node's component, by hooking and pointer jumping."""
    root = np.arange(n)
    a, b = pairs
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def on_faces(size: tuple[int, int, int] = (32, BLOCK, BLOCK)) -> Column:
    """Whether a voxel lies on the face of its block, where neighbours may be in another."""
    edge = F.lit(False)
    for a, s in zip("zyx", size, strict=True):
        m = F.pmod(F.col(a), F.lit(s))
        edge = edge | (m == 0) | (m == s - 1)
    return edge
