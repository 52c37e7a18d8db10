"""Reading volumes: channel cutouts, stacks in array files, and detector output."""

from __future__ import annotations

import io
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.regions import AXES, inside
from voxloom.plans.ship import ship

#: Cells of the slices that a reader hands on together.
BATCH_CELLS = 1 << 20


def cutout(source: DataFrame, box: dict[str, tuple[int, int]], channel: str | None = None, resolution: int | None = None) -> DataFrame:
    """One channel inside a half-open box. All tests are simple ranges, so they prune partitions and reach the scan."""
    out = source.where(inside(box))
    if channel is not None:
        out = out.where(F.col("channel") == channel)
    return out if resolution is None else out.where(F.col("resolution") == resolution)


def co_cutout(channels: dict[str, DataFrame], box: dict[str, tuple[int, int]], pad: dict[str, int] | None = None) -> DataFrame:
    """Aligned channels, one column each, for a padded box; a missing value is null.

    A union and one pivoting aggregate: one shuffle, however many channels.
    """
    pad = pad or {}
    wide = {a: (lo - pad.get(a, 0), hi + pad.get(a, 0)) for a, (lo, hi) in box.items()}
    long = reduce(DataFrame.unionByName, (d.where(inside(wide)).select(*AXES, F.lit(n).alias("channel"), F.col(d.columns[-1]).cast("double").alias("value")) for n, d in channels.items()))
    return long.groupBy(*AXES).agg(*(F.max(F.when(F.col("channel") == n, F.col("value"))).alias(n) for n in channels))


def by_slabs(source: DataFrame, z: tuple[int, int], slabs: int) -> DataFrame:
    """A big cuboid, dealt out by z."""
    return source.where(F.col("z").between(z[0], z[1] - 1)).repartitionByRange(slabs, "z")


def load_stack(spark: SparkSession, path: str, key: str = "X", at: str | None = None) -> DataFrame:
    """(path, z0, nz, ny, nx, data): .npy and .npz arrays, a block for each slice.

    Files come through Spark's reader, so any store that it reads will do; ``key`` names the
    array of an .npz. A slice's number is its place in the array; ``at`` names an array of an .npz that gives the numbers
    instead, so that one file holds slices from anywhere.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).where(F.col("path").rlike(r"\.np[yz]$")).select("path", "content")

    def decode(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                got = np.load(io.BytesIO(content), allow_pickle=False)
                cube = got[key] if name.endswith(".npz") else got
                cube = cube[None] if cube.ndim == 2 else cube
                if cube.ndim != 3:
                    raise ValueError(f"{name}: {cube.ndim} dimensions; a stack has 2 or 3")
                own = np.arange(len(cube)) if at is None or not name.endswith(".npz") else got[at]
                if own.shape != (len(cube),):
                    raise ValueError(f"{name}: {len(cube)} slices, numbers of shape {own.shape}")
                # As many slices in a batch as hold a bounded number of cells.
                step = max(1, BATCH_CELLS // max(1, cube.shape[1] * cube.shape[2]))
                for first in range(0, len(cube), step):
                    some = cube[first : first + step].astype(np.float32)
                    yield pd.DataFrame({"path": name, "z0": own[first : first + step].astype(np.int32), "nz": 1, "ny": cube.shape[1], "nx": cube.shape[2], "data": list(some.reshape(len(some), -1))})

    return files.mapInPandas(decode, "path string, z0 int, nz int, ny int, nx int, data array<float>")


def blocks_to_voxels(blocks: DataFrame, value: str = "v") -> DataFrame:
    """Block payloads in C order, one row a voxel."""
    out = blocks.select("*", F.posexplode("data").alias("_i", value))
    z, y, x = F.floor(F.col("_i") / (F.col("ny") * F.col("nx"))), F.floor(F.col("_i") / F.col("nx")) % F.col("ny"), F.col("_i") % F.col("nx")
    off = lambda c: F.col(c) if c in blocks.columns else F.lit(0)
    return out.select((z + off("z0")).cast("int").alias("z"), (y + off("y0")).cast("int").alias("y"), (x + off("x0")).cast("int").alias("x"), value)


def voxels_to_blocks(voxels: DataFrame, span: dict[str, int], value: str = "v") -> DataFrame:
    """(bz, by, bx, z0, y0, x0, data of (z, y, x, value) in C order): bounded groups, a block each."""
    cell = [F.floor(F.col(a) / span[a]).cast("int").alias(f"b{a}") for a in AXES]
    out = voxels.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct(*AXES, value))).alias("data"))
    return out.select("bz", "by", "bx", *((F.col(f"b{a}") * span[a]).alias(f"{a}0") for a in AXES), "data")


def tool_output(prediction: DataFrame, channel: int, offset: dict[str, int], pad: dict[str, int] | None = None, swap_xy: bool = False, resolution: int = 0) -> DataFrame:
    """One channel of a detector's output as a volume at its place: start of the region plus the pad."""
    pad = pad or {}
    y, x = ("x", "y") if swap_xy else ("y", "x")
    at = lambda a, c: (F.col(c) + offset[a] + pad.get(a, 0)).cast("int").alias(a)
    return prediction.where(F.col("channel") == channel).select(F.lit(resolution).alias("resolution"), at("z", "z"), at("y", y), at("x", x), "value")
