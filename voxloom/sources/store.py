"""A stored volume in z-order: blocks of voxels under Morton keys, so that a box reads few files and row groups.

A voxel's block is its place divided by ``span``; the block's key interleaves the bits of the three block
coordinates. Rows lie sorted by key, in folders of ``zone``, the key's high bits: a cube of blocks. A box becomes a
few ranges of keys; those of zones drop folders when the query is planned, those of keys drop row groups when
they are read, and the box's own test makes the cutout exact.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from voxloom.operators.regions import AXES, extent, inside

#: Block coordinates are kept in 21 bits each, from -BIAS up.
BITS = 21
BIAS = 1 << (BITS - 1)
#: Folders of a volume, at most.
MAX_ZONES = 512
#: Shifts and masks that spread 21 bits to every third place.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


@dataclass(frozen=True)
class Layout:
    """How a volume is stored: cells of a block on each axis, and levels of blocks in a zone (8**levels blocks)."""

    z: int
    y: int
    x: int
    levels: int
    columns: str

    @property
    def span(self) -> dict[str, int]:
        return {a: getattr(self, a) for a in AXES}


def block_key(at: dict[str, Column]) -> Column:
    """The Morton key of block coordinates, biased to be positive; raises beyond 21 bits."""
    out = F.lit(0).cast("bigint")
    for k, a in enumerate(reversed(AXES)):
        v = (at[a] + BIAS).cast("bigint")
        v = F.when((v >= 0) & (v < 2 * BIAS), v).otherwise(F.when(v.isNotNull(), F.raise_error(F.lit(f"block beyond {BITS} bits on {a}")).cast("bigint")))
        for shift, mask in SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        out = out.bitwiseOR(F.shiftleft(v, k))
    return out


def voxel_key(span: dict[str, int]) -> Column:
    """The key of the block that holds a voxel (z, y, x)."""
    return block_key({a: F.floor(F.col(a) / span[a]) for a in AXES})


def morton(at: tuple[int, ...]) -> int:
    """The key of non-negative block coordinates (z, y, x)."""
    return sum((v >> bit & 1) << (3 * bit + k) for k, v in enumerate(reversed(at)) for bit in range(v.bit_length()))


def key_ranges(low: tuple[int, ...], high: tuple[int, ...], limit: int = 64) -> list[tuple[int, int]]:
    """Inclusive ranges of keys that hold all blocks from ``low`` to ``high``, both included, in order.

    Cubes of the octree are split, largest first, while there are under ``limit`` of them; what is cut by the box then is
    taken whole. So there are at most ``limit`` + 7 ranges, and those of a small box hold nothing else.
    """
    if any(a > b for a, b in zip(low, high, strict=True)):
        return []
    level = max((a ^ b).bit_length() for a, b in zip(low, high, strict=True))
    todo, whole = [(level, tuple(v >> level for v in low))], []
    while todo and len(todo) + len(whole) < limit:
        level, cube = todo.pop(0)
        if all(a <= c << level and ((c + 1) << level) - 1 <= b for a, b, c in zip(low, high, cube, strict=True)):
            whole.append((level, cube))
            continue
        level -= 1
        for k in range(8):
            part = tuple(2 * c + (k >> (2 - i) & 1) for i, c in enumerate(cube))
            if all(c << level <= b and ((c + 1) << level) - 1 >= a for a, b, c in zip(low, high, part, strict=True)):
                todo.append((level, part))
    ranges: list[tuple[int, int]] = []
    for level, cube in sorted(whole + todo, key=lambda n: morton(n[1]) << 3 * n[0]):
        first = morton(cube) << 3 * level
        last = first + (1 << 3 * level) - 1
        if ranges and ranges[-1][1] + 1 == first:
            ranges[-1] = (ranges[-1][0], last)
        else:
            ranges.append((first, last))
    return ranges


def _zones(ends: dict[str, tuple[int, int]], span: dict[str, int], levels: int) -> int:
    """How many zones of 8**levels blocks an extent meets."""
    out = 1
    for a, (lo, hi) in ends.items():
        first, last = ((v // span[a] + BIAS) >> levels for v in (lo, hi - 1))
        out *= last - first + 1
    return out


def write_volume(voxels: DataFrame, path: str, span: dict[str, int], zone_cells: int = 1 << 24, files: int | None = None) -> None:
    """Store ``voxels`` (z, y, x, other columns) under ``path``; a voxel without a place is left out.

    A zone is as many blocks as hold at most ``zone_cells`` cells (one at least); more where the volume's extent would ask for over
    ``MAX_ZONES`` folders, so that a large volume isn't scattered over small files. Keys prune row groups all the same. One shuffle by ranges of keys: a
    task holds whole blocks next to each other, so it writes few zones, and no block is larger than ``span``.
    Columns named ``key`` or ``zone`` are refused: the store's own bear these names.
    """
    if clash := {"key", "zone"} & set(voxels.columns):
        raise ValueError(f"columns {sorted(clash)} are the store's own")
    levels, cells = 0, span["z"] * span["y"] * span["x"]
    while cells * 8 <= zone_cells and levels < BITS:
        cells, levels = cells * 8, levels + 1
    placed = voxels.where(" and ".join(f"{a} is not null" for a in AXES))
    ends = extent(placed)
    while levels < BITS and _zones(ends, span, levels) > MAX_ZONES:
        levels += 1
    layout = Layout(**span, levels=levels, columns=voxels.schema.json())
    keyed = placed.withColumn("key", voxel_key(span)).withColumn("zone", F.shiftright("key", 3 * levels))
    dealt = keyed.repartitionByRange(files, "key") if files else keyed.repartitionByRange("key")
    dealt.sortWithinPartitions("zone", "key", *AXES).write.partitionBy("zone").parquet(f"{path}/data")
    voxels.sparkSession.createDataFrame([asdict(layout)]).coalesce(1).write.json(f"{path}/layout")


class Volume:
    """A stored volume, opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.layout = Layout(**spark.read.json(f"{path}/layout").first().asDict())
        own = StructType.fromJson(json.loads(self.layout.columns))
        self.columns = own.names
        self._schema = StructType([*own.fields]).add("key", LongType()).add("zone", LongType())

    def rows(self) -> DataFrame:
        """All voxels with their key and zone."""
        return self.spark.read.schema(self._schema).parquet(f"{self.path}/data")

    def ranges(self, box: dict[str, tuple[int, int]], limit: int = 64) -> list[tuple[int, int]]:
        """Ranges of keys for a half-open ``box``; an axis that it leaves out counts whole."""
        span = self.layout.span
        ends = {a: (lo // span[a] + BIAS, (hi - 1) // span[a] + BIAS) for a, (lo, hi) in box.items()}
        ends = {a: ends.get(a, (0, 2 * BIAS - 1)) for a in AXES}
        low, high = (tuple(min(max(ends[a][k], 0), 2 * BIAS - 1) for a in AXES) for k in (0, 1))
        return [] if any(lo >= hi for lo, hi in box.values()) else key_ranges(low, high, limit)

    def cutout(self, box: dict[str, tuple[int, int]], limit: int = 64) -> DataFrame:
        """The voxels inside a half-open ``box``: zones and keys prune folders and row groups, the box's test does the rest."""
        ranges = self.ranges(box, limit)
        if not ranges:
            return self.rows().where(F.lit(False)).select(*self.columns)
        zones: list[list[int]] = []
        for first, last in ((k >> 3 * self.layout.levels for k in r) for r in ranges):
            if zones and first <= zones[-1][1] + 1:
                zones[-1][1] = max(last, zones[-1][1])
            else:
                zones.append([first, last])
        within = lambda c, spans: reduce(lambda a, b: a | b, (F.col(c).between(*s) for s in spans))
        return self.rows().where(within("zone", zones)).where(within("key", ranges)).where(inside(box)).select(*self.columns)

    def cuboids(self, box: dict[str, tuple[int, int]], limit: int = 64) -> DataFrame:
        """The voxels of all blocks that ``box`` touches."""
        span = self.layout.span
        return self.cutout({a: (lo // span[a] * span[a], -(-hi // span[a]) * span[a]) if lo < hi else (lo, hi) for a, (lo, hi) in box.items()}, limit)

    def in_regions(self, regions: DataFrame) -> DataFrame:
        """(region_id, voxel columns) for each voxel in each of many ``regions``: an equi-join on zone and key, with the
        box's test on top. A region becomes a row for each block that it touches; a selective set of regions prunes zones at run time."""
        span, cells = self.layout.span, regions.select("region_id", *(f"{a}{k}" for a in AXES for k in (0, 1)))
        for a in AXES:
            first, last = (F.floor((F.col(f"{a}{k}") - k) / span[a]).cast("int") for k in (0, 1))
            cells = cells.where(f"{a}0 < {a}1").withColumn(f"_c{a}", F.explode(F.sequence(first, last)))
        cells = cells.withColumn("key", block_key({a: F.col(f"_c{a}") for a in AXES})).withColumn("zone", F.shiftright("key", 3 * self.layout.levels))
        box = reduce(lambda p, q: p & q, ((F.col(f"v.{a}") >= F.col(f"r.{a}0")) & (F.col(f"v.{a}") < F.col(f"r.{a}1")) for a in AXES))
        same = (F.col("v.zone") == F.col("r.zone")) & (F.col("v.key") == F.col("r.key")) & box
        return self.rows().alias("v").join(cells.alias("r"), same).select("r.region_id", *(F.col(f"v.`{c}`") for c in self.columns))
