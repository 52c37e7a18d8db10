"""Choosing voxels for training, in batches, and turning tiles about.

Random orders come from a hash of the coordinates, so a run repeats exactly. Class ranks are
row numbers in partitions of class and hash bucket, put together by the counts before, so a
class that holds nearly all voxels isn't sorted in one task; buckets grow in number with the class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A public spatial hash's primes and its range here.
PRIMES, RANGE = {"z": 73856093, "y": 19349663, "x": 83492791}, 1000003
#: Rows that are ranked together, on average.
BUCKET_ROWS = 100_000


def spread() -> Column:
    """A hash of the coordinates that any SQL engine can follow."""
    return sum((F.col(a).cast("bigint") * p for a, p in list(PRIMES.items())[1:]), F.col("z").cast("bigint") * PRIMES["z"]) % RANGE


def interior(voxels: DataFrame, border: int, extent: dict[str, tuple[int, int]], slices: list[int] | None = None) -> DataFrame:
    """Voxels at least ``border`` from the sides of their slice, of the slices named."""
    out = voxels
    for a in ("y", "x"):
        out = out.where(F.col(a).between(extent[a][0] + border, extent[a][1] - 1 - border))
    return out if slices is None else out.where(F.col("z").isin(list(slices)))


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank", deal: Column | None = None) -> DataFrame:
    """Rank from 1 within ``by``, by ``order`` whose first part is a number from 0 to RANGE.

    Ranges of that number are ranked each by themselves, then offset by the counts before. ``deal``: such a number
    that never falls along ``order``, where its first part is another.
    """
    deal = order[0] if deal is None else deal
    parts = F.ceil(F.count("*") / BUCKET_ROWS).alias("_parts")
    sizes = rows.groupBy(*by).agg(parts) if by else rows.agg(parts)
    keyed = rows.join(sizes, by) if by else rows.crossJoin(sizes)  # one row
    keyed = keyed.withColumn("_part", F.floor(deal * F.col("_parts") / RANGE).cast("int")).drop("_parts")
    n = keyed.groupBy(*by, "_part").agg(F.count("*").alias("_c"))
    first = n.withColumn("_first", F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    local = keyed.withColumn("_local", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    return local.join(first, [*by, "_part"]).withColumn(name, F.col("_first") + F.col("_local")).drop("_part", "_local", "_first")


def batched(rows: DataFrame, rank: Column, size: int) -> DataFrame:
    return rows.withColumn("batch", F.floor((rank - 1) / size).cast("int"))


def masked(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels that ``mask`` (z, y, x) holds."""
    return voxels.join(mask.select("z", "y", "x"), ["z", "y", "x"], "left_semi")


def balanced(voxels: DataFrame, label: str, by: list[str] | None = None, first: Column | None = None, omit: list | None = None) -> DataFrame:
    """(z, y, x, label, rank): as many of each class as the rarest has, in random order.

    ``by`` balances each such group by itself (an image row, say). ``first`` (0 or 1, 0 first)
    puts some voxels of a class before the others.
    """
    by = by or []
    rows = voxels if omit is None else voxels.where(~F.col(label).isin(omit))
    order = spread()
    # Halves of the range, so that those put first are dealt before the others; the order is by both numbers whole.
    key, deal = ([order], order) if first is None else ([first, order], F.floor((order + first * RANGE) / 2))
    rows = ranked(rows, [*by, label], [*key, *map(F.col, "zyx")], deal=deal)
    sizes = rows.groupBy(*by, label).agg(F.count("*").alias("_n"))
    kinds = voxels.select(label).where(F.col(label).isNotNull() & (F.lit(True) if omit is None else ~F.col(label).isin(omit))).distinct().agg(F.count("*").alias("_k"))
    if by:
        least = sizes.groupBy(*by).agg(F.min("_n").alias("_m"), F.count("*").alias("_kinds"))
        out = rows.join(least, by).crossJoin(F.broadcast(kinds)).where((F.col("rank") <= F.col("_m")) & (F.col("_kinds") == F.col("_k")))  # one row
    else:
        out = rows.crossJoin(F.broadcast(sizes.agg(F.min("_n").alias("_m")))).where(F.col("rank") <= F.col("_m"))  # one row
    return out.drop("_m", "_kinds", "_k")


def interleaved(rows: DataFrame, label: str) -> DataFrame:
    """``balanced`` rows with their place in pos, neg, pos, neg, ...: ``place`` from 1."""
    return rows.withColumn("place", 2 * F.col("rank") - F.when(F.col(label) > 0, 1).otherwise(0))


def recycled(rows: DataFrame, size: int, rank: str = "rank") -> DataFrame:
    """Ranked rows in batches of ``size``; the last batch is filled up with the first rows again."""
    n = rows.agg(F.max(rank).alias("_n"))
    out = rows.crossJoin(n)  # one row
    short = F.col(rank) <= F.pmod(-F.col("_n"), F.lit(size))
    places = F.when(short, F.array(F.col(rank), F.col("_n") + F.col(rank))).otherwise(F.array(F.col(rank)))
    out = out.withColumn("place", F.explode(places)).drop("_n")
    return out.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int"))


def hard_first(voxels: DataFrame, label: str, value: str, percent: float = 15) -> DataFrame:
    """``balanced``, with the negatives at or under a percentile of negative intensity first."""
    cut = voxels.where(F.col(label) == 0).agg(F.percentile(value, F.lit(percent / 100)).alias("_cut"))
    rows = voxels.crossJoin(F.broadcast(cut))  # one row
    hard = (F.col(label) == 0) & (F.col(value) <= F.col("_cut"))
    return balanced(rows.withColumn("hard", hard).drop("_cut"), label, first=F.when(F.col("hard") | (F.col(label) != 0), 0).otherwise(1))


def capped(rows: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """The first ``n`` in a fixed order: a sampling operator's limit."""
    return rows.orderBy(*order).limit(n)


def flip_rows(tile: Column) -> Column:
    return F.reverse(tile)


def flip_columns(tile: Column) -> Column:
    return F.transform(tile, F.reverse)


def transpose(tile: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(tile[0])), lambda i: F.transform(tile, lambda row: F.element_at(row, i)))


def rotate(tile: Column, way: int) -> Column:
    """A quarter turn, counter-clockwise for 1, clockwise for -1."""
    return flip_rows(transpose(tile)) if way > 0 else flip_columns(transpose(tile))


def xform(tile: Column, flip: int | None, turn: int) -> Column:
    """``flip``: 0 rows, 1 columns, None neither; then ``turn``: 1, -1 or 0."""
    out = tile if flip is None else flip_columns(tile) if flip else flip_rows(tile)
    return rotate(out, turn) if turn else out


def uniform(key: Column, salt: int) -> Column:
    """A repeatable number in [0, 1) for each key."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def augmented(tiles: DataFrame, key: str, flip_p: float = 0.6, turn_p: float = 0.6, tile: str = "tile") -> DataFrame:
    """Each tile flipped with ``flip_p`` (which way is even) and turned with ``turn_p``, by its key."""
    k, t = F.col(key), F.col(tile)
    f, r = uniform(k, 1), uniform(k, 2)
    flipped = F.when(f < flip_p / 2, flip_rows(t)).when(f < flip_p, flip_columns(t)).otherwise(t)
    out = tiles.withColumn(tile, flipped)
    t = F.col(tile)
    return out.withColumn(tile, F.when(r < turn_p / 2, rotate(t, 1)).when(r < turn_p, rotate(t, -1)).otherwise(t))


def augmented_batches(tiles: DataFrame, batch: str, tile: str = "tile") -> DataFrame:
    """Per batch: rows flipped with 0.2, columns with 0.2, else as they are."""
    u, t = uniform(F.col(batch), 3), F.col(tile)
    return tiles.withColumn(tile, F.when(u < 0.2, flip_rows(t)).when(u < 0.4, flip_columns(t)).otherwise(t))
