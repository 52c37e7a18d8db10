"""Region properties and overlap tables: one row a label, or a pair of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
#: Indices in a part of a label's voxels.
SPAN = 1 << 16


def regionprops(labels: DataFrame, label: str = "label") -> DataFrame:
    """area, bounding box and centroid of each label but 0; its voxels are rows of ``voxel_runs``."""
    fg = labels.where(F.col(label) > 0)
    return fg.groupBy(label).agg(F.count("*").alias("area"), *(f(a).alias(f"{a}{k}") for a in AXES for f, k in ((F.min, "0"), (F.max, "1"))), *(F.avg(a).alias(f"c{a}") for a in AXES))


def voxel_runs(labels: DataFrame, ny: int, nx: int, label: str = "label", span: int = SPAN) -> DataFrame:
    """(label, part, start, length): the voxels of each label but 0 as runs of column-major indices.

    Part k holds the indices from k * ``span`` on, and no run crosses into the next part, so a label of
    any size is ranked in tasks of at most ``span`` voxels. A voxel given twice counts once.
    """
    index = F.col("z").cast("bigint") * ny * nx + F.col("x") * ny + F.col("y")
    rows = labels.where(F.col(label) > 0).select(label, index.alias("_i")).withColumn("part", F.expr(f"(_i - pmod(_i, {span})) div {span}"))
    # Neighbours in a run have the same distance to their rank.
    rank = F.dense_rank().over(Window.partitionBy(label, "part").orderBy("_i"))
    runs = rows.withColumn("_gap", F.col("_i") - rank).groupBy(label, "part", "_gap")
    return runs.agg(F.min("_i").alias("start"), (F.max("_i") - F.min("_i") + 1).alias("length")).drop("_gap")


def voxel_sets(runs: DataFrame, label: str = "label") -> DataFrame:
    """(label, part, n, runs): a row a part, with at most half a span of runs in ascending order."""
    one = F.array_sort(F.collect_list(F.struct("start", "length")))
    return runs.groupBy(label, "part").agg(F.sum("length").alias("n"), one.alias("runs"))


def index_sums(runs: DataFrame, label: str = "label") -> DataFrame:
    """(label, pixel_sum): the sum of each label's indices, from its runs."""
    n = F.col("length")
    return runs.groupBy(label).agg(F.sum(F.col("start") * n + F.expr("length * (length - 1) div 2")).alias("pixel_sum"))


def voxels_of(sets: DataFrame, ny: int, nx: int, label: str = "label") -> DataFrame:
    """(label, z, y, x) of ``voxel_sets``."""
    each = sets.select(label, F.inline("runs")).select(label, F.explode(F.expr("sequence(start, start + length - 1)")).alias("_i"))
    return each.select(label, *(F.expr(e).cast("int").alias(a) for a, e in (("z", f"_i div {ny * nx}"), ("y", f"_i % {ny}"), ("x", f"_i % {ny * nx} div {ny}"))))


def size_filter(labels: DataFrame, low: int, high: int | None = None, label: str = "label") -> DataFrame:
    """Objects with fewer than ``low`` (or more than ``high``) voxels become background.

    The sizes are an aggregate joined back, not a window, so a giant object's voxels stay spread.
    """
    some = labels.where(F.col(label) > 0)
    sizes = some.groupBy(label).agg(F.count("*").alias("_n"))
    keep = sizes.where((F.col("_n") >= low) & (F.lit(True) if high is None else F.col("_n") <= high)).select(F.col(label), F.lit(True).alias("_keep"))
    kept = some.join(keep, label, "left").withColumn(label, F.when(F.col("_keep"), F.col(label)).otherwise(0).cast("bigint")).select(*labels.columns)
    return kept.union(labels.where(~F.coalesce(F.col(label) > 0, F.lit(False))).withColumn(label, F.lit(0).cast("bigint")).select(*labels.columns))


def contingency(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, a, b, n) for aligned labels, zeros dropped."""
    return pairs.where((F.col(a) > 0) & (F.col(b) > 0)).groupBy(*by, a, b).agg(F.count("*").alias("n"))


def ranked(table: DataFrame, by: list[str], of: str = "a", other: str = "b") -> DataFrame:
    """Overlaps of each ``of`` by size, ties by the smaller ``other``."""
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*by, of).orderBy(F.desc("n"), other)))


def modal(table: DataFrame, by: list[str], of: str = "a", other: str = "b") -> DataFrame:
    """Each ``of`` with its most frequent ``other`` (the smallest of ties)."""
    return ranked(table, by, of, other).where("rank = 1").drop("rank")


def dice(table: DataFrame, area_a: DataFrame, area_b: DataFrame, by: list[str]) -> DataFrame:
    """2 n / (area a + area b); areas are (by, a or b, na or nb)."""
    return table.join(area_a, [*by, "a"]).join(area_b, [*by, "b"]).withColumn("dice", 2 * F.col("n") / (F.col("na") + F.col("nb")))


def overlap_fraction(pairs: DataFrame, by: list[str], ignore_zeros: bool = True) -> DataFrame:
    """(by, a, b, n, score): each a's modal b, and its share of a's overlap. With zeros counted,
    the background may be the mode."""
    p = pairs.where("a > 0")
    table = (p.where("b > 0") if ignore_zeros else p).groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by, "a"))
    return modal(table.withColumn("score", F.col("n") / total), by)


def recentred(labels: DataFrame, label: str = "label") -> DataFrame:
    """Rounded mean coordinates of each object."""
    return labels.where(F.col(label) > 0).groupBy(label).agg(*(F.round(F.avg(a)).cast("int").alias(a) for a in AXES))


def merge_counts(groups: DataFrame, root: str = "component", node: str = "node") -> DataFrame:
    """(root, children) for each parent; the parent itself isn't a child."""
    return groups.groupBy(root).agg(F.count_if(F.col(node) != F.col(root)).alias("children"))


def merge_totals(groups: DataFrame, requested: DataFrame, root: str = "component", node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """One row: parents, children, objects, merges requested, and those failed: ones whose ends are null, or that
    ask to merge an object with itself."""
    own = groups.agg(F.count_if(F.col(node) == F.col(root)).alias("parents"), F.count_if(F.col(node) != F.col(root)).alias("children"), F.count("*").alias("objects"))
    failed = F.col(src).isNull() | F.col(dst).isNull() | (F.col(src) == F.col(dst))
    return own.crossJoin(requested.agg(F.count("*").alias("requested"), F.count_if(failed).alias("failed")))  # one row each


def argmax(probabilities: Column) -> Column:
    """The first of the largest, from 0."""
    return F.array_position(probabilities, F.array_max(probabilities)) - 1


def classification_errors(rows: DataFrame, probabilities: str, truth: str, by: list[str] | None = None) -> DataFrame:
    """errors, error_rate and the mean negative log-likelihood of the true class, by groups or over all."""
    wrong = argmax(F.col(probabilities)) != F.col(truth)
    own = F.element_at(F.col(probabilities), (F.col(truth) + 1).cast("int"))
    return rows.groupBy(*(by or [])).agg(F.count_if(wrong).alias("errors"), F.avg(wrong.cast("double")).alias("error_rate"), F.avg(-F.log(own)).alias("nll"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by, bin, n): equal bins from ``low`` to ``high``, the last one closed."""
    k = F.least(F.floor((F.col(value) - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(value).between(low, high)).groupBy(*(by or []), k.alias("bin")).agg(F.count("*").alias("n"))


def delta_summary(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """min, max, mean and median of the absolute changes between two keyed vectors."""
    d = before.select(key, F.col(value).alias("_b")).join(after.select(key, F.col(value).alias("_a")), key).select(F.abs(F.col("_a") - F.col("_b")).alias("d"))
    return d.agg(F.min("d").alias("low"), F.max("d").alias("high"), F.avg("d").alias("mean"), F.percentile("d", F.lit(0.5)).alias("median"))
