"""Writing labels, objects, probabilities and merge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def paint(voxels: DataFrame, path: str, channel: str, resolution: int, kind: str = "label") -> None:
    """Write a volume's voxels under channel and resolution; painting again replaces just that part.

    ``kind``: 'label' or 'probability'.
    """
    if kind not in ("label", "probability"):
        raise ValueError(f"kind {kind!r}")
    out = voxels.withColumns({"channel": F.lit(channel), "resolution": F.lit(resolution), "kind": F.lit(kind)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("channel", "resolution").parquet(path)


def write_objects(objects: DataFrame, path: str) -> None:
    """Object metadata; how many go in a file is Spark's business."""
    objects.write.mode("append").parquet(path)


def object_rows(props: DataFrame, channel: str, kind: str, author: str, resolution: int, label: str = "label") -> DataFrame:
    """Region properties as object metadata."""
    box = F.struct(*(F.col(f"{a}{k}").alias(f"{a}{k}") for a in "zyx" for k in (0, 1)))
    centre = F.struct(*(F.round(f"c{a}").cast("int").alias(a) for a in "zyx"))
    return props.select(F.col(label).alias("id"), F.lit(channel).alias("channel"), F.lit(kind).alias("kind"), F.lit(author).alias("author"), F.lit(resolution).alias("resolution"), "area", box.alias("bbox"), centre.alias("centroid"), F.create_map(F.lit("centroid"), F.concat_ws(",", *(F.col(f"c{a}").cast("string") for a in "zyx"))).alias("fields"))


def next_id(objects: DataFrame, id_col: str = "id") -> int:
    """The first id of a free contiguous block."""
    return (objects.agg(F.max(id_col)).first()[0] or 0) + 1


def shifted(labels: DataFrame, base: int, label: str = "label") -> DataFrame:
    """Labels 1.. become base..; 0 stays."""
    return labels.withColumn(label, F.when(F.col(label) > 0, F.col(label) + base - 1).otherwise(0).cast("bigint"))


def rescaled_slices(voxels: DataFrame, value: str = "v", rescale: bool = True, by: str = "z") -> DataFrame:
    """Each slice to 0..255; or, without ``rescale``, an error unless the values lie in [0, 1]. A null stays null.

    The slice extremes are a small aggregate joined back.
    """
    v = F.col(value)
    if not rescale:
        return voxels.withColumn(value, F.when(v.isNull() | v.between(0, 1), v).otherwise(F.raise_error(F.lit("value outside [0, 1]")).cast("double")))
    ends = voxels.groupBy(by).agg(F.min(value).alias("_lo"), (F.max(value) - F.min(value)).alias("_span"))
    out = voxels.join(ends, by)
    return out.withColumn(value, F.when(v.isNotNull(), F.floor(F.coalesce(F.try_divide((v - F.col("_lo")) * 255, F.col("_span")), F.lit(0.0))).cast("int"))).drop("_lo", "_span")


#: Slices of a folder.
SLICES = 512


def save_slices(voxels: DataFrame, path: str, by: str = "z") -> None:
    """Save slices whole: a slice lies in one file, in order, next to those before and after it.

    Folders ``band`` hold ``SLICES`` numbers each, and a task writes a range of slices, so the files grow with the volume's size, not
    with the number of slices. A reader of one slice drops the other bands, and row groups by ``by``.
    """
    banded = voxels.withColumn("band", F.floor(F.col(by) / SLICES))
    banded.repartitionByRange(by).sortWithinPartitions("band", by).write.mode("overwrite").partitionBy("band").parquet(path)


def merge_lines(groups: DataFrame, root: str = "root", members: str = "members") -> DataFrame:
    """parent,child,... with the parent first and once; a line for each piece of a set."""
    rest = F.array_sort(F.array_remove(F.col(members), F.col(root)))
    return groups.select(F.concat_ws(",", F.col(root).cast("string"), F.transform(rest, lambda x: x.cast("string"))).alias("value"))


def write_merge_list(groups: DataFrame, path: str) -> None:
    merge_lines(groups).write.mode("overwrite").text(path)


def parse_merge_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(new, old): each child with its parent."""
    ids = F.transform(F.split(value, ","), lambda x: x.cast("bigint"))
    return lines.select(ids.alias("_ids")).select(F.col("_ids")[0].alias("new"), F.explode(F.expr("slice(_ids, 2, greatest(size(_ids) - 1, 0))")).alias("old"))


def read_merge_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_merge_lines(spark.read.text(path))
