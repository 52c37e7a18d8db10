"""Projections, masks and value transforms on voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_intensity(p: Column) -> Column:
    """Probability -> 0..255, half away from zero, saturating."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.round(p * 255).cast("int")))


def band(v: Column, low, high) -> Column:
    return (v >= low) & (v <= high)


def band_report(voxels: DataFrame, value: str, low, high) -> DataFrame:
    """How many voxels a band keeps, and the percentage it omits, by slice."""
    keep = F.count_if(band(F.col(value), low, high))
    return voxels.groupBy("z").agg(keep.alias("kept"), F.round(100 * (1 - keep / F.count("*")), 6).alias("omitted_percent"))


def override_trivial(scored: DataFrame, value: str, low, high, p: str = "p") -> DataFrame:
    """After scoring: a voxel above the band is no membrane, one below is."""
    v = F.col(value)
    fixed = F.when(v > high, F.lit(0.0)).when(v < low, F.lit(1.0)).otherwise(F.col(p))
    return scored.withColumns({p: fixed, "p_not": 1 - fixed})


def tails(voxels: DataFrame, value: str, low, high) -> DataFrame:
    """Masks of what lies under and over the band."""
    return voxels.withColumns({"is_lower": F.col(value) < low, "is_upper": F.col(value) > high})


def class_codes(rows: DataFrame, label: str, first: int = 0) -> DataFrame:
    """(label, code): the distinct labels in order, numbered from ``first``."""
    return rows.select(label).where(F.col(label).isNotNull()).distinct().withColumn("code", (F.dense_rank().over(Window.orderBy(label)) - 1 + first).cast("int"))


def encode_classes(rows: DataFrame, label: str, first: int = 0) -> DataFrame:
    return rows.join(class_codes(rows, label, first), label, "left")


def decode_classes(rows: DataFrame, codes: DataFrame, label: str, code: str = "code") -> DataFrame:
    """The codes' own labels again."""
    return rows.join(codes.withColumnRenamed("code", code), code, "left")


def inverted(label: Column) -> Column:
    """0 -> 1 and 255 -> 0; anything else is an error."""
    return F.when(label == 0, 1).when(label == 255, 0).otherwise(F.raise_error(F.format_string("label %s is neither 0 nor 255", label.cast("string"))).cast("int"))


def above(value: Column, threshold) -> Column:
    return value >= threshold


def clamped(value: Column, low=0, high=255) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def ids(labels: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels but 0."""
    return labels.where(F.col(label) > 0).select(label).distinct()


def count_values(voxels: DataFrame, value: str, background: bool = True) -> DataFrame:
    """Number of different values, less one for the background."""
    return voxels.agg((F.count_distinct(value) - (1 if background else 0)).alias("n_values"))


def live_seams(planes: DataFrame) -> DataFrame:
    """Seam regions with labels on both planes: (region_id, side in 'a' or 'b', label)."""
    lit = planes.groupBy("region_id").agg(F.count_if((F.col("side") == "a") & (F.col("label") > 0)).alias("na"), F.count_if((F.col("side") == "b") & (F.col("label") > 0)).alias("nb"))
    return lit.where("na > 0 and nb > 0").select("region_id")
