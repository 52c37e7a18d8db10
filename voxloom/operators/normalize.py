"""Per-slice normalisation and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centred(voxels: DataFrame, value: str = "v", by: str = "z", scale: str = "slice") -> DataFrame:
    """``value`` less its slice's mean, over the largest absolute value of the slice or of all ('global')."""
    return _scaled(less_mean(voxels, value, by), value, by, scale)


def less_mean(voxels: DataFrame, value: str = "v", by: str = "z") -> DataFrame:
    """``value`` less its slice's mean: an aggregate of a row a slice, joined back."""
    means = voxels.groupBy(by).agg(F.avg(value).alias("_mean"))
    return voxels.join(means, by).withColumn(value, F.col(value) - F.col("_mean")).select(*voxels.columns)


def _scaled(rows: DataFrame, value: str, by: str, scale: str) -> DataFrame:
    if scale == "slice":
        out = rows.join(rows.groupBy(by).agg(F.max(F.abs(value)).alias("_top")), by)
    else:
        out = rows.crossJoin(rows.agg(F.max(F.abs(value)).alias("_top")))  # one row
    return out.withColumn(value, F.try_divide(F.col(value), F.col("_top"))).select(*rows.columns)


def log_compressed(v: Column, knee: float = 5.0) -> Column:
    """Beyond +-knee the excess is logarithmic."""
    return F.when(v > knee, knee + F.log(v)).when(v < -knee, -knee - F.log(F.abs(v))).otherwise(v)


def compressed(voxels: DataFrame, value: str = "v", by: str = "z", knee: float = 5.0) -> DataFrame:
    """Log-compress, then scale by the slice's largest absolute value."""
    return _scaled(voxels.withColumn(value, log_compressed(F.col(value), knee)), value, by, "slice")


def slice_summary(voxels: DataFrame, value: str = "v", by: str = "z") -> DataFrame:
    v = F.col(value).cast("double")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = voxels.groupBy(by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.skewness(v).alias("skew"), F.min(v).alias("low"), F.max(v).alias("high"), q.alias("q"), (100 * F.avg((v != 0).cast("double"))).alias("nonzero_percent"))
    return out.select(by, "mean", "std", "skew", "low", "high", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "nonzero_percent")
