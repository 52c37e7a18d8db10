"""Splitting hot keys of an all-against-all comparison into bounded tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, keys: list[str], visitor: Column, spread: Column, size: int) -> DataFrame:
    """Deal the rows of each key into tiles of about ``size`` members by ``size`` visitors.

    Every (member, visitor) pair of a key meets in exactly one tile (``ta``, ``tb``),
    so a key that holds a large share of all rows becomes many tasks of one size.
    A key without members or without visitors has nothing to compare and gives no rows.
    """
    rows = rows.withColumn("_visitor", visitor).withColumn("_spread", spread)
    n = lambda side: F.ceil(F.count(F.when(F.col("_visitor") == F.lit(side), 1)) / size)
    dims = rows.groupBy(*keys).agg(n(False).alias("_na"), n(True).alias("_nb")).where("_na > 0 and _nb > 0")
    out = rows.join(dims, keys)
    own = F.pmod(F.xxhash64("_spread"), F.when(F.col("_visitor"), F.col("_nb")).otherwise(F.col("_na"))).cast("int")
    others = F.sequence(F.lit(0), (F.when(F.col("_visitor"), F.col("_na")).otherwise(F.col("_nb")) - 1).cast("int"))
    out = out.withColumn("_own", own).withColumn("_other", F.explode(others))
    ta, tb = (F.when(F.col("_visitor"), F.col(x)).otherwise(F.col(y)) for x, y in (("_other", "_own"), ("_own", "_other")))
    return out.withColumn("ta", ta).withColumn("tb", tb).drop("_own", "_other", "_na", "_nb", "_spread")
