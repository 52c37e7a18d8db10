"""Precision and recall of detected objects against true objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.label import components


def object_pr(detected: DataFrame, truth: DataFrame, ny: int, nx: int) -> DataFrame:
    """(tp, fp, fn, precision, recall) of foreground voxels (z, y, x), objects with 18 neighbours.

    True objects are taken in the order of their first voxel; one is found if it touches a
    detection that no earlier one touched. So it is found just if it is the earliest true object
    of some detection: a window's winner, no loop. A detection that touches none is false.
    """
    d = components(detected, 18, ny, nx).withColumnRenamed("label", "d")
    t = components(truth, 18, ny, nx).withColumnRenamed("label", "t")
    touch = d.join(t, ["z", "y", "x"]).select("d", "t").distinct()
    first = touch.withColumn("_n", F.row_number().over(Window.partitionBy("d").orderBy("t"))).where("_n = 1")
    n = lambda rows, c: rows.agg(F.count_distinct(c).alias(f"n_{c}"))
    one = n(first, "t").withColumnRenamed("n_t", "tp").crossJoin(n(touch, "d").withColumnRenamed("n_d", "hit")).crossJoin(n(d, "d")).crossJoin(n(t, "t"))  # one row each
    out = one.select("tp", (F.col("n_d") - F.col("hit")).alias("fp"), (F.col("n_t") - F.col("tp")).alias("fn"))
    return out.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})
