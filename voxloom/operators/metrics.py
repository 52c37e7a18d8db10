"""Metrics, curves and calibration of probabilities ``p`` against truth ``t`` (0 or 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def performance(scored: DataFrame, threshold: float, by: list[str] | None = None, p: str = "p", t: str = "t") -> DataFrame:
    """Counts and rates at a threshold; a rate over nothing is null. ``calibration``: share of true
    voxels with p within 0.05 of the threshold."""
    return _rated(scored.groupBy(*(by or [])).agg(*_counts(threshold, p, t)))


def _counts(threshold: float, p: str, t: str) -> list[Column]:
    hit, true = F.col(p) >= threshold, F.col(t) == 1
    near = (F.col(p) >= threshold - 0.05) & (F.col(p) < threshold + 0.05)
    told = {"tp": hit & true, "tn": ~hit & ~true, "fp": hit & ~true, "fn": ~hit & true}
    return [*(F.count_if(c).alias(n) for n, c in told.items()), F.avg(F.when(near, F.col(t).cast("double"))).alias("calibration")]


def _rated(counts: DataFrame) -> DataFrame:
    rate = lambda a, b: F.try_divide(a, b)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = counts.withColumns({"fallout": rate(fp, fp + tn), "recall": rate(tp, tp + fn), "precision": rate(tp, tp + fp), "specificity": rate(tn, tn + fp), "f1": rate(2 * tp, 2 * tp + fp + fn)})
    return out.withColumn("f1_alt", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def at_thresholds(scored: DataFrame, thresholds: list[float], by: list[str] | None = None, p: str = "p", t: str = "t") -> DataFrame:
    """``performance`` for a short list of thresholds, from one aggregate over one reading of ``scored``."""
    by = by or []
    each = F.array(*(F.struct(F.lit(float(x)).alias("threshold"), *_counts(x, p, t)) for x in thresholds))
    counts = scored.groupBy(*by).agg(each.alias("_each")).select(*by, F.inline("_each"))
    return _rated(counts)


def pr_curve(scored: DataFrame, steps: int = 100, p: str = "p", t: str = "t") -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall) at 0, 1/steps, ..., 1.

    Each voxel falls in one bin, floor(steps * p); sums over the bins from the top give all
    thresholds, so the voxels meet one aggregate rather than every threshold.
    """
    # The nearest thresholds settle what rounding of steps * p might mistake.
    k = F.floor(F.col(p) * steps).cast("int")
    k = F.when((k + 1) / F.lit(float(steps)) <= F.col(p), k + 1).when(k / F.lit(float(steps)) > F.col(p), k - 1).otherwise(k)
    bins = scored.groupBy(F.least(F.greatest(k, F.lit(-1)), F.lit(steps)).alias("k")).agg(F.count_if(F.col(t) == 1).alias("pos"), F.count_if(F.col(t) != 1).alias("neg"))
    spark = scored.sparkSession
    grid = _steps(spark, steps).join(F.broadcast(bins), "k", "left").fillna(0, ["pos", "neg"])
    down = Window.orderBy(F.desc("k"))
    both = Window.partitionBy()
    out = grid.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "all": F.sum("pos").over(both)}).where("k >= 0")
    fn = F.col("all") - F.col("tp")
    return out.select((F.col("k") / F.lit(float(steps))).alias("threshold"), "tp", "fp", fn.alias("fn"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "all").alias("recall"))


def _steps(spark: SparkSession, steps: int) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(-1), F.lit(steps))).alias("k"))


def pareto(curve: DataFrame, digits: int = 3) -> DataFrame:
    """Points with no other of at least their recall and more precision, by recall; rounded first."""
    points = curve.where("precision is not null and recall is not null").select(F.round("precision", digits).alias("precision"), F.round("recall", digits).alias("recall")).distinct()
    best = F.max("precision").over(Window.orderBy(F.desc("recall")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return points.withColumn("_best", best).where("precision >= _best").drop("_best").orderBy("recall")


def calibration(scored: DataFrame, bins: int = 10, by: str = "z", p: str = "p", t: str = "t") -> DataFrame:
    """(by, bin, centre, n, share): the share of true voxels for each bin of p, by slice and in all (null)."""
    k = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    counted = scored.select(by, k.alias("bin"), F.col(t).cast("double").alias("t")).rollup(by, "bin").agg(F.count("*").alias("n"), F.avg("t").alias("share"), F.grouping_id().alias("g"))
    by_slice = counted.where("g = 0")
    total = scored.select(k.alias("bin"), F.col(t).cast("double").alias("t")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("t").alias("share"))
    both = by_slice.select(by, "bin", "n", "share").unionByName(total.select(F.lit(None).cast("int").alias(by), "bin", "n", "share"))
    return both.withColumn("centre", (F.col("bin") + 0.5) / bins)


def calibration_closed(scored: DataFrame, bins: int = 10, by: str = "z", p: str = "p", t: str = "t") -> DataFrame:
    """The other form of ``calibration``: bins are (low, high], and one that nothing falls in has a share of 1.

    All slices have all bins; a p of 0 is in none.
    """
    k = (F.ceil(F.col(p) * bins) - 1).cast("int")
    rows = scored.select(by, k.alias("bin"), F.col(t).cast("double").alias("t")).where(F.col("bin").between(0, bins - 1))
    sums = rows.groupBy(by, "bin").agg(F.count("*").alias("n"), F.sum("t").alias("s"))
    total = sums.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select(F.lit(None).cast("int").alias(by), "bin", "n", "s")
    groups = scored.select(by).distinct().unionByName(total.select(by).limit(0)).union(scored.sparkSession.createDataFrame([(None,)], f"{by} int"))
    frame = groups.select(F.col(by).alias("_by"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    both = sums.unionByName(total)
    out = frame.join(both, frame["_by"].eqNullSafe(both[by]) & (frame["bin"] == both["bin"]), "left")
    return out.select(F.col("_by").alias(by), frame["bin"], F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("s") / F.col("n"), F.lit(1.0)).alias("share"), ((frame["bin"] + 0.5) / bins).alias("centre"))


def cubic_fit(curve: DataFrame, by: list[str], x: str = "centre", y: str = "share") -> DataFrame:
    """Coefficients of y = a x^3 + b x^2 + d x by least squares; null where the bins don't settle them.

    Nine sums in one aggregate, then Cramer's rule.
    """
    s = lambda k: F.sum(F.pow(F.col(x), k)).alias(f"s{k}")
    c = lambda k: F.sum(F.pow(F.col(x), k) * F.col(y)).alias(f"c{k}")
    sums = curve.groupBy(*by).agg(*(s(k) for k in range(2, 7)), *(c(k) for k in range(1, 4)))
    m = [[F.col("s6"), F.col("s5"), F.col("s4")], [F.col("s5"), F.col("s4"), F.col("s3")], [F.col("s4"), F.col("s3"), F.col("s2")]]
    v = [F.col("c3"), F.col("c2"), F.col("c1")]
    det = _det(m)
    solved = {n: F.when(F.abs(det) > 1e-12, _det([[v[r] if k == j else m[r][k] for k in range(3)] for r in range(3)]) / det) for j, n in enumerate("abd")}
    return sums.select(*by, *(e.alias(n) for n, e in solved.items()))


def _det(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def apply_cubic(p: Column, a, b, d, clip: bool = True) -> Column:
    a, b, d = (x if isinstance(x, Column) else F.lit(x) for x in (a, b, d))
    y = ((a * p + b) * p + d) * p
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)) if clip else y


def calibrated(a: float, b: float, d: float, p: str = "p", p_not: str = "p_not"):
    """A post-process for scorers: their rows with ``p`` on the cubic, and ``p_not`` what is left of 1."""
    return lambda rows: rows.withColumn(p, apply_cubic(F.col(p), a, b, d)).withColumn(p_not, 1 - F.col(p))


def coded_errors(p: Column, t: Column, threshold: float, tp: float = 1.0, tn: float = 0.0, fp: float = 0.9, fn: float = 0.5) -> Column:
    hit, true = p >= threshold, t == 1
    return F.when(hit & true, tp).when(~hit & ~true, tn).when(hit, fp).otherwise(fn)
