"""Stitching segments across block seams, where two label planes face each other.

All seams are matched on the original ids and joined afterwards by connected components, so
the result doesn't depend on the order of seams.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators import regionprops
from voxloom.operators.graph import connected_components
from voxloom.plans.ship import ship


def planes(labels: DataFrame, seams: DataFrame, axis: str) -> DataFrame:
    """(region_id, u, v, a, b): facing labels of each two-thick seam along ``axis``."""
    u, v = (a for a in "zyx" if a != axis)
    box = seams.where(F.col("axis") == axis).select("region_id", F.col(f"{axis}0").alias("_s"), *(f"{q}{k}" for q in (u, v) for k in (0, 1)))
    src = labels.select(F.col(axis).alias("_s"), F.col(u).alias("u"), F.col(v).alias("v"), "label")
    own = (F.col("u") >= F.col(f"{u}0")) & (F.col("u") < F.col(f"{u}1")) & (F.col("v") >= F.col(f"{v}0")) & (F.col("v") < F.col(f"{v}1"))
    a = src.join(box, "_s").where(own).select("region_id", "u", "v", F.col("label").alias("a"))
    b = src.join(box.withColumn("_s", F.col("_s") + 1), "_s").where(own).select("region_id", "u", "v", F.col("label").alias("b"))
    return a.join(b, ["region_id", "u", "v"])


def by_mode(facing: DataFrame, threshold: float = 0.9, ignore_zeros: bool = True) -> DataFrame:
    """(region_id, a, b, score): each a with its modal b where that holds over ``threshold`` of a's overlap."""
    return regionprops.overlap_fraction(facing, ["region_id"], ignore_zeros).where((F.col("score") > threshold) & (F.col("b") > 0)).select("region_id", "a", "b", "score")


def by_dice(facing: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(region_id, src, dst, dice, way): greedy one-to-one merges.

    First each a's modal b, from the least a on, each id used once; then each unused b's modal a
    among what is left. Exact by two window passes: within a pass an id's taker is the least
    that asks for it.
    """
    by = ["region_id"]
    table = regionprops.contingency(facing, by)
    area = lambda c: facing.where(F.col(c) > 0).groupBy("region_id", c).agg(F.count("*").alias(f"n{c}"))
    scored = regionprops.dice(table, area("a"), area("b"), by).where("a <> b")
    good = F.col("dice") >= threshold

    def one_way(rows: DataFrame, of: str, to: str) -> DataFrame:
        first = Window.partitionBy("region_id", to).orderBy(of)
        return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")

    ab = one_way(regionprops.modal(scored_all(scored), by, "a", "b").where(good), "a", "b")
    back = regionprops.modal(scored_all(scored), by, "b", "a").where(good)
    for c in ("a", "b"):  # an id is used up on its own plane
        back = back.join(ab.select("region_id", c).distinct(), ["region_id", c], "left_anti")
    ba = one_way(back, "b", "a")
    both = ab.withColumn("way", F.lit("ab")).unionByName(ba.withColumn("way", F.lit("ba")))
    return both.select("region_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "dice", "way")


def scored_all(scored: DataFrame) -> DataFrame:
    return scored.select("region_id", "a", "b", "n", "dice")


def ncc(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(peak of the normalised cross-correlation of two binary masks, its distance from no shift).

    Two full masks score 1 at 0; another constant mask has no correlation and scores 0. Of tied
    peaks the mean place counts.
    """
    if a.all() and b.all():
        return 1.0, 0.0
    if a.min() == a.max() or b.min() == b.max():
        return 0.0, float("inf")
    shape = [n + m - 1 for n, m in zip(a.shape, b.shape, strict=True)]
    f = lambda m: np.fft.rfft2(m, shape)
    t, x, ones = a.astype(float), b.astype(float), np.ones_like(a, float)
    flip = t[::-1, ::-1]
    local = np.fft.irfft2(f(x) * f(ones), shape)
    square = np.fft.irfft2(f(x * x) * f(ones), shape)
    num = np.fft.irfft2(f(x) * f(flip), shape) - local * t.mean()
    den = np.sqrt(np.maximum(square - local**2 / t.size, 0) * ((t - t.mean()) ** 2).sum())
    score = np.where(den > 1e-9, num / np.maximum(den, 1e-9), 0)
    peak = score.max()
    where = np.argwhere(score >= peak - 1e-9).mean(0)
    return float(peak), float(np.hypot(*(where - (np.array(a.shape) - 1))))


def boxes(facing: DataFrame, size: dict[str, int]) -> DataFrame:
    """(region_id, a, b, u0, u1, v0, v1): the box in which an overlapping pair is compared, as inclusive bounds: from the lesser start of
    both, as far as the larger extent reaches beyond it, that cell included, clipped to the plane. ``size``: cells of the plane by axis."""
    own = lambda c: facing.where(F.col(c) > 0).groupBy("region_id", c).agg(*(x for q in "uv" for x in (F.min(q).alias(f"{c}_{q}"), (F.max(q) - F.min(q) + 1).alias(f"{c}_n{q}"))))
    both = regionprops.contingency(facing, ["region_id"]).join(own("a"), ["region_id", "a"]).join(own("b"), ["region_id", "b"])
    start = {q: F.least(f"a_{q}", f"b_{q}") for q in "uv"}
    end = {q: F.least(start[q] + F.greatest(f"a_n{q}", f"b_n{q}"), F.lit(size[q] - 1)) for q in "uv"}
    return both.select("region_id", "a", "b", *(x.alias(f"{q}{k}") for q in "uv" for k, x in ((0, start[q]), (1, end[q]))))


def frames(seams: DataFrame, axis: str) -> DataFrame:
    """(region_id, u0, u1, v0, v1): each seam's plane along ``axis``, half open."""
    u, v = (a for a in "zyx" if a != axis)
    return seams.where(F.col("axis") == axis).select("region_id", *(F.col(f"{q}{k}").alias(f"{p}{k}") for p, q in (("u", u), ("v", v)) for k in (0, 1)))


def overlap_parts(facing: DataFrame) -> DataFrame:
    """(region_id, part, u, v, a, b): the cells of objects that meet another, by components of the overlap graph.

    Its nodes are a region's objects of either plane; objects that meet nothing belong to no part. Nodes are told
    by 64-bit hashes: two that meet by chance share a part, which changes no match.
    """
    node = lambda side: F.xxhash64("region_id", F.lit(side), F.col(side))
    clean = facing.select("region_id", "u", "v", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in "ab")).where("a > 0 or b > 0")
    met = clean.where("a > 0 and b > 0").select(node("a").alias("src"), node("b").alias("dst")).distinct()
    parts = connected_components(met).select(F.col("node").alias("_node"), F.col("component").alias("part"))
    return clean.withColumn("_node", F.when(F.col("a") > 0, node("a")).otherwise(node("b"))).join(parts, "_node").drop("_node")


def match_part(pdf: pd.DataFrame, overlap: float, distance: float, shape: np.ndarray) -> list[tuple[int, list[int], float, float]]:
    """One part's merges by growing unions: (id, others, score, peak distance), in the order of acceptance.

    ``shape``: the plane's size, at which boxes end. What a merge takes is gone from its own plane: an id of one
    plane may still be met on the other. Objects are kept as cells; a comparison makes masks of its box alone.
    """
    at = pdf[["u", "v"]].to_numpy()
    cells = {c: {int(i): at[rows] for i, rows in pdf.groupby(c).indices.items() if i > 0} for c in "ab"}
    ends = {c: {i: (x.min(0), x.max(0)) for i, x in cells[c].items()} for c in "ab"}
    met: dict[str, dict[int, list]] = {"a": {}, "b": {}}
    for (a, b), n in pdf[(pdf["a"] > 0) & (pdf["b"] > 0)].groupby(["a", "b"]).size().items():
        met["a"].setdefault(int(a), []).append((-int(n), int(b)))
        met["b"].setdefault(int(b), []).append((-int(n), int(a)))
    gone: dict[str, set] = {"a": set(), "b": set()}
    out = []
    for of, to in (("a", "b"), ("b", "a")):
        for i in sorted(met[of].keys() - gone[of]):
            took: list[int] = []
            low, high = None, None
            for _, o in sorted(met[of][i]):
                if o in gone[to]:
                    continue
                took.append(o)
                first, last = ends[to][o]
                low, high = (first, last) if low is None else (np.minimum(low, first), np.maximum(high, last))
                start = np.minimum(low, ends[of][i][0])
                size = np.minimum(np.maximum(high - low, ends[of][i][1] - ends[of][i][0]) + 2, shape - start)
                masks = []
                for parts in ([cells[of][i]], [cells[to][q] for q in took]):
                    mask = np.zeros(size, bool)
                    for x in parts:
                        x = x - start
                        x = x[(x < size).all(1)]
                        mask[x[:, 0], x[:, 1]] = True
                    masks.append(mask)
                score, far = ncc(*masks)
                if score >= overlap and far <= distance:
                    out.append((i, took, score, far))
                    gone[of].add(i)
                    gone[to].update(took)
                    break
    return out


def by_correlation(facing: DataFrame, overlap: float = 0.6, distance: float = 20.0, plane: DataFrame | None = None) -> DataFrame:
    """(region_id, src, dst, score, peak): merges by cross-correlation, one task a component of the overlap graph.

    A merge depends on objects of its own component alone, so components are matched by themselves, whatever the
    seam's size. ``plane``: ``frames`` of the seams, at whose edges boxes end; without it a plane ends at its last
    facing cell. An object that meets itself on the other side uses itself up and needs no merge.
    """
    ship(facing.sparkSession)
    if plane is None:
        plane = facing.groupBy("region_id").agg(F.min("u").alias("u0"), (F.max("u") + 1).alias("u1"), F.min("v").alias("v0"), (F.max("v") + 1).alias("v1"))
    parts = overlap_parts(facing).join(plane, "region_id")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        u0, u1, v0, v1 = (int(pdf[c].iloc[0]) for c in ("u0", "u1", "v0", "v1"))
        own = pdf.assign(u=pdf["u"] - u0, v=pdf["v"] - v0)
        rows = [(pdf["region_id"].iloc[0], min(i, o), max(i, o), s, d) for i, took, s, d in match_part(own, overlap, distance, np.array((u1 - u0, v1 - v0))) for o in took if o != i]
        return pd.DataFrame(rows, columns=["region_id", "src", "dst", "score", "peak"])

    return parts.groupBy("region_id", "part").applyInPandas(one, "region_id bigint, src bigint, dst bigint, score double, peak double")


def in_range(seams: DataFrame, first: int, last: int) -> DataFrame:
    """A job's share of the regions."""
    return seams.where(F.col("region_id").between(first, last))


def status(seams: DataFrame, merges: DataFrame) -> DataFrame:
    """(region_id, merges, status) for every region, merged or not."""
    n = merges.groupBy("region_id").agg(F.count("*").alias("merges"))
    return seams.select("region_id").distinct().join(n, "region_id", "left").fillna(0, ["merges"]).withColumn("status", F.when(F.col("merges") > 0, "merged").otherwise("none"))
