"""Training and scoring pixel, edge and object classifiers with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators import blocks, metrics, stencil, values
from voxloom.plans.durable import durable

#: The most categories that a feature may have.
MAX_CATEGORIES = 32


def assemble(rows: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(rows)


def train_forest(rows: DataFrame, features: str = "features", label: str = "label", trees: int = 500, mtry: int | None = None, depth: int = 10, min_node: int = 1, bootstrap: bool = True, rate: float = 1.0, weight: str | None = None, cutoff: list[float] | None = None, categories: list[int] | None = None, seed: int = 1) -> RandomForestClassificationModel:
    """A random forest; two classes or more, and no missing values, are needed.

    ``categories``: for each feature the number of its categories, coded from 0 and at most 32; 1 for a number.
    Such a feature is split by sets of categories, not by their order.
    """
    if categories is not None:
        rows = rows.withColumn(features, _nominal(features, categories))
    kinds = rows.select(label).distinct().count()
    if kinds < 2:
        raise ValueError("a classifier needs two classes or more")
    subset = "sqrt" if mtry is None else str(mtry)
    forest = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, featureSubsetStrategy=subset, maxDepth=depth, minInstancesPerNode=min_node, bootstrap=bootstrap, subsamplingRate=rate, seed=seed, leafCol="leaves")
    if weight:
        forest = forest.setWeightCol(weight)
    if cutoff:
        forest = forest.setThresholds(cutoff)
    return forest.fit(rows)


def _nominal(features: str, categories: list[int]) -> Column:
    """``features`` with attributes that tell numbers from categories."""
    if min(categories, default=1) < 1:
        raise ValueError("a feature has one category or more")
    if max(categories, default=1) > MAX_CATEGORIES:
        raise ValueError(f"a feature has over {MAX_CATEGORIES} categories")
    named = [(k, c, f"f{k}") for k, c in enumerate(categories)]
    attrs = {
        "numeric": [{"idx": k, "name": n} for k, c, n in named if c == 1],
        "nominal": [{"idx": k, "name": n, "vals": [str(v) for v in range(c)]} for k, c, n in named if c > 1],
    }
    return F.col(features).alias(features, metadata={"ml_attr": {"attrs": {t: a for t, a in attrs.items() if a}, "num_attrs": len(categories)}})


def predict(model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
    """class, votes and probabilities as arrays."""
    out = model.transform(rows)
    return out.withColumns({"votes": vector_to_array("rawPrediction"), "prob": vector_to_array("probability"), "pred": F.col("prediction").cast("int")}).drop("rawPrediction", "probability", "prediction")


def leaves_of(model: RandomForestClassificationModel, rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, leaves): the leaf of every tree."""
    return model.transform(rows).select(*key, F.transform(vector_to_array("leaves"), lambda x: x.cast("int")).alias("leaves"))


def per_tree(model: RandomForestClassificationModel, rows: DataFrame, key: list[str], classes: list | None = None, cutoff: list[float] | None = None) -> DataFrame:
    """(key, tree_classes, votes, called): each tree's class, the trees for each class, and the class with
    the most votes for its ``cutoff`` (even by default; the first of equals). ``classes``: original labels by code."""
    out, names = rows, [f"_tree{k}" for k in range(model.getNumTrees)]
    for tree, name in zip(model.trees, names, strict=True):
        out = tree.setPredictionCol(name).setRawPredictionCol("").setProbabilityCol("").setLeafCol("").transform(out)
    kinds = model.numClasses
    label = (lambda c: F.element_at(F.array(*map(F.lit, classes)), c + 1)) if classes else (lambda c: c)
    out = out.select(*key, F.array(*(F.col(n).cast("int") for n in names)).alias("_t"))
    votes = lambda k: F.size(F.filter("_t", lambda c: c == k))
    out = out.withColumn("votes", F.array(*map(votes, range(kinds))))
    share = F.array(*(F.col("votes")[k] / F.lit(float(cutoff[k] if cutoff else 1 / kinds)) for k in range(kinds)))
    called = (F.array_position(share, F.array_max(share)) - 1).cast("int")
    return out.select(*key, F.transform("_t", label).alias("tree_classes"), "votes", label(called).alias("called"))


def needed(trees: int, least: float) -> int:
    """The least number of trees, one or more, that is a share of ``least``."""
    return max(1, -(-int(least * trees * 1000) // 1000))


def rare_leaves(classes: DataFrame, size: int) -> DataFrame:
    """(class, leaves, ranks, tree, leaf): each class under its ``size`` rarest leaves, by the classes that a leaf holds.

    ``ranks``: the order of the class's leaves, rarest first, as (n, tree, leaf). Two classes that differ in
    fewer than ``size`` trees have one of these in common, whatever the order, as long as it is one for all.
    """
    each = classes.select("class", F.posexplode("leaves").alias("tree", "leaf"))
    n = each.groupBy("tree", "leaf").agg(F.count("*").alias("n"))  # a row a leaf of the forest
    order = F.array_sort(F.collect_list(F.struct("n", "tree", "leaf")))
    ranked = each.join(n, ["tree", "leaf"]).groupBy("class").agg(F.slice(order, 1, size).alias("ranks"))
    return ranked.join(classes, "class").select("class", "leaves", "ranks", F.explode("ranks").alias("_r")).select("class", "leaves", "ranks", "_r.tree", "_r.leaf")


def close_classes(classes: DataFrame, trees: int, need: int) -> DataFrame:
    """(a, b, share): classes (class, leaves) that share a leaf in ``need`` trees or more.

    Classes meet in their rarest leaves only (``rare_leaves``), in tiles of bounded size, so leaves that hold
    most classes are compared only by classes that have no rarer ones. A pair comes out of the first leaf
    that both have among their rarest.
    """
    from voxloom.plans.ship import ship
    from voxloom.plans.tiles import tiled

    ship(classes.sparkSession)
    met = rare_leaves(classes, trees - need + 1)
    met = met.withColumn("first", F.transform("ranks", lambda r: r["tree"])).drop("ranks")
    both = met.withColumn("visits", F.explode(F.array(F.lit(False), F.lit(True))))
    dealt = tiled(both, ["tree", "leaf"], F.col("visits"), F.col("class"), 1024)

    def compare(pdf):
        m, v = pdf[~pdf["visits"]], pdf[pdf["visits"]]
        lm, lv = (np.array(x["leaves"].tolist(), np.int32).reshape(len(x), -1) for x in (m, v))
        fm, fv = (_chosen(x["first"], trees) for x in (m, v))
        im, iv, out, here = m["class"].to_numpy(), v["class"].to_numpy(), [], int(pdf["tree"].iloc[0])
        for at in range(0, len(v), 64):
            same = lv[at : at + 64, None, :] == lm[None, :, :]
            n = same.sum(2)
            i, j = np.nonzero((n >= need) & (iv[at : at + 64, None] < im[None, :]))
            # Trees whose shared leaf both have among their rarest: the same leaf in both, so the least will do.
            common = same[i, j] & fv[at + i] & fm[j]
            own = common.argmax(1) == here
            out.append(pd.DataFrame({"a": iv[at + i[own]], "b": im[j[own]], "share": n[i[own], j[own]] / trees}))
        return pd.concat(out)

    return dealt.groupBy("tree", "leaf", "ta", "tb").applyInPandas(compare, "a bigint, b bigint, share double")


def _chosen(first: pd.Series, trees: int) -> np.ndarray:
    """A row a class: which trees are among its rarest."""
    out = np.zeros((len(first), trees), bool)
    for k, x in enumerate(first):
        out[k, x] = True
    return out


def proximity(model: RandomForestClassificationModel, rows: DataFrame, key: str, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): rows that end in the same leaf of every tree are one class, named by its least key.

    ``pairs`` (a, b, share): classes that share a leaf in at least ``least`` of the trees, as ``close_classes``
    finds them; ``members`` (key, class).
    """
    trees = model.getNumTrees
    members = durable(leaves_of(model, rows, [key]))
    classes = durable(members.groupBy("leaves").agg(F.min(key).cast("bigint").alias("class")))
    return close_classes(classes, trees, needed(trees, least)), members.join(classes, "leaves").select(key, "class")


def gini(model: RandomForestClassificationModel, names: list[str]) -> DataFrame:
    """(feature, gini): importances by the impurity that splits take away."""
    from pyspark.sql import SparkSession

    found = zip(names, (float(x) for x in model.featureImportances.toArray()), strict=True)
    return SparkSession.getActiveSession().createDataFrame([*found], "feature string, gini double")


def permutation_importance(model: RandomForestClassificationModel, rows: DataFrame, names: list[str], key: Column, label: str = "label", times: int = 1) -> DataFrame:
    """(feature, class, loss, sd): accuracy lost when a feature's values trade places, over ``times`` permutations.

    ``class`` null: over all rows. Each row takes the feature from the row next in a random order within a
    hash bucket of bounded size: one shuffle a permutation, no global sort.
    """
    from functools import reduce

    from pyspark.sql import Window

    right = (F.col("prediction") == F.col(label)).cast("double")

    def accuracy(scored: DataFrame) -> DataFrame:
        own = scored.groupBy(F.col(label).cast("int").alias("class")).agg(F.avg(right).alias("acc"))
        return own.unionByName(scored.agg(F.avg(right).alias("acc")).withColumn("class", F.lit(None).cast("int")))

    base = accuracy(model.transform(assemble(rows, names))).withColumnRenamed("acc", "base")
    buckets = max(16, rows.count() // 100_000)
    parts = []
    for k, name in enumerate(names):
        for turn in range(times):
            ring = Window.partitionBy("_part").orderBy("_order")
            moved = rows.withColumns({"_part": F.pmod(F.xxhash64(key, F.lit(k), F.lit(turn)), F.lit(buckets)), "_order": F.xxhash64(key, F.lit(100 + k), F.lit(turn))})
            moved = moved.withColumn(name, F.coalesce(F.lead(name).over(ring), F.first(name).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
            parts.append(accuracy(model.transform(assemble(moved, names))).withColumn("feature", F.lit(name)))
    every = reduce(DataFrame.unionByName, parts)
    lost = every.join(base, every["class"].eqNullSafe(base["class"])).select("feature", every["class"], (F.col("base") - F.col("acc")).alias("loss"))
    return lost.groupBy("feature", "class").agg(F.avg("loss").alias("loss"), F.stddev_pop("loss").alias("sd"))


PIXEL = ["smooth", "gradient", "laplacian", "deviation"]
#: Scales at which the pixel classifier looks at smoothed intensities.
SCALES = (1.0, 1.6)


def scale_names(scales: tuple[float, ...]) -> list[str]:
    return [f"{n}_{str(s).replace('.', '_')}" for s in scales for n in ("smooth", "edge", "log", "tensor1", "tensor2", "hessian1", "hessian2")]


def _slope(f: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Central differences down and right, and the sum of differences to the four neighbours; a missing neighbour is the cell itself."""
    side = []
    for axis, way in ((-2, 1), (-2, -1), (-1, 1), (-1, -1)):
        near, have = np.roll(f, -way, axis), np.roll(there, -way, axis)
        edge = [slice(None)] * f.ndim
        edge[axis] = -1 if way == 1 else 0
        have[tuple(edge)] = False
        side.append(np.where(have, near, f))
    down, up, right, left = side
    return np.where(there, (down - up) / 2, 0), np.where(there, (right - left) / 2, 0), np.where(there, down + up + right + left - 4 * f, 0)


def _deviation(v: np.ndarray, there: np.ndarray, r: int) -> np.ndarray:
    """The population deviation of the cells that exist in the (2r+1)^2 box about each inner cell."""
    mean = np.where(there, v, 0.0).sum((-2, -1), keepdims=True) / np.maximum(there.sum((-2, -1), keepdims=True), 1)
    near, shifts = np.where(there, v - mean, 0.0), [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    n = np.maximum(sum(blocks.shifted(there, r, *o).astype(float) for o in shifts), 1)
    own = sum(blocks.shifted(near, r, *o) for o in shifts) / n
    return np.sqrt(sum(np.where(blocks.shifted(there, r, *o), blocks.shifted(near, r, *o) - own, 0.0) ** 2 for o in shifts) / n)


def _eigen(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The larger and the smaller eigenvalue of [[a, b], [b, c]]."""
    mid, far = (a + c) / 2, np.hypot((a - c) / 2, b)
    return mid + far, mid - far


def pixel_features(voxels: DataFrame, value: str = "v", sigma: float = 1.0, scales: tuple[float, ...] = (), asked: str | None = None) -> DataFrame:
    """(z, y, x, value, smooth, gradient, laplacian, deviation, ...): colour, edge and texture about each voxel.

    At each of ``scales`` (``scale_names``): the Gaussian mean, its gradient's size and its Laplacian, and the eigenvalues, larger first, of
    the structure tensor (Gaussian means of products of gradients) and of the Hessian. All of it comes from one pass over blocks with a halo;
    cells where no voxel is count for nothing, and stand for the voxel itself in a difference. ``asked``: a column that is true
    where features are given; other voxels are only seen.
    """
    r = max(1, round(2 * sigma))
    halo = max([r + 1, *(2 * max(1, round(2 * s)) + 2 for s in scales)])
    names = [*PIXEL, *scale_names(scales)]

    def look(values, there):
        v = values[0]
        gy, gx, lap = _slope(v, there)
        out = [stencil.smoothed(v, there, sigma), np.hypot(gy, gx), lap, np.pad(_deviation(v, there, r), ((0, 0), (r, r), (r, r)))]
        for s in scales:
            weight = stencil.weighted(there.astype(float), s)
            f = stencil.smoothed(v, there, s, weight)
            gy, gx, lap = _slope(f, there)
            (yy, yx, _), (xy, xx, _) = _slope(gy, there), _slope(gx, there)
            out += [f, np.hypot(gy, gx), lap, *_eigen(*(stencil.smoothed(g, there, s, weight) for g in (gy * gy, gy * gx, gx * gx))), *_eigen(yy, (yx + xy) / 2, xx)]
        cells = blocks.inner(there if asked is None else there & (values[1] > 0), halo)
        return cells, [blocks.inner(f, halo)[cells] for f in (v, *out)]

    kind = voxels.schema[value].dataType.simpleString()
    inputs = [value] if asked is None else [value, asked]
    got = blocks.on_stacks(voxels.select("z", "y", "x", *inputs), inputs, halo, look, "z int, y int, x int, " + ", ".join(f"`{c}` double" for c in (value, *names)), max(blocks.BLOCK, 2 * halo))
    return got.withColumn(value, F.col(value).cast(kind))


def train_pixels(voxels: DataFrame, truth: DataFrame, value: str = "v", label: str = "t", trees: int = 20, scales: tuple[float, ...] = SCALES, **how) -> RandomForestClassificationModel:
    """A pixel classifier on features at ``scales``; ``truth`` (z, y, x, label) may be sparse."""
    rows = pixel_features(voxels, value, scales=scales).join(truth.select("z", "y", "x", F.col(label).alias("label")), ["z", "y", "x"])
    # A forest passes over its rows once for each level.
    return train_forest(durable(assemble(rows, [value, *PIXEL, *scale_names(scales)]).select("features", "label")), trees=trees, **how)


def score_pixels(model: RandomForestClassificationModel, voxels: DataFrame, value: str = "v", scales: tuple[float, ...] = SCALES, asked: str | None = None) -> DataFrame:
    """(z, y, x, value, prob array), of the voxels ``asked`` for."""
    return predict(model, assemble(pixel_features(voxels, value, scales=scales, asked=asked), [value, *PIXEL, *scale_names(scales)])).select("z", "y", "x", value, "prob", "pred")


def tile_scorer(model, scale: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    """A function of flattened tiles (rows) that gives the probability of class 1: the layers of a perceptron in numpy, or ``model`` itself if it is one."""
    if not isinstance(model, MultilayerPerceptronClassificationModel):
        if not callable(model):
            raise TypeError("a perceptron or a function of tiles is needed; score_tiles takes any Spark ML classifier")
        return lambda rows: model(rows / scale)
    layers, left = [], model.weights.toArray()
    for n, m in zip(model.getLayers(), model.getLayers()[1:], strict=False):
        layers.append((left[: n * m].reshape(n, m), left[n * m : n * m + m]))
        left = left[n * m + m :]

    def score(rows: np.ndarray) -> np.ndarray:
        x = rows / scale
        for k, (w, b) in enumerate(layers):
            x = x @ w + b
            if k < len(layers) - 1:
                x = 1 / (1 + np.exp(-x))
        x = np.exp(x - x.max(1, keepdims=True))
        return x[:, 1] / x.sum(1)

    return score


def score_blocks(voxels: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], r: int, value: str = "v", band: tuple[float, float] | None = None, whole: bool = False, extent: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(z, y, x, value, p): ``scorer`` on the (2r+1)^2 tile about each voxel, cut and scored in the block's own task.

    Cells of a tile where no voxel is count as 0, as in a dense cutout; so a voxel beside a hole or an edge has a score like any other.
    ``whole``: only voxels with whole tiles are given. Voxels out of ``band`` have no score; those beyond ``extent`` are seen, not given.
    """

    def score(values, there, corner):
        v = blocks.inner(values[0], r)
        cells = blocks.inner(there, r).copy()
        if whole:
            cells &= blocks.row_by_row(blocks.windows(there, r), lambda w: w.all(2))
        z, y, x = blocks.places(cells, r, corner)
        own = v[cells]
        p = np.full(len(own), np.nan)
        asked = np.flatnonzero((own >= band[0]) & (own <= band[1])) if band else np.arange(len(own))
        view, (yy, xx) = blocks.windows(values[0], r), np.nonzero(cells)
        step = max(1, stencil.TILE_CELLS // (2 * r + 1) ** 2)
        for at in range(0, len(asked), step):
            some = asked[at : at + step]
            p[some] = scorer(view[yy[some], xx[some]].reshape(len(some), -1))
        return [z, y, x, own, pd.Series(p).astype(object).where(~np.isnan(p), None)]

    kind = voxels.schema[value].dataType.simpleString()
    out = blocks.on_slices(voxels, [value], r, score, f"z int, y int, x int, {value} double, p double").withColumn(value, F.col(value).cast(kind))
    for a, (lo, hi) in (extent or {}).items():
        out = out.where(F.col(a).between(lo, hi - 1))
    return out


def score_tiles(model, tiles: DataFrame, tile: str = "tile", scale: float = 1.0) -> DataFrame:
    """Any Spark ML classifier on flattened tiles, their values over ``scale``."""
    flat = tiles.withColumn("features", array_to_vector(F.flatten(F.transform(tile, lambda r: F.transform(r, lambda x: x.cast("double") / scale)))))
    return model.transform(flat).withColumn("prob", vector_to_array("probability"))


def edge_values(faces: DataFrame) -> DataFrame:
    """(u, v, m, n): an edge's different values with their faces; of ``faces`` (u, v, m), or (u, v, m, n) to be added up.

    These rows add when regions merge, so every figure of a merged edge follows from them exactly, and an edge
    of many faces is spread over its values.
    """
    n = F.sum("n") if "n" in faces.columns else F.count("*")
    return faces.groupBy("u", "v", "m").agg(n.cast("bigint").alias("n"))


def merged_values(values: DataFrame, merges: DataFrame) -> DataFrame:
    """``edge_values`` of the graph with each ``old`` region become ``new``; faces inside a region are gone."""
    for c in ("u", "v"):
        values = values.join(merges.select(F.col("old").alias(c), F.col("new").alias("_n")), c, "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
    return edge_values(values.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "m", "n"))


def edge_features(faces: DataFrame, bins: int = 25, points: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(u, v, moments, histogram, percentiles, contact, degrees) of each edge of the adjacency graph.

    ``faces`` (u, v, m) as from ``rag.boundary``, or their ``edge_values``. Moments come from power sums about
    the middle of [0, 1]; an edge of one value has none above the mean. Percentiles come from counts up to each value, in
    the order of an edge's values: sorted rows and plain aggregates, no map of values in a row.
    """
    from pyspark.sql import Window

    values = faces if "n" in faces.columns else durable(edge_values(faces))
    n, d = F.col("n"), F.col("m") - 0.5
    edge = Window.partitionBy("u", "v").orderBy("m")
    ranked = values.withColumn("_c", F.sum("n").over(edge)).withColumn("_all", F.sum("n").over(edge.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    at = [(F.col("_all") - 1) * F.lit(float(p)) for p in points]
    # The value of each rank from 0: the least that more than so many faces reach.
    ranks = [F.min(F.when(F.col("_c") > f(a), F.col("m"))).alias(f"_{e}{i}") for i, a in enumerate(at) for e, f in (("lo", F.floor), ("hi", F.ceil))]
    share = lambda test: (F.sum(F.when(test, n).otherwise(0)) / F.sum(n)).cast("double")
    k = F.least(F.floor(F.col("m") * bins), F.lit(bins - 1))
    hist = [share(k == b).alias(f"h{b}") for b in range(bins)]
    over = [share(F.col("m") > p).alias(f"contact{i}") for i, p in enumerate(points)]
    sums = [(F.sum(n * F.pow(d, q)) / F.sum(n)).alias(f"_s{q}") for q in (1, 2, 3, 4)]
    out = ranked.groupBy("u", "v").agg(F.sum(n).cast("double").alias("n"), (F.min("m") == F.max("m")).alias("_one"), *sums, *ranks, *hist, *over)
    s1, s2, s3, s4 = (F.col(f"_s{q}") for q in (1, 2, 3, 4))
    var = F.when(F.col("_one"), 0.0).otherwise(F.greatest(s2 - s1 * s1, F.lit(0.0)))
    out = out.withColumn("_v", var)
    higher = lambda moment: F.when(F.col("_v") > 0, moment).otherwise(0.0)
    skew = higher((s3 - 3 * s1 * s2 + 2 * F.pow(s1, 3)) / F.pow("_v", F.lit(1.5)))
    kurt = higher((s4 - 4 * s1 * s3 + 6 * s1 * s1 * s2 - 3 * F.pow(s1, 4)) / F.pow("_v", F.lit(2.0)) - 3)
    named = [c for c in out.columns if not c.startswith("_") and c not in ("u", "v", "n")]

    def percentile(i: int, p: float) -> Column:
        at, lo, hi = (F.col("n") - 1) * F.lit(float(p)), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    out = out.select("u", "v", "n", (s1 + 0.5).alias("mean"), F.sqrt("_v").alias("std"), skew.alias("skew"), kurt.alias("kurt"), *named, *(percentile(i, p).alias(f"pct{i}") for i, p in enumerate(points)))
    ends = out.select(F.explode(F.array("u", "v")).alias("id"), "n").groupBy("id").agg(F.count("*").cast("double").alias("degree"), F.sum("n").alias("faces"))
    for c in ("u", "v"):
        out = out.join(ends.select(F.col("id").alias(c), F.col("degree").alias(f"degree_{c}"), F.col("faces").alias(f"faces_{c}")), c)
    return out.select("u", "v", *(c for c in out.columns if c not in ("u", "v")))


def edge_table(values: DataFrame, builders: Sequence[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(u, v, features): what each builder makes of the ``edge_values``, side by side.

    A builder takes (u, v, m, n) and gives one row (u, v, its own columns) for each edge; two that name a column
    alike are an error. By default ``edge_features`` alone.
    """
    out = None
    for build in builders or [edge_features]:
        got = build(values)
        if out is not None and (twice := set(out.columns) & set(got.columns) - {"u", "v"}):
            raise ValueError(f"features named twice: {sorted(twice)}")
        out = got if out is None else out.join(got, ["u", "v"])
    return out


def edge_truth(edges: DataFrame, fragments: DataFrame, truth: DataFrame) -> DataFrame:
    """``edges`` with label 1 where both fragments' modal true label is the same.

    ``fragments`` and ``truth``: (z, y, x, label).
    """
    pairs = fragments.select("z", "y", "x", F.col("label").alias("id")).where("id > 0").join(truth.select("z", "y", "x", F.col("label").alias("t")), ["z", "y", "x"])
    own = pairs.groupBy("id").agg(F.mode("t", True).alias("t"))
    out = edges
    for c in ("u", "v"):
        out = out.join(own.select(F.col("id").alias(c), F.col("t").alias(f"_t{c}")), c)
    return out.withColumn("label", (F.col("_tu") == F.col("_tv")).cast("int")).drop("_tu", "_tv")


def object_features(labels: DataFrame, voxels: DataFrame, value: str = "v") -> DataFrame:
    """(label, shape and intensity figures) of every object."""
    both = labels.where("label > 0").join(voxels.select("z", "y", "x", F.col(value).cast("double").alias("_v")), ["z", "y", "x"])
    span = lambda a: (F.max(a) - F.min(a) + 1).cast("double").alias(f"span_{a}")
    return both.groupBy("label").agg(F.count("*").cast("double").alias("area"), span("z"), span("y"), span("x"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("low"), F.max("_v").alias("high"))


OBJECT = ["area", "span_z", "span_y", "span_x", "mean", "std", "low", "high"]


def validation_report(scored: DataFrame, p: str = "p", t: str = "t", thresholds: tuple[float, ...] = (0.5, 0.7)) -> DataFrame:
    """``metrics.performance`` of held-out voxels at each threshold."""
    return metrics.at_thresholds(scored.select(F.col(p).alias("p"), F.col(t).alias("t")), list(thresholds))


encode = values.encode_classes
