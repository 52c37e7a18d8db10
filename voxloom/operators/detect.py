"""Detectors as whole jobs over the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import graph, label, metrics, ml, rag, regionprops, regions, reticula, sampling, seam, stencil, values
from voxloom.plans.durable import durable
from voxloom.sources import sinks


def watershed_segments(p: DataFrame, ny: int, nx: int, dilate_xy: int = 11, dilate_z: float = 5, threshold: float = 10, min_size: int = 500, median: int = 4, value: str = "p") -> DataFrame:
    """(z, y, x, label): intensity, median, dilation, markers, watershed, size filter, filling, 1..N."""
    v = durable(stencil.median(p.select("z", "y", "x", values.to_intensity(F.col(value)).alias("v")), median))
    # Markers and the forest both look at it.
    both = durable(v.join(stencil.dilate(v, stencil.ball(dilate_xy, dilate_z), top=255).withColumnRenamed("v", "m"), ["z", "y", "x"])) if dilate_xy else v.withColumn("m", F.col("v"))
    grown = rag.watershed(both, threshold, ny, nx, marker_value="m")
    return label.relabel(label.fill_background(regionprops.size_filter(grown, min_size)))


def find_reticula(voxels: DataFrame, ny: int, nx: int, channel: str = "axoplasmicReticula", author: str = "detector", resolution: int = 1) -> tuple[DataFrame, DataFrame]:
    """(labelled voxels, object rows)."""
    painted = label.components(reticula.detect(voxels), 26, ny, nx)
    return painted, sinks.object_rows(regionprops.regionprops(painted), channel, "organelle", author, resolution)


def classify_blocks(voxels: DataFrame, grid: DataFrame, span: dict[str, int], pad: dict[str, int], extent: dict[str, tuple[int, int]], model) -> DataFrame:
    """Grid, padded cutouts, pixel scores by block, pads off again: (z, y, x, p).

    A pixel's features lie within its slice, so a block's pad on z would be scored for nothing, and is left out. Blocks of one place on y and x
    are a column; columns are kept apart on z, so that neighbours in other blocks aren't seen. Pads are seen, not scored.
    """
    cut = regions.in_regions(voxels, regions.padded(grid, {**pad, "z": 0}, extent), span)
    (low, high), wide = extent["z"], -(-(extent["x"][1] - extent["x"][0]) // span["x"])
    deep = max(1, high - low)
    column = F.floor((F.col("y0") - extent["y"][0]) / span["y"]) * wide + F.floor((F.col("x0") - extent["x"][0]) / span["x"])
    own = F.col("y").between(F.col("y0"), F.col("y1") - 1) & F.col("x").between(F.col("x0"), F.col("x1") - 1)
    placed = cut.join(grid.select("region_id", "y0", "y1", "x0", "x1"), "region_id").select((column * deep + F.col("z") - low).cast("int").alias("z"), "y", "x", "v", own.cast("int").alias("own"))
    scored = ml.score_pixels(model, placed, asked="own")
    return scored.select((F.col("z") % deep + low).cast("int").alias("z"), "y", "x", F.col("prob")[1].alias("p"))


def detect_and_classify(voxels: DataFrame, p: DataFrame, truth: DataFrame, ny: int, nx: int, threshold: float = 0.7, low: int = 5, trees: int = 10) -> DataFrame:
    """Objects of a probability map, each called target or clutter by a forest on object features.

    ``truth`` (z, y, x, t): an object is a target if most of its voxels are.
    """
    found = durable(label.detect_objects(p, ny, nx, threshold=threshold, low=low))
    feats = ml.object_features(found, voxels)
    own = found.join(truth.select("z", "y", "x", "t"), ["z", "y", "x"]).groupBy("label").agg((F.avg("t") >= 0.5).cast("int").alias("target"))
    rows = durable(ml.assemble(feats.join(own, "label"), ml.OBJECT).select("label", "features", "target"))
    if rows.select("target").distinct().count() < 2:
        called = rows.select("label", "target")
    else:
        model = ml.train_forest(rows, label="target", trees=trees, depth=4)
        called = ml.predict(model, rows).select("label", F.col("pred").alias("target"))
    return found.join(called, "label").select("z", "y", "x", "label", "target")


def agglomerated(labels: DataFrame, p: DataFrame, threshold: float = 0.5, priority: Callable | None = None) -> DataFrame:
    """Fragments merged while their mean boundary lies under the threshold; labels 1..N."""
    labels = durable(labels)  # neighbours meet by a join of the volume with itself, and the result is painted on it
    both = durable(labels.join(p.select("z", "y", "x", "p"), ["z", "y", "x"]))
    return rag.segmentation(labels, rag.agglomerate(rag.rag(both), threshold, priority))


#: Of edge values to features of edges (``ml.edge_table``).
Builders = Sequence[Callable[[DataFrame], DataFrame]]


def train_policy(fragments: DataFrame, p: DataFrame, truth: DataFrame, trees: int = 20, builders: Builders | None = None):
    """(model, feature names): a forest on the edges' features, merge or not by the true labels."""
    faces = rag.boundary(fragments.join(p.select("z", "y", "x", "p"), ["z", "y", "x"]))
    table = ml.edge_table(durable(ml.edge_values(faces)), builders)
    names = [c for c in table.columns if c not in ("u", "v")]
    rows = ml.edge_truth(table, fragments, truth)
    # A forest passes over its rows a few times before the first level.
    rows = durable(ml.assemble(rows.withColumn("label", 1 - F.col("label")), names).select("features", "label"))
    return ml.train_forest(rows, trees=trees, depth=6), names


def learned_agglomeration(fragments: DataFrame, p: DataFrame, model, names: list[str], threshold: float = 0.5, builders: Builders | None = None) -> DataFrame:
    """(node, component): score the edges, contract the mutual best, take features anew, until no edge is under ``threshold``.

    Voxels are read once: the edges' values are kept as rows that add when regions merge (``ml.merged_values``), and every
    round's features come from them. ``builders``: those that the policy was trained with.
    """
    now, total = durable(ml.edge_values(rag.boundary(fragments.join(p.select("z", "y", "x", "p"), ["z", "y", "x"])))), None
    while True:
        feats = ml.assemble(ml.edge_table(now, builders), names)
        scored = ml.predict(model, feats).select("u", "v", F.lit(1).cast("bigint").alias("n"), F.col("prob")[1].alias("s"))
        step = durable(rag.agglomerate(durable(scored), threshold, once=True))
        total = step if total is None else durable(total.join(step.select(F.col("node").alias("component"), F.col("component").alias("_n")), "component", "left").select("node", F.coalesce("_n", "component").alias("component")))
        moved = step.where("node <> component").select(F.col("node").alias("old"), F.col("component").alias("new"))
        if moved.isEmpty():
            break
        now = durable(ml.merged_values(now, moved))
    return total


def merge_blocks(labels: DataFrame, seams: DataFrame, axis: str = "z", how: str = "dice", threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(merges as (node, component), relabelled volume): seams matched on the original ids, joined to a fixpoint,
    applied. ``graph.pieces`` makes lists of the merges."""
    facing = seam.planes(labels, seams, axis)
    if how == "dice":
        found = seam.by_dice(facing, threshold).select("src", "dst")
    elif how == "mode":
        found = seam.by_mode(facing, threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    else:
        found = seam.by_correlation(facing, threshold).select("src", "dst")
    parts = durable(graph.connected_components(found))
    return parts, label.mapped(labels, parts.select(F.col("node").alias("old"), F.col("component").alias("new")))


#: Slices of the training variants.
VARIANTS = {"full": None, "50": 50, "10": 10}


def train_from_volumes(voxels: DataFrame, p: DataFrame, truth: DataFrame, ny: int, nx: int, variant: str = "full", flat: bool = False, trees: int = 20, **how):
    """(model, feature names): data preparation, fragments by watershed (``flat``: slice by slice) and the policy learned from the truth.

    ``variant``: all slices, or the first 50 or 10.
    """
    first = VARIANTS[variant]
    part = (lambda df: df) if first is None else (lambda df: df.where(F.col("z") < first))
    v = part(p).select("z", "y", "x", values.to_intensity(F.col("p")).alias("v"))
    if flat:
        # Slices that are two apart have no neighbours.
        apart = v.withColumn("z", F.col("z") * 2)
        fragments = rag.watershed(apart, how.get("threshold", 60), ny, nx).withColumn("z", (F.col("z") / 2).cast("int"))
    else:
        fragments = rag.watershed(v, how.get("threshold", 60), ny, nx)
    return train_policy(durable(fragments), part(p), part(truth), trees=trees)


def score_volume(voxels: DataFrame, model, border: int, extent: dict[str, tuple[int, int]], band: tuple[int, int], path: str, truth: DataFrame | None = None, r: int = 2, postprocess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The whole membrane job: scores, saved slice by slice as 1 - p under ``path``, and metrics against ``truth`` if there is one."""
    scored = durable(score_membranes(voxels, model, border, extent, band, r, postprocess))
    sinks.save_slices(sinks.rescaled_slices(scored.select("z", "y", "x", (1 - F.col("p")).alias("v")), rescale=False), path)
    return scored if truth is None else metrics.performance(scored.select("z", "y", "x", "p").join(truth.select("z", "y", "x", "t"), ["z", "y", "x"]), 0.5, ["z"])


#: Intensities are divided by this before a perceptron sees them, in training and in scoring.
SCALE = 255.0


def score_membranes(voxels: DataFrame, model, border: int, extent: dict[str, tuple[int, int]], band: tuple[int, int], r: int = 2, postprocess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(z, y, x, v, p, p_not): pad, mask, tiles about what the mask leaves, scores, overrides, pad off.

    Blocks cut and score their own tiles. The cheap mask comes before both; what it leaves out gets the override's value, so every voxel
    has a score. Holes count as 0. ``model``: a perceptron, or a function of flattened tiles over ``SCALE``.
    ``postprocess`` takes the finished rows and gives as many, with the same columns (``metrics.calibrated``, say).
    """
    if border < r:
        raise ValueError("the border must be as wide as a tile reaches")
    padded = stencil.mirrored(voxels.select("z", "y", "x", "v"), border, extent)
    scored = ml.score_blocks(padded, ml.tile_scorer(model, SCALE), r, band=band, extent={a: extent[a] for a in ("y", "x")})
    told = values.override_trivial(scored, "v", *band)
    return told if postprocess is None else postprocess(told)


def train_tiles(voxels: DataFrame, truth: DataFrame, r: int = 2, iterations: int = 20, sampler: Callable[[DataFrame], DataFrame] | None = None):
    """A perceptron on flattened tiles.

    ``sampler`` chooses their centres: of (z, y, x, t, v) it gives the rows to train on, at least with (z, y, x, t).
    By default as many of each class as the rarest has.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    known = truth.select("z", "y", "x", "t")
    if sampler is None:
        chosen = durable(sampling.balanced(known, "t"))
    else:
        # A sampler counts, ranks and cuts in passes of its own.
        chosen = durable(sampler(durable(known.join(voxels.select("z", "y", "x", "v"), ["z", "y", "x"]))).select("z", "y", "x", "t"))
    cut = stencil.tiles(voxels, r, centres=chosen).join(chosen.select("z", "y", "x", F.col("t").alias("label")), ["z", "y", "x"])
    flat = F.flatten(F.transform("tile", lambda row: F.transform(row, lambda x: x.cast("double") / SCALE)))
    rows = durable(cut.select(array_to_vector(flat).alias("features"), F.col("label").cast("double").alias("label")))
    return MultilayerPerceptronClassifier(layers=[(2 * r + 1) ** 2, 8, 2], maxIter=iterations, seed=1).fit(rows)

