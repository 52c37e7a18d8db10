"""Region adjacency, agglomeration by contraction rounds, and marker-controlled watershed."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import blocks
from voxloom.operators.graph import connected_components
from voxloom.operators.label import components, half_offsets, mapped, neighbours, numbered, relabel
from voxloom.plans.durable import durable
from voxloom.plans.ship import ship

#: Edges of a part of an adjacency graph that one task merges.
PART_EDGES = 200_000

#: Voxels of a block that grows its own part of a forest.
FOREST_BLOCK = (16, 64, 64)


def boundary(voxels: DataFrame, label: str = "label", value: str = "p", connectivity: int = 6) -> DataFrame:
    """(u, v, m): one row for each face between two labels, m the mean of the two values."""
    faces = neighbours(voxels.select("z", "y", "x", label, value).where(F.col(label) > 0), connectivity, [label, value])
    faces = faces.where(F.col(f"a_{label}") != F.col(f"b_{label}"))
    return faces.select(F.least(f"a_{label}", f"b_{label}").alias("u"), F.greatest(f"a_{label}", f"b_{label}").alias("v"), ((F.col(f"a_{value}") + F.col(f"b_{value}")) / 2).alias("m"))


def rag(voxels: DataFrame, label: str = "label", value: str = "p") -> DataFrame:
    """(u, v, n, s): the region adjacency graph with each edge's faces and their sum."""
    return boundary(voxels, label, value).groupBy("u", "v").agg(F.count("*").alias("n"), F.sum("m").alias("s"))


def agglomerate(edges: DataFrame, threshold: float, priority: Callable[[DataFrame], DataFrame] | None = None, max_rounds: int | None = None, once: bool = False, part_edges: int = PART_EDGES) -> DataFrame:
    """(node, component) of the regions merged while some edge's priority is under ``threshold``.

    Mutual nearest neighbours merge: two regions whose least edges are each other's. The mean is reducible, so any order of such merges
    gives what merging the least edge again and again gives, up to ties. So parts of the graph of about ``part_edges`` edges merge all they can in one task
    (``merged_in_part``), however long a chain of merges is, and a round over the whole graph does what crosses parts; the graph that
    is left is parted anew, until one part holds it.
    With another ``priority`` (adds column ``w``) there are rounds alone, and it is an approximation.
    The least edge of all is always mutual, so rounds go on until no edge is left under the
    threshold; if ``max_rounds`` are given and don't suffice, that is an error. ``once``: one round alone.
    """
    score = priority or (lambda e: e.withColumn("w", F.col("s") / F.col("n")))
    extra = [c for c in edges.columns if c not in ("u", "v")]
    in_parts = priority is None and not once
    # Edges come from a pass over the volume, and the nodes are asked for again at the end.
    edges = now = durable(edges)
    joined = None

    def apply(step: DataFrame) -> None:
        nonlocal now, joined
        joined = step if joined is None else durable(joined.join(step.select(F.col("old").alias("new"), F.col("new").alias("_n")), "new", "left").select("old", F.coalesce("_n", "new").alias("new")).union(step))
        moved = now
        for c in ("u", "v"):
            moved = moved.join(step.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        moved = moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), *extra)
        now = durable(moved.groupBy("u", "v").agg(*(F.sum(c).alias(c) for c in extra)))

    for done in count():
        whole = False
        if in_parts:
            step, whole = _merged_in_parts(now, threshold, part_edges)
            step = durable(step)
            if not step.isEmpty():
                apply(step)
        if whole:
            break
        step = durable(_mutual(score(now).where(F.col("w") < threshold)))
        if step.isEmpty():
            break
        if done == max_rounds:
            raise RuntimeError(f"edges under the threshold are left after {max_rounds} rounds")
        apply(step)
        if once:
            break
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if joined is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(joined.withColumnRenamed("old", "node"), "node", "left").select("node", F.coalesce("new", "node").alias("component"))


def _mutual(scored: DataFrame) -> DataFrame:
    """(old, new): pairs whose least edges are each other's. They share no region, so no mapping meets another."""
    ends = scored.select(F.col("u").alias("node"), F.col("v").alias("other"), "w").union(scored.select("v", "u", "w"))
    key = F.struct("w", F.least("node", "other").alias("lo"), F.greatest("node", "other").alias("hi"))
    best = ends.groupBy("node").agg(F.min(key).alias("k"))
    pairs = best.groupBy(F.col("k.lo").alias("lo"), F.col("k.hi").alias("hi")).agg(F.count("*").alias("asks")).where("asks = 2")
    return pairs.select(F.col("hi").alias("old"), F.col("lo").alias("new"))


def _merged_in_parts(edges: DataFrame, threshold: float, most: int) -> tuple[DataFrame, bool]:
    """(old, new) of what parts merge by themselves, and whether one part held the whole graph.

    Parts are ranges of ids, as near regions mostly have near ids. A region with more than ``most`` edges belongs to no part.
    """
    total = edges.count()
    if total <= most:
        dealt = edges.select("u", "v", "n", "s", F.lit(0).cast("bigint").alias("part"), F.lit(True).alias("in_u"), F.lit(True).alias("in_v"))
    else:
        degrees = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("d")).where(F.col("d") <= most)
        ranks = numbered(degrees.select("node"), ["node"])
        each = max(1, degrees.count() * most // (2 * total))
        parts = durable(ranks.select("node", F.floor((F.col("_n") - 1) / each).alias("part")))
        of = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"p{c}"))
        met = edges.select("u", "v", "n", "s").join(of("u"), "u", "left").join(of("v"), "v", "left")
        groups = F.array_distinct(F.filter(F.array("pu", "pv"), lambda p: p.isNotNull()))
        met = met.withColumn("part", F.explode(groups))
        here = lambda c: F.coalesce(F.col(c) == F.col("part"), F.lit(False))
        dealt = met.select("u", "v", "n", "s", "part", here("pu").alias("in_u"), here("pv").alias("in_v"))
    ship(edges.sparkSession)
    merge = lambda pdf: merged_in_part(pdf, threshold)
    return dealt.groupBy("part").applyInPandas(merge, "old bigint, new bigint"), total <= most


def merged_in_part(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(old, new): merges of mutual nearest neighbours among the regions of a part, all of whose edges are known.

    Edges are taken in order of their means. If both ends are the part's own and free, they merge, and their edges add up. Else the ends are held: what is
    nearest to them lies outside, or is held itself. Merges elsewhere can only raise the mean of an edge that leads out, so a held region is held rightly or waits for the next round.
    """
    inside = {*pdf["u"][pdf["in_u"]].tolist(), *pdf["v"][pdf["in_v"]].tolist()}
    near: dict[int, dict[int, tuple]] = {}
    heap = []
    for u, v, n, s in zip(pdf["u"].tolist(), pdf["v"].tolist(), pdf["n"].tolist(), pdf["s"].tolist(), strict=True):
        near.setdefault(u, {})[v] = near.setdefault(v, {})[u] = (n, s)
        heap.append((s / n, u, v))
    heapq.heapify(heap)
    into, held = {}, set()
    while heap:
        w, u, v = heapq.heappop(heap)
        if w >= threshold:
            break
        have = near.get(u, {}).get(v)
        if have is None or have[1] / have[0] != w:
            continue  # an edge that has been merged or has a new mean
        if u not in inside or v not in inside or u in held or v in held:
            held.update(x for x in (u, v) if x in inside)
            continue
        lo, hi = min(u, v), max(u, v)
        into[hi] = lo
        del near[lo][hi], near[hi][lo]
        for x, (n, s) in near.pop(hi).items():
            del near[x][hi]
            if x in near[lo]:
                n, s = n + near[lo][x][0], s + near[lo][x][1]
            near[lo][x] = near[x][lo] = (n, s)
            heapq.heappush(heap, (s / n, min(lo, x), max(lo, x)))
    out = []
    for old in into:
        new = into[old]
        while new in into:
            new = into[new]
        out.append((old, new))
    return pd.DataFrame(out, columns=["old", "new"], dtype="int64")


def segmentation(labels: DataFrame, merged: DataFrame, label: str = "label") -> DataFrame:
    """The merged volume, labels 1..N."""
    return relabel(mapped(labels, merged.select(F.col("node").alias("old"), F.col("component").alias("new")), label), label)


def watershed(voxels: DataFrame, low: float, ny: int, nx: int, value: str = "v", marker_value: str | None = None, flat: bool = False, size: tuple[int, int, int] = FOREST_BLOCK) -> DataFrame:
    """(z, y, x, label): regions grown from markers, the components of voxels under ``low``.

    A minimum spanning forest rooted at the markers (Cousty et al. 2009): an edge between
    neighbours weighs the larger of their values; rounds of least edges join voxels and trees
    until all hang on a marker. No ridge lines; ties go by weight, then by the pair's indices.
    Voxels that no path joins to a marker are 0.

    Blocks grow their own part of the forest (``grown_in_block``). What goes on globally are the trees that reach out of a
    block, and for each pair of trees their least edge.
    """
    markers = components(voxels.where(F.col(marker_value or value) < low), 8 if flat else 26, ny, nx)
    at = voxels.select("z", "y", "x", F.col(value).cast("double").alias("v"), (F.col("z").cast("bigint") * ny * nx + F.col("x") * ny + F.col("y")).alias("i"))
    # Trees have ids: a marker's is negative, so that it is the least of any union; another's is its least voxel's.
    marked = at.join(markers.select("z", "y", "x", F.col("label").alias("m")), ["z", "y", "x"], "left").select("z", "y", "x", "i", "v", F.coalesce(-F.col("m"), F.col("i")).alias("t"))
    offsets = half_offsets(8 if flat else 26)
    halo = (0 if flat else 1, 1, 1)
    made = durable(blocks.on_boxes(marked, ["i", "v", "t"], halo, lambda pdf, own: grown_in_block(pdf, own, offsets), FOREST, (1, *size[1:]) if flat else size))
    leaf = made.where("i is not null").select("z", "y", "x", "i", "t")
    inside, across = made.where("i is null and q is null"), made.where("q is not null")
    key = F.struct("w", "lo", "hi").alias("k")
    edges = inside.select("u", F.col("t").alias("v"), key).union(across.join(leaf.select(F.col("i").alias("q"), F.col("t").alias("far")), "q").select("u", "far", key))
    edges = edges.where("u <> v and not (u < 0 and v < 0)").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("k").alias("k"))
    edges = durable(edges)
    # Only trees that go on are followed through the rounds.
    open_ = edges.select(F.explode(F.array("u", "v")).alias("t0")).where("t0 >= 0").distinct()
    tree = durable(open_.withColumn("t", F.col("t0")))
    while True:  # every round joins each tree without a marker to another, or finds none left
        ends = edges.select(F.col("u").alias("node"), "u", "v", "k").union(edges.select("v", "u", "v", "k"))
        # Trees without a marker reach out along their least edge; keys are all different, so no cycle forms.
        best = ends.where("node >= 0").groupBy("node").agg(F.min(F.struct("k", "u", "v")).alias("e")).select("node", "e.u", "e.v", "e.k")
        best = durable(best)
        if best.isEmpty():
            break
        step = durable(_rooted(best))
        tree = durable(_moved(tree, step, "t"))
        edges = _moved(_moved(edges, step, "u"), step, "v").where("u <> v and not (u < 0 and v < 0)")
        edges = durable(edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("k").alias("k")))
    # Most voxels hang on a marker already.
    settled = leaf.where("t < 0").select("z", "y", "x", "t")
    rest = leaf.where("t >= 0").withColumnRenamed("t", "t0").join(tree, "t0", "left").select("z", "y", "x", F.coalesce("t", "t0").alias("t"))
    return settled.union(rest).select("z", "y", "x", F.when(F.col("t") < 0, -F.col("t")).otherwise(0).cast("bigint").alias("label"))


#: Rows of a block's forest. A voxel: z, y, x, i and its tree t. An edge: trees u and t inside, or u and a voxel q of another block; its key is (w, lo, hi).
FOREST = "z int, y int, x int, i bigint, t bigint, u bigint, q bigint, w double, lo bigint, hi bigint"


def grown_in_block(pdf: pd.DataFrame, own: np.ndarray, offsets: list[tuple[int, int, int]]) -> pd.DataFrame:
    """The part of the forest that a block can tell: its trees, and the edges that go on.

    With a halo of one voxel a block knows every edge of its own voxels. A tree without a marker joins along its least edge,
    as in any round, wherever that edge leads to a voxel of the block or to a marker; if it leads to a voxel of
    another block, the tree waits. When all wait or hang on markers, each pair of trees keeps its least edge.
    """
    pdf = pdf.reset_index(drop=True)
    i, v, t = pdf["i"].to_numpy(np.int64), pdf["v"].to_numpy(float), pdf["t"].to_numpy(np.int64)
    places = [pdf[a].to_numpy(np.int64) for a in "zyx"]
    corner = [int(c.min()) - 1 for c in places]
    at = [c - o for c, o in zip(places, corner, strict=True)]
    grid = np.full([int(c.max()) + 2 for c in at], -1, np.int64)
    grid[tuple(at)] = np.arange(len(i))
    ends = []
    for o in offsets:
        far = grid[tuple(c + d for c, d in zip(at, o, strict=True))]
        have = np.flatnonzero(far >= 0)
        ends.append(np.stack([have, far[have]]))
    a, b = np.concatenate(ends, 1)
    seen = own[a] | own[b]
    a, b = a[seen], b[seen]
    w, lo, hi = np.maximum(v[a], v[b]), np.minimum(i[a], i[b]), np.maximum(i[a], i[b])
    order = np.lexsort((hi, lo, w))
    # Each edge is told by the block of its first voxel, if it leads out.
    told = own[a][order]
    a, b, w, lo, hi = (c[order] for c in (a, b, w, lo, hi))

    ids, node = np.unique(t, return_inverse=True)
    rooted = ids < 0
    outside = np.zeros(len(ids), bool)
    outside[node[~own & (t >= 0)]] = True
    root = np.arange(len(ids))  # ids ascend, so the least of a union is its marker, or its least voxel
    none = len(a)
    live = np.arange(none)
    while True:
        ra, rb = root[node[a[live]]], root[node[b[live]]]
        on = (ra != rb) & ~(rooted[ra] & rooted[rb])
        live, ra, rb = live[on], ra[on], rb[on]
        best = np.full(len(ids), none, np.int64)
        for r in (ra, rb):
            # Edges are in order, so the first of a tree is its least.
            first = np.unique(r, return_index=True)
            np.minimum.at(best, first[0], live[first[1]])
        asks = np.flatnonzero((best < none) & ~rooted & ~outside & (root == np.arange(len(ids))))
        e = best[asks]
        ea, eb = root[node[a[e]]], root[node[b[e]]]
        inside = ~(outside[ea] | outside[eb])
        if not inside.any():
            break
        up = blocks.least_roots(len(ids), np.stack([ea[inside], eb[inside]]))
        root = up[root]
    ra, rb = root[node[a[live]]], root[node[b[live]]]
    leads_out = outside[ra] | outside[rb]
    # An edge that leads out ends at a voxel of another block; its tree is that block's to tell.
    a_, b_, out_a = a[live], b[live], outside[ra]
    u = np.where(out_a, ids[rb], ids[ra])
    q = np.where(leads_out, np.where(out_a, i[a_], i[b_]), -1)
    other = np.where(leads_out, 0, np.where(out_a, ids[ra], ids[rb]))
    keep = ~(outside[ra] & outside[rb]) & (~leads_out | told[live])
    u, q, other, k = u[keep], q[keep], other[keep], live[keep]
    lone = q < 0
    u, other = np.where(lone, np.minimum(u, other), u), np.where(lone, np.maximum(u, other), other)
    # The first of each pair, in order, is its least.
    pair = np.unique(np.stack([u, q, other]), axis=1, return_index=True)[1]
    u, q, other, k = u[pair], q[pair], other[pair], k[pair]
    n, m = int(own.sum()), len(k)
    voxel = np.r_[np.ones(n, bool), np.zeros(m, bool)]
    first = lambda c: np.r_[c, np.zeros(m, c.dtype)]
    last = lambda c: np.r_[np.zeros(n, c.dtype), c]
    where = lambda c, there: pd.Series(c).astype("Int64").where(there)
    return pd.DataFrame({
        "z": where(first(places[0][own]), voxel).astype("Int32"), "y": where(first(places[1][own]), voxel).astype("Int32"), "x": where(first(places[2][own]), voxel).astype("Int32"),
        "i": where(first(i[own]), voxel), "t": pd.Series(np.r_[ids[root[node[own]]], other]).astype("Int64"), "u": where(last(u), ~voxel), "q": where(last(q), ~voxel & (last(q) >= 0)),
        "w": pd.Series(last(w[k])).where(~voxel), "lo": where(last(lo[k]), ~voxel), "hi": where(last(hi[k]), ~voxel),
    })


def _rooted(chosen: DataFrame) -> DataFrame:
    """(old, new) of a round: every union of chosen edges gets one id, its marker's if it holds one.

    Each tree chose one edge, so a union holds one marker at most: along the chosen edges keys
    fall, and end at a marker or at a pair that chose each other.
    """
    found = connected_components(chosen.select("u", "v"), "u", "v")
    return found.where("node <> component").select(F.col("node").alias("old"), F.col("component").alias("new"))


def _moved(rows: DataFrame, step: DataFrame, c: str) -> DataFrame:
    return rows.join(step.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
