"""Near-duplicate embeddings through an inverted multi-index.

Unit vectors are cut in halves; each half has a codebook of its own, fitted by k-means on a
bounded sample (``sample`` rows). The two nearest centroids name a vector's home cell in
the product grid. A vector visits the cells in the order of a lower bound on their distance
(multi-sequence traversal: both halves' cells sorted by bound, a heap over the grid) until
the target recall is reached; then candidates are verified by cosine in double precision. The
bound on a half is the distance to the plane between the home centroid and the other one.
With ``recall`` 1 the traversal goes on to the length of the longest link, and none is missed;
below, to the part of it that a displacement in a random direction takes with that chance.

Rows with equal labels and vectors are one representative with a weight, so copies never
pair up. A cell that holds a large share of the rows is dealt into tiles of bounded size;
a tile gives each vector's links as a sum, and of its links only those that join up new
groups, never all pairs.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null label, link with nothing. Vectors of different length aren't compared. Each row counts
as a vector of its own even if its id repeats. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.simhash import spanning
from voxloom.operators.graph import connected_components
from voxloom.plans.durable import durable
from voxloom.plans.ship import ship
from voxloom.plans.tiles import tiled

COSINE = 0.98
#: Target recall of links as long as the threshold allows; shorter ones fare better. 1 is exact.
RECALL = 0.9999
#: Rows on which the codebooks are fitted at least; they take 16 for each centroid, so 65,536 at most.
SAMPLE = 4096
#: Vectors of a label that a cell holds on average; the codebooks grow with the table.
CELL_ROWS = 32
MAX_CENTROIDS = 4096
TILE = 1024
#: Vectors placed at once; each may go to many cells.
SLICE = 128
#: Distances held at once by the driver while it fits a codebook: 32 MB.
HELD = 1 << 22
#: What rounding may take off a bound.
SLACK = 1e-6


def centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k-means on a sample in memory; distances are taken a block of rows at a time, at most ``HELD`` of them."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    step = max(1, HELD // max(1, k))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([_squares(x[at : at + step], c).argmin(1) for at in range(0, len(x), step)])
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return np.unique(c, axis=0)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rows by centroids: how far a row is, at least, from any point whose nearest centroid that is."""
    d = _squares(x, c)
    home = d.argmin(1)
    gap = np.sqrt(_squares(c[home], c))
    plane = (d - d[np.arange(len(x)), home][:, None]) / (2 * np.where(gap > 0, gap, np.inf))
    plane[np.arange(len(x)), home] = 0
    return np.maximum(plane, 0)


def traverse(a: np.ndarray, b: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells (i, j) in the order of a[i]^2 + b[j]^2, as far as ``limit``."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = (a[ia] ** 2).tolist(), (b[ib] ** 2).tolist()
    heap, out = [(sa[0] + sb[0], 0, 0)], []
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > limit:
            break
        out.append((int(ia[i]), int(ib[j])))
        if j + 1 < len(sb):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(sa):
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
    return out


def reach(recall: float, width: int) -> float:
    """The part of a link's squared length that its crossing of two planes takes, at most, with chance ``recall``.

    The share of a random direction's square that falls on two of n axes is over f with chance
    (1 - f)^(n/2 - 1).
    """
    return 1.0 if recall >= 1 or width <= 2 else 1 - (1 - recall) ** (1 / (width / 2 - 1))


def embedding_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``."""
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"), F.col(label).alias("label"))
    sound = "label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    v = v.withColumn("sound", F.coalesce(F.expr(sound), F.lit(False)))
    # One representative of equal rows, by 128 bits of hash; -0.0 is 0.0.
    plain = F.expr("transform(v, x -> cast(x as double) + 0.0D)")
    rows = v.withColumn("h", F.when(F.col("sound"), F.struct(F.xxhash64("label", plain).alias("a"), F.xxhash64(plain, F.lit(1), "label").alias("b"))))
    reps = rows.where("sound").groupBy("h").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    reps = durable(reps.withColumn("rep", F.monotonically_increasing_id()))
    total, labels, width = reps.agg(F.count("*"), F.approx_count_distinct("label", 0.05), F.max(F.size("v"))).first()
    if not total:
        return v.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    k = int(max(1, min(MAX_CENTROIDS, (total / (cell_rows * max(1, labels))) ** 0.5)))
    picked = _units([_padded(r[0], width) for r in reps.orderBy("h").limit(max(sample, 16 * k)).select("v").collect()])
    half = (width + 1) // 2
    books = spark.sparkContext.broadcast((centroids(picked[:, :half], k), centroids(picked[:, half:], k) if width > 1 else np.zeros((1, 0))))
    limit = (2 - 2 * cosine) * reach(recall, width) + SLACK
    kind = dict(reps.dtypes)["label"]

    def cells(batches):
        import pyarrow as pa

        first, second = books.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rep, weight, lab, vs = (part.column(c) for c in ("rep", "weight", "label", "v"))
                unit = _units([_padded(y, width) for y in vs.to_pylist()])
                a, b = bounds(unit[:, :half], first), bounds(unit[:, half:], second)
                home = (a.argmin(1) * len(second) + b.argmin(1)).tolist()
                rows, cell, visits = [], [], []
                for k, (p, q, h) in enumerate(zip(a, b, home, strict=True)):
                    # Of two vectors in different cells the one in the lower cell visits the other.
                    seen = [c for c in (i * len(second) + j for i, j in traverse(p, q, limit)) if c >= h]
                    rows += [k] * (len(seen) + 1)
                    cell += [h, *seen]
                    visits += [False, *([True] * len(seen))]
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [lab.take(take), pa.array([len(y) for y in vs], pa.int32()).take(take), pa.array(cell, pa.int32()), pa.array([home[k] for k in rows], pa.int32()), rep.take(take), weight.take(take), vs.take(take), pa.array(visits)],
                    names=["label", "dim", "cell", "home", "rep", "weight", "v", "visits"],
                )

    placed = reps.select("rep", "weight", "label", "v").mapInArrow(cells, f"label {kind}, dim int, cell int, home int, rep bigint, weight bigint, v {dict(reps.dtypes)['v']}, visits boolean")
    dealt = tiled(placed, ["label", "dim", "cell"], F.col("visits"), F.col("rep"), TILE)

    def verify(pdf):
        m, w = pdf[~pdf["visits"]], pdf[pdf["visits"]]
        xm, xw = (_units(list(x["v"])) for x in (m, w))
        near = (xw @ xm.T >= cosine) & (w["rep"].to_numpy()[:, None] != m["rep"].to_numpy()[None, :])
        # Within its own cell each pair comes up from both sides.
        near &= (w["home"].to_numpy() != w["cell"].to_numpy())[:, None] | (w["rep"].to_numpy()[:, None] < m["rep"].to_numpy()[None, :])
        rw, rm = w["rep"].to_numpy(), m["rep"].to_numpy()
        out = [(int(r), int(n), int(r)) for r, n in zip(rw, near @ m["weight"].to_numpy(), strict=True) if n]
        out += [(int(r), int(n), int(r)) for r, n in zip(rm, near.T @ w["weight"].to_numpy(), strict=True) if n]
        out += [(a, 0, b) for a, b in spanning(rw, rm, near)]
        return pd.DataFrame(out, columns=["rep", "n", "to"], dtype="int64")

    found = durable(dealt.groupBy("label", "dim", "cell", "ta", "tb").applyInPandas(verify, "rep bigint, n bigint, to bigint"))
    linked = found.where("n > 0").groupBy("rep").agg(F.sum("n").alias("others"))
    parts = connected_components(found.where("n = 0"), "rep", "to").withColumnRenamed("node", "rep")
    graded = reps.select("rep", "h", "weight", "least").join(linked, "rep", "left").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = graded.groupBy("component").agg(F.min("least").alias("component_id"))
    graded = graded.join(least, "component").select("h", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    good = rows.where("sound").select("vec_id", "h").join(graded, "h").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    bad = rows.where("not sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _units(vectors: list) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares don't overflow."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _padded(v, width: int) -> np.ndarray:
    out = np.zeros(width)
    out[: len(v)] = v
    return out
