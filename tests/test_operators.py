"""Operators that SQL can't express, against brute force on small volumes."""

import re
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import scalars
from voxloom.operators import blocks, detect, graph, label, metrics, ml, objects, rag, regionprops, regions, reticula, sampling, seam, stencil
from voxloom.plans.durable import durable
from voxloom.sources import sinks, volumes

RNG = np.random.default_rng(5)


def frame(spark, cube, name="v", kind="double", keep=lambda v: True):
    cast = {"double": float, "bigint": int, "int": int}[kind]
    rows = [(int(z), int(y), int(x), cast(cube[z, y, x])) for z, y, x in np.ndindex(cube.shape) if keep(cube[z, y, x])]
    return spark.createDataFrame(rows, f"z int, y int, x int, {name} {kind}")


def cube_of(df, shape, name="label", fill=0):
    out = np.full(shape, fill, float)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = r[name]
    return out


def neighbours(shape, at, near):
    for d in product((-1, 0, 1), repeat=3):
        q = tuple(a + b for a, b in zip(at, d, strict=True))
        if d != (0, 0, 0) and near(d) and all(0 <= a < n for a, n in zip(q, shape, strict=True)):
            yield q


def flood(mask, near):
    out, n = np.zeros(mask.shape, int), 0
    order = sorted(zip(*np.nonzero(mask), strict=True), key=lambda p: (p[0], p[2], p[1]))
    for p in order:
        if out[p]:
            continue
        n += 1
        todo = [p]
        out[p] = n
        while todo:
            for q in neighbours(mask.shape, todo.pop(), near):
                if mask[q] and not out[q]:
                    out[q] = n
                    todo.append(q)
    return out


@pytest.mark.parametrize(("connectivity", "near"), [(26, lambda d: True), (18, lambda d: sum(map(abs, d)) <= 2), (6, lambda d: sum(map(abs, d)) == 1), (4, lambda d: d[0] == 0 and sum(map(abs, d)) == 1)])
def test_components(spark, connectivity, near):
    mask = RNG.random((3, 8, 9)) < 0.3
    got = label.components(frame(spark, mask, "m", "int", bool), connectivity, 8, 9)
    assert (cube_of(got, mask.shape) == flood(mask, near)).all()


def test_components_of_nothing(spark):
    empty = spark.createDataFrame([], "z int, y int, x int")
    assert label.components(empty, 26, 5, 5).count() == 0
    assert graph.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_connected_components_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7000, 7000), (None, 5)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(chain, "src bigint, dst bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100), 7000: 7000}


def test_consolidate_is_idempotent(spark):
    sets = spark.createDataFrame([([1, 2],), ([2, 3],), ([9],), ([],), (None,), ([7, 8],)], "members array<bigint>")
    once = graph.consolidate(sets)
    want = {1: [1, 2, 3], 7: [7, 8]}
    assert {r["root"]: r["members"] for r in once.collect()} == want
    assert {r["root"]: r["members"] for r in graph.consolidate(once).collect()} == want


@pytest.mark.parametrize("size", [2, 7, 65_536])
def test_large_sets_come_in_pieces(spark, tmp_path, size):
    giant = [(k, 5) for k in np.random.default_rng(8).permutation(range(5, 3000)).tolist()]
    small = [(10_000 + 3 * k + j, 10_000 + 3 * k) for k in range(40) for j in range(3)]
    found = spark.createDataFrame([*giant, *small, (90_000, 90_000)], "node bigint, component bigint")
    once = durable(graph.pieces(found, size))
    rows = sorted(tuple(r) for r in once.collect())
    assert max(len(m) for _, _, m in rows) == min(size, 2995)
    got = {}
    for root, part, members in rows:
        held = got.setdefault(root, [])
        assert (part, members) == (len(held) // size, sorted(members))  # parts are full but for the last
        held += members
    assert got == {5: [*range(5, 3000)], **{10_000 + 3 * k: [10_000 + 3 * k + j for j in range(3)] for k in range(40)}}
    # Pieces of a set hang together by their key.
    assert sorted(tuple(r) for r in graph.consolidate(once, key="root", size=size).collect()) == rows
    sinks.write_merge_list(once, str(tmp_path / "list"))
    lines = [r["value"].split(",") for r in spark.read.text(str(tmp_path / "list")).collect()]
    assert max(map(len, lines)) <= min(size, 2995) + 1
    assert {(r["new"], r["old"]) for r in sinks.read_merge_list(spark, str(tmp_path / "list")).collect()} == {(r, m) for r, held in got.items() for m in held if m != r}


def test_pieces_of_nothing(spark):
    assert graph.pieces(spark.createDataFrame([], "node bigint, component bigint")).count() == 0
    with pytest.raises(ValueError, match="two members"):
        graph.pieces(spark.createDataFrame([(1, 1)], "node bigint, component bigint"), 1)


@pytest.mark.parametrize("span", [16, 64, 1 << 16])
def test_voxels_as_runs(spark, span):
    cube = np.random.default_rng(9).integers(0, 3, (4, 6, 9))
    cube[1] = 2  # a label that fills a slice
    voxels = frame(spark, cube, "label", "bigint")
    rows = regionprops.voxel_runs(voxels.union(voxels.where("label = 1")), 6, 9, span=span)
    index = lambda z, y, x: z * 54 + x * 6 + y
    want = set()
    for lab in (1, 2):
        held = sorted(index(*map(int, p)) for p in np.argwhere(cube == lab))
        starts = [i for i in held if i - 1 not in held or i % span == 0]
        want |= {(lab, i // span, i, next(n for n in range(1, 300) if i + n not in held or (i + n) % span == 0)) for i in starts}
    assert {tuple(r) for r in rows.collect()} == want
    sets = regionprops.voxel_sets(rows)
    assert all(r["n"] == sum(x["length"] for x in r["runs"]) and len(r["runs"]) <= -(-span // 2) and r["runs"] == sorted(r["runs"]) for r in sets.collect())
    back = regionprops.voxels_of(sets, 6, 9).select("z", "y", "x", "label").collect()
    assert sorted(tuple(r) for r in back) == sorted(tuple(r) for r in voxels.where("label > 0").collect())
    assert {r["label"]: r["pixel_sum"] for r in regionprops.index_sums(rows).collect()} == {lab: sum(index(*map(int, p)) for p in np.argwhere(cube == lab)) for lab in (1, 2)}


def test_fill_background(spark):
    cube = np.where(RNG.random((2, 10, 10)) < 0.05, RNG.integers(1, 9, (2, 10, 10)), 0)
    cube[1] = 0
    want = cube.copy()
    while True:
        now = want.copy()
        for z, y, x in zip(*np.nonzero(want == 0), strict=True):
            best = [want[z, y + dy, x + dx] for _, dy, dx in stencil.disk(3) if 0 <= y + dy < 10 and 0 <= x + dx < 10]
            now[z, y, x] = max(best)
        if (now == want).all():
            break
        want = now
    assert (cube_of(label.fill_background(frame(spark, cube, "label", "bigint")), cube.shape) == want).all()


def test_filling_moves_the_front_alone(spark, monkeypatch):
    """Each round sends only what the last one labelled."""
    cube = np.zeros((2, 12, 40), int)
    cube[0, :, :2], cube[0, 3, 30], cube[1, 5, 20] = 4, 9, 2
    sent = []
    was = stencil.gathered
    monkeypatch.setattr(stencil, "gathered", lambda voxels, *a, **k: sent.append(voxels.count()) or was(voxels, *a, **k))
    got = cube_of(label.fill_background(frame(spark, cube, "label", "bigint")), cube.shape)
    want = cube.copy()
    while (want == 0).any():
        now = want.copy()
        for z, y, x in zip(*np.nonzero(want == 0), strict=True):
            now[z, y, x] = max(want[z, y + dy, x + dx] for _, dy, dx in stencil.disk(3) if 0 <= y + dy < 12 and 0 <= x + dx < 40)
        want = now
    assert (got == want).all()
    assert sum(sent) <= cube.size  # a voxel travels once


def features_by_hand(cube, there, sigma, scales):
    """The pixel features, one voxel at a time."""
    z_, ny, nx = cube.shape
    have = lambda z, y, x: 0 <= y < ny and 0 <= x < nx and there[z, y, x]

    def smooth(f, s):
        r, out = max(1, round(2 * s)), np.zeros(cube.shape)
        for z, y, x in np.ndindex(cube.shape):
            near = [(f[z, y + dy, x + dx], np.exp(-(dy * dy + dx * dx) / (2 * s * s))) for _, dy, dx in stencil.box(r) if have(z, y + dy, x + dx)]
            out[z, y, x] = sum(v * w for v, w in near) / sum(w for _, w in near) if near else 0
        return out

    def around(f, p, dy, dx):
        z, y, x = p
        return f[z, y + dy, x + dx] if have(z, y + dy, x + dx) else f[p]

    def every(fn):
        return np.array([fn(p) if there[p] else 0.0 for p in np.ndindex(cube.shape)]).reshape(cube.shape)

    def slope(f):
        return every(lambda p: (around(f, p, 1, 0) - around(f, p, -1, 0)) / 2), every(lambda p: (around(f, p, 0, 1) - around(f, p, 0, -1)) / 2)

    def laplacian(f):
        return every(lambda p: sum(around(f, p, *o) for o in ((1, 0), (-1, 0), (0, 1), (0, -1))) - 4 * f[p])

    def eigen(a, b, c):
        both = np.linalg.eigvalsh(np.stack([np.stack([a, b], -1), np.stack([b, c], -1)], -1))
        return both[..., 1], both[..., 0]

    cube = np.where(there, cube, 0).astype(float)
    gy, gx = slope(cube)
    r = max(1, round(2 * sigma))
    spread = every(lambda p: np.std([cube[p[0], p[1] + dy, p[2] + dx] for _, dy, dx in stencil.box(r) if have(p[0], p[1] + dy, p[2] + dx)]))
    out = {"smooth": smooth(cube, sigma), "gradient": np.hypot(gy, gx), "laplacian": laplacian(cube), "deviation": spread}
    for s in scales:
        f, k = smooth(cube, s), str(s).replace(".", "_")
        gy, gx = slope(f)
        out |= {f"smooth_{k}": f, f"edge_{k}": np.hypot(gy, gx), f"log_{k}": laplacian(f)}
        out[f"tensor1_{k}"], out[f"tensor2_{k}"] = eigen(smooth(gy * gy, s), smooth(gy * gx, s), smooth(gx * gx, s))
        (yy, yx), (xy, xx) = slope(gy), slope(gx)
        out[f"hessian1_{k}"], out[f"hessian2_{k}"] = eigen(yy, (yx + xy) / 2, xx)
    return out


@pytest.mark.parametrize("size", [6, 128])
def test_pixel_features(spark, monkeypatch, size):
    monkeypatch.setattr(blocks.on_slices, "__defaults__", (size,))
    cube, there = holed((2, 11, 13))
    scales = (1.0, 1.6)
    want = features_by_hand(cube, there, 1.0, scales)
    got = ml.pixel_features(with_holes(spark, cube, there), scales=scales)
    assert got.columns == ["z", "y", "x", "v", *ml.PIXEL, *ml.scale_names(scales)]
    rows = got.collect()
    assert {(r["z"], r["y"], r["x"]) for r in rows} == set(zip(*np.nonzero(there), strict=True))
    for name, f in want.items():
        assert [r[name] for r in rows] == pytest.approx([f[r["z"], r["y"], r["x"]] for r in rows], abs=1e-6), name


def test_visible_regions(spark):
    cube = RNG.integers(0, 2, (1, 9, 9))
    got = stencil.visible_regions(frame(spark, cube, "label", "int"), 2, 0).collect()
    assert len(got) == 25
    for r in got:
        tile = cube[r["z"], r["y"] - 2 : r["y"] + 3, r["x"] - 2 : r["x"] + 3] != 0
        assert r["n_regions"] == flood(tile[None], lambda d: d[0] == 0 and sum(map(abs, d)) == 1).max()


def test_median_and_compat_contrast(spark):
    cube = RNG.integers(0, 255, (1, 7, 8))
    padded = np.pad(cube[0], 1)
    got = cube_of(stencil.median(frame(spark, cube, "v", "int"), 1), cube.shape, "v")
    assert all(got[0, y, x] == np.median(padded[y : y + 3, x : x + 3]) for y in range(7) for x in range(8))
    one = {(r["y"], r["x"]): r["v"] for r in stencil.local_contrast(frame(spark, cube), 3, compat=True).collect()}
    around = np.delete(cube[0, 1:4, 2:5].ravel(), 4)
    assert one[2, 3] == pytest.approx(cube[0, 1, 2] / around.std())


def greedy(edges, threshold):
    """Merge the least mean again and again."""
    e = {k: list(v) for k, v in edges.items()}
    root = {n: n for k in edges for n in k}
    while True:
        best = min(((s / n, k) for k, (n, s) in e.items()), default=None)
        if not best or best[0] >= threshold:
            return root
        lo, hi = best[1]
        for k, r in root.items():
            if r == hi:
                root[k] = lo
        new = {}
        for (u, v), (n, s) in e.items():
            u, v = (lo if q == hi else q for q in (u, v))
            if u != v:
                got = new.setdefault((min(u, v), max(u, v)), [0, 0.0])
                got[0] += n
                got[1] += s
        e = new


def same_partition(a, b):
    return len(set(a.items())) == len(a) and len({(a[k], b[k]) for k in a}) == len(set(a.values())) == len(set(b.values()))


def test_agglomerate_equals_greedy(spark):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        edges = {}
        for _ in range(60):
            u, v = sorted(rng.choice(25, 2, replace=False))
            edges[int(u), int(v)] = [int(rng.integers(1, 9)), float(rng.random() * 5)]
        df = spark.createDataFrame([(u, v, n, s) for (u, v), (n, s) in edges.items()], "u bigint, v bigint, n bigint, s double")
        got = {r["node"]: r["component"] for r in rag.agglomerate(df, 0.6).collect()}
        assert same_partition(got, greedy(edges, 0.6))


def test_round_bounds_raise(spark):
    """On a path of rising priorities only one pair is mutual in a round; a bound that cuts the work short is an error."""
    path = spark.createDataFrame([(k, k + 1, 1, 0.1 * k) for k in range(4)], "u bigint, v bigint, n bigint, s double")
    with pytest.raises(RuntimeError):
        rag.agglomerate(path, 0.6, max_rounds=2, part_edges=0)
    assert {r["component"] for r in rag.agglomerate(path, 0.6, max_rounds=4, part_edges=0).collect()} == {0}
    line = np.zeros((1, 1, 20), int)
    line[0, 0, 0] = 5
    with pytest.raises(RuntimeError):
        label.fill_background(frame(spark, line, "label", "bigint"), max_rounds=2)
    assert (cube_of(label.fill_background(frame(spark, line, "label", "bigint"), max_rounds=7), line.shape) == 5).all()


def test_learned_agglomeration_goes_on_to_the_threshold(spark, monkeypatch):
    """Scores that rise along a row of fragments: one merge a round, more rounds than three."""
    row = np.repeat(np.arange(1, 8), 2).reshape(1, 1, 14)
    p = np.repeat(np.arange(7), 2).reshape(1, 1, 14) / 100
    monkeypatch.setattr(detect.ml, "assemble", lambda table, names: table)
    monkeypatch.setattr(detect.ml, "edge_features", lambda faces: faces.groupBy("u", "v").agg(F.avg("m").alias("m")))
    monkeypatch.setattr(detect.ml, "predict", lambda model, rows: rows.withColumn("prob", F.array(1 - F.col("m"), F.col("m"))))
    got = detect.learned_agglomeration(frame(spark, row, "label", "bigint"), frame(spark, p, "p", "double"), None, ["m"]).collect()
    assert {r["node"]: r["component"] for r in got} == dict.fromkeys(range(1, 8), 1)


def test_edge_features_by_hand(spark):
    """Moments, shares and percentiles against numpy; the same from faces, from values, and from merged values."""
    rng = np.random.default_rng(6)
    faces = [(int(u), int(u + k), float(m)) for u in (1, 2, 3) for k in (1, 2) for m in rng.choice([0.0, 0.1, 0.13, 0.5, 0.52, 0.9, 0.97, 1.0], rng.integers(1, 30))]
    faces += [(8, 9, 0.3)] * 5
    df = spark.createDataFrame(faces, "u bigint, v bigint, m double")

    def check(got, faces):
        got = {(r["u"], r["v"]): r for r in got.collect()}
        assert got.keys() == {f[:2] for f in faces}
        for edge, r in got.items():
            m = np.array([f[2] for f in faces if f[:2] == edge])
            d, var = m - m.mean(), m.var() if len(set(m)) > 1 else 0
            high = [(d**3).mean() / var**1.5, (d**4).mean() / var**2 - 3] if var else [0, 0]
            assert [r["n"], r["mean"], r["std"], r["skew"], r["kurt"]] == pytest.approx([len(m), m.mean(), np.sqrt(var), *high], abs=1e-7)
            assert [r[f"h{b}"] for b in range(25)] == pytest.approx(list(np.bincount(np.minimum((m * 25).astype(int), 24), minlength=25) / len(m)))
            assert [r[f"pct{i}"] for i in range(3)] == pytest.approx(list(np.percentile(m, [10, 50, 90])))
            assert [r[f"contact{i}"] for i in range(3)] == pytest.approx([(m > t).mean() for t in (0.1, 0.5, 0.9)])
            assert r["degree_u"] == len({f[:2] for f in faces if edge[0] in f[:2]})
            assert r["faces_v"] == sum(edge[1] in f[:2] for f in faces)

    check(ml.edge_features(df), faces)
    values = ml.edge_values(df)
    assert values.count() == len(set(faces))
    check(ml.edge_features(values), faces)
    to = {3: 1, 4: 1, 9: 8}
    merges = spark.createDataFrame([*to.items()], "old bigint, new bigint")
    moved = [(to.get(u, u), to.get(v, v), m) for u, v, m in faces]
    check(ml.edge_features(ml.merged_values(values, merges)), [(min(u, v), max(u, v), m) for u, v, m in moved if u != v])


def test_learned_agglomeration_reads_voxels_once(spark, monkeypatch):
    """The same as features taken from all voxels in every round."""
    rng = np.random.default_rng(17)
    cube = np.kron(rng.permutation(np.arange(1, 28)).reshape(3, 3, 3), np.ones((1, 3, 3), int))
    p = np.round(rng.random(cube.shape), 2)
    fragments, scores = frame(spark, cube, "label", "bigint"), frame(spark, p, "p", "double")
    truth = fragments.withColumn("label", F.floor(F.col("label") / 9).cast("bigint"))
    model, names = detect.train_policy(fragments, scores, truth, trees=5)
    now, want = fragments, {int(i): int(i) for i in np.unique(cube)}
    for rounds in range(1, 30):
        feats = ml.assemble(ml.edge_features(rag.boundary(now.join(scores, ["z", "y", "x"]))), names)
        step = rag.agglomerate(ml.predict(model, feats).select("u", "v", F.lit(1).cast("bigint").alias("n"), F.col("prob")[1].alias("s")), 0.5, once=True)
        moved = {r["node"]: r["component"] for r in step.where("node <> component").collect()}
        if not moved:
            break
        want = {i: moved.get(c, c) for i, c in want.items()}
        now = frame(spark, np.vectorize(want.get)(cube), "label", "bigint")
    assert rounds > 2
    reads, real = [], rag.boundary
    monkeypatch.setattr(detect.rag, "boundary", lambda *a, **k: reads.append(1) or real(*a, **k))
    got = detect.learned_agglomeration(fragments, scores, model, names)
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert len(reads) == 1


def test_watershed_is_a_minimum_spanning_forest(spark):
    cube = RNG.permutation(6 * 7).reshape(1, 6, 7)
    mask = cube < 6
    markers = flood(mask, lambda d: d[0] == 0)
    got = cube_of(rag.watershed(frame(spark, cube, "v", "int"), 6, 6, 7, flat=True), cube.shape)
    # Kruskal rooted at the markers, with the same order of edges.
    at = lambda p: p[0] * 42 + p[2] * 6 + p[1]
    edges = sorted({(max(cube[p], cube[q]), min(at(p), at(q)), max(at(p), at(q))) for p in np.ndindex(cube.shape) for q in neighbours(cube.shape, p, lambda d: d[0] == 0)})
    tree = {at(p): (-markers[p] if markers[p] else at(p)) for p in np.ndindex(cube.shape)}
    for _, p, q in edges:
        a, b = tree[p], tree[q]
        if a != b and not (a < 0 and b < 0):
            for k, t in tree.items():
                if t == max(a, b):
                    tree[k] = min(a, b)
    want = np.array([-tree[at(p)] for p in np.ndindex(cube.shape)]).reshape(cube.shape)
    assert (got == want).all()
    assert (got[mask] == markers[mask]).all()


def kruskal(cube, there, markers, ny, nx, near):
    """A minimum spanning forest rooted at the markers, edges in one order."""
    at = lambda p: p[0] * ny * nx + p[2] * ny + p[1]
    nodes = [p for p in np.ndindex(cube.shape) if there[p]]
    edges = sorted({(max(cube[p], cube[q]), min(at(p), at(q)), max(at(p), at(q))) for p in nodes for q in neighbours(cube.shape, p, near) if there[q]})
    tree = {at(p): (-markers[p] if markers[p] else at(p)) for p in nodes}
    for _, p, q in edges:
        a, b = tree[p], tree[q]
        if a != b and not (a < 0 and b < 0):
            for k, t in tree.items():
                if t == max(a, b):
                    tree[k] = min(a, b)
    return {p: max(0, -tree[at(p)]) for p in nodes}


@pytest.mark.parametrize("size", [(2, 3, 4), (1, 5, 5), (16, 64, 64)])
@pytest.mark.parametrize("flat", [False, True])
def test_watershed_in_blocks(spark, size, flat):
    """The forest doesn't depend on the blocks: ties in weight, holes, and parts without a marker."""
    cube, there = RNG.integers(0, 9, (3, 9, 10)), RNG.random((3, 9, 10)) >= 0.1
    cube[:, :, 4:6] = RNG.integers(3, 9, (3, 9, 2))
    there[:, :, 7] = False
    near = (lambda d: d[0] == 0) if flat else (lambda d: True)
    cube[:, :, 8:] += 2  # beyond the gap nothing is under the threshold
    markers = flood((cube < 2) & there, near)
    got = {(r["z"], r["y"], r["x"]): r["label"] for r in rag.watershed(with_holes(spark, cube, there), 2, 9, 10, flat=flat, size=size).collect()}
    assert got == kruskal(cube, there, markers, 9, 10, near)
    assert 0 in got.values()


def test_ncc():
    a = RNG.random((7, 9)) < 0.4
    assert seam.ncc(a, a) == pytest.approx((1.0, 0.0), abs=1e-9)
    assert seam.ncc(np.ones((3, 3), bool), np.ones((3, 3), bool)) == (1.0, 0.0)
    assert seam.ncc(np.ones((3, 3), bool), a[:3, :3])[0] == 0
    big = np.zeros((12, 12), bool)
    big[3:6, 4:8] = True
    score, far = seam.ncc(big, np.roll(big, (2, 1), (0, 1)))
    assert score > 0.5
    assert far == pytest.approx(np.hypot(2, 1), abs=1e-6)


def slow_ncc(t, x):
    """The correlation at every shift, from its definition."""
    if t.all() and x.all():
        return 1.0, 0.0
    if t.min() == t.max() or x.min() == x.max():
        return 0.0, np.inf
    (h, w), best = t.shape, []
    padded = np.zeros((3 * h - 2, 3 * w - 2))
    padded[h - 1 : 2 * h - 1, w - 1 : 2 * w - 1] = x
    d = t - t.mean()
    for dy, dx in product(range(2 * h - 1), range(2 * w - 1)):
        part = padded[dy : dy + h, dx : dx + w]
        e = part - part.mean()
        norm = np.sqrt((d**2).sum() * (e**2).sum())
        best.append((round((d * e).sum() / norm, 9) if norm > 1e-9 else 0.0, dy - h + 1, dx - w + 1))
    top = max(best)[0]
    return top, float(np.hypot(*np.mean([b[1:] for b in best if b[0] == top], 0)))


def sequential_correlation(a, b, overlap, distance):
    """Each id of one plane in turn grows a union on the other; both planes lose what a merge takes."""
    planes, out = [a.copy(), b.copy()], []
    for of in (0, 1):
        for i in [x for x in np.unique(planes[of]) if x]:
            mine, other = planes[of] == i, planes[1 - of]
            met = [x for x in other[mine] if x]
            order = sorted(set(met), key=lambda x, met=met: (-met.count(x), x))
            for k in range(1, len(order) + 1):
                grown = np.isin(other, order[:k])
                y0, x0 = (min(np.nonzero(m.any(1 - ax))[0].min() for m in (mine, grown)) for ax in (0, 1))
                ny, nx = (max(np.ptp(np.nonzero(m.any(1 - ax))[0]) + 1 for m in (mine, grown)) for ax in (0, 1))
                box = np.s_[y0 : y0 + ny + 1, x0 : x0 + nx + 1]
                score, far = slow_ncc(mine[box].astype(float), grown[box].astype(float))
                if score >= overlap and far <= distance:
                    out += [(min(i, o), max(i, o)) for o in order[:k] if o != i]
                    planes[of][mine] = 0
                    other[grown] = 0
                    break
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_correlation_equals_sequential(spark, seed):
    rng = np.random.default_rng(seed)
    a = np.kron(rng.integers(0, 6, (4, 4)), np.ones((3, 3), int))
    b = np.roll(np.where(a > 0, a + rng.integers(0, 2) * 3, 0), rng.integers(0, 2, 2), (0, 1))
    b[rng.random(b.shape) < 0.1] = 4  # ids of both planes, too
    rows = [(1, int(u), int(v), int(a[u, v]), int(b[u, v])) for u, v in np.ndindex(a.shape)]
    df = spark.createDataFrame(rows, "region_id bigint, u int, v int, a bigint, b bigint")
    for overlap, distance in ((0.6, 20.0), (0.3, 2.0)):
        got = sorted((r["src"], r["dst"]) for r in seam.by_correlation(df, overlap, distance).collect())
        assert got == sequential_correlation(a, b, overlap, distance)


def test_correlation_keeps_ids_apart_by_plane(spark):
    rows = [(1, u, v, 1 if v < 5 else 7, 7 if v < 5 else 9) for u in range(6) for v in range(10)]
    got = seam.by_correlation(spark.createDataFrame(rows, "region_id bigint, u int, v int, a bigint, b bigint")).collect()
    assert sorted((r["src"], r["dst"]) for r in got) == [(1, 7), (7, 9)]


@pytest.mark.parametrize("seed", range(3))
def test_correlation_of_planes_with_holes(spark, seed):
    """Only labelled cells are given, and none at the plane's edge: boxes still end there, not at the last cell."""
    rng = np.random.default_rng(seed + 40)
    rows, want = [], []
    for region in range(12):
        a, b = (np.kron(rng.integers(0, 4, (4, 4)), np.ones((2, 2), int)) for _ in "ab")
        b = np.where(rng.random(b.shape) < 0.6, a, b)
        a[-2:], b[-2:], a[:, -1:], b[:, -1:] = 0, 0, 0, 0
        rows += [(region, int(u) + 5, int(v) + 9, int(a[u, v]), int(b[u, v]) or None) for u, v in np.ndindex(a.shape) if a[u, v] or b[u, v]]
        want += [(region, *m) for m in sequential_correlation(a, b, 0.5, 4.0)]
    df = spark.createDataFrame(rows, "region_id bigint, u int, v int, a bigint, b bigint")
    plane = spark.range(12).select(F.col("id").alias("region_id"), *(F.lit(x).alias(n) for n, x in (("u0", 5), ("u1", 13), ("v0", 9), ("v1", 17))))
    got = seam.by_correlation(df, 0.5, 4.0, plane)
    assert sorted((r["region_id"], r["src"], r["dst"]) for r in got.collect()) == sorted(want)
    assert want


def test_seams_part_by_overlap(spark):
    """Objects that don't meet, even by way of others, are matched in parts of their own; a lone one in none."""
    rows = [(1, 0, v, 1 + v // 4, 1 + v // 4) for v in range(40)] + [(1, 1, v, 99, 0) for v in range(3)] + [(2, 0, 0, 1, 1)]
    parts = seam.overlap_parts(spark.createDataFrame(rows, "region_id bigint, u int, v int, a bigint, b bigint"))
    got = parts.groupBy("region_id", "part").agg(F.countDistinct("a").alias("a"), F.count("*").alias("n")).collect()
    assert sorted((r["region_id"], r["a"], r["n"]) for r in got) == [(1, 1, 4)] * 10 + [(2, 1, 1)]
    assert seam.by_correlation(spark.createDataFrame([], "region_id bigint, u int, v int, a bigint, b bigint")).count() == 0


def test_components_across_blocks(spark, monkeypatch):
    mask = RNG.random((5, 11, 13)) < 0.35
    small = (2, 3, 4)
    monkeypatch.setattr(blocks.components, "__defaults__", (small,))
    monkeypatch.setattr(blocks.on_faces, "__defaults__", (small,))
    for connectivity, near in ((26, lambda d: True), (6, lambda d: sum(map(abs, d)) == 1)):
        got = label.components(frame(spark, mask, "m", "int", bool), connectivity, 11, 13)
        assert (cube_of(got, mask.shape) == flood(mask, near)).all()


@pytest.mark.parametrize("size", [4, 128])
def test_stencils_across_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(blocks.by_slice, "__defaults__", (None, size))
    cube = RNG.integers(0, 255, (2, 13, 17))
    df = frame(spark, cube, "v", "int")
    padded = np.pad(cube, ((0, 0), (2, 2), (2, 2)))
    want = np.array([[[np.median(padded[z, y : y + 5, x : x + 5]) for x in range(17)] for y in range(13)] for z in range(2)])
    assert (cube_of(stencil.median(df, 2), cube.shape, "v") == want).all()
    low = np.pad(cube.astype(float), ((0, 0), (2, 2), (2, 2)), constant_values=-np.inf)
    ball = stencil.ball(2, 7.0)
    want = np.array([[[max(low[z, y + 2 + o[1], x + 2 + o[2]] + o[3] for o in ball) for x in range(17)] for y in range(13)] for z in range(2)])
    assert np.allclose(cube_of(stencil.dilate(df, ball), cube.shape, "v"), want)


def test_numbered_ranks_in_ranges(spark):
    ids = [int(x) for x in RNG.permutation(3000)[:1000]]
    df = spark.createDataFrame([(i,) for i in ids], "label bigint").repartition(7)
    got = {r["label"]: r["_n"] for r in label.numbered(df, ["label"]).collect()}
    assert got == {x: k for k, x in enumerate(sorted(ids), 1)}


def test_long_chain_agglomerates(spark):
    edges = spark.createDataFrame([(k, k + 1, 1, k * 37 % 101 / 200) for k in range(100)], "u bigint, v bigint, n bigint, s double")
    assert {r["component"] for r in rag.agglomerate(edges, 0.9).collect()} == {0}


@pytest.mark.parametrize("part", [12, 40, 200_000])
def test_parts_agglomerate_as_greedy_does(spark, part):
    """Parts of any size, with regions of more edges than a part, merge what the least edges give."""
    rng = np.random.default_rng(9)
    edges = {}
    for k in range(30):
        for j in {*rng.integers(0, 30, 2).tolist(), (k + 1) % 30, 7}:
            if j != k:
                n = int(rng.integers(1, 9))
                edges[min(j, k), max(j, k)] = (n, float(n * rng.random()))
    df = spark.createDataFrame([(*k, *x) for k, x in edges.items()], "u bigint, v bigint, n bigint, s double")
    got = {r["node"]: r["component"] for r in rag.agglomerate(df, 0.5, part_edges=part).collect()}
    assert got == greedy(edges, 0.5)
    assert 1 < len(set(got.values())) < len(got)


def test_rising_chain_takes_few_rounds(spark, monkeypatch):
    """10,000 regions, each merged only after the one before: no round of the whole graph, or few where parts are small."""
    rounds = []
    was = rag._mutual
    monkeypatch.setattr(rag, "_mutual", lambda scored: rounds.append(1) or was(scored))
    edges = spark.range(10_000).selectExpr("id u", "id + 1 v", "1L n", "id / 20000.0D s")
    assert {r["component"] for r in rag.agglomerate(edges, 0.9).select("component").distinct().collect()} == {0}
    assert not rounds
    assert {r["component"] for r in rag.agglomerate(edges, 0.9, part_edges=4000).select("component").distinct().collect()} == {0}
    assert len(rounds) <= 4


def test_detected_objects(spark):
    """Smooth, threshold, 26 neighbours, sizes: step by step in numpy."""
    p = RNG.random((3, 12, 12))
    p[:, 3:8, 3:8] = 0.95
    w = {o: np.exp(-(o[1] ** 2 + o[2] ** 2) / 2) for o in stencil.box(2)}
    smooth = np.zeros_like(p)
    for z, y, x in np.ndindex(p.shape):
        near = [(p[z, y + dy, x + dx], k) for (_, dy, dx), k in w.items() if 0 <= y + dy < 12 and 0 <= x + dx < 12]
        smooth[z, y, x] = sum(v * k for v, k in near) / sum(k for _, k in near)
    found = flood(smooth >= 0.6, lambda d: True)
    sizes = np.bincount(found.ravel())
    want, n = np.zeros_like(found), 0
    for k in range(1, len(sizes)):
        if 4 <= sizes[k] <= 500:
            n += 1
            want[found == k] = n
    assert (cube_of(label.detect_objects(frame(spark, p, "p"), 12, 12, threshold=0.6, low=4, high=500), p.shape) == want).all()


def forest_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), int(a + b > 1)) for i, (a, b) in enumerate(rng.random((300, 2)))]
    return ml.assemble(spark.createDataFrame(rows, "i bigint, a double, b double, label int"), ["a", "b"])


def test_votes_and_cutoff(spark):
    rows = forest_rows(spark)
    model = ml.train_forest(rows, trees=7, depth=4)
    got = ml.per_tree(model, rows, ["i"], classes=["no", "yes"], cutoff=[0.8, 0.2]).collect()
    for r in got:
        yes = r["tree_classes"].count("yes")
        assert r["votes"] == [7 - yes, yes]
        assert r["called"] == ("yes" if yes / 0.2 > (7 - yes) / 0.8 else "no")
    assert ml.train_forest(rows.withColumn("w", F.lit(1.0)), trees=3, depth=3, weight="w", mtry=1, rate=0.5, cutoff=[0.5, 0.5]).getNumTrees == 3


def test_proximity_equals_brute_force(spark):
    rows = forest_rows(spark)
    model = ml.train_forest(rows, trees=6, depth=3)
    leaves = {r["i"]: r["leaves"] for r in ml.leaves_of(model, rows, ["i"]).collect()}
    pairs, members = ml.proximity(model, rows, "i", 0.5)
    own = {r["i"]: r["class"] for r in members.collect()}
    assert all(leaves[i] == leaves[c] for i, c in own.items())
    got = {(r["a"], r["b"]): r["share"] for r in pairs.collect()}
    kinds = sorted(set(own.values()))
    share = lambda a, b: sum(p == q for p, q in zip(leaves[a], leaves[b], strict=True)) / 6
    assert got == {(a, b): share(a, b) for a in kinds for b in kinds if a < b and share(a, b) >= 0.5}


@pytest.mark.parametrize("least", [0.4, 0.7, 1.0])
def test_hot_leaves_meet_only_in_rare_ones(spark, least):
    """A leaf that holds 90 % of the classes is in no prefix, and nothing is lost by that."""
    rng = np.random.default_rng(3)
    sets = {tuple(int(x) for x in [0 if rng.random() < 0.9 else 1, *rng.integers(0, 5, 7)]) for _ in range(300)}
    leaves = dict(enumerate(sorted(sets)))
    classes = spark.createDataFrame([(k, list(v)) for k, v in leaves.items()], "class bigint, leaves array<int>")
    trees, need = 8, ml.needed(8, least)
    met = ml.rare_leaves(classes, trees - need + 1).collect()
    held = {}
    for r in met:
        held.setdefault(r["class"], set()).add((r["tree"], r["leaf"]))
    assert all(len(v) == trees - need + 1 for v in held.values())
    assert len(held) == len(leaves)
    assert not any(leaf == (0, 0) for v in held.values() for leaf in v)
    share = lambda a, b: sum(p == q for p, q in zip(leaves[a], leaves[b], strict=True)) / trees
    want = {(a, b): share(a, b) for a in leaves for b in leaves if a < b and share(a, b) >= least}
    assert least == 1 or want
    got = [tuple(r) for r in ml.close_classes(classes, trees, need).collect()]
    assert {(a, b): s for a, b, s in got} == want
    assert len(got) == len(want)  # a pair comes from one leaf alone


def test_importances(spark):
    rows = forest_rows(spark).withColumn("c", F.lit(0.5)).drop("features")
    model = ml.train_forest(ml.assemble(rows, ["a", "b", "c"]), trees=10, depth=4)
    got = {(r["feature"], r["class"]): (r["loss"], r["sd"]) for r in ml.permutation_importance(model, rows, ["a", "b", "c"], F.col("i"), times=3).collect()}
    assert len(got) == 9
    assert got["c", None] == (0.0, 0.0)
    assert min(got["a", None][0], got["b", None][0]) > 0.1
    gini = {r["feature"]: r["gini"] for r in ml.gini(model, ["a", "b", "c"]).collect()}
    assert gini["c"] == 0
    assert sum(gini.values()) == pytest.approx(1)


def test_batches_turn_as_one(spark):
    df = spark.range(60).select((F.col("id") % 6).cast("int").alias("batch"), F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))).alias("tile"))
    kinds = {}
    for r in sampling.augmented_batches(df, "batch").collect():
        kinds.setdefault(r["batch"], set()).add(str(r["tile"]))
    assert all(len(k) == 1 for k in kinds.values())
    assert {x for k in kinds.values() for x in k} <= {"[[1, 2], [3, 4]]", "[[3, 4], [1, 2]]", "[[2, 1], [4, 3]]"}


def test_scalar_functions(spark):
    row = spark.range(1).select(
        scalars.round_away(F.lit(-2.5)).alias("r"), scalars.squeezed(F.array(F.array(F.lit(1), F.lit(2)))).alias("s"), F.array(F.lit(1), F.lit(2)).alias("a"), F.array(F.lit(3), F.lit(4)).alias("b")
    ).select("r", "s", scalars.stacked(F.col("a"), F.col("b")).alias("st"), scalars.reader_of(F.lit("X.TIFF")).alias("k"), scalars.token_of("t", F.lit(12)).alias("t"), scalars.reshaped(F.sequence(F.lit(1), F.lit(5)), 2).alias("re")).first()
    assert (row["r"], row["s"], row["st"], row["k"], row["t"], row["re"]) == (-3.0, [1, 2], [[1, 3], [2, 4]], "tiff", "t_000012", [[1, 2], [3, 4], [5]])


def test_dice_equals_sequential(spark):
    rng = np.random.default_rng(3)
    rows = [(1, u, v, int(a), int(b)) for u, v, a, b in zip(np.repeat(range(12), 12), np.tile(range(12), 12), rng.integers(0, 6, 144), rng.integers(4, 10, 144), strict=True)]
    rows = [(r, int(u), int(v), a, b if (u + v) % 3 else a + 4) for r, u, v, a, b in rows]
    got = {(r["src"], r["dst"], r["way"]) for r in seam.by_dice(spark.createDataFrame(rows, "region_id bigint, u int, v int, a bigint, b bigint"), 0.3).collect()}
    used, want = (set(), set()), set()
    from collections import Counter

    n = Counter((a, b) for *_, a, b in rows if a and b)
    na, nb = Counter(r[3] for r in rows if r[3]), Counter(r[4] for r in rows if r[4])
    for of, to, way in ((0, 1, "ab"), (1, 0, "ba")):
        for i in sorted({k[of] for k in n}):
            cand = [(-c, k[to]) for k, c in n.items() if k[of] == i and k[0] != k[1]]
            if not cand or i in used[of]:
                continue
            c, j = min(cand)
            a, b = (i, j) if of == 0 else (j, i)
            if 2 * -c / (na[a] + nb[b]) >= 0.3 and j not in used[to]:
                want.add((min(a, b), max(a, b), way))
                used[of].add(i)
                used[to].add(j)
    assert got == want


def test_object_pr_equals_sequential(spark):
    d, t = RNG.random((3, 9, 9)) < 0.2, RNG.random((3, 9, 9)) < 0.2
    near = lambda q: sum(map(abs, q)) <= 2
    dl, tl = flood(d, near), flood(t, near)
    used, tp = set(), 0
    for k in range(1, tl.max() + 1):
        touch = set(dl[tl == k]) - {0}
        tp += bool(touch - used)
        used |= touch
    r = objects.object_pr(frame(spark, d, "m", "int", bool), frame(spark, t, "m", "int", bool), 9, 9).first()
    assert (r["tp"], r["fn"], r["fp"]) == (tp, tl.max() - tp, dl.max() - len(used))


def test_reticula_order_free(spark):
    cube = np.full((1, 30, 30), 200)
    cube[0, 10:13, 10:13] = 20
    cube[0, 25, 25:29] = 30
    want = np.zeros_like(cube, bool)
    for y, x in zip(*np.nonzero(cube[0] < 45), strict=True):
        dark, stop = [(y, x)], None
        for r in range(1, 17):
            cells = [(y + dy, x + dx) for dy, dx in reticula.ring(r) if 0 <= y + dy < 30 and 0 <= x + dx < 30]
            black = [c for c in cells if cube[0][c] < int(45 + r * 0.5)]
            dark += black
            if sum(cube[0][c] > 87 for c in set(cells) - set(black)) >= len(cells) - 5:
                stop = r
                break
        if stop and 2 <= stop <= 15:
            for c in dark:
                want[0][c] = True
    got = cube_of(reticula.detect(frame(spark, cube, "v", "int")).withColumn("label", F.lit(1)), cube.shape)
    assert (got.astype(bool) == want).all()
    voxels, rows = detect.find_reticula(frame(spark, cube, "v", "int"), 30, 30)
    assert rows.count() == voxels.select("label").distinct().count()


def test_trim_undoes_pad(spark):
    cube = RNG.random((4, 9, 11))
    ext = {"z": (0, 4), "y": (0, 9), "x": (0, 11)}
    span, pad = {"z": 2, "y": 4, "x": 5}, {"z": 1, "y": 1, "x": 2}
    grid = regions.grid(spark, ext, span)
    cut = regions.in_regions(frame(spark, cube), regions.padded(grid, pad, ext), span)
    assert sorted(regions.owned(cut, grid).select("z", "y", "x").collect()) == sorted(frame(spark, cube).select("z", "y", "x").collect())


def test_grid_of_nothing(spark):
    assert regions.grid(spark, {"z": (0, 0), "y": (0, 5), "x": (0, 5)}, {"z": 1, "y": 2, "x": 2}).count() == 0


def test_tiles_turn(spark):
    tile = [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
    df = spark.createDataFrame([(tile,)], "tile array<array<int>>")
    a = np.array(tile)
    for flip in (None, 0, 1):
        for turn in (-1, 0, 1):
            want = a if flip is None else np.flip(a, flip)
            got = df.select(sampling.xform(F.col("tile"), flip, turn)).first()[0]
            assert np.array_equal(got, np.rot90(want, turn))


def test_blocks_and_voxels(spark, tmp_path):
    cube = RNG.random((3, 4, 5)).astype(np.float32)
    np.save(tmp_path / "a.npy", cube)
    np.savez(tmp_path / "b.npz", X=cube[0])
    stack = volumes.load_stack(spark, str(tmp_path))
    assert stack.count() == 4
    voxels = volumes.blocks_to_voxels(stack.where("path like '%a.npy'"))
    assert (cube_of(voxels, cube.shape, "v") == cube).all()
    blocks = volumes.voxels_to_blocks(voxels, {"z": 2, "y": 2, "x": 3})
    assert sum(len(r["data"]) for r in blocks.collect()) == cube.size


def test_domain_checks(spark):
    bad = spark.createDataFrame([(0, 0, 0, 7)], "z int, y int, x int, v int")
    from voxloom.operators.values import inverted

    with pytest.raises(Exception, match="neither 0 nor 255"):
        bad.select(inverted(F.col("v"))).collect()
    with pytest.raises(Exception, match="outside"):
        sinks.rescaled_slices(bad, rescale=False).collect()
    with pytest.raises(ValueError, match="two classes"):
        ml.train_forest(ml.assemble(bad.withColumn("label", F.lit(0)), ["v"]))


def test_merge_table_survives_a_repeat(spark, tmp_path):
    from voxloom.streaming.merges import MergeTable

    t = MergeTable(spark, str(tmp_path / "t"))
    e = lambda *p: spark.createDataFrame(list(p), "src bigint, dst bigint")
    t.apply(e((1, 2), (5, 6)), 0)
    t.apply(e((2, 5)), 1)
    t.apply(e((2, 5)), 1)
    assert t.log().where("v = 1").count() == 2  # only what changed
    t.apply(e((9, 8)), 2)
    t.apply(e((1, 8), (8, 8), (0, 9)), 3)
    t.apply(e((0, 6)), 4)
    t.apply(e((1, 8), (8, 8), (0, 9)), 3)
    assert {r["node"]: r["component"] for r in t.read().collect()} == dict.fromkeys((0, 1, 2, 5, 6, 8, 9), 0)
    t.apply(e((40, 41)), 5)
    assert t.read(before=2).count() == 4
    assert {r["node"]: r["component"] for r in t.read(before=3).collect()} == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8}


def test_categories_are_split_as_sets(spark):
    """Every other code of a category is one class: one split by sets tells them apart, one by order can't."""
    rows = spark.createDataFrame([(float(k % 6), float(k % 6 in (1, 3, 5))) for k in range(120)], "c double, label double")
    rows = ml.assemble(rows.withColumn("noise", F.lit(0.0)), ["c", "noise"])
    right = lambda model: ml.predict(model, rows).where("pred = label").count()
    how = {"trees": 3, "depth": 1, "mtry": 2, "bootstrap": False}
    assert right(ml.train_forest(rows, categories=[6, 1], **how)) == 120
    assert right(ml.train_forest(rows, **how)) < 120
    with pytest.raises(ValueError, match="32"):
        ml.train_forest(rows, categories=[33, 1], **how)
    with pytest.raises(ValueError, match="one category"):
        ml.train_forest(rows, categories=[0, 1], **how)
    assert right(ml.train_forest(rows, categories=[32, 1], **how)) == 120


def test_policy_with_own_features(spark):
    rng = np.random.default_rng(4)
    frag = np.repeat(np.repeat(np.arange(1, 17).reshape(1, 4, 4), 3, 1), 3, 2)
    truth = np.where(np.arange(12)[None, None, :] < 6, 1, 2) * np.ones((1, 12, 1), int)
    p = np.where(np.isin(np.arange(12), (5, 6))[None, None, :], 0.9, 0.1) + rng.random((1, 12, 12)) / 20
    given = frame(spark, frag, "label", "bigint"), frame(spark, p, "p")
    highest = lambda e: e.groupBy("u", "v").agg(F.max("m").alias("highest"))
    model, names = detect.train_policy(*given, frame(spark, truth, "label", "bigint"), trees=5, builders=[ml.edge_features, highest])
    assert names[-1] == "highest" and "mean" in names  # noqa: PT018
    got = detect.learned_agglomeration(*given, model, names, builders=[ml.edge_features, highest]).collect()
    own = {int(frag[0, y, x]): int(truth[0, y, x]) for y, x in np.ndindex(12, 12)}
    parts = {r["node"]: r["component"] for r in got}
    assert {n: own[c] for n, c in parts.items()} == own
    assert len(set(parts.values())) == 2
    with pytest.raises(ValueError, match="named twice"):
        ml.edge_table(ml.edge_values(rag.boundary(given[0].join(given[1], ["z", "y", "x"]))), [highest, highest])


def test_sampler_and_postprocess(spark):
    cube, there = holed((2, 9, 9), 0)
    voxels, truth = with_holes(spark, cube, there), with_holes(spark, (cube > 128).astype(int), there, "t")
    seen = []

    def first_slice(rows):
        seen.append(set(rows.columns))
        return rows.where("z = 0 and y between 2 and 6 and x between 2 and 6")

    model = detect.train_tiles(voxels, truth, iterations=2, sampler=first_slice)
    assert seen == [{"z", "y", "x", "t", "v"}]
    assert model.numFeatures == 25
    extent = {"y": (0, 9), "x": (0, 9)}
    scorer = lambda rows: rows.mean(1)
    plain, told = (detect.score_membranes(voxels, scorer, 2, extent, (30, 220), postprocess=f).collect() for f in (None, metrics.calibrated(2.0, 0.0, 0.5)))
    at = lambda rows: {(r["z"], r["y"], r["x"]): (r["p"], r["p_not"]) for r in rows}
    want = {k: min(1.0, 2 * p**3 + p / 2) for k, (p, _) in at(plain).items()}
    assert {k: v[0] for k, v in at(told).items()} == pytest.approx(want)
    assert all(p + q == pytest.approx(1) for p, q in at(told).values())


def test_thresholds_read_once(spark):
    rows = spark.createDataFrame([(k % 2, (k * 7 % 20) / 20, int(k % 3 == 0)) for k in range(40)], "z int, p double, t int")
    some = metrics.at_thresholds(rows, [0.2, 0.5, 1.0], ["z"])
    want = [{**r.asDict(), "threshold": x} for x in (0.2, 0.5, 1.0) for r in metrics.performance(rows, x, ["z"]).collect()]
    key = lambda r: (r["threshold"], r["z"])
    assert sorted((r.asDict() for r in some.collect()), key=key) == sorted(want, key=key)
    assert some._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_levels_of_a_merge_table():
    from voxloom.streaming.merges import levels

    assert levels(0, 4) == []
    assert levels(9, 4) == [(0, 3), (4, 7), (8, 8)]
    assert levels(16, 4) == [(0, 15)]
    for end in range(200):
        got = levels(end, 3)
        assert [k for a, b in got for k in range(a, b + 1)] == [*range(end)]
        assert len(got) <= 2 * 6
        assert all(a % (b - a + 1) == 0 for a, b in got)


def test_merge_table_in_levels(spark, tmp_path):
    from voxloom.streaming.merges import MergeTable, levels

    rng, path = np.random.default_rng(11), str(tmp_path / "t")
    t, seen = MergeTable(spark, path, buckets=8, fan=2), []
    e = lambda pairs: spark.createDataFrame(pairs, "src bigint, dst bigint")
    batches = [[(None, 3), *((int(a), int(b)) for a, b in rng.integers(0, 60, (4, 2)))] for _ in range(7)]
    for k, pairs in enumerate(batches):
        t.apply(e(pairs), k)
        seen += pairs[1:]
        count, _ = t.runs()
        assert count == [*levels(k, 2), (k, k)]
        want = {r["node"]: r["component"] for r in graph.connected_components(e(seen)).collect()}
        assert {r["node"]: r["component"] for r in t.read().collect()} == want
    assert t.log().groupBy("node", "v").count().where("count > 1").count() == 0
    t.apply(e(batches[6]), 6)  # the last batch again, after its own merging of those before
    t.apply(e(batches[1]), 1)  # one that is merged with others by now
    assert {r["node"]: r["component"] for r in t.read().collect()} == want
    with pytest.raises(ValueError, match="merged with later"):
        t.read(before=2)
    # A run that was cut off before it was whole doesn't count.
    (tmp_path / "t" / "of=8" / "by=component" / "run=000000000000-000000000003" / "_SUCCESS").unlink()
    assert (0, 3) not in t.runs()[0]


def test_merge_table_reads_the_buckets_it_touches(spark, tmp_path):
    from voxloom.streaming.merges import MergeTable

    t = MergeTable(spark, str(tmp_path / "t"), buckets=16)
    t.apply(spark.range(0, 400, 2).selectExpr("id src", "id + 1 dst"), 0)
    few = spark.createDataFrame([(10,), (11,)], "node bigint")
    touched = t._touched(few, "node")
    assert len(touched) <= 2
    got = t._of_nodes(t.runs()[0], few)
    assert {tuple(r) for r in got.collect()} == {(10, 10), (11, 10)}
    files = {f for f in t._rows("node", t.runs()[0], touched).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in files} == set(touched)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    with pytest.raises(ValueError, match="other buckets"):
        MergeTable(spark, str(tmp_path / "t"), buckets=4)


def holed(shape, share=0.06):
    """A cube of intensities and which of its voxels exist."""
    return RNG.integers(0, 255, shape), RNG.random(shape) >= share


def with_holes(spark, cube, there, name="v", kind="int"):
    cast = {"double": float, "int": int, "bigint": int}[kind]
    return spark.createDataFrame([(*map(int, p), cast(cube[p])) for p in zip(*np.nonzero(there), strict=True)], f"z int, y int, x int, {name} {kind}")


@pytest.mark.parametrize("size", [5, 128])
def test_membrane_scores_of_a_volume_with_holes(spark, tmp_path, monkeypatch, size):
    """Every voxel in the band has the score of its tile, holes being 0 and borders mirrored; all are saved."""
    monkeypatch.setattr(blocks.on_slices, "__defaults__", (size,))
    cube, there = holed((2, 13, 17))
    extent = {"y": (0, 13), "x": (0, 17)}
    weights = RNG.random(25) / 30
    scorer = lambda rows: 1 / (1 + np.exp(-(rows @ weights)))
    got = detect.score_membranes(with_holes(spark, cube, there), scorer, 2, extent, (30, 220)).collect()
    padded = np.pad(np.where(there, cube, 0), ((0, 0), (2, 2), (2, 2)), mode="symmetric")
    want = {}
    for z, y, x in zip(*np.nonzero(there), strict=True):
        v = cube[z, y, x]
        tile = padded[z, y : y + 5, x : x + 5].reshape(1, -1) / 255
        want[z, y, x] = 0.0 if v > 220 else 1.0 if v < 30 else scorer(tile)[0]
    assert {(r["z"], r["y"], r["x"]): r["p"] for r in got} == pytest.approx(want)
    assert all(r["v"] == cube[r["z"], r["y"], r["x"]] and r["p"] + r["p_not"] == pytest.approx(1) for r in got)
    truth = with_holes(spark, (cube > 128).astype(int), there, "t")
    told = detect.score_volume(with_holes(spark, cube, there), scorer, 2, extent, (30, 220), str(tmp_path / "saved"), truth)
    assert told.agg(F.sum(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).first()[0] == there.sum()
    saved = spark.read.parquet(str(tmp_path / "saved")).collect()
    assert {(r["z"], r["y"], r["x"]): r["v"] for r in saved} == pytest.approx({p: 1 - s for p, s in want.items()})


def test_tile_scorer_equals_spark(spark):
    rows = with_holes(spark, *holed((1, 12, 12), 0.0))
    truth = rows.select("z", "y", "x", (F.col("v") > 128).cast("int").alias("t"))
    model = detect.train_tiles(rows, truth)
    a = {(r["y"], r["x"]): r["p"] for r in ml.score_blocks(rows, ml.tile_scorer(model, detect.SCALE), 2, whole=True).collect()}
    b = {(r["y"], r["x"]): r["prob"][1] for r in ml.score_tiles(model, stencil.tiles(rows, 2), scale=detect.SCALE).collect()}
    assert a == pytest.approx(b)
    assert len(a) == 64
    with pytest.raises(TypeError):
        ml.tile_scorer(3)


@pytest.mark.parametrize("cells", [1 << 21, 400])
def test_tiles_are_whole(spark, monkeypatch, cells):
    monkeypatch.setattr(stencil, "TILE_CELLS", cells)
    cube, there = holed((2, 14, 19))
    rows = with_holes(spark, cube, there)
    centres = rows.where("(y + x) % 2 = 0")
    want = {(z, y, x): cube[z, y - 1 : y + 2, x - 1 : x + 2].tolist() for z in range(2) for y in range(1, 13) for x in range(1, 18) if there[z, y - 1 : y + 2, x - 1 : x + 2].all()}
    assert {(r["z"], r["y"], r["x"]): r["tile"] for r in stencil.tiles(rows, 1).collect()} == want
    assert {(r["z"], r["y"], r["x"]): r["tile"] for r in stencil.tiles(rows, 1, centres=centres).collect()} == {p: t for p, t in want.items() if (p[1] + p[2]) % 2 == 0}
    assert stencil.tiles(rows, 1).schema["tile"].dataType.simpleString() == "array<array<int>>"


def test_rescaling_lets_nulls_be(spark):
    rows = spark.createDataFrame([(0, 0, 0, None), (0, 0, 1, 0.5), (0, 0, 2, 1.0)], "z int, y int, x int, v double")
    assert [r["v"] for r in sinks.rescaled_slices(rows, rescale=False).orderBy("x").collect()] == [None, 0.5, 1.0]
    assert [r["v"] for r in sinks.rescaled_slices(rows).orderBy("x").collect()] == [None, 0, 255]
    with pytest.raises(Exception, match="outside"):
        sinks.rescaled_slices(rows.withColumn("v", F.col("v") + 1), rescale=False).collect()


@pytest.mark.parametrize("size", [9, 128])
def test_reticula_across_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(blocks.on_slices, "__defaults__", (size,))
    cube = np.where(RNG.random((2, 40, 45)) < 0.02, 20, 200) + RNG.integers(0, 20, (2, 40, 45))
    cube[0, 10:13, 10:13] = cube[1, 7:9, 17:20] = 30
    there = RNG.random(cube.shape) >= 0.03
    seen, want = {}, np.zeros(cube.shape, bool)
    for z, y, x in zip(*np.nonzero(there & (cube < 45)), strict=True):
        dark, stop = [(y, x)], None
        for r in range(1, 17):
            cells = [(y + dy, x + dx) for dy, dx in reticula.ring(r) if 0 <= y + dy < 40 and 0 <= x + dx < 45 and there[z, y + dy, x + dx]]
            black = [c for c in cells if cube[z][c] < int(45 + r * 0.5)]
            light = sum(cube[z][c] > 87 for c in set(cells) - set(black))
            if cells:
                seen[z, y, x, r] = (len(cells), light, len(black))
            if stop is None:
                dark += black
                if cells and light >= len(cells) - 5:
                    stop = r
        if stop and 2 <= stop <= 15:
            for c in dark:
                want[z][c] = True
    rows = with_holes(spark, cube, there)
    assert {(r["sz"], r["sy"], r["sx"], r["r"]): (r["n"], r["n_light"], r["n_black"]) for r in reticula.rings(rows).collect()} == seen
    assert {(r["z"], r["y"], r["x"]) for r in reticula.detect(rows).collect()} == set(zip(*np.nonzero(want), strict=True))
    assert want.any()
