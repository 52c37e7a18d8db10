"""What the review of round 3 found at size and a later round mended, on small tables."""

from pyspark.sql import functions as F

from voxloom.operators import blocks, detect, label, ml, rag, regions, sampling
from voxloom.plans import queries_graph, registry


def test_slices_share_a_kernel_call(spark):
    """Pixel features of small slices come from stacks, one call for many slices, and no slice sees another."""
    calls = spark.sparkContext.accumulator(0)
    rows = [(z, y, x, z * 100 + y * 10 + x) for z in range(40) for y in range(6) for x in range(6)]

    def look(values, there):
        calls.add(1)
        cells = blocks.inner(there, 2)
        return cells, [sum(blocks.shifted(values[0], 2, 0, dx) for dx in (-2, 0, 2))[cells]]

    got = blocks.on_stacks(spark.createDataFrame(rows, "z int, y int, x int, v int"), ["v"], 2, look, "z int, y int, x int, s double", 4).collect()
    assert calls.value == 3 * 4  # 40 slices in groups of 16, four blocks each
    at = {r[:3]: r[3] for r in rows}
    assert sorted((r["z"], r["y"], r["x"], r["s"]) for r in got) == [(z, y, x, sum(at.get((z, y, x + dx), 0) for dx in (-2, 0, 2))) for z, y, x, _ in rows]


def test_pads_are_seen_not_scored(spark, monkeypatch):
    """Blocks' pads get no features and meet no forest; every voxel has the features of its padded block."""
    span, pad = {"z": 2, "y": 4, "x": 5}, {"z": 1, "y": 2, "x": 3}
    rows = [(z, y, x, (z * 31 + y * 17 + x * 7) % 97) for z in range(3, 8) for y in range(9) for x in range(11) if (y + x) % 7]
    voxels = spark.createDataFrame(rows, "z int, y int, x int, v int")
    seen = []

    def scored(model, feats):
        seen.append(feats.count())
        return feats.withColumns({"prob": F.array(F.lit(0.0), F.col("tensor1_1_6")), "pred": F.lit(0)})

    monkeypatch.setattr(ml, "predict", scored)
    box = regions.extent(voxels)
    grid = regions.grid(spark, box, span)
    got = {(r["z"], r["y"], r["x"]): r["p"] for r in detect.classify_blocks(voxels, grid, span, pad, box, None).collect()}
    assert seen == [len(rows)] and set(got) == {r[:3] for r in rows}
    for z0, y0, x0 in ((3, 0, 0), (5, 4, 5), (7, 8, 10)):
        cut = voxels.where(F.col("z").between(z0, z0 + 1) & F.col("y").between(y0 - 2, y0 + 5) & F.col("x").between(x0 - 3, x0 + 7))
        for r in ml.pixel_features(cut, scales=ml.SCALES).collect():
            if y0 <= r["y"] < y0 + 4 and x0 <= r["x"] < x0 + 5:
                assert abs(got[r["z"], r["y"], r["x"]] - r["tensor1_1_6"]) < 1e-9


def test_held_out_slices_get_no_training_features(spark, sf_dir, monkeypatch):
    """A forest's rows come from its own slices: features of the others aren't made and dropped."""
    seen, features = [], ml.pixel_features
    monkeypatch.setattr(ml, "pixel_features", lambda voxels, **how: seen.append(voxels) or features(voxels, **how))
    t = registry.Tables(spark, sf_dir, keep=True)
    rows = queries_graph.train_rows(t, queries_graph.TRAIN)
    assert {r["z"] % 7 for r in seen[0].select("z").distinct().collect()} <= {0, 1, 2, 3}
    assert rows.count() == t.fx_em.where(queries_graph.TRAIN).count()


def test_packing_holds_few_words():
    """A worker of the packing stage keeps its words' ids under a bound that two workers of a small executor can hold."""
    import public_tokenizers

    from voxloom.llm import packing

    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    made = ids.make
    ids.make = lambda word: b"\0" * 4
    for k in range(450_000):
        ids[b"%d" % k]
    assert len(ids) + len(ids.old) <= 400_000 and made(b"word") != b""


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def once(plan):
    return "Scan ExistingRDD" in plan and not any(x in plan for x in ("Join", "Pandas", "Exchange"))


def test_watershed_dilates_once(spark, sf_dir, monkeypatch):
    """Markers and the forest read the dilated volume; neither derives it."""
    seen = []
    monkeypatch.setattr(rag, "watershed", lambda voxels, *a, **how: seen.append(plan_of(voxels)) or voxels.withColumn("label", F.lit(0).cast("bigint")))
    monkeypatch.setattr(label, "fill_background", lambda labels, *a, **how: labels)
    detect.watershed_segments(registry.Tables(spark, sf_dir, keep=True).fx_pt, 25, 50, dilate_xy=1, dilate_z=1, median=1)
    assert once(seen[0])


def test_agglomeration_reads_its_volume_once(spark, sf_dir, monkeypatch):
    """Neither the adjacency graph nor the result derives labels anew, and the nodes don't come from another pass over the faces."""
    seen, real = [], rag.rag
    monkeypatch.setattr(rag, "rag", lambda voxels, *a: seen.append(plan_of(voxels)) or real(voxels, *a))
    t = registry.Tables(spark, sf_dir, keep=True)
    detect.agglomerated(t.fx_lbl, t.fx_pt, 0.45)
    assert once(seen[0])
    edges = spark.createDataFrame([(1, 2, 1, 0.1), (2, 3, 1, 0.9)], "u bigint, v bigint, n bigint, s double").groupBy("u", "v").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    got = rag.agglomerate(edges, 0.5)
    assert plan_of(got).count("HashAggregate") <= 2  # the nodes' distinct alone
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 3)]


def test_a_sampler_reads_rows_made_once(spark, sf_dir):
    t, seen = registry.Tables(spark, sf_dir, keep=True), []

    def sampler(rows):
        seen.append(plan_of(rows))
        return sampling.hard_first(rows, "t", "v")

    detect.train_tiles(t.fx_em, t.fx_pt, sampler=sampler, iterations=1)
    assert once(seen[0])
