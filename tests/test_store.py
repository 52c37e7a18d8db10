"""A stored volume against plain filters, and what its plans read."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from voxloom.operators.regions import inside
from voxloom.sources import store

SPAN = {"z": 2, "y": 4, "x": 8}


def test_ranges_hold_the_box():
    rng = random.Random(3)
    for _ in range(60):
        low = tuple(rng.randrange(12) for _ in range(3))
        high = tuple(v + rng.randrange(6) for v in low)
        own = {store.morton(p) for p in product(*(range(a, b + 1) for a, b in zip(low, high, strict=True)))}
        for limit in (1, 8, 10**6):
            ranges = store.key_ranges(low, high, limit)
            held = {k for a, b in ranges for k in range(a, b + 1)}
            assert own <= held
            assert len(ranges) <= limit + 7
            assert limit < 10**6 or held == own
            assert all(p[1] + 1 < q[0] for p, q in zip(ranges, ranges[1:], strict=False))
    assert store.key_ranges((3, 0, 0), (2, 5, 5)) == []


def test_keys_are_those_of_the_rule(spark):
    at = [(0, 0, 0), (1, 2, 3), (-1, 0, 5), (-(1 << 20), (1 << 20) - 1, 77)]
    df = spark.createDataFrame(at, "z int, y int, x int")
    got = [r[0] for r in df.select(store.voxel_key(dict.fromkeys("zyx", 1))).collect()]
    assert got == [store.morton(tuple(v + store.BIAS for v in p)) for p in at]
    with pytest.raises(Exception, match="beyond 21 bits"):
        spark.createDataFrame([(1 << 20, 0, 0)], "z int, y int, x int").select(store.voxel_key(dict.fromkeys("zyx", 1))).collect()


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    df = spark.range(12 * 24 * 40).select((F.floor(F.col("id") / 960) - 4).cast("int").alias("z"), (F.floor(F.col("id") / 40) % 24 - 10).cast("int").alias("y"), (F.col("id") % 40).cast("int").alias("x"), (F.col("id") * 31 % 257).alias("v"))
    df = df.where("v % 11 <> 3")
    lost = spark.createDataFrame([(None, 1, 1, 5)], "z int, y int, x int, v bigint")
    path = str(tmp_path_factory.mktemp("store") / "a")
    store.write_volume(df.unionByName(lost), path, SPAN, zone_cells=600, files=5)
    return df, store.Volume(spark, path)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("limit", [1, 64])
def test_cutouts(kept, limit):
    df, volume = kept
    assert rows(volume.rows().select(*volume.columns)) == rows(df)
    rng = random.Random(8)
    boxes = [{a: (lo := rng.randrange(-6, n), lo + rng.randrange(1, 15)) for a, n in (("z", 8), ("y", 14), ("x", 40))} for _ in range(4)]
    for box in [*boxes, {"x": (3, 9)}, {"z": (2, 2), "y": (0, 5)}, {"z": (10**8, 10**8 + 1)}]:
        assert rows(volume.cutout(box, limit)) == rows(df.where(inside(box)))
    assert rows(volume.cuboids({"z": (1, 2), "y": (-3, 1), "x": (9, 17)})) == rows(df.where("z between 0 and 1 and y between -4 and 3 and x between 8 and 23"))


def test_a_cutout_prunes(kept):
    df, volume = kept
    small = volume.cutout({"z": (0, 2), "y": (0, 4), "x": (8, 16)})
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "zone" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "key" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert len(small.inputFiles()) >= 1
    scan = small._jdf.queryExecution().executedPlan().collectLeaves().head()
    small.collect()
    read, there = scan.selectedPartitions().totalNumberOfFiles(), len(volume.rows().inputFiles())
    assert 1 <= read * 4 <= there


def test_many_regions(spark, kept):
    df, volume = kept
    boxes = [(k, z, z + 3, y, y + 5, x, x + 9) for k, (z, y, x) in enumerate(product((-4, 1), (-10, 0, 9), (0, 17, 33)))] + [(99, 0, 0, 0, 5, 0, 5)]
    regions = spark.createDataFrame(boxes, "region_id bigint, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    want = df.join(regions, (F.col("z") >= F.col("z0")) & (F.col("z") < F.col("z1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))).select("region_id", *df.columns)
    assert rows(volume.in_regions(regions)) == rows(want)


def test_empty_volume_and_clashes(spark, tmp_path):
    none = spark.createDataFrame([], "z int, y int, x int, v double")
    store.write_volume(none, str(tmp_path / "n"), SPAN)
    volume = store.Volume(spark, str(tmp_path / "n"))
    assert volume.cutout({"z": (0, 5)}).collect() == []
    assert volume.cutout({"z": (0, 5)}).columns == none.columns
    with pytest.raises(ValueError, match="own"):
        store.write_volume(none.withColumnRenamed("v", "key"), str(tmp_path / "c"), SPAN)
