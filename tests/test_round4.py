"""What the review of round 3 found at size, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import detect, ml
from voxloom.plans import queries_general, queries_graph, queries_volume, registry  # noqa: F401


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edge_percentiles_come_from_sorted_values(spark):
    """No map of an edge's values in an aggregate's row; the percentiles are Spark's own."""
    rng = np.random.default_rng(5)
    rows = [(int(u), int(u) + 1 + int(d), int(m) / 16, int(n)) for u, d, m, n in rng.integers(0, [4, 2, 17, 6], (120, 4)) if n]
    values = ml.edge_values(spark.createDataFrame(rows, "u bigint, v bigint, m double, n bigint"))
    got = ml.edge_features(values)
    assert "ObjectHashAggregate" not in plan_of(got)
    points = (0.1, 0.5, 0.9)
    want = values.groupBy("u", "v").agg(F.percentile("m", F.array(*map(F.lit, points)), F.col("n")).alias("p")).collect()
    found = {(r["u"], r["v"]): [r[f"pct{i}"] for i in range(3)] for r in got.collect()}
    assert found == {(r["u"], r["v"]): r["p"] for r in want}


def test_a_policy_derives_its_rows_once(spark, sf_dir, monkeypatch):
    """A forest passes over its rows a few times before the first level, so these come from the shared folder."""
    seen = []
    monkeypatch.setattr(ml, "train_forest", lambda rows, **how: seen.append(plan_of(rows)))
    t = registry.Tables(spark, sf_dir, keep=True)
    detect.train_policy(t.fx_lbl, t.fx_pt, t.fx_lbl)
    assert "Scan ExistingRDD" in seen[0] and not any(x in seen[0] for x in ("Join", "Aggregate", "Exchange"))
