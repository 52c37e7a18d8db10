"""Queries over joins, seams, graphs, sampling, models, metrics, detectors and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import detect, graph, label, metrics, ml, objects, rag, regionprops, regions, reticula, sampling, seam, stencil, values
from voxloom.plans.durable import durable
from voxloom.plans.queries_volume import COMPONENTS, DICE, FACING, GRID, PAD, SPAN, YX, extent, facing, flood, fresh, grid, r6, seam_regions
from voxloom.plans.registry import SLICE, query
from voxloom.streaming.merges import MergeTable, stream_performance

# Joins

query("jon1_aligned", "select z, count(*) n, cast(sum(e.v) filter (l.label > 0) as bigint) v_in, round(sum(p.p) filter (l.label > 0), 4) p_in from fx_em e join fx_pt p using (z, y, x) join fx_lbl l using (z, y, x) group by z")(
    lambda t: t.fx_em.join(t.fx_pt, ["z", "y", "x"]).join(t.fx_lbl, ["z", "y", "x"]).groupBy("z").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") > 0, F.col("v"))).alias("v_in"), F.round(F.sum(F.when(F.col("label") > 0, F.col("p"))), 4).alias("p_in"))
)
query("jon2_seam_planes", f"with {FACING} select * from facing")(facing)
query("jon3_lookup", "select z, y, x, v from fx_em join fx_lbl using (z, y, x) where label in (select label from fx_lbl where label > 0 group by label having count(*) < 10)")(
    lambda t: t.fx_em.select("z", "y", "x", "v").join(t.fx_lbl.join(regionprops.regionprops(t.fx_lbl).where("area < 10").select("label"), "label", "left_semi"), ["z", "y", "x"], "left_semi")
)
query("jon4_neighbours", """select a.label a, b.label b, count(*) n from fx_lbl a join fx_lbl b on (b.z = a.z + 1 and b.y = a.y and b.x = a.x) or (b.z = a.z and b.y = a.y + 1 and b.x = a.x) or (b.z = a.z and b.y = a.y and b.x = a.x + 1) group by all""")(
    lambda t: label.neighbours(t.fx_lbl, 6, ["label"]).groupBy(F.col("a_label").alias("a"), F.col("b_label").alias("b")).agg(F.count("*").alias("n"))
)
query("jon5_unused", "select distinct label from fx_lbl where label > 0 and label not in (select src from fx_edges union select dst from fx_edges)")(
    lambda t: values.ids(t.fx_lbl).join(t.fx_edges.select(F.explode(F.array("src", "dst")).alias("label")), "label", "left_anti")
)
query("jon6_thresholds", "select t.k / 100.0 threshold, count(*) filter (p >= t.k / 100.0) hits from fx_pt cross join (select unnest(range(0, 101)) k) t group by 1")(
    lambda t: metrics.pr_curve(t.fx_pt).select("threshold", (F.col("tp") + F.col("fp")).alias("hits"))
)
query("jon7_in_regions", GRID + " select g.region_id, count(*) n, cast(sum(v) as bigint) s from g join fx_em e on e.z >= z0 and e.z < z1 and e.y >= y0 and e.y < y1 and e.x >= x0 and e.x < x1 group by 1")(
    lambda t: regions.in_regions(t.fx_em, grid(t), SPAN).groupBy("region_id").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
)
CURVE = """with k as (select unnest(range(0, 101)) k), c as (select k / 100.0 threshold, count(*) filter (p >= k / 100.0 and t = 1) tp, count(*) filter (p >= k / 100.0 and t = 0) fp, count(*) filter (p < k / 100.0 and t = 1) fn from fx_pt, k group by k),
    r as (select threshold, tp, fp, fn, tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) recall from c)"""
PARETO = CURVE + """, q as (select distinct round(precision, 3) as precision, round(recall, 3) recall from r where precision is not null and recall is not null)
    select * from q where not exists (select 1 from q o where o.recall >= q.recall and o.precision > q.precision)"""
query("jon8_dominance", PARETO.split("select * from q")[0] + "select q.* from q where exists (select 1 from q o where o.recall >= q.recall and o.precision > q.precision)")(
    lambda t: (c := metrics.pr_curve(t.fx_pt).where("precision is not null and recall is not null").select(F.round("precision", 3).alias("precision"), F.round("recall", 3).alias("recall")).distinct()).join(metrics.pareto(c), ["precision", "recall"], "left_anti")
)

# Seams

query("seg1_mode", f"""with {FACING}, c as (select region_id, a, b, count(*) n from facing where a > 0 and b > 0 group by all), m as (select *, n / sum(n) over (partition by region_id, a) score from c qualify row_number() over (partition by region_id, a order by n desc, b) = 1)
    select region_id, a, b, round(score, 6) score from m where score > 0.5""")(lambda t: seam.by_mode(facing(t), 0.5).select("region_id", "a", "b", *r6("score")))
GREEDY = DICE + """, ma as (select * from s where a <> b qualify row_number() over (partition by region_id, a order by n desc, b) = 1), ab as (select * from ma where dice >= 0.6 qualify row_number() over (partition by region_id, b order by a) = 1),
    mb as (select * from s where a <> b qualify row_number() over (partition by region_id, b order by n desc, a) = 1),
    ba as (select * from mb where dice >= 0.6 and not exists (select 1 from ab u where u.region_id = mb.region_id and (u.a = mb.a or u.b = mb.b)) qualify row_number() over (partition by region_id, a order by b) = 1),
    merges as (select region_id, least(a, b) src, greatest(a, b) dst, dice, 'ab' way from ab union all select region_id, least(a, b), greatest(a, b), dice, 'ba' from ba)"""
query("seg2_dice", GREEDY + " select region_id, src, dst, round(dice, 6) dice, way from merges")(lambda t: seam.by_dice(facing(t)).select("region_id", "src", "dst", *r6("dice"), "way"))
query("seg3_dice_recentred", GREEDY.replace("with facing", "with recursive facing", 1) + """, e as (select src a, dst b from merges union select dst, src from merges), reach(node, cur) as (select a, a from e union select r.node, e.b from reach r join e on r.cur = e.a),
    roots as (select node, min(cur) root from reach group by node) select coalesce(root, label) label, cast(round(avg(z)) as int) z, cast(round(avg(y)) as int) y, cast(round(avg(x)) as int) x from fx_lbl left join roots on roots.node = label where label > 0 group by 1""")(
    lambda t: regionprops.recentred(detect.merge_blocks(t.fx_lbl, seam_regions(t))[1])
)
query("seg4_correlation")(lambda t: seam.by_correlation(facing(t), plane=seam.frames(seam_regions(t), "z")))
query("seg5_boxes", f"""with {FACING}, p as (select region_id, a, min(u) u0, max(u) - min(u) + 1 nu, min(v) v0, max(v) - min(v) + 1 nv from facing where a > 0 group by all),
    q as (select region_id, b, min(u) w0, max(u) - min(u) + 1 mu, min(v) t0, max(v) - min(v) + 1 mv from facing where b > 0 group by all), c as (select distinct region_id, a, b from facing where a > 0 and b > 0)
    select c.region_id, c.a, c.b, least(u0, w0) u0, least(least(u0, w0) + greatest(nu, mu), 24) u1, least(v0, t0) v0, least(least(v0, t0) + greatest(nv, mv), 49) v1 from c join p using (region_id, a) join q using (region_id, b)""")(
    lambda t: seam.boxes(facing(t), {"u": SLICE["y"], "v": SLICE["x"]})
)


query("seg6_peaks")(lambda t: seam.by_correlation(facing(t), 0.3, 40.0, seam.frames(seam_regions(t), "z")).groupBy("region_id").agg(F.count("*").alias("n"), F.max("peak").alias("farthest")))
query("seg7_status", GREEDY + ", r as (select unnest(range(1, 5)) region_id) select cast(r.region_id as bigint) region_id, count(m.src) merges, case when count(m.src) > 0 then 'merged' else 'none' end status from r left join merges m using (region_id) group by 1")(
    lambda t: seam.status(s := seam.in_range(seam_regions(t), 1, 4), seam.by_dice(seam.planes(t.fx_lbl, s, "z")))
)

# Graphs

query("gra1_components", COMPONENTS + " select node, component from comp")(lambda t: graph.connected_components(t.fx_edges))
LISTS = COMPONENTS + " select component root, count(*) n, cast(sum(node) as bigint) s from comp group by component having count(*) > 1"


def listed(pieces):
    own = F.aggregate("members", F.lit(0).cast("bigint"), lambda a, b: a + b)
    return pieces.groupBy("root").agg(F.sum(F.size("members")).alias("n"), F.sum(own).alias("s"))


query("gra2_consolidated", LISTS)(lambda t: listed(graph.consolidate(t.fx_edges.select(F.array("src", "dst").alias("members")))))
query("gra3_closure", LISTS)(lambda t: listed(graph.consolidate(t.fx_edges.groupBy("src").agg(F.collect_set("dst").alias("d")).select(F.array_union(F.array("src"), "d").alias("members")))))
PIECES = COMPONENTS + """, r as (select component root, node, row_number() over (partition by component order by node) - 1 k, count(*) over (partition by component) n from comp)
    select root, cast(k // 3 as int) part, string_agg(cast(node as varchar), ',' order by node) members from r where n > 1 group by 1, 2"""
query("gra2_pieces", PIECES)(lambda t: graph.pieces(graph.connected_components(t.fx_edges), 3).withColumn("members", F.concat_ws(",", F.col("members").cast("array<string>"))))
query("gra4_merge_edges", "select src, dst from fx_edges union select src, src from fx_edges")(lambda t: graph.merge_edges(t.fx_edges.groupBy(F.col("src").alias("parent")).agg(F.collect_list("dst").alias("children"))))


@query("gra5_reset", "select src, dst from fx_edges where src % 2 = 1")
def _(t):
    """A run's part of the merge table, overwritten by nothing."""
    to = fresh(t, "runs")
    rows = t.fx_edges.withColumn("run", (F.col("src") % 2).cast("int"))
    rows.write.partitionBy("run").parquet(to)
    t.spark.createDataFrame([], "src bigint, dst bigint").write.mode("overwrite").parquet(f"{to}/run=0")
    return t.spark.read.parquet(to).select("src", "dst")


FACES = """faces as (select least(a.label, b.label) u, greatest(a.label, b.label) v, (p.p + q.p) / 2 m from fx_lbl a join fx_lbl b on ((b.z = a.z + 1 and b.y = a.y and b.x = a.x) or (b.z = a.z and b.y = a.y + 1 and b.x = a.x) or (b.z = a.z and b.y = a.y and b.x = a.x + 1))
    and a.label <> b.label and a.label > 0 and b.label > 0 join fx_pt p on p.z = a.z and p.y = a.y and p.x = a.x join fx_pt q on q.z = b.z and q.y = b.y and q.x = b.x)"""


def fragments(t):
    return t.fx_lbl.join(t.fx_pt, ["z", "y", "x"]).select("z", "y", "x", "label", "p")


query("gra6_rag", f"with {FACES} select u, v, count(*) n, round(sum(m), 6) s from faces group by u, v")(lambda t: rag.rag(fragments(t)).select("u", "v", "n", *r6("s")))
query("gra7_agglomerated", keep=True)(lambda t: rag.agglomerate(rag.rag(fragments(t)), 0.45))


def policy(t):
    truth = t.fx_lbl.select("z", "y", "x", F.floor(F.col("label") / 22).cast("bigint").alias("label"))
    return detect.train_policy(t.fx_lbl, t.fx_pt, truth, trees=10)


query("gra8_learned", keep=True)(lambda t: detect.learned_agglomeration(t.fx_lbl, t.fx_pt, *policy(t)))
query("gra9_segmentation", keep=True)(lambda t: detect.agglomerated(t.fx_lbl, t.fx_pt, 0.45))
query("gra10_watershed", keep=True)(lambda t: rag.watershed(t.fx_em, 30, 25, 50, flat=True))

# Sampling

HASH = "(z::bigint * 73856093 + y::bigint * 19349663 + x::bigint * 83492791) % 1000003"
INNER = "y between 2 and 22 and x between 2 and 47"


def inner(t):
    return sampling.interior(t.fx_pt, 2, YX)


query("smp1_interior", f"select z, y, x, cast(floor((row_number() over (order by {HASH}, z, y, x) - 1) / 100) as int) batch from fx_pt where {INNER} and z in (0, 2, 4)")(
    lambda t: sampling.batched(sampling.ranked(sampling.interior(t.fx_pt, 2, YX, [0, 2, 4]), [], [sampling.spread(), *map(F.col, "zyx")]), F.col("rank"), 100).select("z", "y", "x", "batch")
)
query("smp2_band_interior", f"select z, y, x from fx_em where {INNER} and v between 50 and 200")(lambda t: sampling.interior(t.fx_em, 2, YX).where(values.band(F.col("v"), 50, 200)).select("z", "y", "x"))
query("smp3_masked_interior", f"select z, y, x, p from fx_pt where {INNER} and (z, y, x) in (select (z, y, x) from fx_fg)")(lambda t: sampling.masked(inner(t).select("z", "y", "x", "p"), t.fx_fg))
BAL = "with r as (select *, row_number() over (partition by {by}t order by " + HASH + ", z, y, x) rank from fx_pt where " + INNER + ")"
query("smp4_balanced", BAL.format(by="") + " select z, y, x, t, rank from r where rank <= (select min(n) from (select count(*) n from r group by t))")(lambda t: sampling.balanced(inner(t), "t").select("z", "y", "x", "t", "rank"))
query("smp4_interleaved", BAL.format(by="") + " select z, y, x, t, 2 * rank - t place from r where rank <= (select min(n) from (select count(*) n from r group by t))")(lambda t: sampling.interleaved(sampling.balanced(inner(t), "t"), "t").select("z", "y", "x", "t", "place"))
query("smp5_balanced_rows", BAL.format(by="z, y, ") + """, m as (select z, y, min(n) m from (select z, y, t, count(*) n from r group by all) group by z, y having count(*) = 2) select r.z, r.y, r.x, r.t, r.rank from r join m using (z, y) where rank <= m""")(
    lambda t: sampling.balanced(inner(t), "t", by=["z", "y"]).select("z", "y", "x", "t", "rank")
)
query("smp6_hard_first", f"""with b as (select e.z, e.y, e.x, e.v, p.t from fx_em e join fx_pt p using (z, y, x) where {INNER.replace("y bet", "e.y bet").replace("x bet", "e.x bet")}), c as (select quantile_cont(v, 0.15) cut from b where t = 0),
    r as (select z, y, x, t, t = 0 and v <= cut hard, row_number() over (partition by t order by case when t = 0 and v > cut then 1 else 0 end, {HASH}, z, y, x) rank from b, c) select * from r where rank <= (select min(n) from (select count(*) n from b group by t))""")(
    lambda t: sampling.hard_first(inner(t).join(t.fx_em, ["z", "y", "x"]).select("z", "y", "x", "v", "t"), "t", "v").select("z", "y", "x", "t", "hard", "rank")
)
query("smp7_stratified", f"""with b as (select z, y, x, v // 64 k from fx_em where z <> 3 and v // 64 <> 2), r as (select *, row_number() over (partition by k order by {HASH}, z, y, x) rank from b) select z, y, x, k, rank from r where rank <= (select min(n) from (select count(*) n from b group by k))""")(
    lambda t: sampling.balanced(t.fx_em.where("z <> 3").select("z", "y", "x", F.floor(F.col("v") / 64).cast("int").alias("k")), "k", omit=[2]).select("z", "y", "x", "k", "rank")
)
query("smp8_shuffled", f"select z, y, x, v, row_number() over (order by {HASH}, z, y, x) rank from fx_em")(lambda t: sampling.ranked(t.fx_em, [], [sampling.spread(), *map(F.col, "zyx")]).select("z", "y", "x", "v", "rank"))
query("smp9_capped", f"select z, y, x, p from fx_pt order by {HASH}, z, y, x limit 1000")(lambda t: sampling.capped(t.fx_pt.select("z", "y", "x", "p"), 1000, [sampling.spread(), "z", "y", "x"]))
query("smp9_recycled", f"""with r as (select z, y, x, row_number() over (order by {HASH}, z, y, x) rank from fx_pt), n as (select count(*) n from r), e as (select z, y, x, rank place from r union all select z, y, x, rank + n from r, n where rank <= (100 - n % 100) % 100)
    select z, y, x, place, cast(floor((place - 1) / 100) as int) batch from e""")(
    lambda t: sampling.recycled(sampling.ranked(t.fx_pt.select("z", "y", "x"), [], [sampling.spread(), *map(F.col, "zyx")]), 100).select("z", "y", "x", "place", "batch")
)
query("aug1_turned", """select a.z, a.y, a.x, b.v flip_row, c.v flip_col, d.v turn_left, e.v turn_right from fx_em a join fx_em b on b.z = a.z and b.y = a.y + 2 and b.x = a.x join fx_em c on c.z = a.z and c.y = a.y and c.x = a.x + 2
    join fx_em d on d.z = a.z and d.y = a.y and d.x = a.x + 2 join fx_em e on e.z = a.z and e.y = a.y + 2 and e.x = a.x
    where (select count(*) from fx_em q where q.z = a.z and q.y between a.y and a.y + 2 and q.x between a.x and a.x + 2) = 9""")(
    lambda t: stencil.tiles(t.fx_em, 1).select(
        "z", (F.col("y") - 1).alias("y"), (F.col("x") - 1).alias("x"), sampling.flip_rows(F.col("tile"))[0][0].alias("flip_row"), sampling.flip_columns(F.col("tile"))[0][0].alias("flip_col"),
        sampling.rotate(F.col("tile"), 1)[0][0].alias("turn_left"), sampling.rotate(F.col("tile"), -1)[0][0].alias("turn_right"),
    )
)
query("aug2_augmented")(lambda t: sampling.augmented(stencil.tiles(t.fx_em, 1).withColumn("key", regions.to_linear(25, 50)), "key"))

query("aug2_batches")(lambda t: sampling.augmented_batches(sampling.batched(sampling.ranked(stencil.tiles(t.fx_em, 1), [], [sampling.spread(), *map(F.col, "zyx")]), F.col("rank"), 100), "batch").select("z", "y", "x", "batch", "tile"))

# Models


#: Slices to train on, and the others. Features lie within a slice, so slices are chosen before.
TRAIN, HELD_OUT = "z % 7 < 4", "z % 7 >= 4"


def train_rows(t, slices: str):
    known = t.fx_pt.where(slices).select("z", "y", "x", F.col("t").alias("label"))
    return ml.assemble(ml.pixel_features(t.fx_em.where(slices)).join(known, ["z", "y", "x"]), ["v", *ml.PIXEL])


def forest(t, trees: int = 10):
    return ml.train_forest(durable(train_rows(t, TRAIN)), trees=trees, depth=5)


query("ml1_forest", keep=True)(lambda t: ml.predict(forest(t), train_rows(t, HELD_OUT)).select("z", "y", "x", "label", "pred"))
query("ml1_weighted", keep=True)(
    lambda t: ml.predict(
        ml.train_forest(durable(train_rows(t, TRAIN).withColumn("weight", F.when(F.col("label") == 1, 2.0).otherwise(1.0))), trees=10, mtry=2, depth=5, rate=0.5, weight="weight", cutoff=[0.6, 0.4]),
        train_rows(t, HELD_OUT),
    ).select("z", "y", "x", "label", "pred", "votes")
)


def coded(t):
    """Pixels with their intensity and, as a category, their slice's place among seven."""
    return ml.assemble(t.fx_em.join(t.fx_pt.select("z", "y", "x", F.col("t").alias("label")), ["z", "y", "x"]).withColumn("k", F.col("z") % 7), ["v", "k"])


query("ml1_categories", keep=True)(lambda t: ml.predict(ml.train_forest(durable(coded(t)), trees=10, depth=5, categories=[1, 7]), coded(t)).select("z", "y", "x", "label", "pred"))
query("ml2_edge_features", f"with {FACES} select u, v, round(avg(m), 6) mean, round(stddev_pop(m), 6) std, round(avg(case when floor(m * 25) = 10 then 1.0 else 0.0 end), 6) h10, round(quantile_cont(m, 0.5), 6) pct1, round(avg(case when m > 0.9 then 1.0 else 0.0 end), 6) contact2 from faces group by u, v")(
    lambda t: ml.edge_features(rag.boundary(fragments(t))).select("u", "v", *r6("mean", "std", "h10", "pct1", "contact2"))
)
query("ml3_policy", keep=True)(lambda t: ml.predict((mn := policy(t))[0], ml.assemble(ml.edge_features(rag.boundary(fragments(t))), mn[1])).select("u", "v", "pred", F.col("prob")[1].alias("p")))
NEAR = "select c.z, c.y, c.x, max(c.v) v, {} from fx_em c cross join (select cast(unnest(range(-3, 4)) as int) dy) a cross join (select cast(unnest(range(-3, 4)) as int) dx) b join fx_em e on e.z = c.z and e.y = c.y + dy and e.x = c.x + dx group by c.z, c.y, c.x"
GAUSS = "sum(e.v * exp(-(dy * dy + dx * dx) / (2 * {0} * {0}))) filter (abs(dy) <= {1} and abs(dx) <= {1}) / sum(exp(-(dy * dy + dx * dx) / (2 * {0} * {0}))) filter (abs(dy) <= {1} and abs(dx) <= {1})"
AT = "coalesce(max(e.v) filter (dy = {} and dx = {}), max(c.v))"
LINEAR = NEAR.format(f"""round({GAUSS.format(1.0, 2)}, 4) smooth, round({GAUSS.format(1.6, 3)}, 4) wider, round(sqrt((({AT.format(1, 0)} - {AT.format(-1, 0)}) / 2.0) ** 2 + (({AT.format(0, 1)} - {AT.format(0, -1)}) / 2.0) ** 2), 4) gradient,
    cast({AT.format(1, 0)} + {AT.format(-1, 0)} + {AT.format(0, 1)} + {AT.format(0, -1)} - 4 * max(c.v) as double) laplacian, round(stddev_pop(e.v) filter (abs(dy) <= 2 and abs(dx) <= 2), 4) deviation""")
query("ml4_linear_features", LINEAR)(
    lambda t: ml.pixel_features(t.fx_em, scales=(1.6,)).select("z", "y", "x", "v", *(F.round(c, 4).alias(n) for c, n in (("smooth", "smooth"), ("smooth_1_6", "wider"), ("gradient", "gradient"))), "laplacian", F.round("deviation", 4).alias("deviation"))
)
query("ml4_structure_features")(lambda t: ml.pixel_features(t.fx_em, scales=ml.SCALES))
query("ml4_pixel_classifier", keep=True)(lambda t: ml.score_pixels(ml.train_pixels(t.fx_em.where("z % 7 < 4"), t.fx_pt, trees=10), t.fx_em.where("z % 7 >= 4")))
query("ml5_scored_tiles", keep=True)(lambda t: ml.score_blocks(t.fx_em.where("z % 7 >= 4"), ml.tile_scorer(detect.train_tiles(t.fx_em, t.fx_pt.where("z % 7 < 4")), detect.SCALE), 2, whole=True).select("z", "y", "x", "p"))
query("ml6_objects", keep=True)(lambda t: detect.detect_and_classify(t.fx_em, t.fx_pt.select("z", "y", "x", "p"), t.fx_pt, 25, 50, threshold=0.55))
query("ml7_per_tree", keep=True)(lambda t: ml.per_tree(forest(t), train_rows(t, HELD_OUT), ["z", "y", "x"], classes=["clear", "membrane"], cutoff=[0.6, 0.4]))
query("ml8_importance", keep=True)(
    lambda t: ml.permutation_importance((m := forest(t)), train_rows(t, HELD_OUT).drop("features"), ["v", *ml.PIXEL], regions.to_linear(25, 50), times=2).join(ml.gini(m, ["v", *ml.PIXEL]), "feature")
)
query("ml9_proximity", keep=True)(lambda t: ml.proximity(forest(t), train_rows(t, HELD_OUT).withColumn("i", regions.to_linear(25, 50)), "i", 0.9)[0])
query("ml9_classes", keep=True)(lambda t: ml.proximity(forest(t), train_rows(t, HELD_OUT).withColumn("i", regions.to_linear(25, 50)), "i", 0.9)[1])
query("ml10_report", keep=True)(lambda t: ml.validation_report(ml.score_pixels(ml.train_pixels(t.fx_em.where("z % 7 < 4"), t.fx_pt, trees=10), t.fx_em.where("z % 7 >= 4")).join(t.fx_pt.select("z", "y", "x", "t"), ["z", "y", "x"]).withColumn("p", F.col("prob")[1])))

# Metrics

RATES = """tp, tn, fp, fn, round(cal, 6) calibration, round(fp / nullif(fp + tn, 0), 6) fallout, round(tp / nullif(tp + fn, 0), 6) recall, round(tp / nullif(tp + fp, 0), 6) as precision, round(tn / nullif(tn + fp, 0), 6) specificity,
    round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) f1, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) f1_alt"""
COUNTS = """count(*) filter (p >= {0} and t = 1) tp, count(*) filter (p < {0} and t <> 1) tn, count(*) filter (p >= {0} and t <> 1) fp, count(*) filter (p < {0} and t = 1) fn, avg(t) filter (p >= {0} - 0.05 and p < {0} + 0.05) cal"""
RATE_NAMES = ("calibration", "fallout", "recall", "precision", "specificity", "f1", "f1_alt")
query("met1_performance", f"with c as (select z, {COUNTS.format(0.5)} from fx_pt group by z) select z, {RATES} from c")(lambda t: metrics.performance(t.fx_pt, 0.5, ["z"]).select("z", "tp", "tn", "fp", "fn", *r6(*RATE_NAMES)))
query("met2_calibration_at", "select z, round(avg(t) filter (p >= 0.7 - 0.05 and p < 0.7 + 0.05), 6) calibration from fx_pt group by z")(lambda t: metrics.performance(t.fx_pt, 0.7, ["z"]).select("z", *r6("calibration")))
query("met3_pr_curve", CURVE + " select round(threshold, 6) threshold, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) recall from r")(lambda t: metrics.pr_curve(t.fx_pt).select(*r6("threshold"), "tp", "fp", "fn", *r6("precision", "recall")))
query("met4_object_pr", flood("abs(a.z - b.z) <= 1 and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) <= 2", "fx_fg").split("select f.z")[0] + """,
    g as (select *, z * 1250 + x * 25 + y i from fx_em where v >= 250 or v between 200 and 206), ge as (select a.i a, b.i b from g a join g b on abs(a.z - b.z) <= 1 and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) <= 2),
    greach(node, cur) as (select i, i from g union select r.node, e.b from greach r join ge e on r.cur = e.a), gc as (select node, min(cur) root from greach group by node),
    touch as (select distinct gc.root d, c.root t from gc join c on gc.node = c.node), w as (select d, min(t) t from touch group by d), n as (select (select count(distinct t) from w) tp, (select count(distinct root) from gc) - (select count(distinct d) from touch) fp, (select count(distinct root) from c) - (select count(distinct t) from w) fn)
    select tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) recall from n""")(
    lambda t: objects.object_pr(t.fx_em.where("v >= 250 or v between 200 and 206"), t.fx_fg, 25, 50).select("tp", "fp", "fn", *r6("precision", "recall"))
)
query("met5_pareto", PARETO)(lambda t: metrics.pareto(metrics.pr_curve(t.fx_pt)))
CAL = """with b as (select z, cast(least(floor(p * 10), 9) as int) bin, t from fx_pt), cal as (select z, bin, count(*) n, avg(t) share, (bin + 0.5) / 10 centre from b group by z, bin union all select null, bin, count(*), avg(t), (bin + 0.5) / 10 from b group by bin)"""
query("met6_calibration", CAL + " select z, bin, n, round(share, 6) share, round(centre, 6) centre from cal")(lambda t: metrics.calibration(t.fx_pt).select("z", "bin", "n", *r6("share", "centre")))
query("met6_closed", """with b as (select z, cast(ceil(p * 10) - 1 as int) bin, t from fx_pt), g as (select distinct z from fx_pt union all select null), f as (select z, cast(unnest(range(0, 10)) as int) bin from g),
    c as (select z, bin, count(*) n, avg(t) share from b where bin between 0 and 9 group by z, bin union all select null, bin, count(*), avg(t) from b where bin between 0 and 9 group by bin)
    select f.z, f.bin, coalesce(n, 0) n, round(coalesce(share, 1.0), 6) share, round((f.bin + 0.5) / 10, 6) centre from f left join c on f.z is not distinct from c.z and f.bin = c.bin""")(lambda t: metrics.calibration_closed(t.fx_pt).select("z", "bin", "n", *r6("share", "centre")))
FIT = CAL + """, s as (select z, sum(power(centre, 2)) s2, sum(power(centre, 3)) s3, sum(power(centre, 4)) s4, sum(power(centre, 5)) s5, sum(power(centre, 6)) s6, sum(centre * share) c1, sum(power(centre, 2) * share) c2, sum(power(centre, 3) * share) c3 from cal group by z),
    d as (select *, s6 * (s4 * s2 - s3 * s3) - s5 * (s5 * s2 - s3 * s4) + s4 * (s5 * s3 - s4 * s4) det from s),
    fit as (select z, (c3 * (s4 * s2 - s3 * s3) - s5 * (c2 * s2 - s3 * c1) + s4 * (c2 * s3 - s4 * c1)) / det a, (s6 * (c2 * s2 - s3 * c1) - c3 * (s5 * s2 - s3 * s4) + s4 * (s5 * c1 - c2 * s4)) / det b, (s6 * (s4 * c1 - c2 * s3) - s5 * (s5 * c1 - c2 * s4) + c3 * (s5 * s3 - s4 * s4)) / det d from d)"""


def fit(t):
    return metrics.cubic_fit(metrics.calibration(t.fx_pt), ["z"])


query("met7_cubic_fit", FIT + " select z, round(a, 4) a, round(b, 4) b, round(d, 4) d from fit")(lambda t: fit(t).select("z", *(F.round(c, 4).alias(c) for c in "abd")))
query("met8_cubic_applied", FIT + " select q.z, q.y, q.x, round(greatest(0.0, least(1.0, ((a * p + b) * p + d) * p)), 4) p from fx_pt q join fit f on f.z = q.z")(
    lambda t: t.fx_pt.join(fit(t).where("z is not null"), "z").select("z", "y", "x", F.round(metrics.apply_cubic(F.col("p"), F.col("a"), F.col("b"), F.col("d")), 4).alias("p"))  # a row a slice
)
query("met9_errors", "select z, y, x, cast(case when p >= 0.5 and t = 1 then 1.0 when p < 0.5 and t = 0 then 0.0 when p >= 0.5 then 0.9 else 0.5 end as double) code from fx_pt")(
    lambda t: t.fx_pt.select("z", "y", "x", metrics.coded_errors(F.col("p"), F.col("t"), 0.5).cast("double").alias("code"))
)
query("met9_errors_other", "select z, y, x, cast(case when p >= 0.5 and t = 1 then 1.0 when p < 0.5 and t = 0 then 0.0 when p >= 0.5 then 0.9 else 0.4 end as double) code from fx_pt")(
    lambda t: t.fx_pt.select("z", "y", "x", metrics.coded_errors(F.col("p"), F.col("t"), 0.5, fn=0.4).cast("double").alias("code"))
)
TH = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
query("met10_f_scores", "with k as (select cast(unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as double) threshold), c as (select threshold, count(*) filter (p >= threshold and t = 1) tp, count(*) filter (p >= threshold and t = 0) fp, count(*) filter (p < threshold and t = 1) fn from fx_pt, k group by 1) select threshold, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) f1 from c")(
    lambda t: metrics.at_thresholds(t.fx_pt, TH).select("threshold", *r6("f1"))
)
query("met10_f_scores_filtered")(lambda t: metrics.at_thresholds(stencil.median(t.fx_pt, 1, "p", "mirror", YX).join(t.fx_pt.select("z", "y", "x", "t"), ["z", "y", "x"]), TH).select("threshold", *r6("f1")))

# Detectors

RING = "(k = 0 or k = r + 2 or c = 0 or c = 2 * r)"
query("stn9_rings", f"""with o as (select r, k + 1 - r dy, c + 1 - r dx from (select r, k, unnest(range(2 * r + 1)) c from (select r, unnest(range(2 * r + 1)) k from (select unnest(range(1, 17)) r))) where {RING}),
    s as (select z, y, x from fx_em where v < 45), met as (select s.z sz, s.y sy, s.x sx, r, e.v v, floor(45 + r * 0.5) b from s cross join o join fx_em e on e.z = s.z and e.y = s.y + dy and e.x = s.x + dx)
    select sz, sy, sx, r::int r, count(*) n, count(*) filter (v >= b and v > 87) n_light, count(*) filter (v < b) n_black from met group by sz, sy, sx, r""")(lambda t: reticula.rings(t.fx_em))
query("det1_watershed_segments", keep=True)(lambda t: detect.watershed_segments(t.fx_pt, 25, 50, dilate_xy=1, dilate_z=1, threshold=110, min_size=4, median=1))
query("det1_original_radii", keep=True)(lambda t: detect.watershed_segments(t.fx_pt, 25, 50, threshold=130))
query("det2_reticula")(lambda t: detect.find_reticula(t.fx_em, 25, 50)[0])
query("det3_pixel_pipeline", keep=True)(lambda t: detect.classify_blocks(t.fx_em.select("z", "y", "x", "v"), grid(t), SPAN, PAD, extent(t), ml.train_pixels(t.fx_em, t.fx_pt, trees=5)))
query("det4_object_pipeline", keep=True)(
    lambda t: detect.detect_and_classify(t.fx_em, detect.classify_blocks(t.fx_em.select("z", "y", "x", "v"), grid(t), SPAN, PAD, extent(t), ml.train_pixels(t.fx_em, t.fx_pt, trees=5)), t.fx_pt, 25, 50, threshold=0.5)
)
query("det5_agglomerative", keep=True)(lambda t: detect.agglomerated(detect.watershed_segments(t.fx_pt, 25, 50, dilate_xy=1, dilate_z=1, threshold=110, min_size=3, median=1), t.fx_pt, 0.4))


def truth_labels(t):
    return t.fx_lbl.select("z", "y", "x", F.floor(F.col("label") / 22).cast("bigint").alias("label"))


def trained(t, variant: str, flat: bool):
    model, names = detect.train_from_volumes(t.fx_em, t.fx_pt, truth_labels(t), 25, 50, variant, flat, trees=10)
    return ml.predict(model, ml.assemble(ml.edge_features(rag.boundary(fragments(t))), names)).select("u", "v", "pred")


query("det6_policy_training", keep=True)(lambda t: trained(t, "full", False))
query("det6_policy_flat", keep=True)(lambda t: trained(t, "50", True))
query("det6_policy_ten", keep=True)(lambda t: trained(t, "10", False))
query("det7_block_merge", GREEDY.replace("with facing", "with recursive facing", 1) + """, e as (select src a, dst b from merges union select dst, src from merges), reach(node, cur) as (select a, a from e union select r.node, e.b from reach r join e on r.cur = e.a),
    roots as (select node, min(cur) root from reach group by node) select z, y, x, coalesce(root, label) label from fx_lbl left join roots on roots.node = label""")(lambda t: detect.merge_blocks(t.fx_lbl, seam_regions(t))[1])
TILED = """with t as (select c.z, c.y, c.x, c.v, sum(coalesce(m.v, 0)) / 25.0 / 255.0 p from fx_em c cross join (select unnest(range(-2, 3)) dy) cross join (select unnest(range(-2, 3)) dx)
    left join fx_em m on m.z = c.z and m.y = case when c.y + dy < 0 then -1 - c.y - dy when c.y + dy > 24 then 49 - c.y - dy else c.y + dy end and m.x = case when c.x + dx < 0 then -1 - c.x - dx when c.x + dx > 49 then 99 - c.x - dx else c.x + dx end group by 1, 2, 3, 4),
    o as (select z, y, x, cast(case when v > 220 then 0.0 when v < 30 then 1.0 else p end as double) p from t), q as (select z, y, x, greatest(0.0, least(1.0, ((0.4 * p - 0.3) * p + 1.1) * p)) p from o)
    select z, y, x, round(p, 6) p, round(1 - p, 6) p_not from q"""
query("udf_postprocess", TILED)(
    lambda t: detect.score_membranes(t.fx_em, lambda rows: rows.mean(1), 2, YX, (30, 220), postprocess=metrics.calibrated(0.4, -0.3, 1.1)).select("z", "y", "x", F.round("p", 6).alias("p"), F.round("p_not", 6).alias("p_not"))
)
query("udf_sampler", keep=True)(lambda t: detect.score_membranes(t.fx_em, detect.train_tiles(t.fx_em, t.fx_pt, sampler=lambda rows: sampling.hard_first(rows, "t", "v")), 2, YX, (30, 220)))
BUILDERS = [lambda e: e.groupBy("u", "v").agg(F.sum("n").alias("n")), lambda e: e.groupBy("u", "v").agg(F.min("m").alias("low"), F.max("m").alias("high"))]
query("udf_features", f"with {FACES} select u, v, cast(count(*) as bigint) n, round(min(m), 6) low, round(max(m), 6) high from faces group by u, v")(
    lambda t: ml.edge_table(ml.edge_values(rag.boundary(fragments(t))), BUILDERS).select("u", "v", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
)
query("det8_saved_and_measured", keep=True)(lambda t: detect.score_volume(t.fx_em, detect.train_tiles(t.fx_em, t.fx_pt), 2, YX, (30, 220), fresh(t, "scores"), t.fx_pt))
query("det8_membrane_scores", keep=True)(lambda t: detect.score_membranes(t.fx_em, detect.train_tiles(t.fx_em, t.fx_pt), 2, YX, (30, 220)))

# Streams

STREAMED = """with recursive both_ways as (select src a, dst b from fx_stream union select dst, src from fx_stream), reach(node, cur) as (select a, a from both_ways union select r.node, e.b from reach r join both_ways e on r.cur = e.a)
    select node, min(cur) component from reach group by node"""


@query("str1_merge_table", STREAMED)
def _(t):
    """Edges arrive as files by day; each batch merges its own into the table."""
    base = fresh(t, "stream")
    t.fx_stream.select("src", "dst").repartition(4, "src").write.parquet(f"{base}/in")
    table = MergeTable(t.spark, f"{base}/table")
    edges = t.spark.readStream.schema("src bigint, dst bigint").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    q = table.stream(edges, f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return table.read()


@query("str2_block_metrics", "select count(*) filter (p >= 0.5 and t = 1) tp, count(*) filter (p < 0.5 and t <> 1) tn, count(*) filter (p >= 0.5 and t <> 1) fp, count(*) filter (p < 0.5 and t = 1) fn from fx_pt")
def _(t):
    base = fresh(t, "blocks")
    t.fx_pt.repartition(3, "z").write.parquet(f"{base}/in")
    blocks = t.spark.readStream.schema("z int, y int, x int, p double, t int").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = stream_performance(blocks, f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(f"{base}/out").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("tp", "tn", "fp", "fn")))


