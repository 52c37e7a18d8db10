"""Queries over sources, regions, values, stencils, normalisation, aggregates and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.operators import graph, label, normalize, regionprops, regions, seam, stencil, values
from voxloom.plans.durable import shared_dir
from voxloom.plans.registry import SLICE, query
from voxloom.sources import sinks, store, volumes

YX = {a: (0, n) for a, n in SLICE.items()}
#: Slices of a stack in a file.
STACK = 1024
#: The number of slices, in SQL.
DEEP = "(select max(z) + 1 from fx_em)"
BOX = {"z": (1, 5), "y": (5, 20), "x": (10, 35)}
SPAN, PAD = {"z": 3, "y": 10, "x": 20}, {"z": 1, "y": 2, "x": 3}
IN_BOX = "z >= 1 and z < 5 and y >= 5 and y < 20 and x >= 10 and x < 35"


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def fresh(t, name: str) -> str:
    """A new folder where the cluster shares files."""
    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def extent(t):
    """The volume's own extent."""
    return regions.extent(t.fx_em)


def grid(t):
    return regions.grid(t.spark, extent(t), SPAN)


#: The same grid in SQL.
GRID = """with ext as (select max(z) + 1 nz, max(y) + 1 ny, max(x) + 1 nx from fx_em), zs as (select unnest(range(0, (select nz from ext), 3)) z0),
    ys as (select unnest(range(0, (select ny from ext), 10)) y0), xs as (select unnest(range(0, (select nx from ext), 20)) x0),
    g as (select cast((z0 // 3 * ((ny + 9) // 10) + y0 // 10) * ((nx + 19) // 20) + x0 // 20 as bigint) region_id, 'cutout' kind, cast(z0 as int) z0, cast(least(z0 + 3, nz) as int) z1,
    cast(y0 as int) y0, cast(least(y0 + 10, ny) as int) y1, cast(x0 as int) x0, cast(least(x0 + 20, nx) as int) x1 from zs, ys, xs, ext)"""
PADDED = GRID + """, p as (select region_id, kind, greatest(z0 - 1, 0) z0, cast(least(z1 + 1, nz) as int) z1, greatest(y0 - 2, 0) y0, cast(least(y1 + 2, ny) as int) y1, greatest(x0 - 3, 0) x0, cast(least(x1 + 3, nx) as int) x1 from g, ext)"""


# Sources and sinks

query("src1_cutout", f"select z, y, x, v, n from fx_em where {IN_BOX}")(lambda t: volumes.cutout(t.fx_em, BOX))


def stored(t, span, zone_cells):
    """The volume, stored in z-order."""
    to = fresh(t, "volume")
    store.write_volume(t.fx_em, to, span, zone_cells)
    return store.Volume(t.spark, to)


query("src1_stored_cutout", f"select z, y, x, v, n from fx_em where {IN_BOX}", keep=True)(lambda t: stored(t, {"z": 2, "y": 4, "x": 8}, 512).cutout(BOX))
query("reg3_stored_cuboids", "select z, y, x, v, n from fx_em where z >= 0 and z < 6 and y >= 4 and y < 20 and x >= 8 and x < 40", keep=True)(lambda t: stored(t, {"z": 2, "y": 4, "x": 8}, 512).cuboids(BOX))
query("jon7_stored_regions", PADDED + " select p.region_id, count(*) n, cast(sum(v) as bigint) s from p join fx_em e on e.z >= z0 and e.z < z1 and e.y >= y0 and e.y < y1 and e.x >= x0 and e.x < x1 group by 1", keep=True)(
    lambda t: stored(t, SPAN, 5000).in_regions(regions.padded(grid(t), PAD, extent(t))).groupBy("region_id").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
)


@query("src2_co_cutout", """select e.z, e.y, e.x, cast(e.v as double) em, p.p prob, cast(l.label as double) truth from fx_em e join fx_pt p using (z, y, x) join fx_lbl l using (z, y, x)
    where e.z between 0 and 5 and e.y between 3 and 21 and e.x between 7 and 37""")
def _(t):
    return volumes.co_cutout({"em": t.fx_em.select("z", "y", "x", "v"), "prob": t.fx_pt.select("z", "y", "x", "p"), "truth": t.fx_lbl}, BOX, PAD)


@query("src3_slabs", "select z, count(*) n, cast(sum(v) as bigint) s from fx_em where z >= 1 and z < 6 group by z")
def _(t):
    return volumes.by_slabs(t.fx_em, (1, 6), 5).groupBy("z").agg(F.count("*").alias("n"), F.sum("v").alias("s"))


@query("src4_load_stack", "select cast(vec_id as int) z, cast(i // 8 as int) y, cast(i % 8 as int) x, round(cast(embedding[i + 1] as double), 6) v from embeddings, (select unnest(range(64)) i)")
def _(t):
    """Slices saved by tasks as stacks of many in .npz files with their numbers, then read through Spark's file reader."""
    from voxloom.plans.ship import ship

    ship(t.spark)
    folder = fresh(t, "stack")

    def save(batches):
        import io
        import uuid

        import numpy as np
        import pandas as pd
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        for pdf in batches:
            for at in range(0, len(pdf), STACK):
                some, out = pdf.iloc[at : at + STACK], io.BytesIO()
                np.savez(out, X=np.stack([np.asarray(v, np.float32).reshape(8, 8) for v in some["embedding"]]), z=some["vec_id"].to_numpy(np.int64))
                with system.open_output_stream(f"{inner}/{uuid.uuid4().hex}.npz") as f:
                    f.write(out.getvalue())
            yield pd.DataFrame({"n": [len(pdf)]})

    # A task that runs again writes its stacks anew under other names; a slice counts once.
    t.embeddings.select("vec_id", "embedding").mapInPandas(save, "n bigint").agg(F.sum("n")).collect()
    got = volumes.load_stack(t.spark, folder, at="z").dropDuplicates(["z0"])
    return volumes.blocks_to_voxels(got).select("z", "y", "x", F.round(F.col("v").cast("double"), 6).alias("v"))


@query("src5_tool_output", "select 1 resolution, z + 101 z, x + 202 y, y + 303 x, round(1 - p, 6) \"value\" from fx_pt")
def _(t):
    both = t.fx_pt.select("z", "y", "x", F.explode(F.array(F.struct(F.lit(0).alias("channel"), F.col("p").alias("value")), F.struct(F.lit(1).alias("channel"), (1 - F.col("p")).alias("value")))).alias("c")).select("z", "y", "x", "c.*")
    return volumes.tool_output(both, 1, {"z": 100, "y": 200, "x": 300}, {"z": 1, "y": 2, "x": 3}, swap_xy=True, resolution=1).withColumn("value", F.round("value", 6))


@query("snk1_paint", "select z, y, x, label, 'a' channel, 1 resolution from fx_lbl where label > 0")
def _(t):
    to = fresh(t, "paint")
    for channel in ("b", "a", "a"):  # again is the same
        sinks.paint(t.fx_lbl.where("label > 0"), to, channel, 1)
    return t.spark.read.parquet(to).where("channel = 'a'").select("z", "y", "x", "label", "channel", "resolution")


@query("snk2_objects", """select label id, 'seg' kind, 'auto' author, count(*) area, min(z) z0, max(x) x1, cast(round(avg(y)) as int) cy from fx_lbl where label > 0 group by label""")
def _(t):
    to = fresh(t, "objects")
    sinks.write_objects(sinks.object_rows(regionprops.regionprops(t.fx_lbl), "anno", "seg", "auto", 1), to)
    return t.spark.read.parquet(to).select("id", "kind", "author", "area", F.col("bbox.z0").alias("z0"), F.col("bbox.x1").alias("x1"), F.col("centroid.y").alias("cy"))


@query("snk3_reserve_ids", "select z, y, x, case when label > 0 then label + (select max(p_partkey) from part) else 0 end label from fx_lbl")
def _(t):
    return sinks.shifted(t.fx_lbl, sinks.next_id(t.part, "p_partkey"))


@query("snk4_probabilities", "select z, y, x, round(p, 6) p, 'probability' kind from fx_pt")
def _(t):
    to = fresh(t, "prob")
    sinks.paint(t.fx_pt.select("z", "y", "x", "p"), to, "prob", 0, "probability")
    return t.spark.read.parquet(to).select("z", "y", "x", F.round("p", 6).alias("p"), "kind")


@query("snk5_rescaled", """select z, y, x, cast(floor((v - min(v) over (partition by z)) * 255 / cast(max(v) over (partition by z) - min(v) over (partition by z) as double)) as int) v from fx_em""", keep=True)
def _(t):
    to = fresh(t, "slices")
    sinks.save_slices(sinks.rescaled_slices(t.fx_em.select("z", "y", "x", "v")), to)
    return t.spark.read.parquet(to).select("z", "y", "x", "v")


@query("snk5_asserted", "select z, y, x, round(1 - p, 6) v from fx_pt", keep=True)
def _(t):
    """1 - p, after the check that all values lie in [0, 1]."""
    to = fresh(t, "slices")
    sinks.save_slices(sinks.rescaled_slices(t.fx_pt.select("z", "y", "x", (1 - F.col("p")).alias("v")), rescale=False), to)
    return t.spark.read.parquet(to).select("z", "y", "x", F.round("v", 6).alias("v"))


COMPONENTS = """with recursive both_ways as (select src a, dst b from fx_edges union select dst, src from fx_edges),
    reach(node, cur) as (select a, a from both_ways union select r.node, e.b from reach r join both_ways e on r.cur = e.a),
    comp as (select node, min(cur) component from reach group by node)"""


@query("snk6_merge_list", COMPONENTS + " select component \"new\", node \"old\" from comp where node <> component")
def _(t):
    to = fresh(t, "merges")
    sinks.write_merge_list(graph.pieces(graph.connected_components(t.fx_edges), 3), to)
    return sinks.read_merge_list(t.spark, to)


# Regions

query("reg1_grid", GRID + " select * from g")(grid)
query("reg2_padded", PADDED + " select * from p")(lambda t: regions.padded(grid(t), PAD, extent(t)))
query("reg3_aligned", GRID + " select region_id, kind, z0, z1, cast(y0 // 4 * 4 as int) y0, cast((y1 + 3) // 4 * 4 as int) y1, cast(x0 // 8 * 8 as int) x0, cast((x1 + 7) // 8 * 8 as int) x1 from g")(
    lambda t: regions.aligned(grid(t), {"y": 4, "x": 8})
)
query("reg4_seams", GRID + """ select region_id, 'merge' kind, 'z' axis, z1 - 1 z0, z1 + 1 z1, y0, y1, x0, x1 from g, ext where z1 < nz
    union all select region_id, 'merge', 'y', z0, z1, y1 - 1, y1 + 1, x0, x1 from g, ext where y1 < ny
    union all select region_id, 'merge', 'x', z0, z1, y0, y1, x1 - 1, x1 + 1 from g, ext where x1 < nx""")(lambda t: regions.seams(grid(t)))
query("reg5_shuffled", GRID + " select region_id, cast(row_number() over (order by region_id * 7919 % 1009, region_id) as int) place from g")(
    lambda t: regions.shuffled(grid(t), F.col("region_id") * 7919 % 1009).select("region_id", F.row_number().over(Window.orderBy(F.col("region_id") * 7919 % 1009, "region_id")).alias("place"))
)
query("reg6_pyramid", "select z, y // 2 y, x // 2 x, round(avg(v), 6) v from fx_em group by all")(lambda t: regions.pyramid(t.fx_em, 1).select("z", "y", "x", *r6("v")))
query("reg6_pyramid_labels", """with c as (select z, cast(y // 4 as int) y, cast(x // 4 as int) x, label, count(*) n from fx_lbl group by all)
    select z, y, x, label from c qualify row_number() over (partition by z, y, x order by n desc, label) = 1""")(lambda t: regions.pyramid(t.fx_lbl, 2, "label", labels=True))
query("reg7_crop", GRID + " select z, y, x, v from fx_em, ext where z between 1 and nz - 2 and y between 2 and ny - 3 and x between 3 and nx - 4")(lambda t: regions.crop(t.fx_em.select("z", "y", "x", "v"), extent(t), PAD))
query("reg8_trim", PADDED + """ select p.region_id, e.z, e.y, e.x, e.v from p cross join ext join fx_em e on e.z >= z0 + case when z0 = 0 then 0 else 1 end and e.z < z1 - case when z1 = nz then 0 else 1 end
    and e.y >= y0 + case when y0 = 0 then 0 else 2 end and e.y < y1 - case when y1 = ny then 0 else 2 end and e.x >= x0 + case when x0 = 0 then 0 else 3 end and e.x < x1 - case when x1 = nx then 0 else 3 end""")(
    lambda t: regions.trimmed(regions.in_regions(t.fx_em.select("z", "y", "x", "v"), (p := regions.padded(grid(t), PAD, (e := extent(t)))), SPAN), p, PAD, e)
)
query("reg8_owned", GRID + " select g.region_id, e.z, e.y, e.x, e.v from g join fx_em e on e.z >= g.z0 and e.z < g.z1 and e.y >= g.y0 and e.y < g.y1 and e.x >= g.x0 and e.x < g.x1")(
    lambda t: regions.owned(regions.in_regions(t.fx_em.select("z", "y", "x", "v"), regions.padded(grid(t), PAD, extent(t)), SPAN), grid(t))
)
query("reg9_slices", "select z, y, x, v from fx_em where z in (0, 2, 4)")(lambda t: regions.slices(t.fx_em.select("z", "y", "x", "v"), range(0, 6, 2)))


@query("reg10_coordinates", "select z + 1100 z, y + 5440 y, x + 4400 x, v from fx_em")
def _(t):
    local = t.fx_em.select(regions.to_linear(25, 50).alias("i"), "v").select(*regions.from_linear("i", 25, 50), "v")
    return regions.to_global(local, {"z": 1100, "y": 5440, "x": 4400})


# Values

query("prj1_intensity", "select z, y, x, cast(round(255 * p) as int) v from fx_pt")(lambda t: t.fx_pt.select("z", "y", "x", values.to_intensity(F.col("p")).alias("v")))
query("prj2_band", "select z, count(*) filter (v between 50 and 200) kept, round(100 * (1 - count(*) filter (v between 50 and 200) / count(*)), 6) omitted_percent from fx_em group by z")(
    lambda t: values.band_report(t.fx_em, "v", 50, 200)
)
query("prj3_override", "select z, y, x, round(case when v > 220 then 0.0 when v < 30 then 1.0 else p.p end, 6) p, round(1 - case when v > 220 then 0.0 when v < 30 then 1.0 else p.p end, 6) p_not from fx_em join fx_pt p using (z, y, x)")(
    lambda t: values.override_trivial(t.fx_em.join(t.fx_pt, ["z", "y", "x"]), "v", 30, 220).select("z", "y", "x", *r6("p", "p_not"))
)
query("prj4_tails", "select z, y, x, v, v < 30 is_lower, v > 220 is_upper from fx_em")(lambda t: values.tails(t.fx_em.select("z", "y", "x", "v"), "v", 30, 220))
query("prj5_class_codes", "select p_partkey, p_size, cast(dense_rank() over (order by p_size) - 1 as int) code from part")(lambda t: values.encode_classes(t.part.select("p_partkey", "p_size"), "p_size"))


@query("prj5_class_codes_back", "select p_partkey, p_size from part")
def _(t):
    codes = values.class_codes(t.part, "p_size", 1)
    return values.decode_classes(values.encode_classes(t.part, "p_size", 1).select("p_partkey", "code"), codes, "p_size").select("p_partkey", "p_size")


query("prj6_inverted", "select z, y, x, case when t = 0 then 1 else 0 end label from fx_pt")(lambda t: t.fx_pt.select("z", "y", "x", values.inverted(F.col("t") * 255).alias("label")))
query("prj7_above", "select z, y, x, p >= 0.5 m from fx_pt")(lambda t: t.fx_pt.select("z", "y", "x", values.above(F.col("p"), 0.5).alias("m")))
query("prj8_clamped", "select z, y, x, least(255, greatest(0, v * 2 - 100)) v from fx_em")(lambda t: t.fx_em.select("z", "y", "x", values.clamped(F.col("v") * 2 - 100).alias("v")))
query("prj10_n_values", "select count(distinct v) - 1 n_values from fx_em")(lambda t: values.count_values(t.fx_em, "v"))
query("prj11_ids", "select distinct label from fx_lbl where label > 0")(lambda t: values.ids(t.fx_lbl))

#: Each pair of neighbouring slices is a seam.
FACING = "facing as (select cast(a.z as bigint) region_id, a.y u, a.x v, a.label a, b.label b from fx_lbl a join fx_lbl b on b.z = a.z + 1 and a.y = b.y and a.x = b.x)"


def seam_regions(t):
    return regions.seams(regions.grid(t.spark, extent(t), {"z": 1, **SLICE}))


def facing(t):
    return seam.planes(t.fx_lbl, seam_regions(t), "z")


@query("prj9_live_seams", f"with {FACING} select region_id from facing group by region_id having count(*) filter (a > 0) > 0 and count(*) filter (b > 0) > 0")
def _(t):
    return values.live_seams(facing(t).select("region_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("label")), F.struct(F.lit("b").alias("side"), F.col("b").alias("label")))).alias("s")).select("region_id", "s.*"))


# Stencils


def around(r: int, agg: str, cond: str = "true", src: str = "fx_em", cols: str = "v", how: str = "", join: str = "join", y="c.y + o.dy", x="c.x + o.dx", group: str = "c.z, c.y, c.x") -> str:
    """SQL of an aggregate over neighbours."""
    return f"""with d as (select unnest(range({-r}, {r + 1})) d), o as (select cast(p.d as int) dy, cast(q.d as int) dx from d p, d q where {cond.replace("dy", "p.d").replace("dx", "q.d")})
        select c.z, c.y, c.x, {agg} from {src} c cross join o {join} {src} e on e.z = c.z and e.y = {y} and e.x = {x} group by {group} {how}"""


MY = "case when c.y + o.dy < 0 then -1 - c.y - o.dy when c.y + o.dy >= 25 then 49 - c.y - o.dy else c.y + o.dy end"
MX = "case when c.x + o.dx < 0 then -1 - c.x - o.dx when c.x + o.dx >= 50 then 99 - c.x - o.dx else c.x + o.dx end"

query("stn1_median", around(4, "quantile_cont(coalesce(e.v, 0), 0.5) v", join="left join"))(lambda t: stencil.median(t.fx_em, 4))
query("stn2_median_mirror", around(2, "quantile_cont(e.v, 0.5) v", y=MY, x=MX))(lambda t: stencil.median(t.fx_em, 2, border="mirror", extent=YX))
query("stn3_dilate", around(3, "cast(max(e.v) as double) v", "dy * dy + dx * dx <= 9"))(lambda t: stencil.dilate(t.fx_em, stencil.disk(3)))
query("stn4_dilate_ball", around(3, "round(least(255.0, max(e.v + 3 * sqrt(1 - (o.dy * o.dy + o.dx * o.dx) / 9.0))), 6) v", "dy * dy + dx * dx <= 9"))(
    lambda t: stencil.dilate(t.fx_em, stencil.ball(3, 3.0), top=255).select("z", "y", "x", *r6("v"))
)
MASK = "(select z, y, x, v >= 128 m from fx_em)"


def mask(t):
    return t.fx_em.select("z", "y", "x", (F.col("v") >= 128).alias("m"))


query("stn5_binary_dilate", around(2, "bool_or(e.m) m", "abs(dy) + abs(dx) <= 2", MASK))(lambda t: stencil.binary_dilate(mask(t), stencil.diamond(2)))
query("stn6_binary_erode", around(1, "count(*) filter (e.m) = 5 m", "abs(dy) + abs(dx) <= 1", MASK))(lambda t: stencil.binary_erode(mask(t), stencil.diamond(1)))
query("stn7_label_interior", around(1, "count(*) filter (e.t = 1) = 9 inside", src="fx_pt", y=MY, x=MX))(lambda t: stencil.label_interior(t.fx_pt.select("z", "y", "x", F.col("t").alias("label")), 1, 1, YX))
query("stn8_local_contrast", around(3, "round(max(c.v) / nullif(stddev_pop(e.v) filter (o.dy <> 0 or o.dx <> 0), 0), 6) v"))(lambda t: stencil.local_contrast(t.fx_em, 7).select("z", "y", "x", *r6("v")))
query("stn10_tiles", around(2, "cast(sum(e.v * ((o.dy + 2) * 5 + o.dx + 3)) as bigint) weighed", how="having count(*) = 25"))(
    lambda t: stencil.tiles(t.fx_em, 2).select("z", "y", "x", F.aggregate(F.transform(F.flatten("tile"), lambda v, i: v * (i + 1)), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("weighed"))
)
query("stn11_z_neighbours", f"""with o as (select cast(unnest(range(-2, 3)) as int) channel), w as (select z, y, x, channel, case when z + channel >= {DEEP} then 2 * {DEEP} - 2 - z - channel when z + channel < 0 then -z - channel else z + channel end s from fx_em, o)
    select w.z, w.y, w.x, w.channel, e.v from w join fx_em e on e.z = w.s and e.y = w.y and e.x = w.x""")(lambda t: stencil.z_neighbours(t.fx_em, 2, extent(t)["z"]))
query("stn12_visible_regions")(lambda t: stencil.visible_regions(mask(t).select("z", "y", "x", F.col("m").cast("int").alias("label")), 3, 0))
query("pad1_mirrored", """with yy as (select cast(unnest(range(-3, 28)) as int) y), xx as (select cast(unnest(range(-3, 53)) as int) x)
    select e.z, yy.y, xx.x, e.v from yy, xx, fx_em e where e.y = case when yy.y < 0 then -1 - yy.y when yy.y >= 25 then 49 - yy.y else yy.y end and e.x = case when xx.x < 0 then -1 - xx.x when xx.x >= 50 then 99 - xx.x else xx.x end""")(
    lambda t: stencil.mirrored(t.fx_em.select("z", "y", "x", "v"), 3, YX)
)
query("pad1_zero_border", """with yy as (select cast(unnest(range(-3, 28)) as int) y), xx as (select cast(unnest(range(-3, 53)) as int) x)
    select e.z, yy.y, xx.x, case when yy.y between 0 and 24 and xx.x between 0 and 49 then e.v else 0 end v from yy, xx, fx_em e where e.y = case when yy.y < 0 then -1 - yy.y when yy.y >= 25 then 49 - yy.y else yy.y end and e.x = case when xx.x < 0 then -1 - xx.x when xx.x >= 50 then 99 - xx.x else xx.x end""")(
    lambda t: stencil.mirrored(t.fx_em.select("z", "y", "x", "v"), 3, YX, zero=True)
)
query("pad2_unpadded", "select z, y, x, v from fx_em")(lambda t: stencil.unpadded(stencil.mirrored(t.fx_em.select("z", "y", "x", "v"), 3, YX), 3, {"y": (-3, 28), "x": (-3, 53)}))

# Normalisation

CENTRED = "with w as (select z, y, x, v - avg(v) over (partition by z) v from fx_em)"
query("nrm1_slice", CENTRED + " select z, y, x, round(v / max(abs(v)) over (partition by z), 6) v from w")(lambda t: normalize.centred(t.fx_em).select("z", "y", "x", *r6("v")))
query("nrm2_global", CENTRED + " select z, y, x, round(v / max(abs(v)) over (), 6) v from w")(lambda t: normalize.centred(t.fx_em, scale="global").select("z", "y", "x", *r6("v")))
query("nrm3_contrast", """with w as (select z, y, x, v - avg(v) over (partition by z) v from fx_em), d as (select unnest(range(-3, 4)) d), o as (select cast(p.d as int) dy, cast(q.d as int) dx from d p, d q),
    l as (select c.z, c.y, c.x, max(c.v) / nullif(stddev_pop(e.v) filter (o.dy <> 0 or o.dx <> 0), 0) v from w c cross join o join w e on e.z = c.z and e.y = c.y + o.dy and e.x = c.x + o.dx group by c.z, c.y, c.x),
    k as (select z, y, x, case when v > 0.5 then 0.5 + ln(v) when v < -0.5 then -0.5 - ln(abs(v)) else v end v from l) select z, y, x, round(v / max(abs(v)) over (partition by z), 6) v from k""")(
    lambda t: normalize.compressed(stencil.local_contrast(normalize.less_mean(t.fx_em), 7), knee=0.5).select("z", "y", "x", *r6("v"))
)
query("nrm4_summary", """with m as (select z, v, avg(v) over (partition by z) a from fx_em) select z, round(avg(v), 6) mean, round(stddev_pop(v), 6) std, round(avg(power(v - a, 3)) / power(var_pop(v), 1.5), 6) skew,
    cast(min(v) as double) low, cast(max(v) as double) high, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.5) median, quantile_cont(v, 0.75) q3, round(100 * avg(case when v <> 0 then 1.0 else 0.0 end), 6) nonzero_percent from m group by z""")(
    lambda t: normalize.slice_summary(t.fx_em).select("z", *r6("mean", "std", "skew"), "low", "high", "q1", "median", "q3", *r6("nonzero_percent"))
)

# Aggregates and overlaps

query("agg1_regionprops", """select label, count(*) area, min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1, round(avg(z), 6) cz, round(avg(y), 6) cy, round(avg(x), 6) cx,
    cast(sum(z * 1250 + x * 25 + y) as bigint) pixel_sum from fx_lbl where label > 0 group by label""")(
    lambda t: regionprops.regionprops(t.fx_lbl).join(regionprops.index_sums(regionprops.voxel_runs(t.fx_lbl, 25, 50)), "label").select("label", "area", "z0", "z1", "y0", "y1", "x0", "x1", *r6("cz", "cy", "cx"), "pixel_sum")
)
RUNS = """with i as (select label, cast(z * 1250 + x * 25 + y as bigint) i from fx_lbl where label > 0), g as (select label, i, i // 512 part, i - row_number() over (partition by label, i // 512 order by i) gap from i),
    runs as (select label, part, min(i) "start", count(*) length from g group by label, part, gap)"""
query("agg1_voxel_runs", RUNS + ' select label, part, "start", length from runs')(lambda t: regionprops.voxel_runs(t.fx_lbl, 25, 50, span=512))
query("agg1_voxel_sets", RUNS + """ select label, part, cast(sum(length) as bigint) n, string_agg("start" || '+' || length, ',' order by "start") runs from runs group by label, part""")(
    lambda t: regionprops.voxel_sets(regionprops.voxel_runs(t.fx_lbl, 25, 50, span=512)).withColumn("runs", F.concat_ws(",", F.transform("runs", lambda r: F.concat_ws("+", r["start"], r["length"]))))
)
query("agg2_size_filter", "select z, y, x, case when label > 0 and count(*) over (partition by label) >= 22 then label else 0 end label from fx_lbl")(lambda t: regionprops.size_filter(t.fx_lbl, 22))
TABLE = f"with {FACING}, c as (select region_id, a, b, count(*) n from facing where a > 0 and b > 0 group by all)"
query("agg3_contingency", TABLE + " select * from c")(lambda t: regionprops.contingency(facing(t), ["region_id"]))
query("agg4_ranked", TABLE + " select *, cast(row_number() over (partition by region_id, a order by n desc, b) as int) rank from c")(lambda t: regionprops.ranked(regionprops.contingency(facing(t), ["region_id"]), ["region_id"]))
query("agg5_modal", TABLE + " select * from c qualify row_number() over (partition by region_id, a order by n desc, b) = 1")(lambda t: regionprops.modal(regionprops.contingency(facing(t), ["region_id"]), ["region_id"]))
DICE = TABLE + """, na as (select region_id, a, count(*) na from facing where a > 0 group by all), nb as (select region_id, b, count(*) nb from facing where b > 0 group by all),
    s as (select region_id, a, b, n, 2.0 * n / (na + nb) dice from c join na using (region_id, a) join nb using (region_id, b))"""


def area(f, c):
    return f.where(F.col(c) > 0).groupBy("region_id", c).agg(F.count("*").alias(f"n{c}"))


query("agg6_dice", DICE + " select region_id, a, b, n, round(dice, 6) dice from s")(
    lambda t: regionprops.dice(regionprops.contingency(f := facing(t), ["region_id"]), area(f, "a"), area(f, "b"), ["region_id"]).select("region_id", "a", "b", "n", *r6("dice"))
)
query("agg7_overlap_fraction", f"""with {FACING}, c as (select region_id, a, b, count(*) n from facing where a > 0 group by all)
    select region_id, a, b, n, round(n / sum(n) over (partition by region_id, a), 6) score from c qualify row_number() over (partition by region_id, a order by n desc, b) = 1""")(
    lambda t: regionprops.overlap_fraction(facing(t), ["region_id"], ignore_zeros=False).select("region_id", "a", "b", "n", *r6("score"))
)
query("agg8_recentred", "select label, cast(round(avg(z)) as int) z, cast(round(avg(y)) as int) y, cast(round(avg(x)) as int) x from fx_lbl where label > 0 group by label")(lambda t: regionprops.recentred(t.fx_lbl))
query("agg9_merge_counts", COMPONENTS + " select component, count(*) filter (node <> component) children from comp group by component")(lambda t: regionprops.merge_counts(graph.connected_components(t.fx_edges)))
query("agg9_totals", COMPONENTS + " select (select count(*) from comp where node = component) parents, (select count(*) from comp where node <> component) children, (select count(*) from comp) objects, (select count(*) from fx_edges) requested, (select count(*) from fx_edges where src = dst) failed")(
    lambda t: regionprops.merge_totals(graph.connected_components(t.fx_edges), t.fx_edges)
)
query("agg10_errors", """select count(*) filter (w) errors, round(avg(w::int), 6) error_rate, round(avg(-ln(case when t = 1 then q else 1 - q end)), 6) nll from (select t, p * 0.98 + 0.01 q, (case when p * 0.98 + 0.01 > 1 - (p * 0.98 + 0.01) then 1 else 0 end) <> t w from fx_pt)""")(
    lambda t: regionprops.classification_errors(t.fx_pt.select("t", F.array(1 - (F.col("p") * 0.98 + 0.01), F.col("p") * 0.98 + 0.01).alias("prob")), "prob", "t").select("errors", *r6("error_rate", "nll"))
)
query("agg11_nll_by_class", "select t, round(avg(-ln(case when t = 1 then p * 0.98 + 0.01 else 1 - (p * 0.98 + 0.01) end)), 6) nll from fx_pt group by t")(
    lambda t: regionprops.classification_errors(t.fx_pt.select("t", F.array(1 - (F.col("p") * 0.98 + 0.01), F.col("p") * 0.98 + 0.01).alias("prob")), "prob", "t", ["t"]).select("t", *r6("nll"))
)
query("agg12_histogram", "select z, cast(least(floor((v - 0.0) * 50 / 256.0), 49) as int) bin, count(*) n from fx_em group by all")(lambda t: regionprops.histogram(t.fx_em, "v", 0.0, 256.0, 50, ["z"]))
query("agg13_delta", "select min(d) low, max(d) high, round(avg(d), 6) mean, quantile_cont(d, 0.5) median from (select abs(v - n) d from fx_em)")(
    lambda t: regionprops.delta_summary(t.fx_em.select(regions.to_linear(25, 50).alias("i"), "v"), t.fx_em.select(regions.to_linear(25, 50).alias("i"), F.col("n").alias("v")), "i", "v").select("low", "high", *r6("mean"), "median")
)

# Labels

query("rel1_relabel", "select z, y, x, case when label = 0 then 0 else dense_rank() over (order by label) - (select count(*) from (select 1 from fx_lbl where label = 0 limit 1)) end label from fx_lbl")(lambda t: label.relabel(t.fx_lbl))
query("rel1_width", "select count(distinct label) n, case when count(distinct label) < 256 then 8 when count(distinct label) < 65536 then 16 else 32 end bits from fx_lbl where label > 0")(lambda t: label.renumbered(t.fx_lbl)[1])
query("rel2_relabel_slices", "with r as (select z, label, dense_rank() over (order by z, label) k from (select distinct z, label from fx_lbl where label > 0)) select z, y, x, coalesce(k, 0) label from fx_lbl left join r using (z, label)")(
    lambda t: label.relabel(t.fx_lbl, per_slice=True)
)
query("rel3_mapped", "select z, y, x, case when label % 5 = 0 then label // 5 else label end label from fx_lbl")(
    lambda t: label.mapped(t.fx_lbl, values.ids(t.fx_lbl).where("label % 5 = 0").select(F.col("label").alias("old"), F.floor(F.col("label") / 5).alias("new")))
)


def flood(near: str, src: str = "fx_fg") -> str:
    return f"""with recursive f as (select *, z * 1250 + x * 25 + y i from {src}), e as (select a.i a, b.i b from f a join f b on {near}),
        reach(node, cur) as (select i, i from f union select r.node, e.b from reach r join e on r.cur = e.a), c as (select node, min(cur) root from reach group by node)
        select f.z, f.y, f.x, dense_rank() over (order by root) label from f join c on c.node = f.i"""


query("rel4_components_26", flood("abs(a.z - b.z) <= 1 and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1"))(lambda t: label.components(t.fx_fg, 26, 25, 50))
query("rel5_components_18", flood("abs(a.z - b.z) <= 1 and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) <= 2"))(lambda t: label.components(t.fx_fg, 18, 25, 50))
query("rel6_components_4", flood("a.z = b.z and abs(a.y - b.y) + abs(a.x - b.x) <= 1"))(lambda t: label.components(t.fx_fg, 4, 25, 50))
query("rel7_detect_objects")(lambda t: label.detect_objects(t.fx_pt.select("z", "y", "x", "p"), 25, 50, threshold=0.55, low=5))
query("rel8_fill_background")(lambda t: label.fill_background(t.fx_lbl))
