"""Queries over the general categories: order, limits, sets, grouping sets, windows, scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.functions import scalars
from voxloom.operators import regionprops
from voxloom.plans.registry import query

query("cat_top_k", "with a as (select z, label, count(*) n from fx_lbl where label > 0 group by all) select z, label, n from a qualify row_number() over (partition by z order by n desc, label) <= 3")(
    lambda t: t.fx_lbl.where("label > 0").groupBy("z", "label").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("z").orderBy(F.desc("n"), "label"))).where("k <= 3").drop("k")
)
SETS = "with a as (select distinct y, x from fx_lbl where z % 2 = 0 and label > 0), b as (select distinct y, x from fx_lbl where z % 2 = 1 and label > 0)"


def two(t):
    """Where labels lie in slices of even and of odd number."""
    return (t.fx_lbl.where(f"z % 2 = {k} and label > 0").select("y", "x").distinct() for k in (0, 1))


query("cat_union", SETS + " select * from a union select * from b")(lambda t: (lambda a, b: a.unionByName(b).distinct())(*two(t)))
query("cat_intersect", SETS + " select * from a intersect select * from b")(lambda t: (lambda a, b: a.intersect(b))(*two(t)))
query("cat_except", SETS + " select * from a except select * from b")(lambda t: (lambda a, b: a.exceptAll(b))(*two(t)))
query("cat_rollup", "select z, bin, count(*) n, sum(t)::bigint pos from (select z, cast(least(floor(p * 10), 9) as int) bin, t from fx_pt) group by rollup(z, bin)")(
    lambda t: t.fx_pt.select("z", F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin"), "t").rollup("z", "bin").agg(F.count("*").alias("n"), F.sum("t").cast("bigint").alias("pos"))
)
query("cat_growing_prefix", """with c as (select z, label, count(*) n from fx_lbl where label > 0 group by all) select z, label, cast(sum(n) over (partition by z order by n desc, label rows unbounded preceding) as bigint) grown from c""")(
    lambda t: t.fx_lbl.where("label > 0").groupBy("z", "label").agg(F.count("*").alias("n")).select("z", "label", F.sum("n").over(Window.partitionBy("z").orderBy(F.desc("n"), "label").rowsBetween(Window.unboundedPreceding, 0)).alias("grown"))
)
query("cat_math", "select z, y, x, round((v - 128) / 2.0) half, round(sqrt(v), 6) root, round(ln(v + 1), 6) log, abs(v - n) gap, v % 7 rest, round(power(p.p, 3), 6) cube from fx_em join fx_pt p using (z, y, x)")(
    lambda t: t.fx_em.join(t.fx_pt, ["z", "y", "x"]).select(
        "z", "y", "x", scalars.round_away((F.col("v") - 128) / F.lit(2.0)).alias("half"), F.round(F.sqrt("v"), 6).alias("root"), F.round(F.log(F.col("v") + 1), 6).alias("log"),
        F.abs(F.col("v") - F.col("n")).alias("gap"), (F.col("v") % 7).alias("rest"), F.round(F.pow("p", F.lit(3)), 6).alias("cube"),
    )
)
query("cat_arrays", "select vec_id, label, round(embedding[2]::double, 6) first_of_column, round(embedding[57]::double, 6) last_row_first, round(embedding[1]::double - embedding[64]::double, 6) ends from embeddings")(
    lambda t: t.embeddings.withColumn("g", scalars.reshaped(F.col("embedding"), 8)).select(
        "vec_id", "label", F.round(scalars.transposed(F.col("g"))[1][0].cast("double"), 6).alias("first_of_column"), F.round(F.reverse("g")[0][0].cast("double"), 6).alias("last_row_first"),
        F.round(F.flatten("g")[0].cast("double") - F.flatten(F.reverse("g"))[7].cast("double"), 6).alias("ends"),
    )
)
query("cat_strings", "select label id, 'seg_' || lpad(label::varchar, greatest(6, length(label::varchar))::int, '0') as token, count(*) area from fx_lbl where label > 0 group by label")(
    lambda t: regionprops.regionprops(t.fx_lbl).select(F.col("label").alias("id"), scalars.token_of("seg", F.col("label")).alias("token"), "area")
)
