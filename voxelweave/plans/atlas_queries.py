"""Queries of components and holes, and of composed region jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import views
from ..functions.views import SQL
from ..operators import atlases as a
from ..operators import hierarchy as h
from ..operators import labelling as lb
from ..operators import matching as m
from ..operators import regions as r
from ..operators import tables as t
from ..operators import volumes as v
from .registry import query
from .tables import cut

GRID = SQL["grid"]
#: The grid with a count of nuclei at each voxel and three segments along an axis.
HEATED = f"(select *, floor(atlas/10000)::int as heat, x//4 as segment from {GRID})"


def _heated(s, d):
    return cut(views.grid(s, d)).withColumns({"heat": F.floor(F.col("atlas") / 10000).cast("int"), "segment": F.floor(F.col("x") / 4).cast("int")})


def _closed(s, d):
    return h.closure(views.ontology(s, d))


@query()
def carved_volume(s, d):
    return lb.carved(views.grid(s, d).select("z", "y", "x", "atlas"), "atlas", most=20)


@query()
def components_over_size(s, d):
    return lb.components_over(views.grid(s, d), "atlas", 38000.0, 20)


@query(f"select z, y, x, label2::bigint as label from {GRID} where label<>0 and label2<>0")
def cropped_to_original(s, d):
    g = views.grid(s, d)
    return lb.cropped_to_original(g.select("z", "y", "x", F.col("label2").alias("label")), g.select("z", "y", "x", "label"), 0)


VARIED = f"""with g as (select * from {HEATED} where label<>0), e as (select a.z, a.y, a.x from g a join (values (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dz,dy,dx) on true join g b on b.z=a.z+dz and b.y=a.y+dy and b.x=a.x+dx and b.label=a.label group by all having count(*)=6),
i as (select g.*, e.z is not null as inside from g left join e using (z, y, x)),
s as (select label, segment, count(*) as volume, stddev_pop(atlas) as var_intensity, avg(atlas) as mean_intensity, stddev_pop(atlas)/avg(atlas) as coef_var_intensity, stddev_pop(atlas) filter (inside) as var_intensity_in, stddev_pop(atlas) filter (not inside) as var_intensity_out,
abs(stddev_pop(atlas) filter (not inside)-stddev_pop(atlas) filter (inside)) as var_intensity_match, stddev_pop(atlas) filter (not inside)-stddev_pop(atlas) filter (inside) as var_intensity_diff,
sum(heat) as nuclei, stddev_pop(heat) as var_nuclei, avg(heat) as mean_nuclei, case when avg(heat)<>0 then stddev_pop(heat)/avg(heat) end as coef_var_nuclei, stddev_pop(heat) filter (inside) as var_nuclei_in, stddev_pop(heat) filter (not inside) as var_nuclei_out, abs(stddev_pop(heat) filter (not inside)-stddev_pop(heat) filter (inside)) as var_nuclei_match,
quantile_cont(atlas,0.5) as median_intensity, quantile_cont(atlas,0.05) as low_intensity, quantile_cont(atlas,0.95) as high_intensity from i group by 1,2)"""
MEANS = [m for m, w in a.ROLL_UP.items() if w in ("volume", "nuclei") and m != "entropy_intensity"]
ROLLED = ", ".join(f"nullif(sum({m}*{a.ROLL_UP[m]})/nullif(sum({a.ROLL_UP[m]}),0),0) as {m}" for m in MEANS)


@query(f"{VARIED} select label, sum(volume)::bigint as volume, sum(nuclei)::bigint as nuclei, {ROLLED} from s group by 1")
def region_variation(s, d):
    g = _heated(s, d)
    return a.region_variation(g, "atlas", "segment", "heat", v.eroded(g, "label"))


@query(f"{VARIED}, l as (select label, sum(volume)::bigint as volume, sum(nuclei)::bigint as nuclei, {ROLLED} from s group by 1) select ancestor as id, sum(volume)::bigint as volume, sum(nuclei)::bigint as nuclei, {ROLLED} from {{closure}} join l on descendant=label group by 1")
def region_variation_of_parents(s, d):
    g = _heated(s, d)
    leaves = a.region_variation(g, "atlas", "segment", "heat", v.eroded(g, "label"))
    return a.rolled_up_to_parents(leaves, _closed(s, d))


OVERLAPS = f"""l as (select distinct label from g where label<>0), o as (select l.label, count(*) filter (g.label=l.label) as volume, count(*) filter (g.label2=l.label) as volume_alt, 2.0*count(*) filter (g.label=l.label and g.label2=l.label)/(count(*) filter (g.label=l.label)+count(*) filter (g.label2=l.label)) as volume_dsc, count(*) filter (g.label2=l.label and g.label<>l.label) as volume_out,
sum(heat) filter (g.label=l.label) as nuclei, 2.0*coalesce(sum(heat) filter (g.label=l.label and g.label2=l.label),0)/(sum(heat) filter (g.label=l.label)+coalesce(sum(heat) filter (g.label2=l.label),0)) as nuclei_dsc, coalesce(sum(heat) filter (g.label2=l.label and g.label<>l.label),0) as nuclei_out from l, g group by 1)"""


@query(f"with g as (select * from {HEATED}), {OVERLAPS} select label, volume, volume_alt, volume_dsc, volume_out, nuclei::bigint as nuclei, nuclei_dsc, nuclei_out::bigint as nuclei_out from o")
def label_overlaps(s, d):
    return a.label_overlaps(_heated(s, d), "label", "label2", "heat")


@query(f"""with h as (select * from {HEATED} where y between 1 and 7 and atlas>15000), g as (select z, y, x, heat, label, case when label2=6 then 1 when label2=2 then 2 when label2=7 then 2 else 0 end as label2 from h), {OVERLAPS}
select ancestor as id, sum(volume)::bigint as volume, sum(volume_alt)::bigint as volume_alt, sum(volume_out)::bigint as volume_out, sum(nuclei)::bigint as nuclei, sum(nuclei_out)::bigint as nuclei_out, sum(volume_dsc*volume)/sum(volume) as volume_dsc, sum(nuclei_dsc*nuclei)/sum(nuclei) as nuclei_dsc from {{closure}} join o on descendant=label group by 1""")
def compared_atlases(s, d):
    g = _heated(s, d)
    pairs = s.createDataFrame([(6, 1), (2, 2), (7, 2)], "from_label long, to_label long")
    return a.compared_atlases(g, g.withColumn("label", F.col("label2")), _closed(s, d), g.select("z", "y", "x", F.col("heat").alias("n")), ("y", 1, 8), g.filter("atlas > 15000"), (None, pairs), parents=True)


#: Regions 0, 1 and 2 stand for the whole and two parts outside of the tissue.
DEVELOPED = "(select sample, condition, region::bigint as region, volume, sample%4+10 as age from {metrics})".replace("{metrics}", SQL["metrics"])


@query(f"""with d as (select age, condition, region, sum(volume) as value from {DEVELOPED} group by all), b as (select age, condition, sum(value) filter (region=0)-coalesce(sum(value) filter (region in (1,2)),0) as base from d where region in (0,1,2) group by 1,2)
select age, condition, region, n_name as name, 2 as level, value, base, case when region not in (1,2,3) then value/base end as fraction from d left join b using (age, condition) left join nation on n_nationkey=region""")
def development_table(s, d):
    m = views.metrics(s, d).withColumn("region", F.col("region").cast("long"))
    ages = m.select("sample").distinct().withColumn("age", F.col("sample") % 4 + 10)
    regions = views.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(2).alias("level"))
    closed = s.createDataFrame([(1, 1), (1, 3), (2, 2)], "ancestor long, descendant long")  # region 3 is below region 1 here
    return a.development(m, ages, regions, "volume", 0, [1, 2], closed)


@query("""with v as (select region, sum(volume) as volume, avg(volume) filter (condition='F') as f, avg(volume) filter (condition='O') as o, avg(nuclei) filter (condition='F') as nf, avg(nuclei) filter (condition='O') as no from {metrics} group by 1)
select region, volume, f as intensity_F, o as intensity_O, f/volume as intensity_density_F, o/volume as intensity_density_O, nf as nuclei_F, no as nuclei_O, nf/volume as nuclei_density_F, no/volume as nuclei_density_O from v""")
def intensity_and_nuclei(s, d):
    m = views.metrics(s, d)
    means = lambda c: m.groupBy("region").agg(F.sum("volume").alias("volume"), *[F.avg(F.when(F.col("condition") == x, F.col(c))).alias(f"{x}_mean") for x in "FO"])
    return a.side_by_side({"intensity": means("volume"), "nuclei": means("nuclei")}, "region", "volume")


# ---- small table and store operators -------------------------------------------------------------------------------------
@query("select sample, region, condition, volume*w/max(w) over () as bar, nuclei*w/max(w) over () as bar_error from (select *, region+1 as w from {metrics})")
def weighted_errors(s, d):
    return t.weighted_bars(views.metrics(s, d).withColumn("w", F.col("region") + 1), "volume", "w", "nuclei").select("sample", "region", "condition", "bar", "bar_error")


@query("select volume::double as volume, count(*) as n from (select floor(volume/1000)/10 as volume from {metrics}) group by 1")
def volumes_by_key(s, d):
    m = views.metrics(s, d).withColumn("volume", F.floor(F.col("volume") / 1000) * 0.1)
    return m.groupBy(t.shortened(F.col("volume"), 6).alias("volume")).agg(F.count("*").alias("n"))


@query("with e as (select region, avg(volume) filter (condition='O')-avg(volume) filter (condition='F') as effect from {metrics} group by 1) select n_nationkey::bigint as region, n_name as name, sign(effect)::int as sign from nation join e on region=n_nationkey where region%2=0")
def regions_with_effects(s, d):
    m = views.metrics(s, d).filter("region % 2 = 0")
    e = m.groupBy("region").agg((F.avg(F.when(F.col("condition") == "O", F.col("volume"))) - F.avg(F.when(F.col("condition") == "F", F.col("volume")))).alias("effect"))
    n = views.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("region"), F.col("n_name").alias("name"))
    return t.with_effects(n, e, "region", "effect")


@query("select distinct id from (select id from {ontology} union all select -id from {ontology})")
def ids_of_both_sides(s, d):
    return h.mirrored_ids(views.ontology(s, d), True)


@query("with g as (select z//100 as part, z, max((label2>=5)::int) as p from {grid} where y>=1 and z%100 between 10 and 80 group by 1,2) select part, 1-sum(p)/count(*) as unlabeled from g group by 1")
def unlabeled_planes(s, d):
    g = views.grid(s, d).filter("y >= 1 and z % 100 between 10 and 80").withColumns({"part": F.floor(F.col("z") / 100), "on": (F.col("label2") >= 5).cast("int")})
    return r.unlabeled_planes(g, "on", "z", (0, 2**30), ["part"])


@query("with e as (select label, count(*) as edge_size, sum(x)::double as edge_dist_sum, avg(x) as edge_dist_mean from {grid} where label<>0 group by 1) select 1 as part, sum(edge_size)::bigint as edge_size, sum(edge_dist_sum*edge_size) as edge_dist_sum, sum(edge_dist_mean*edge_size)/sum(edge_size) as edge_dist_mean, 'all' as label from e")
def edge_total(s, d):
    e = views.grid(s, d).filter("label <> 0").groupBy("label").agg(F.count("*").alias("edge_size"), F.sum("x").cast("double").alias("edge_dist_sum"), F.avg("x").alias("edge_dist_mean")).withColumn("part", F.lit(1))
    return r.edge_total(e, ["part"])


@query("select o_orderpriority||'.tif' as name, count(*) as n from orders where o_orderpriority='2-HIGH' group by 1")
def experiments_by_name(s, d):
    e = views.read(s, d, "orders").groupBy(F.concat("o_orderpriority", F.lit(".tif")).alias("name")).agg(F.count("*").alias("n"))
    return m.experiments_named(e, "2-HIGH.czi", False)


@query("""with b as (select s_suppkey%3 as store, s_suppkey::bigint as roi_id, s_nationkey as experiment, s_suppkey%2 as z0 from supplier), f as (select experiment, z0, min((store, roi_id)) as f from b group by 1,2),
p as (select b.store, b.roi_id, f.f from b join f using (experiment, z0)) select (select count(*) from f) as boxes, count(*) as points, count(distinct f) as boxes_with_points from p join {places} q on q.blob_id%(select count(*) from supplier)=p.roi_id-(select min(s_suppkey) from supplier)""")
def stores_in_one(s, d):
    k = F.col("s_suppkey")
    boxes = views.read(s, d, "supplier").select((k % 3).alias("store"), k.cast("long").alias("roi_id"), F.col("s_nationkey").alias("experiment"), (k % 2).alias("z0"), F.lit(0).alias("y0"), F.lit(0).alias("x0"))
    ends = views.read(s, d, "supplier").agg(F.count("*").alias("c"), F.min("s_suppkey").alias("low"))
    points = views.places(s, d).crossJoin(F.broadcast(ends)).select((F.col("blob_id") % F.col("c") + F.col("low")).cast("long").alias("roi_id"), "blob_id").join(boxes.select("store", "roi_id"), "roi_id")
    links = points.select("store", "roi_id", F.col("blob_id").alias("a"), F.col("blob_id").alias("b"))
    kept, moved, _ = m.merged_boxes(boxes, points, links)
    n = moved.join(kept.select("roi_id"), "roi_id").agg(F.count("*").alias("points"), F.count_distinct("roi_id").alias("boxes_with_points"))
    return kept.agg(F.count("*").alias("boxes")).crossJoin(F.broadcast(n))  # one row each
