"""Queries of voxel volumes beyond the first ones, on a grid whose planes grow with the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import views
from ..functions.views import SQL
from ..operators import blocks
from ..operators import detection as de
from ..operators import labelling as lb
from ..operators import morphology as mo
from ..operators import regions as r
from ..operators import volumes as v
from .registry import query
from .tables import cut

GRID = SQL["grid"]
FACES = "(values (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dz,dy,dx)"
SELF = "(values (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dz,dy,dx)"


def _steps(cells: str, offsets: str = FACES) -> str:
    """Cells with the places next to them as bz, by, bx."""
    return f"n as materialized (select a.*, z+dz as bz, y+dy as by, x+dx as bx from {cells} a, {offsets})"


THERE = "b.z=n.bz and b.y=n.by and b.x=n.bx"
ERODED = f"(with {_steps(GRID)} select n.z, n.y, n.x, n.label from n join {GRID} b on {THERE} and b.label=n.label where n.label<>0 group by all having count(*)=6)"


_grid = views.grid


def _labels(s, d, planes=False):
    return _grid(s, d, planes).select("z", "y", "x", "label")


@query(f"select z, y, 9-x as x, label from {GRID}")
def flipped_volume(s, d):
    return v.flipped(_labels(s, d), "x", 10)


@query(f"select y as z, z as y, x, label from {GRID}")
def transposed_volume(s, d):
    return v.transposed(_labels(s, d), "z", "y")


@query(f"select z, y, x, case when y>=1 and y<7 and x>=2 and x<10 then label else 0 end as label from {GRID}")
def truncated_labels(s, d):
    return v.truncated(_labels(s, d), {"y": (0.1, 0.75), "x": (0.25, 1.0)}, {"y": 10, "x": 10})


@query(f"select z-4 as z, y-1 as y, x as x, label from {GRID} where z>=4 and z<16 and y>=1 and y<8 and x>=-1 and x<7")
def cropped_volume(s, d):
    return v.cropped(_labels(s, d), (5, 2, 1), (10, 5, 4), (1, 1, 2))


@query(f"with g as (select * from {GRID}), e as (select min(z) as z0, max(z) as z1, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from g where label2=6) select z-greatest(z0-1,0) as z, y-greatest(y0-1,0) as y, x-greatest(x0-1,0) as x, case when label2=6 then 6 else 0 end as label from g, e where z between z0-1 and z1+1 and y between y0-1 and y1+1 and x between x0-1 and x1+1")
def cropped_to_labels(s, d):
    g = _grid(s, d).select("z", "y", "x", F.when(F.col("label2") == 6, 6).otherwise(0).alias("label"))
    return v.cropped_to_labels(g, 1)


@query(f"select z, y, x, label from {GRID} where z>=(select min(z) from {GRID} where label=1)")
def without_leading_planes(s, d):
    g = _labels(s, d).withColumn("mark", F.when(F.col("label") == 1, 1).otherwise(0))
    return v.without_leading_planes(g, "z", "mark").drop("mark")


@query(f"with g as (select * from {GRID}) select g.z, g.y, g.x, coalesce(b.label2,g.label) as label from g left join (select z+3 as z, y+2 as y, x+1 as x, label2 from g where y<4) b using (z, y, x)")
def placed_volume(s, d):
    g = _grid(s, d)
    return v.placed(g.select("z", "y", "x", "label"), g.filter("y < 4").select("z", "y", "x", F.col("label2").alias("label")), (3, 2, 1), "label")


@query(f"select z, y, x, case when atlas>30000 then label else 0 end as label from {GRID}")
def masked_labels(s, d):
    g = _grid(s, d)
    return v.masked(g.select("z", "y", "x", "label"), g.filter("atlas > 30000"))


@query(f"with g as (select * from {GRID}) select 'and' as how, count(*) as n from g where label=1 and y<5 union all select 'or', count(*) from g where label=1 or y<5 union all select 'xor', count(*) from g where (label=1)<>(y<5) union all select 'not', count(*) from g where label=1 and y>=5")
def mask_logic(s, d):
    g = cut(_labels(s, d))
    return v.mask_sizes(g.filter("label = 1"), g.filter("y < 5"))


@query(f"select z, y, x, label from {ERODED}")
def eroded_patches(s, d):
    return v.eroded(_labels(s, d), "label")


@query(f"select z+dz as z, y+dy as y, x+dx as x, min(label) as label from {ERODED}, {SELF} group by 1,2,3")
def opened_labels(s, d):
    return v.opened(_labels(s, d))


@query(f"with w as materialized (select distinct z+dz as z, y+dy as y, x+dx as x from {GRID}, {SELF} where label=2), {_steps('w', SELF)} select n.z, n.y, n.x from n join w b on {THERE} group by 1,2,3 having count(*)=7")
def closed_labels(s, d):
    return v.closed(_labels(s, d).filter("label = 2"))


@query(f"""with g as (select * from {GRID}), u as (select a.z, a.y, a.x, min(struct_pack(d:=sqrt((a.z-b.z)**2+(a.y-b.y)**2+(a.x-b.x)**2), z:=b.z, y:=b.y, x:=b.x, l:=b.label2)) as m from (select * from g where label2<5) a join (select * from g where label2>=5) b on b.z between a.z-14 and a.z+14 group by 1,2,3)
select g.z, g.y, g.x, coalesce(u.m.l, case when g.label2<5 then 0 else g.label2 end) as label from g left join u on u.z=g.z and u.y=g.y and u.x=g.x""")
def in_painted_labels(s, d):
    return v.in_painted(_grid(s, d).select("z", "y", "x", F.when(F.col("label2") < 5, 0).otherwise(F.col("label2")).alias("label")))


@query(f"with {_steps(GRID)} select distinct n.z, n.y, n.x from n join {GRID} b on {THERE} where (n.atlas-35000)*(b.atlas-35000)<0")
def zero_crossings(s, d):
    return v.zero_crossings(_grid(s, d).select("z", "y", "x", (F.col("atlas") - 35000).alias("value")), "value")


@query(f"with n as (select label, count(*) as size from {GRID} where label<>0 group by 1), e as (select label, count(*) as k from {ERODED} group by 1) select label, size, case when k>0.02*size then 1 else 0 end as radius, case when k>0.02*size then k else size end as kept from n left join e using (label)")
def erosion_table(s, d):
    return v.erosion_table(_labels(s, d), (1,), 0.02)


@query("select z+dz as z, y+dy as y, x+dx as x, max(blob_id) as blob_id from (select blob_id, z::int as z, y::int as y, x::int as x from {places}), " + SELF + " group by 1,2,3")
def painted_points(s, d):
    return v.painted(views.places(s, d), 1)


@query(f"""with {_steps(GRID)}, e as (select distinct n.z, n.y, n.x, n.label from n join {GRID} b on {THERE} where n.label<>0 and b.label<>n.label)
select label, sum(x)::double as edge_dist_sum, avg(x) as edge_dist_mean, count(*) as edge_size from e group by 1""")
def edge_distance_metrics(s, d):
    g = _labels(s, d)
    return r.edge_distances(v.edges(g), g.select("z", "y", "x", F.col("x").cast("double").alias("dist")))


@query(f"""with g as (select * from {GRID} where label<>0), i as (select g.*, e.label is not null as inside from g left join {ERODED} e using (z, y, x))
select label, stddev_pop(atlas) as var, stddev_pop(atlas) filter (inside) as var_in, stddev_pop(atlas) filter (not inside) as var_out, stddev_pop(atlas) filter (not inside)-stddev_pop(atlas) filter (inside) as var_diff, stddev_pop(atlas)/avg(atlas) as coef_var from i group by 1""")
def inside_outside_variation(s, d):
    g = _grid(s, d)
    return r.inside_outside(g, v.eroded(g, "label"), "atlas")


def _shape(label: str) -> str:
    return f"(select label, volume, surface from (select n.{label} as label, sum(1.0) as surface from n left join g b on {THERE} and b.{label}=n.{label} where n.{label}<>0 and b.z is null group by 1) join (select {label} as label, count(*) as volume from g group by 1) using (label))"


@query(f"""with g as (select * from {GRID}), {_steps('g')}, d as (select a.label, a.volume, b.volume as volume_new, a.surface, b.surface as surface_new from {_shape("label")} a left join {_shape("label2")} b using (label)),
w as (select label2 as label, count(*) filter (label<>label2) as away from g group by 1),
m as (select d.*, (surface**3/volume**2-surface_new**3/volume_new**2)/(surface**3/volume**2) as compaction, away/volume_new as displacement from d left join w using (label))
select label, volume::double as volume_orig, coalesce(volume_new,0)::double as volume, compaction, displacement, compaction-displacement as quality, surface**3/volume**2 as compactness_orig, surface_new**3/volume_new**2 as compactness, surface/volume as sa_to_vol_orig, surface_new/volume_new as sa_to_vol, (surface_new/volume_new)/(surface/volume) as sa_to_vol_frac from m""")
def smoothing_metrics(s, d):
    g = _grid(s, d).select("z", "y", "x", F.col("label").cast("long").alias("was"), F.col("label2").cast("long").alias("label"))
    shape = blocks.extents(g)
    before = mo.label_measures(g.select("z", "y", "x", F.col("was").alias("label")), shape=shape)
    return mo.smoothing_quality(before, mo.label_measures(g, shape=shape, was="was"), by=())


@query(f"select label, count(*) as volume from {GRID} where label<>2 and label not in (select label2 from {GRID} where y>=2 and label2<>1) group by 1")
def labels_lost_in_part(s, d):
    g = _grid(s, d)
    new = g.select("z", "y", "x", F.when((F.col("y") >= 2) & (F.col("label2") != 1), F.col("label2")).otherwise(2).alias("new"))
    return r.labels_lost(g.select("z", "y", "x", "label").join(new, ["z", "y", "x"]), "label", "new")


@query(f"with g as (select z, y, x, label from {GRID}) select tz as tile_z, ty as tile_y, z, y, x, label from g, (select unnest(generate_series(0,1)) as back), (select unnest(range(2)) as ty), lateral (select z//16-back as tz) where tz>=0 and z<tz*16+16+3 and y>=ty*6 and y<ty*6+6+1")
def tile_members(s, d):
    g = _labels(s, d)
    return v.tiles(g, (16, 6, 10), (3, 1, 0), (blocks.extents(g)[0], 10, 10)).select("tile_z", "tile_y", "z", "y", "x", "label")


@query()
def largest_components(s, d):
    return v.largest(lb.labelled(_labels(s, d), full=False)).groupBy("label").agg(F.count("*").alias("size"), F.min("component").alias("component"))


# ---- halo blocks: detection, preprocessing, smoothing ---------------------------------------------------------------------
#: Planted spots are 1.2 to 1.8 voxels wide.
SPOTS = de.Profile(min_sigma=1.0, max_sigma=2.2, sigmas=5, threshold=0.1, overlap=0.5)


def _spots(s, d):
    """The volume of spots, and its shape from their centres."""
    return views.spots(s, d), tuple(n + 4 if n else 0 for n in blocks.extents(views.spot_centres(s, d)))


@query()
def detected_points(s, d):
    volume, shape = _spots(s, d)
    return de.detected(volume, SPOTS, shape=shape)


TILE = "with g as (select z, y, x, atlas/100000 as v from {grid}), e as (select max(z)+1 as n from g), d as (select z//10 as t, z, y, x, coalesce(g.v,0) as v from (select unnest(range((select n from e)))::int as z) join (select unnest(range(10))::int as y) on true join (select unnest(range(10))::int as x) on true left join g using (z, y, x)),"


@query(TILE + """q as (select t, quantile_cont(v,0.05) as lo, quantile_cont(v,0.995) as hi from d group by 1),
s as materialized (select t, z, y, x, case when lo=hi then v else (least(greatest(v,lo),greatest(hi,0.45))-lo)/(greatest(hi,0.45)-lo) end as v from d join q using (t)),
k as (select k, exp(-k*k/8.0)/sum(exp(-k*k/8.0)) over () as w from (select unnest(generate_series(-8,8)) as k)),
c as materialized (select t, z, y, x, least(greatest(v,0),1) as v from s),
bx as materialized (select a.t, a.z, a.y, a.x, sum(w*b.v) as v from c a join k on true join c b on b.z=a.z and b.y=a.y and b.x=least(greatest(a.x+k,0),9) group by all),
cy as materialized (select a.t, a.z, a.y, a.x, sum(w*b.v) as v from bx a join k on true join bx b on b.z=a.z and b.x=a.x and b.y=least(greatest(a.y+k,0),9) group by all),
cz as materialized (select a.t, a.z, a.y, a.x, sum(w*b.v) as v from cy a join k on true join e on true join cy b on b.y=a.y and b.x=a.x and b.z=least(greatest(a.z+k,a.t*10),least(a.t*10+9,n-1)) group by all),
u as materialized (select c.t, c.z, c.y, c.x, 2*c.v-0.3*cz.v as v from c join cz using (t, z, y, x)),
o as (select * from (values (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dz,dy,dx)),
r as (select a.t, a.z, a.y, a.x, min(b.v) as least from u a join o on true join u b on b.t=a.t and b.z=a.z+dz and b.y=a.y+dy and b.x=a.x+dx group by all),
m as (select t, avg(v) as mean from s group by 1)
select z, y, x, case when mean>0.2 then least else u.v end as value from u join r using (t, z, y, x) join m using (t) where t in (select z//10 from g)""")
def preprocessed_volume(s, d):
    g = _grid(s, d).select("z", "y", "x", (F.col("atlas") / 100000).alias("value"))
    return de.preprocessed(g, de.Profile(blur=2.0), 0.9, tile=(10, 10, 10))


@query()
def smoothed_labels(s, d):
    return mo.smoothed_labels(_labels(s, d, planes=True), [1, 2], small=500)


@query()
def smoothing_sweep(s, d):
    return mo.smoothing_sweep(_labels(s, d, planes=True), [1, 2, 3], small=500)[0]


@query()
def adaptive_smoothing(s, d):
    return mo.smoothing_sweep(_labels(s, d, planes=True), [1, 2], mode="adaptive_opening")[1]


@query(f"""with g as (select * from {GRID}), o as (select 2.0*count(*) filter (atlas>30000 and label<>0)/(count(*) filter (atlas>30000)+count(*) filter (label<>0)) as dsc, count(*) filter (atlas>30000) as volume_atlas, count(*) filter (label<>0) as volume_labels from g),
w as (select * from g where atlas>20000), f as (select count(*) as faces from w a join {FACES} on true left join w b on b.z=a.z+dz and b.y=a.y+dy and b.x=a.x+dx where b.z is null)
select o.*, faces::double**3/(select count(*) from w)::double**2 as compactness from o, f""")
def refinement_row(s, d):
    return mo.refinement_row(_grid(s, d), "atlas", "label", 30000, 20000)


BALL = "(select a as dz, b as dy, c as dx from unnest(range(-2,3)) t(a), unnest(range(-2,3)) u(b), unnest(range(-2,3)) w(c) where a*a+b*b+c*c<=4)"


@query(f"""with g as (select z, y, x, case when label2>=6 then label2 else 0 end as label, atlas from {GRID}), e as (select min(z) as z0, max(z) as z1, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from g where label<>0),
n as (select distinct z+dz as z, y+dy as y, x+dx as x from g join {BALL} on label<>0)
select z-greatest(z0-1,0) as z, y-greatest(y0-1,0) as y, x-greatest(x0-1,0) as x, label, case when n.z is null then 0 else atlas end as atlas from g join e on z between z0-1 and z1+1 and y between y0-1 and y1+1 and x between x0-1 and x1+1 left join n using (z, y, x) where label<>0 or n.z is not null""")
def extracted_labels(s, d):
    g = _grid(s, d).withColumn("label", F.when(F.col("label2") >= 6, F.col("label2")).otherwise(0))
    return mo.extracted_labels(g, "atlas", radius=2, padding=1)


@query("select sample, channel, least(round_even(z*0.5,0)::int,24) as z, least(round_even(y*0.5,0)::int,4) as y, least(round_even(x*0.5,0)::int,3) as x, count(*) as n from {voxels} group by all")
def density_by_sample(s, d):
    return r.heat_map(views.voxels(s, d), (0.5, 0.5, 0.5), (25, 5, 4), ["sample", "channel"])


@query()
def detection_grid(s, d):
    volume, shape = _spots(s, d)
    return de.detection_grid(volume, views.spot_centres(s, d), SPOTS, [0.05, 0.15, 0.25], [0.1, 0.5], (2.0, 2.0, 2.0), shape=shape)
