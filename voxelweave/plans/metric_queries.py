"""Queries of region metrics, metric tables and statistics beyond the first ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import views
from ..functions.views import SQL
from ..operators import hierarchy as h
from ..operators import models as mo
from ..operators import regions as r
from ..operators import stats as st
from ..operators import tables as t
from .registry import query

PAIR = ("F", "O")
BASE = "(select sample, region, condition, sum(volume) as volume, sum(nuclei) as nuclei from {metrics} group by 1,2,3)".replace("{metrics}", SQL["metrics"])
RANK = "rank() over (partition by region order by {v})+(count(*) over (partition by region, {v})-1)/2"
PAIRED = f"(select sample, region, min(volume) filter (condition='F') as v1, min(volume) filter (condition='O') as v2 from {BASE} group by 1,2 having v1 is not null and v2 is not null)"


def _base(s, d):
    return views.metrics(s, d).groupBy("sample", "region", "condition").agg(F.sum("volume").alias("volume"), F.sum("nuclei").alias("nuclei"))


def _tree(s, d):
    tree = views.ontology(s, d)
    return tree, h.closure(tree)


# ---- regions ---------------------------------------------------------------------------------------------------------
@query("select p.blob_id, v.label from {places} p left join (select z, y, x, min(label) as label from {voxels} group by 1,2,3) v on v.z=trunc(p.z*0.9)::int and v.y=trunc(p.y*0.05)::int and v.x=trunc(p.x*0.018)::int")
def point_labels(s, d):
    v = views.voxels(s, d).groupBy("z", "y", "x").agg(F.min("label").alias("label"))
    return r.point_labels(views.places(s, d).select("blob_id", "z", "y", "x"), v, (0.9, 0.05, 0.018)).select("blob_id", "label")


@query("""with v as (select sample, label, count(*) as volume, sum(atlas) as intensity, stddev_pop(atlas) as std, avg(atlas) as mean, quantile_cont(atlas,0.5) as median, quantile_cont(atlas,0.05) as low, quantile_cont(atlas,0.95) as high from {voxels} group by 1,2),
n as (select sample, label, count(*) as nuclei from {voxels} where channel=1 group by 1,2), e as (select sample, label, sum(x)::double as edge_dist_sum, avg(x) as edge_dist_mean, count(*) as edge_size from {voxels} where z<5 group by 1,2)
select v.*, coalesce(nuclei,0) as nuclei, edge_dist_sum, edge_dist_mean, edge_size, coalesce(nuclei,0)/volume as density from v left join n using (sample,label) left join e using (sample,label)""")
def region_metrics(s, d):
    v = views.voxels(s, d)
    return r.region_metrics(v, v.filter("channel = 1"), v.filter("z < 5").withColumn("dist", F.col("x").cast("double")), ["sample", "label"])


@query("""with m as (select case when condition='P' then -region-1 else region+1 end as region, volume, nuclei from {metrics}) select abs(region) as region, sum(volume) as volume, sum(nuclei) as nuclei, case when sum(volume)<>0 then sum(nuclei)/sum(volume) end as density from m group by 1""")
def combined_sides(s, d):
    k = F.col("region") + 1
    m = views.metrics(s, d).withColumn("region", F.when(F.col("condition") == "P", -k).otherwise(k))
    return r.combined_sides(m, ["region"])


@query("with m as (select avg(atlas) as a, avg(z) as b from {voxels}) select 2*count(*) filter (atlas>a and z>b)/(count(*) filter (atlas>a)+count(*) filter (z>b)) as dsc, count(*) filter (atlas>a) as size_a, count(*) filter (z>b) as size_b from {voxels}, m")
def thresholded_overlap(s, d):
    return r.thresholded_overlap(views.voxels(s, d), "atlas", "z")


@query("select 2*count(*) filter (label%7=label2%7 and label%7<>0)/(count(*) filter (label%7<>0)+count(*) filter (label2%7<>0)) as dsc from {voxels}")
def mean_label_overlap(s, d):
    v = views.voxels(s, d).select((F.col("label") % 7).alias("a"), (F.col("label2") % 7).alias("b"))
    return r.mean_label_overlap(v, "a", "b")


@query("with m as (select region, avg(volume) filter (condition='P')-avg(volume) filter (condition='F') as value from {metrics} group by 1) select sample, z, y, x, label, value from {voxels} left join m on region=abs(label) where channel=0")
def region_change_map(s, d):
    v = views.voxels(s, d).filter("channel = 0").select("sample", "z", "y", "x", "label")
    return r.value_map(v, views.metrics(s, d), "volume", "condition")


@query("with m as (select region, median(volume) as value from {metrics} group by 1) select sample, label, avg(value) as value from {voxels} left join m on region=abs(label) group by 1,2")
def region_value_map(s, d):
    v = views.voxels(s, d).select("sample", "label")
    med = lambda c: F.percentile(c, F.lit(0.5))
    return r.value_map(v, views.metrics(s, d), "volume", fn=med).groupBy("sample", "label").agg(F.avg("value").alias("value"))


@query("select label, " + ", ".join(f"round_even({f}({c})/{k},0)::int as {c}_{n}" for c, k in (("z", 5.0), ("y", 2.0), ("x", 0.5)) for n, f in (("min", "min"), ("max", "max"), ("mid", "avg"))) + " from {voxels} group by 1")
def scaled_boxes(s, d):
    return r.scaled_boxes(r.boxes(views.voxels(s, d), "label"), (5.0, 2.0, 0.5)).drop("volume", "z_extent", "y_extent", "x_extent")


@query("with c as (select trunc(avg(z))::int as cz, trunc(avg(y))::int as cy, trunc(avg(x))::int as cx from {voxels}) select distinct z, y, x, sqrt((z-cz)**2+(y-cy)**2+(x-cx)**2) as radial from {voxels}, c where label2=1")
def radial_distances(s, d):
    v = views.voxels(s, d)
    return r.radial_distance(v.filter("label2 = 1").select("z", "y", "x").distinct(), v.agg(*[F.avg(c).alias(c) for c in r.CELL]))


@query("""with m as (select channel, z, quantile_cont(atlas,0.005) as a, quantile_cont(atlas,0.995) as b from {voxels} group by 1,2) select channel, min(a) as near_min, max(b) as near_max from m group by 1""")
def plane_bounds(s, d):
    from ..operators.ranks import quantiles

    planes = quantiles(views.voxels(s, d), ["channel", "z"], "atlas", {"near_min": 0.005, "near_max": 0.995})
    return r.merged_bounds(planes, "channel")


@query("""with v as (select *, z//10 as tile from {voxels}), k as (select channel, quantile_cont(atlas,0.995) as near_max from v group by 1), b as (select channel, tile, quantile_cont(atlas,0.05) as lo, quantile_cont(atlas,0.995) as hi from v group by 1,2), e as (select channel, tile, lo, case when lo=hi then hi else greatest(hi,0.9*near_max) end as hi from b join k using (channel))
select sample, channel, z, y, x, case when lo=hi then atlas else (least(greatest(atlas,lo),hi)-lo)/(hi-lo) end as atlas from v join e using (channel, tile)""")
def saturated(s, d):
    from ..operators.ranks import quantiles

    v = views.voxels(s, d).select("sample", "channel", "z", "y", "x", "atlas", F.floor(F.col("z") / 10).alias("tile"))
    top = quantiles(v, ["channel"], "atlas", {"near_max": 0.995})
    return r.saturated(v, ["channel", "tile"], "atlas", top, 0.9).drop("tile")


@query("""with e as (select min(atlas) as lo, max(atlas) as hi from {voxels}), h as (select least(floor((atlas-lo)/(hi-lo)*64),63)::int as bin, count(*) as n from {voxels}, e group by 1),
c as (select bin, sum(n) over (order by bin) as w0, sum(n*(bin+0.5)) over (order by bin) as s0, sum(n) over () as w, sum(n*(bin+0.5)) over () as s from h)
select lo+(bin+0.5)/64*(hi-lo) as threshold from e, (select arg_max(bin, w0*(w-w0)*(s0/w0-(s-s0)/(w-w0))**2) as bin from c where w0<w)""")
def otsu_threshold(s, d):
    return r.otsu(views.voxels(s, d), "atlas", 64)


# ---- hierarchy -------------------------------------------------------------------------------------------------------
@query("select o.id, o.name, o.level, coalesce(p.p,0) as parent from {ontology} o left join (select descendant, arg_min(ancestor,depth) as p from {closure} where depth>0 group by 1) p on p.descendant=o.id")
def region_table(s, d):
    tree, closed = _tree(s, d)
    up = h.parent_at_most(tree.select(F.col("id").alias("label")), tree, closed, None)
    return tree.join(up, tree.id == up.label).select("id", "name", "level", F.col("parent_label").alias("parent"))


@query("select id, name, level, parent from {ontology} where name='NATION_3'")
def region_search(s, d):
    return views.ontology(s, d).filter("name = 'NATION_3'")


@query("select distinct label, name || case when label%2=0 then ' (R)' else ' (L)' end as name from (select distinct label from {voxels}) join {ontology} on id=label")
def drawn_labels(s, d):
    tree = views.ontology(s, d)
    signed = F.when(F.col("label") % 2 == 0, F.col("label")).otherwise(-F.col("label"))
    return views.voxels(s, d).select("label").distinct().join(tree, F.col("label") == tree.id).select("label", h.side_name(F.col("name"), signed).alias("name"))


@query("select n_nationkey as region, n_name as name, volume from nation right join (select region, sum(volume) as volume from {metrics} group by 1) on region=n_nationkey")
def named_metrics(s, d):
    n = views.read(s, d, "nation").select(F.col("n_nationkey").alias("region"), F.col("n_name").alias("name"))
    return t.with_names(views.metrics(s, d).groupBy("region").agg(F.sum("volume").alias("volume")), n, "region").select("region", "name", "volume")


# ---- metric tables ---------------------------------------------------------------------------------------------------
@query("select sample, region, 'x' as note, 2 as factor from {metrics}")
def constant_columns(s, d):
    return t.with_columns(views.metrics(s, d).select("sample", "region"), {"note": "x", "factor": 2})


@query(f"select region, a.volume as f_volume, b.volume as o_volume from (select region, sum(volume) as volume from {BASE} where condition='F' group by 1) a full join (select region, sum(volume) as volume from {BASE} where condition='O' group by 1) b using (region)")
def prefixed_columns(s, d):
    of = lambda c: views.metrics(s, d).filter(F.col("condition") == c).groupBy("region").agg(F.sum("volume").alias("volume"), F.sum("nuclei").alias("nuclei"))
    return t.prefixed({"f": of("F"), "o": of("O")}, "region", lambda c: c.startswith("v"))


@query("select sample, " + ", ".join(f"max(volume) filter (condition='{c}' and region%2={i}) as \"{c}_{i}\"" for c in "FO" for i in (0, 1)) + " from {metrics} group by 1")
def pivoted_conditions(s, d):
    m = views.metrics(s, d).withColumn("half", (F.col("region") % 2).cast("string"))
    return t.pivoted(m, ["sample"], ["condition", "half"], ["F_0", "F_1", "O_0", "O_1"], F.max("volume"))


@query("select sample, region, volume from {metrics} where region in (select region from {metrics} where volume>400000)")
def rows_present_elsewhere(s, d):
    m = views.metrics(s, d)
    return t.present_in(m.select("sample", "region", "volume"), m.filter("volume > 400000"), "region")


@query("select region, condition, volume from (select region, condition, volume, sample, max(volume) over (partition by region) as top from {metrics}) where volume=top or sample=0")
def quality_peaks(s, d):
    return t.peaks(views.metrics(s, d), ["region"], "sample", "volume").select("region", "condition", "volume")


@query("select sample, condition, case condition when 'O' then 1 else 2 end as place from {metrics} where condition in ('O','F')")
def chosen_groups(s, d):
    return t.chosen_in_order(views.metrics(s, d).select("sample", "condition"), "condition", ["O", "F", "O"])


@query("select region, volume, e, p, -log10(p) as logp, sqrt(volume/max(volume) over ()) as size, abs(e)>=2 and -log10(p)>=1.5 as labelled from (select region, volume, nuclei/1000 as e, (sample%100+1)/101.0 as p from {metrics})")
def volcano_labels(s, d):
    m = views.metrics(s, d).select("region", "volume", (F.col("nuclei") / 1000).alias("e"), ((F.col("sample") % 100 + 1) / 101.0).alias("p"))
    return t.volcano(m, "e", "p", "volume", 2.0, 1.5)


GRID_SQL = "select radius_min, channel, pos, tp, fp, case when tp+fp<>0 then tp/(tp+fp) end as ppv, case when pos<>0 then tp/pos end as sensitivity, 1-case when tp+fp<>0 then tp/(tp+fp) end as fdr from (select radius_min, channel, count(*) filter (confirmed>=0) as pos, count(*) filter (confirmed=1 and radius>=radius_min) as tp, count(*) filter (confirmed=0 and radius>=radius_min) as fp from {places}, (select unnest([10.0,50.0,90.0])::double as radius_min) group by 1,2)"


@query(GRID_SQL)
def parameter_grid(s, d):
    def counts(x):
        n = lambda on: F.count(F.when(on, 1))
        big = F.col("radius") >= F.col("radius_min")
        one = x.groupBy("radius_min", "channel").agg(n(F.col("confirmed") >= 0).alias("pos"), n((F.col("confirmed") == 1) & big).alias("tp"), n((F.col("confirmed") == 0) & big).alias("fp"))
        return t.grid_statistics(one, ["radius_min", "channel"])

    return t.parameter_grid(views.places(s, d), {"radius_min": [10.0, 50.0, 90.0]}, counts)


@query("select sample, region, 'original' as \"set\" from {metrics} where region=0 union all select sample, region, 'best' from {metrics} where region=3 union all select sample, region, 'smoothed' from {metrics} where region>0")
def compared_sets(s, d):
    return t.compared_sets(views.metrics(s, d).select("sample", "region"), "region", F.col("region") == 3)


@query("select sample, region, case when sample%2=0 then sample%30+19 else sample%30/2.0 end as age from {metrics}")
def absolute_ages(s, d):
    n = F.col("sample") % 30
    rel = F.when(F.col("sample") % 2 == 0, F.concat(F.lit("P"), n.cast("string"))).otherwise(F.concat(F.lit("E"), (n / 2).cast("string")))
    return views.metrics(s, d).select("sample", "region", t.absolute_age(rel).alias("age"))


@query(f"with z as (select *, (volume-avg(volume) over (partition by region))/nullif(stddev_pop(volume) over (partition by region),0) as z from {BASE}) select sample, region, " + ", ".join(f"max(z) filter (condition='{c}') as \"{c}\"" for c in "FOP") + " from z group by 1,2")
def wide_z_scores(s, d):
    z = t.z_scores_grouped(_base(s, d), ["region"], ["volume"])
    return t.pivoted(z, ["sample", "region"], ["condition"], ["F", "O", "P"], F.max("volume_z"))


@query("with m as (select region, condition, avg(volume) as v, avg(nuclei) as n from {metrics} group by 1,2), w as (select m.condition, m.region, m.v/b.v as v, m.n/nullif(b.n,0) as n from m join m b on b.condition=m.condition and b.region=0) select region, " + ", ".join(f"max(v) filter (condition='{c}') as \"{c}_volume\", max(n) filter (condition='{c}') as \"{c}_nuclei\"" for c in "FOP") + " from w group by 1")
def developmental_table(s, d):
    m = views.metrics(s, d).groupBy("region", "condition").agg(F.avg("volume").alias("volume"), F.avg("nuclei").alias("nuclei"))
    m = t.normalize_to_base(m, ["condition"], "region", 0, ["volume", "nuclei"])
    return t.pivoted(t.melt(m, ["condition", "region"], ["volume", "nuclei"]), ["region"], ["condition", "metric"], [f"{c}_{k}" for c in "FOP" for k in ("volume", "nuclei")], F.max("value"))


# ---- statistics ------------------------------------------------------------------------------------------------------
@query(f"select region, sample, v1, v2 from {PAIRED}")
def paired_values(s, d):
    return st.paired_values(_base(s, d), ["region", "sample"], "condition", "volume", PAIR)


@query(f"select region, count(*) as n, avg(v2-v1) as mean, avg(v2-v1) as effect, avg(v2-v1)/nullif(stddev_samp(v2-v1),0) as cohen_d, avg(v2-v1)/nullif(stddev_samp(v2-v1)/sqrt(count(*)),0) as t, (count(*)-1)::double as df from (select region, v1/1e6 as v1, v2/1e6 as v2 from {PAIRED}) group by 1")
def paired_t_test(s, d):
    return st.paired_t(_base(s, d).withColumn("volume", F.col("volume") / 1e6), "region", "sample", "condition", "volume", PAIR).drop("p", "cohen_low", "cohen_high")


@query("select region, count(nuclei) as n, avg(nuclei) as mean, avg(nuclei)-4000 as effect, (avg(nuclei)-4000)/stddev_samp(nuclei) as cohen_d, (avg(nuclei)-4000)/(stddev_samp(nuclei)/sqrt(count(nuclei))) as t, (count(nuclei)-1)::double as df from {metrics} group by 1")
def one_sample_t_test(s, d):
    return st.one_sample_t(views.metrics(s, d), "region", "nuclei", 4000.0).drop("p", "cohen_low", "cohen_high")


@query(f"""with r as (select region, round(v2-v1,2) as d, abs(round(v2-v1,2)) as a from {PAIRED} where round(v2-v1,2)<>0), k as (select *, {RANK.replace('{v}', 'a')} as rank, count(*) over (partition by region, a) as ties from r),
s as (select region, count(*)::double as n, sum(case when d>0 then rank else 0 end)::double as w, sum(ties*ties-1)::double as t from k group by 1), z as (select *, (w-n*(n+1)/4)/sqrt(n*(n+1)*(2*n+1)/24-t/48) as z from s) select region, n, w, z, z/sqrt(n) as effect from z""")
def signed_rank_test(s, d):
    return st.signed_rank(_base(s, d), "region", "sample", "condition", "volume", PAIR, 2).drop("p", "cohen_low", "cohen_high")


@query()
def fligner_test(s, d):
    return st.fligner(views.metrics(s, d), "region", "condition", "volume")


@query()
def logistic_regression(s, d):
    return st.logistic(views.metrics(s, d), "region", "condition", "volume", PAIR)


@query("with r as (select " + ", ".join(f"(rank() over (order by {c})+(count(*) over (partition by {c})-1)/2)::double as {c}" for c in ("volume", "nuclei", "sample")) + " from {metrics}) " + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a},{b}) as rho, count(*) as n from r" for a, b in (("volume", "nuclei"), ("volume", "sample"), ("nuclei", "sample"))))
def correlation_matrix(s, d):
    return st.spearman_matrix(views.metrics(s, d), ["volume", "nuclei", "sample"]).drop("p")


STATS = """with m as (select region||'|'||metric as k, condition, value from (select region::varchar as region, condition, volume, nuclei from {metrics}) unpivot (value for metric in (volume, nuclei))),
a as (select k, count(value) filter (condition='F') as n1, avg(value) filter (condition='F') as mean1, var_samp(value) filter (condition='F') as var1, count(value) filter (condition='O') as n2, avg(value) filter (condition='O') as mean2, var_samp(value) filter (condition='O') as var2 from m group by 1)
select k, n1, mean1, n2, mean2, mean2-mean1 as effect, (mean2-mean1)/sqrt(var1/n1+var2/n2) as t from a"""


@query(STATS)
def stats_by_region(s, d):
    m = t.melt(views.metrics(s, d), ["region", "condition"], ["volume", "nuclei"]).withColumn("k", F.concat_ws("|", "region", "metric"))
    return st.welch(m, "k", "condition", "value", PAIR).select("k", "n1", "mean1", "n2", "mean2", "effect", "t")


@query()
def wide_statistics(s, d):
    w = st.welch(views.metrics(s, d), "region", "condition", "volume", PAIR).withColumn("n", F.col("n1") + F.col("n2"))
    return st.wide_stats(w, "region", "cohen_d", "p", F.col("cohen_low"), F.col("cohen_high"))


@query("with r as (select *, ((sample*7919)%1000+1)/1001.0 as p from {metrics}), k as (select *, rank() over (order by p)+count(*) over (partition by p)-1 as k, count(*) over () as n from r) select sample, region, volume, p, least(min(p*n/k) over (order by p desc),1) as p_corr from k")
def corrected_p_values(s, d):
    m = views.metrics(s, d).select("sample", "region", "volume", ((F.col("sample") * 7919 % 1000 + 1) / 1001.0).alias("p"))
    return st.corrected(m, "p", "bh")


# ---- models with a second factor ----------------------------------------------------------------------------------------
SIDED = "(select region%5 as region, condition, (case when sample%3=0 then 'L' else 'R' end) as side, volume, nuclei from {metrics} where condition<>'P')".replace("{metrics}", SQL["metrics"])


def _sided(s, d):
    return views.metrics(s, d).filter("condition <> 'P'").select((F.col("region") % 5).alias("region"), "condition", F.when(F.col("sample") % 3 == 0, "L").otherwise("R").alias("side"), "volume", "nuclei")


#: With all four pairs of levels the model has a mean for each; its errors are those of differences of means.
@query(f"""with c as (select region, condition as g, side as s, count(*)::double as n, avg(volume) as m, var_pop(volume) as v from {SIDED} group by all),
w as (select region, sum(n)::bigint as n, sum(n*v)/(sum(n)-4) as s2, sum(n*v) as rest, sum(n*m)/sum(n) as mean, max(m) filter (g='F' and s='L') as m00, max(m) filter (g='O' and s='L') as m10, max(m) filter (g='F' and s='R') as m01, max(m) filter (g='O' and s='R') as m11,
max(1/n) filter (g='F' and s='L') as i00, max(1/n) filter (g='O' and s='L') as i10, max(1/n) filter (g='F' and s='R') as i01, max(1/n) filter (g='O' and s='R') as i11 from c group by 1),
q as (select w.*, 1-rest/(select sum(c.n*c.v)+sum(c.n*(c.m-w.mean)**2) from c where c.region=w.region) as r_squared from w),
x as (select region, n, 1 as position, 'group:O' as term, m10-m00 as estimate, sqrt(s2*(i00+i10)) as se, m00 as intercept, r_squared from q union all select region, n, 2, 'side:R', m01-m00, sqrt(s2*(i00+i01)), m00, r_squared from q union all select region, n, 3, 'group:O*side:R', m11-m10-m01+m00, sqrt(s2*(i00+i10+i01+i11)), m00, r_squared from q)
select region, position, term, n, estimate, se, estimate/se as t, (n-4)::double as df, r_squared, intercept from x""")
def sided_linear_models(s, d):
    return mo.linear_model(_sided(s, d), "region", "volume", "condition", "side").drop("p")


@query()
def sided_logistic_models(s, d):
    return mo.logistic_model(_sided(s, d), "region", "condition", "volume", PAIR, "side")


@query(f"""with m as (select region, measure, condition as g, value as v from {SIDED} unpivot (value for measure in (volume, nuclei)) where region not in (3, 4)),
c as (select region, measure, count(*) as n, avg(v) filter (g='F') as a, avg(v) filter (g='O') as b, count(*) filter (g='F') as na, count(*) filter (g='O') as nb, var_pop(v) filter (g='F') as va, var_pop(v) filter (g='O') as vb from m group by 1,2),
e as (select *, sqrt((na*va+nb*vb)/(n-2)*(1.0/na+1.0/nb)) as se from c)
select region, measure, 1 as position, 'group:O' as term, n, b-a as estimate, se, (b-a)/se as t, (n-2)::double as df from e""")
def models_by_measure(s, d):
    model = lambda rows, key, value: mo.linear_model(rows, key, value, "condition")
    return mo.by_measure(_sided(s, d), "region", ["condition"], ["volume", "nuclei"], model, ignore=[3, 4]).drop("p", "r_squared", "intercept")
