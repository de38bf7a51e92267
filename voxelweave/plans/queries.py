"""The queries of the region, point and table operators, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import views
from ..functions.views import SQL
from ..operators import hierarchy as h
from ..operators import labelling as lb
from ..operators import points as p
from ..operators import regions as r
from ..operators import stats as st
from ..operators import tables as t
from ..operators import volumes as v
from ..operators.blocks import extents
from ..operators.ranks import quantiles
from .registry import ORACLE_SQL, QUERIES, query
from .tables import read

CONDITIONS = ["F", "O", "P"]


def _tree(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tree = views.ontology(s, d)
    return tree, h.closure(tree)


# ---- regions ---------------------------------------------------------------------------------------------------------
@query("select sample, label, count(*) as volume, sum(atlas) as intensity, stddev_pop(atlas) as std, avg(atlas) as mean, quantile_cont(atlas,0.5) as median, quantile_cont(atlas,0.05) as low, quantile_cont(atlas,0.95) as high from {voxels} group by 1,2")
def region_counts(s, d):
    return r.region_counts(views.voxels(s, d), ["sample", "label"])


@query("""with l as (select label as region, count(*) as volume, sum(atlas) as intensity, avg(atlas) as mean from {voxels} group by 1)
select ancestor as id, sum(volume)::double as volume, sum(intensity) as intensity, sum(mean*volume)/sum(volume) as mean from {closure} join l on descendant=region group by 1""")
def region_roll_up(s, d):
    _, closed = _tree(s, d)
    leaves = views.voxels(s, d).groupBy(F.col("label").alias("region")).agg(F.count("*").cast("double").alias("volume"), F.sum("atlas").alias("intensity"), F.avg("atlas").alias("mean"))
    return h.roll_up(leaves, closed, ["volume", "intensity"], {"mean": "volume"})


@query("select label, -sum(n/t*log2(n/t)) as entropy from (select label, z, count(*)::double as n, (sum(count(*)) over (partition by label))::double as t from {voxels} group by 1,2) group by 1")
def region_entropy(s, d):
    return r.entropy(views.voxels(s, d), ["label"], "z")


@query("select region, sum(volume) as volume, sum(nuclei) as nuclei, sum(volume)*(0.025*0.02*0.02/1e9)*1e6 as volume_phys, sum(nuclei)/(sum(volume)*(0.025*0.02*0.02/1e9)*1e6) as density from {metrics} group by 1")
def region_density(s, d):
    m = views.metrics(s, d).groupBy("region").agg(F.sum("volume").alias("volume"), F.sum("nuclei").alias("nuclei"))
    return r.physical(m, (0.025 * 1e2, 0.02 * 1e2, 0.02 * 1e2), 1e3)


@query("""with l as (select sample, label, count(*) as volume, sum(atlas) as intensity, avg(atlas) as mean from {voxels} group by 1,2)
select sample, label::varchar as label, volume, intensity, mean from l union all select sample, 'all', sum(volume)::bigint, sum(intensity), sum(mean*volume)/sum(volume) from l group by 1""")
def region_grand_total(s, d):
    m = views.voxels(s, d).groupBy("sample", "label").agg(F.count("*").alias("volume"), F.sum("atlas").alias("intensity"), F.avg("atlas").alias("mean"))
    return r.with_total(m, ["sample"])


@query("""with a as (select label, count(*) as n, count(*) filter (label=label2) as b from {voxels} group by 1), c as (select label2 as label, count(*) as n from {voxels} group by 1)
select coalesce(a.label,c.label) as label, coalesce(a.n,0) as volume, coalesce(c.n,0) as volume_alt, coalesce(b,0) as shared, 2*coalesce(b,0)/(coalesce(a.n,0)+coalesce(c.n,0)) as dsc, coalesce(c.n,0)-coalesce(b,0) as out from a full join c using (label)""")
def label_overlap(s, d):
    return r.overlap(views.voxels(s, d), "label", "label2")


@query("select sample, 2*sum(atlas) filter (z>25 and y>4)/(sum(atlas) filter (z>25)+sum(atlas) filter (y>4)) as dsc_weighted, 2*count(*) filter (z>25 and y>4)/(count(*) filter (z>25)+count(*) filter (y>4)) as dsc from {voxels} group by 1")
def mask_dice(s, d):
    a, b = F.col("z") > 25, F.col("y") > 4
    return views.voxels(s, d).groupBy("sample").agg(r.dice(a, b, F.col("atlas")).alias("dsc_weighted"), r.dice(a, b).alias("dsc"))


@query("select label, min(z) as z_min, max(z) as z_max, avg(z) as z_mid, min(y) as y_min, max(y) as y_max, avg(y) as y_mid, min(x) as x_min, max(x) as x_max, avg(x) as x_mid, count(*) as volume, (max(z)-min(z)+1)*5.0 as z_extent, (max(y)-min(y)+1)*1.0 as y_extent, (max(x)-min(x)+1)*1.0 as x_extent from {voxels} group by 1")
def label_boxes(s, d):
    return r.boxes(views.voxels(s, d), "label", (5.0, 1.0, 1.0))


@query("""with a as (select label::bigint as label, avg(z) as z, avg(y) as y, avg(x) as x from {voxels} group by 1), b as (select label2::bigint as label, avg(z) as z, avg(y) as y, avg(x) as x from {voxels} group by 1)
select coalesce(a.label,b.label) as label, sqrt(((a.z-b.z)*5)**2+(a.y-b.y)**2+(a.x-b.x)**2) as distance from a full join b using (label)""")
def label_centroid_distance(s, d):
    return r.centroid_distance(views.voxels(s, d), "label", "label2", (5.0, 1.0, 1.0))


@query("select label2 as label, count(*) as volume from {voxels} where label2 not in (select label from {voxels}) group by 1")
def labels_lost(s, d):
    return r.labels_lost(views.voxels(s, d), "label2", "label")


@query("select channel, least(round_even(z*0.5,0)::int,24) as z, least(round_even(y*0.25,0)::int,24) as y, least(round_even(x*0.1,0)::int,24) as x, count(*) as n from {blobs} group by all")
def heat_map(s, d):
    return r.heat_map(views.blobs(s, d), (0.5, 0.25, 0.1), (25, 25, 25), ["channel"])


@query("select region, avg(volume) filter (condition='O')-avg(volume) filter (condition='F') as change from {metrics} group by 1")
def region_change(s, d):
    return r.region_change(views.metrics(s, d), "volume", ("F", "O"))


@query("select y, x, max(atlas) as atlas from {voxels} group by 1,2")
def max_projection(s, d):
    return r.projection(views.voxels(s, d), ("y", "x"), "atlas")


@query("""with n as (select z//4 as z, y//4 as y, x//4 as x, label2, count(*) as n, sum(atlas) as s from {voxels} group by all)
select z, y, x, sum(s)/sum(n) as atlas, arg_max(label2, n*1000-label2) as label2 from n group by 1,2,3""")
def downsampled(s, d):
    return r.shrink(views.voxels(s, d), 4, "atlas", "label2")


@query("""with a as (select label, z, y, x from {voxels}),
m1 as (select label, list_sort(list(z))[len(list(z))//2+1] as z from a group by 1), b as (select a.* from a join m1 using (label,z)),
m2 as (select label, list_sort(list(y))[len(list(y))//2+1] as y from b group by 1), c as (select b.* from b join m2 using (label,y))
select label, any_value(z) as z, any_value(y) as y, list_sort(list(x))[len(list(x))//2+1] as x from c group by 1""")
def region_middle(s, d):
    return r.region_middle(views.voxels(s, d), "label")


@query("""with f as (select channel, count(*) filter (truth>=0) as pos, count(*) filter (truth=-1 and confirmed=1) as tp, count(*) filter (truth=-1 and confirmed=0) as fp, count(*) filter (truth=0) as fn from {blobs} group by 1)
select *, case when pos<>0 then tp/pos end as sensitivity, case when tp+fp<>0 then tp/(tp+fp) end as ppv from f""")
def verification(s, d):
    return r.verification(views.blobs(s, d), ["channel"])


@query("select sample, 1-(count(*) filter (atlas>0 and x<3 and label2%7<>0)+count(*) filter (atlas>0 and x>=3 and x<6))/count(*) filter (atlas>0) as unlabeled from {voxels} group by 1")
def unlabeled_share(s, d):
    return r.unlabeled_share(views.voxels(s, d).withColumn("part", F.col("label2") % 7), "part", (3, 6))


@query("select channel, quantile_cont(atlas,0.005) as near_min, quantile_cont(atlas,0.995) as near_max from {voxels} group by 1")
def intensity_bounds(s, d):
    return r.intensity_bounds(views.voxels(s, d), "channel", "atlas")


@query("""with w as (select sample, z, y, x, coalesce(avg(atlas) filter (channel=0),0) as a, coalesce(avg(atlas) filter (channel=1),0) as b from {voxels} group by 1,2,3,4)
select sample, z, y, x, greatest(a-b*0.2,0) as channel_0, greatest(b-a*0.1,0) as channel_1 from w""")
def spectral_unmixing(s, d):
    return r.unmixed(views.voxels(s, d), {0: {1: 0.2}, 1: {0: 0.1}}, [0, 1])


@query("select sample, z, y, x, sum(atlas) as atlas from {voxels} group by 1,2,3,4")
def merged_images(s, d):
    return views.voxels(s, d).groupBy("sample", "z", "y", "x").agg(F.sum("atlas").alias("atlas"))


@query("select z, y, x, max(atlas) as atlas from {voxels} where sample='F' or channel=1 group by 1,2,3")
def merged_by_maximum(s, d):
    x = views.voxels(s, d)
    return r.merged_values([x.filter("sample = 'F'"), x.filter("channel = 1")], "atlas", F.max)


ACCURACY = "select channel, 'ignore' as maybes, pos, tp, fp from f union all select channel, 'correct', pos+mf, tp+mf, fp from f union all select channel, 'incorrect', pos+m-mf, tp, fp+mf from f"


@query(f"""with b as (select channel, case when blob_id%4=3 then 2 else confirmed end as confirmed, case when blob_id%5=0 then 0.0 else radius end as radius from {{blobs}}),
f as (select channel, count(*) filter (confirmed=1) as pos, count(*) filter (confirmed=1 and radius>=0.001) as tp, count(*) filter (confirmed=0) as fp, count(*) filter (confirmed=2) as m, count(*) filter (confirmed=2 and radius>=0.001) as mf from b group by 1), a as ({ACCURACY})
select *, pos-tp as fn, case when pos<>0 then tp/pos end as sensitivity, case when tp+fp<>0 then tp/(tp+fp) end as ppv from a""")
def detection_accuracy(s, d):
    b = views.blobs(s, d).withColumns({"confirmed": F.when(F.col("blob_id") % 4 == 3, 2).otherwise(F.col("confirmed")), "radius": F.when(F.col("blob_id") % 5 == 0, 0.0).otherwise(F.col("radius"))})
    out = None
    for how in ("ignore", "correct", "incorrect"):
        one = r.detection_accuracy(b, ["channel"], maybes=how).withColumn("maybes", F.lit(how))
        out = one if out is None else out.unionByName(one)
    return out


@query("select label, median(z)/(select max(z) from {voxels}) as weight from {voxels} group by 1")
def distance_weight(s, d):
    vox = views.voxels(s, d)
    top = F.broadcast(vox.agg(F.max("z").alias("top")))
    return quantiles(vox, ["label"], "z", {"m": 0.5}).join(top).select("label", (F.col("m") / F.col("top")).alias("weight"))


# ---- hierarchy -------------------------------------------------------------------------------------------------------
@query("select ancestor, descendant, depth from {closure}")
def ontology_closure(s, d):
    return _tree(s, d)[1]


@query("""select o.id, name, level, parent, coalesce(a.l,'') as path from {ontology} o left join (select descendant, string_agg(ancestor,'/' order by depth desc) as l from {closure} where depth>0 group by 1) a on a.descendant=o.id""")
def ontology_lookup(s, d):
    tree, closed = _tree(s, d)
    return h.lookup(tree, closed).select("id", "name", "level", "parent", F.array_join(F.transform("ancestors", lambda x: x.cast("string")), "/").alias("path"))


@query("select ancestor, descendant, depth from {closure} where ancestor in (100001,200003)")
def ontology_descendants(s, d):
    return h.descendants(_tree(s, d)[1], [100001, 200003])


@query("select distinct l.label, c.ancestor as at_level from (select distinct label from {voxels}) l left join (select descendant, ancestor from {closure} where ancestor between 100000 and 199999) c on c.descendant=l.label")
def label_at_level(s, d):
    tree, closed = _tree(s, d)
    return h.at_level(views.voxels(s, d).select("label").distinct(), tree, closed, 1)


@query("select l.label, coalesce(c.p,0) as parent_label from (select distinct label from {voxels}) l left join (select descendant, arg_min(ancestor,depth) as p from {closure} where ancestor>=100000 group by 1) c on c.descendant=l.label")
def label_parent(s, d):
    tree, closed = _tree(s, d)
    return h.parent_at_most(views.voxels(s, d).select("label").distinct(), tree, closed, 2)


@query("select ancestor, descendant from {closure} where ancestor>=100000")
def level_id_sets(s, d):
    tree, closed = _tree(s, d)
    return h.ids_to_level(tree, closed, 2)


@query("select coalesce(c.ancestor,label)::bigint as label, count(*) as n from {voxels} left join (select descendant, ancestor from {closure} where ancestor>=200000 and ancestor<1000000) c on descendant=label group by 1")
def relabelled_to_level(s, d):
    tree, closed = _tree(s, d)
    return h.relabel(views.voxels(s, d), tree, closed, 2).groupBy("label").agg(F.count("*").alias("n"))


@query("select coalesce(t.t,label)::bigint as label, count(*) as n from {voxels} left join (select descendant, arg_min(case ancestor when 100000 then 7 else 8 end, depth) as t from {closure} where ancestor in (100000,200004) group by 1) t on descendant=label group by 1")
def translated_labels(s, d):
    _, closed = _tree(s, d)
    pairs = views.ontology(s, d).filter("id in (100000, 200004)").select(F.col("id").alias("from_label"), F.when(F.col("id") == 100000, 7).otherwise(8).alias("to_label"))
    return h.translate(views.voxels(s, d), pairs, closed).groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))


@query("""with l as (select id from {ontology} where level<>1), n as (select descendant, arg_min(ancestor,depth) as parent from {closure} where depth>0 and ancestor in (select id from l) and descendant in (select id from l) group by 1)
select parent, count(*) as n_children, min(descendant) as first_child from n group by 1""")
def region_network(s, d):
    tree, closed = _tree(s, d)
    return h.network(tree.filter("level <> 1"), closed)


@query("select label2 as id, case when min(s)>0 then 'R' when max(s)<0 then 'L' else 'both' end as side from (select label2, case when channel=0 then -label2 else label2 end as s from {voxels}) group by 1")
def label_sides(s, d):
    signed = F.when(F.col("channel") == 0, -F.col("label2")).otherwise(F.col("label2"))
    return views.voxels(s, d).select("label2", signed.alias("s")).groupBy(F.col("label2").alias("id")).agg(h.side(F.col("s")).alias("side"))


# ---- metric tables ---------------------------------------------------------------------------------------------------
BASE = "(select sample, region, condition, sum(volume) as volume, sum(nuclei) as nuclei from {metrics} group by 1,2,3)".replace("{metrics}", SQL["metrics"])


def _by_condition(s, d):
    return views.metrics(s, d).groupBy("sample", "region", "condition").agg(F.sum("volume").alias("volume"), F.sum("nuclei").alias("nuclei"))


@query(f"select a.sample, a.region, a.condition, a.volume/b.volume as volume, case when b.nuclei<>0 then a.nuclei/b.nuclei end as nuclei from {BASE} a left join {BASE} b on a.sample=b.sample and a.region=b.region and b.condition='F'")
def normalized_to_base(s, d):
    return t.normalize_to_base(_by_condition(s, d), ["sample", "region"], "condition", "F", ["volume", "nuclei"])


@query("select sample, region, condition, volume, nuclei, (volume-avg(volume) over w)/nullif(stddev_pop(volume) over w,0) as volume_z from {metrics} window w as (partition by region)")
def z_scores(s, d):
    return t.z_scores_grouped(views.metrics(s, d), ["region"], ["volume"])


@query("select region, stddev_pop(volume)/avg(volume) as volume_cv, stddev_pop(nuclei)/avg(nuclei) as nuclei_cv, avg(volume) as volume_mean from {metrics} group by 1")
def variation(s, d):
    return t.variation(views.metrics(s, d), ["region"], ["volume", "nuclei"], "volume")


@query(f"select sample, region, condition, metric, value from {BASE} unpivot (value for metric in (volume, nuclei))")
def melted(s, d):
    return t.melt(_by_condition(s, d), ["sample", "region", "condition"], ["volume", "nuclei"])


@query(f"select sample, region, min(volume) filter (condition='F') as \"volume_F\", min(volume) filter (condition='O') as \"volume_O\", min(volume) filter (condition='P') as \"volume_P\" from {BASE} group by 1,2")
def conditions_to_columns(s, d):
    return t.conditions_to_columns(_by_condition(s, d), ["sample", "region"], "condition", "volume", CONDITIONS)


@query("select region, " + ", ".join(f"nullif(sum(volume) filter (condition='{c}'),0) as \"volume_{c}\", nullif(sum(nuclei) filter (condition='{c}'),0) as \"nuclei_{c}\", nullif(sum(nuclei) filter (condition='{c}'),0)/nullif(sum(volume) filter (condition='{c}'),0) as \"density_{c}\"" for c in CONDITIONS) + " from {metrics} group by 1")
def experiments_by_region(s, d):
    return t.experiments_by_region(views.metrics(s, d), "condition", CONDITIONS)


@query("select region, sum(nuclei*volume)/sum(volume) as mean, sqrt(greatest(sum(nuclei*nuclei*volume)/sum(volume)-(sum(nuclei*volume)/sum(volume))**2,0)) as std from {metrics} group by 1")
def weighted_stats(s, d):
    return t.weighted_stats(views.metrics(s, d), ["region"], "nuclei", "volume")


@query("""select count(*) as n, count(*) filter (e>0) as n_improved, sum(e) filter (e>0) as sum_improved, sum(e*volume) filter (e>0) as weighted_improved, count(*) filter (e<0) as n_worsened, sum(e) filter (e<0) as sum_worsened, sum(e*volume) filter (e<0) as weighted_worsened,
 count(*) filter (e>0 and p<0.05) as n_improved_sig, sum(e) filter (e>0 and p<0.05) as sum_improved_sig, sum(e*volume) filter (e>0 and p<0.05) as weighted_improved_sig, count(*) filter (e<0 and p<0.05) as n_worsened_sig, sum(e) filter (e<0 and p<0.05) as sum_worsened_sig, sum(e*volume) filter (e<0 and p<0.05) as weighted_worsened_sig
 from (select nuclei/1000 as e, volume/1e6 as volume, (sample%100)/100.0 as p from {metrics})""")
def improvement_summary(s, d):
    m = views.metrics(s, d).select((F.col("nuclei") / 1000).alias("e"), (F.col("volume") / 1e6).alias("volume"), (F.col("sample") % 100 / 100.0).alias("p"))
    return t.improvement(m, "e", "p", "volume")


@query("select least(floor((volume-lo)/(hi-lo)*10),9)::int as bin, count(*) as n from {metrics}, (select min(volume) as lo, max(volume) as hi from {metrics}) group by 1")
def histogram(s, d):
    return t.histogram(views.metrics(s, d), "volume")


@query("select sample, region, condition, (volume+nuclei)/2 as homogeneity from {metrics}")
def combined_columns(s, d):
    return t.combine_columns(views.metrics(s, d), "homogeneity", ["volume", "nuclei"]).select("sample", "region", "condition", "homogeneity")


@query("select sample, region, condition, (volume+nuclei)/2 as homogeneity, case when volume<>0 then nuclei/volume end as share from {metrics}")
def column_combinations(s, d):
    combos = {"homogeneity": (["volume", "nuclei"], t.mean_of), "share": (["nuclei", "volume"], t.ratio_of), "absent": (["nuclei", "missing"], t.mean_of)}
    return t.combined_by(views.metrics(s, d), combos).select("sample", "region", "condition", "homogeneity", "share")


@query("select sample, volume+nuclei as added, volume-nuclei as less, volume*nuclei as times, case when nuclei<>0 then volume/nuclei end as ratio from {metrics}")
def paired_columns(s, d):
    m = views.metrics(s, d)
    for name, fn in (("added", lambda a, b: a + b), ("less", lambda a, b: a - b), ("times", lambda a, b: a * b), ("ratio", F.try_divide)):
        m = t.paired(m, "volume", "nuclei", fn, name)
    return m.select("sample", "added", "less", "times", "ratio")


@query("select sample, case condition when 'P' then 'partial' else condition end as condition, volume from {metrics}")
def replaced_values(s, d):
    return t.replace_values(views.metrics(s, d), "P", "partial", ["condition"]).select("sample", "condition", "volume")


@query("select sample, volume from {metrics} where condition='F' union all select sample, volume from {metrics} where region=3")
def filtered_rows(s, d):
    m = views.metrics(s, d)
    return t.filter_and_concat([m, m], ["sample", "volume"], [("condition", "F"), ("region", 3)])


@query("select sample, region, sign(nuclei)*log10(abs(nuclei)+1) as modulus, (volume-lo)/(hi-lo)*2-1 as scaled, volume*nuclei/hn as bar from {metrics}, (select min(volume) as lo, max(volume) as hi, max(nuclei) as hn from {metrics})")
def rescaled_columns(s, d):
    m = views.metrics(s, d).withColumn("bar_value", F.col("volume"))
    m = t.weighted_bars(t.rescale(m, "volume", -1.0, 1.0), "bar_value", "nuclei")
    return m.select("sample", "region", t.log_modulus(F.col("nuclei")).alias("modulus"), F.col("volume").alias("scaled"), "bar")


@query("select region, max(1) filter (condition='F') as \"in_F\", max(1) filter (condition='O') as \"in_O\", max(1) filter (condition='P') as \"in_P\" from {metrics} group by 1")
def common_labels(s, d):
    return t.common_labels(views.metrics(s, d), "condition", CONDITIONS, "region")


@query("select region, condition, count(volume) as n, avg(volume) as mean, quantile_cont(volume,0.5) as median, stddev_samp(volume) as sd, stddev_samp(volume)/sqrt(count(volume)) as se from {metrics} group by 1,2")
def group_summary(s, d):
    return t.group_summary(views.metrics(s, d), ["region", "condition"], "volume").drop("ci")


#: The 0.975 quantile of Student's t by its expansion around the normal one, for many degrees of freedom.
Z = "1.959963984540054::double"
T975 = f"({Z}+({Z}**3+{Z})/(4*f)+(5*{Z}**5+16*{Z}**3+3*{Z})/(96*f**2)+(3*{Z}**7+19*{Z}**5+17*{Z}**3-15*{Z})/(384*f**3)+(79*{Z}**9+776*{Z}**7+1482*{Z}**5-1920*{Z}**3-945*{Z})/(92160*f**4))"


@query(f"select condition, n, mean, {T975}*sd/sqrt(n) as ci from (select condition, count(volume) as n, avg(volume) as mean, stddev_samp(volume) as sd, count(volume)-1.0 as f from {{metrics}} where condition<>'P' group by 1)")
def mean_intervals(s, d):
    return t.group_summary(views.metrics(s, d).filter("condition <> 'P'"), ["condition"], "volume").select("condition", "n", "mean", "ci")


@query("select a.region, a.volume, b.volume as volume_1, c.nuclei from (select region, sum(volume) as volume from {metrics} where condition='F' group by 1) a left join (select region, sum(volume) as volume from {metrics} where condition='O' group by 1) b using (region) left join (select region, min(nuclei) as nuclei from {metrics} group by 1) c using (region)")
def joined_tables(s, d):
    m = views.metrics(s, d)
    part = lambda c: m.filter(F.col("condition") == c).groupBy("region").agg(F.sum("volume").alias("volume"))
    return t.join_on([part("F"), part("O"), m.select("region", "nuclei")], "region", first_only=True)


# ---- points ----------------------------------------------------------------------------------------------------------
@query("select * from {blobs} where channel in (1,3) and z>=5 and z<35 and y>=10 and y<150 and x>=20 and x<220")
def points_in_box(s, d):
    return p.in_box(p.in_channels(views.blobs(s, d), [1, 3]), (10, 20, 30), (20, 120, 180), (5, 10, 10))


@query("select blob_id, (z*0.5)::double as z, trunc(z*0.7)::int as z_index, trunc(y*0.7)::int as y_index, trunc(x*0.7)::int as x_index from {blobs}")
def scaled_points(s, d):
    return p.scaled_index(views.blobs(s, d), (0.7, 0.7, 0.7)).select("blob_id", (F.col("z") * 0.5).alias("z"), "z_index", "y_index", "x_index")


@query("select blob_id, case when abs(radius)<0.001 then -5 else radius end as radius from {blobs} where confirmed=1")
def confirmed_points(s, d):
    return p.cleaned(views.blobs(s, d)).select("blob_id", "radius")


@query("select roi, channel, min(blob_id) as blob_id from {blobs} group by 1,2")
def first_points(s, d):
    b = views.blobs(s, d).select("roi", "channel", "blob_id", "radius")
    return p.first_of_each(b, ["roi", "channel"], ["blob_id"]).select("roi", "channel", "blob_id")


NEAR = "abs(a.z-b.z)<=2 and abs(a.y-b.y)<=3 and abs(a.x-b.x)<=3"


@query("select a.blob_id as a, b.blob_id as b from {places} a join {places} b on a.channel=0 and b.channel=1 and " + NEAR)
def near_points(s, d):
    b = views.places(s, d).select("blob_id", "channel", "z", "y", "x")
    return p.near_pairs(b.filter("channel = 0"), b.filter("channel = 1"), (2, 3, 3)).select(F.col("blob_id_a").alias("a"), F.col("blob_id_b").alias("b"))


@query("select blob_id from {blobs} a where channel=0 and not exists (select 1 from {blobs} b where b.channel=1 and " + NEAR + ")")
def points_without_close(s, d):
    b = views.blobs(s, d)
    return p.without_close(b.filter("channel = 0"), b.filter("channel = 1"), (2, 3, 3)).select("blob_id")


@query()
def thinned_points(s, d):
    return p.thinned(views.blobs(s, d), (2, 3, 3), ("channel",)).select("blob_id")


@query()
def pruned_tile_points(s, d):
    return p.pruned_tiles(views.blobs(s, d), (20, 60, 60), (4, 6, 6), (2, 3, 3)).select("blob_id")


@query()
def greedy_matches(s, d):
    b = views.blobs(s, d)
    return p.greedy_matches(b.filter("channel = 0"), b.filter("channel = 1"), (2, 3, 3))


@query("select a, b, dist from (select a.blob_id as a, b.blob_id as b, sqrt((a.z-b.z)**2+(a.y-b.y)**2+(a.x-b.x)**2) as dist, row_number() over (partition by a.blob_id order by sqrt((a.z-b.z)**2+(a.y-b.y)**2+(a.x-b.x)**2), b.blob_id) as n from {blobs} a join {blobs} b on a.channel=2 and b.channel=3 and (a.z-b.z)**2+(a.y-b.y)**2+(a.x-b.x)**2<16) where n=1")
def closest_points(s, d):
    b = views.blobs(s, d)
    return p.closest(b.filter("channel = 2"), b.filter("channel = 3"), 4.0)


VECTORS = "(select vec_id, embedding[1]::double*100 as z, embedding[2]::double*100 as y, embedding[3]::double*100 as x from embeddings)"


def _vectors(s, d):
    e = read(s, d, "embeddings")
    return e.select("vec_id", *[(F.get("embedding", F.lit(i)).cast("double") * 100).alias(c) for i, c in enumerate(p.AXES)])


@query(f"select vec_id, dist from (select a.vec_id, sqrt((a.z-b.z)**2+(a.y-b.y)**2+(a.x-b.x)**2) as dist, row_number() over (partition by a.vec_id order by sqrt((a.z-b.z)**2+(a.y-b.y)**2+(a.x-b.x)**2)) as n from {VECTORS} a, {VECTORS} b) where n=5")
def nearest_neighbours(s, d):
    return p.nearest(_vectors(s, d), 5, 6.0, p.AXES, "vec_id")


@query(f"""with recursive v as {VECTORS}, e as (select a.vec_id as a, b.vec_id as b from v a, v b where (a.z-b.z)**2+(a.y-b.y)**2+(a.x-b.x)**2<=16),
c as (select a from e group by a having count(*)>=4), k as (select e.a, e.b from e join c on c.a=e.a join c c2 on c2.a=e.b),
g(a,b) as (select a,b from k union select g.a,k.b from g join k on g.b=k.a), m as (select a, min(b) as cl from g group by a),
o as (select e.a, min(m.cl) as cl from e join m on m.a=e.b where e.a not in (select a from c) group by 1)
select vec_id, coalesce(m.cl,o.cl,-1) as cluster from v left join m on m.a=vec_id left join o on o.a=vec_id""")
def density_clusters(s, d):
    return p.dbscan(_vectors(s, d), 4.0, 4, p.AXES, "vec_id")


@query("select channel, count(*) as n from {blobs} group by 1")
def points_per_channel(s, d):
    return views.blobs(s, d).groupBy("channel").agg(F.count("*").alias("n"))


@query("select l_orderkey%5000 as z, count(*) as n from lineitem group by 1")
def points_per_cell(s, d):
    return read(s, d, "lineitem").groupBy((F.col("l_orderkey") % 5000).alias("z")).agg(F.count("*").alias("n"))


# ---- volumes ---------------------------------------------------------------------------------------------------------
GRID = "(select z, y, x, label from {grid})".replace("{grid}", SQL["grid"])
FACES = "(values (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dz,dy,dx)"


def _grid(s, d):
    return views.grid(s, d).select("z", "y", "x", "label")


@query(f"select distinct a.z, a.y, a.x, a.label from {GRID} a, {FACES} join {GRID} b on b.z=a.z+dz and b.y=a.y+dy and b.x=a.x+dx where a.label<>0 and b.label<>a.label")
def label_edges(s, d):
    return v.edges(_grid(s, d))


@query(f"select distinct z+dz as z, y+dy as y, x+dx as x from {GRID} a, {FACES} where label=1 except select z, y, x from {GRID} where label=1")
def label_shell(s, d):
    return v.shell(_grid(s, d).filter("label = 1"))


@query(f"""with s as (select a.label, sum(case when dz<>0 then 1.0*1.0 when dy<>0 then 2.0 else 2.0 end) as surface from {GRID} a, {FACES} where a.label<>0 and not exists (select 1 from {GRID} b where b.z=a.z+dz and b.y=a.y+dy and b.x=a.x+dx and b.label=a.label) group by 1)
select * from s""")
def label_surface(s, d):
    return v.surface(_grid(s, d), "label", (2.0, 1.0, 1.0))


@query(f"""select label, surface, volume, surface**3/volume**2 as compactness from (select a.label, sum(1.0) as surface from {GRID} a, {FACES} where a.label<>0 and not exists (select 1 from {GRID} b where b.z=a.z+dz and b.y=a.y+dy and b.x=a.x+dx and b.label=a.label) group by 1) join (select label, count(*) as volume from {GRID} group by 1) using (label)""")
def label_compactness(s, d):
    return v.compactness(_grid(s, d))


@query()
def connected_labels(s, d):
    return lb.labelled(_grid(s, d), full=False)


@query(f"select a.z, a.y, a.x, a.label from {GRID} a, {FACES} join {GRID} b on b.z=a.z+dz and b.y=a.y+dy and b.x=a.x+dx and b.label=a.label where a.label<>0 group by all having count(*)=6")
def eroded_labels(s, d):
    return v.eroded(_grid(s, d), "label")


@query(f"select distinct z+dz as z, y+dy as y, x+dx as x from {GRID} a, (select * from {FACES} union all select 0,0,0) where label=2")
def dilated_labels(s, d):
    return v.dilated(_grid(s, d).filter("label = 2"))


@query(f"select a.z, a.y, a.x, min(sqrt((a.z-b.z)**2+(a.y-b.y)**2+(a.x-b.x)**2)) as dist from (select * from {GRID} where label=1) a join (select * from {GRID} where label=2) b on b.z between a.z-9 and a.z+9 group by 1,2,3")
def nearest_border(s, d):
    g = _grid(s, d)
    return v.nearest_voxel(g.filter("label = 1"), g.filter("label = 2"))


@query(f"select z, y, x, label from {GRID} where x<5 union all select z, y, 9-x, -label from {GRID} where x<5")
def mirrored_labels(s, d):
    return v.mirrored(_grid(s, d), "x", 5)


@query(f"select z, y, x, label from {GRID} a where not exists (select 1 from {GRID} b where b.z=a.z and b.y=a.y and 9-b.x=a.x and b.label=a.label)")
def asymmetric_labels(s, d):
    return v.asymmetric(_grid(s, d), "x", 5, 1)


@query(f"select z, y, x, label from {GRID}")
def tiles_round_trip(s, d):
    g, size = _grid(s, d), (16, 4, 3)
    shape = extents(g)
    return v.merged_tiles(v.tiles(g, size, (3, 1, 2), shape), size, shape)


@query(f"select x as y, 10-y as x, z, label from {GRID}")
def quarter_turn(s, d):
    return v.turned(_grid(s, d), "y", "x", 11)


# ---- statistics ------------------------------------------------------------------------------------------------------
@query("""with a as (select region, count(volume) filter (condition='F') as n1, avg(volume) filter (condition='F') as mean1, var_samp(volume) filter (condition='F') as var1, count(volume) filter (condition='O') as n2, avg(volume) filter (condition='O') as mean2, var_samp(volume) filter (condition='O') as var2 from {metrics} group by 1)
select region, n1, mean1, n2, mean2, mean2-mean1 as effect, (mean2-mean1)/sqrt(((n1-1)*var1+(n2-1)*var2)/(n1+n2-2)) as cohen_d, (mean2-mean1)/sqrt(var1/n1+var2/n2) as t, (var1/n1+var2/n2)**2/((var1/n1)**2/(n1-1)+(var2/n2)**2/(n2-1)) as df from a""")
def welch_test(s, d):
    return st.welch(views.metrics(s, d), "region", "condition", "volume", ("F", "O")).drop("p", "var1", "var2", "cohen_low", "cohen_high")


@query()
def welch_test_p(s, d):
    w = st.welch(views.metrics(s, d), "region", "condition", "volume", ("F", "O"))
    return st.corrected(st.corrected(w, "p").withColumnRenamed("p_corr", "p_bonferroni"), "p", "bh").select("region", "t", "df", "p", "p_bonferroni", F.col("p_corr").alias("p_bh"))


@query("select region, avg(volume) filter (condition='O')-avg(volume) filter (condition='F') as effect from {metrics} group by 1")
def mean_difference(s, d):
    return st.mean_difference(views.metrics(s, d), "region", "condition", "volume", ("F", "O"))


@query("select region, count(*) as n, regr_slope(nuclei,volume) as slope, regr_intercept(nuclei,volume) as intercept, regr_r2(nuclei,volume) as r2, sqrt((regr_syy(nuclei,volume)-regr_slope(nuclei,volume)*regr_sxy(nuclei,volume))/(regr_sxx(nuclei,volume)*(count(*)-2))) as slope_se from {metrics} group by 1")
def linear_regression(s, d):
    return st.regression(views.metrics(s, d), "region", "volume", "nuclei").drop("p")


@query("""with r as (select region, condition, rank() over (partition by region order by volume)+(count(*) over (partition by region, volume)-1)/2 as k, count(*) over (partition by region, volume) as ties from {metrics} where condition in ('F','O')),
s as (select region, count(*) filter (condition='F')::double as n1, count(*) filter (condition='O')::double as n2, sum(k) filter (condition='F') as r1, sum(ties*ties-1)::double as t from r group by 1),
z as (select region, r1-n1*(n1+1)/2 as u, n1+n2 as n, (r1-n1*(n1+1)/2-n1*n2/2)/sqrt(n1*n2/12*(n1+n2+1-t/((n1+n2)*(n1+n2-1)))) as z from s) select region, u, z, z/sqrt(n) as effect from z""")
def rank_sum_test(s, d):
    return st.rank_sum(views.metrics(s, d), "region", "condition", "volume", ("F", "O")).drop("p")


@query("""with a as (select region, rank() over (partition by region order by volume)+(count(*) over (partition by region, volume)-1)/2 as ra, rank() over (partition by region order by nuclei)+(count(*) over (partition by region, nuclei)-1)/2 as rb from {metrics}) select region, corr(ra,rb) as rho from a group by 1""")
def spearman_correlation(s, d):
    return st.spearman(views.metrics(s, d), "region", "volume", "nuclei")


from . import atlas_queries, matching_queries, metric_queries, volume_queries  # noqa: E402, F401  they register theirs
