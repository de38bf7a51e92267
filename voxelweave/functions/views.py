"""Spatial tables derived from the star schema, so that every operator has rows to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import ROWS, dealt
from ..plans.tables import partitions, read


def voxels(spark: SparkSession, sf: str) -> DataFrame:
    """sample, channel, z, y, x, label, label2, atlas; one row per line item. Label 0 is background."""
    return read(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("sample"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("channel"),
        F.col("l_quantity").cast("int").alias("z"),
        F.round(F.col("l_discount") * 100).cast("int").alias("y"),
        F.round(F.col("l_tax") * 100).cast("int").alias("x"),
        (F.col("l_suppkey") + 1).cast("int").alias("label"),
        (F.col("l_partkey") % 100 + 1).cast("int").alias("label2"),
        F.col("l_extendedprice").alias("atlas"),
    )


def blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Detected points with flags, from events."""
    e = read(spark, sf, "events")
    kind = F.pmod(F.col("event_id"), F.lit(3))
    return e.select(
        F.col("event_id").alias("blob_id"),
        F.col("user_id").alias("roi"),
        (F.col("event_id") * 7 % 50).cast("double").alias("z"),
        (F.col("event_id") * 13 % 200).cast("double").alias("y"),
        (F.col("event_id") * 29 % 300).cast("double").alias("x"),
        F.col("value").alias("radius"),
        (kind - 1).cast("int").alias("confirmed"),
        (F.pmod(F.col("event_id"), F.lit(5)) % 3 - 1).cast("int").alias("truth"),
        F.pmod(F.col("user_id"), F.lit(4)).cast("int").alias("channel"),
    )


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Points of even density at any size: planes of 500 points, more planes the more events there are."""
    e = read(spark, sf, "events")
    n = F.col("event_id")
    return e.select(
        n.alias("blob_id"),
        F.floor(n / 500).cast("double").alias("z"),
        ((n * n * 31 + n * 7) % 211).cast("double").alias("y"),
        ((n * n * 17 + n * 13) % 499).cast("double").alias("x"),
        F.col("value").alias("radius"),
        (F.pmod(n, F.lit(3)) - 1).cast("int").alias("confirmed"),
        F.pmod(F.col("user_id"), F.lit(4)).cast("int").alias("channel"),
    )


def rois(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes, one a supplier: roi_id, z0, y0, x0, nz, ny, nx."""
    k = F.col("s_suppkey")
    size = [F.lit(n).alias(c) for c, n in (("nz", 6), ("ny", 40), ("nx", 60))]
    return read(spark, sf, "supplier").select(k.cast("long").alias("roi_id"), (k % 20).cast("int").alias("z0"), (k * 37 % 170).cast("int").alias("y0"), (k * 53 % 430).cast("int").alias("x0"), *size)


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """sample, region, condition, volume, nuclei per order."""
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_custkey").alias("sample"), F.col("c_nationkey").alias("region"), F.col("o_orderstatus").alias("condition"), F.col("o_totalprice").alias("volume"), F.col("c_acctbal").alias("nuclei")
    )


def ontology(spark: SparkSession, sf: str) -> DataFrame:
    """id, name, level, parent: a root, regions, nations and suppliers."""
    r, n, s = (read(spark, sf, t) for t in ("region", "nation", "supplier"))
    one = lambda df, *c: df.select(*[x.alias(k) for x, k in zip(c, ("id", "name", "level", "parent"), strict=True)])
    root = one(spark.range(1), F.lit(1000000).cast("long"), F.lit("root"), F.lit(0), F.lit(None).cast("long"))
    return (
        root.unionByName(one(r, (100000 + F.col("r_regionkey")).cast("long"), F.col("r_name"), F.lit(1), F.lit(1000000).cast("long")))
        .unionByName(one(n, (200000 + F.col("n_nationkey")).cast("long"), F.col("n_name"), F.lit(2), (100000 + F.col("n_regionkey")).cast("long")))
        .unionByName(one(s, (F.col("s_suppkey") + 1).cast("long"), F.col("s_name"), F.lit(3), (200000 + F.col("s_nationkey")).cast("long")))
    )


def grid(spark: SparkSession, sf: str, planes: bool = False) -> DataFrame:
    """z, y, x, label, label2, atlas: planes of 100 voxels, more of them the more line items there are; labels come in slabs of three planes.

    ``planes``: whole planes are dealt to tasks of the same size however many there are, instead of voxels to the session's partitions.
    """
    k = F.floor(F.col("l_orderkey") / 60) % 3
    cells = read(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / 20).cast("int").alias("z"),
        (F.col("l_partkey") % 10).cast("int").alias("y"),
        (F.col("l_suppkey") % 10).cast("int").alias("x"),
        k.cast("int").alias("label"),
        (k + F.when(F.col("l_partkey") % 10 < 2, 5).otherwise(0)).cast("int").alias("label2"),
        F.col("l_extendedprice").alias("atlas"),
    )
    if planes and (parts := dealt(cells)):
        cells = cells.repartition(parts, "z")
    return cells.groupBy("z", "y", "x").agg(F.min("label").alias("label"), F.max("label2").alias("label2"), F.avg("atlas").alias("atlas"))


def spot_centres(spark: SparkSession, sf: str) -> DataFrame:
    """z, y, x, s, top: where ``spots`` are planted, one a part in slabs of 64, with their widths and strengths."""
    n = F.col("p_partkey")
    return read(spark, sf, "part").select(
        (F.floor(n / 64) * 9 + 4 + n * 7 % 3).cast("int").alias("z"), (F.floor(n % 64 / 8) * 9 + 4 + n * 11 % 3).cast("int").alias("y"), (n % 8 * 9 + 4 + n * 5 % 3).cast("int").alias("x"), (n % 3 * 0.3 + 1.2).cast("double").alias("s"), (n % 2 * 0.2 + 0.6).cast("double").alias("top")
    )


def spots(spark: SparkSession, sf: str, planes: int = 64) -> DataFrame:
    """z, y, x, value: a volume of blurred spots of radius 4 (see ``spot_centres``).

    Spots are dealt to the runs of ``planes`` that they reach before they become voxels, so only they are shuffled.
    """
    ball = [(z, y, x) for z in range(-4, 5) for y in range(-4, 5) for x in range(-4, 5) if z * z + y * y + x * x <= 16]
    near = F.array(*[F.struct(F.lit(z).alias("z"), F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(float(z * z + y * y + x * x)).alias("d2")) for z, y, x in ball])
    run = lambda z: F.floor(z / planes).cast("int")
    centres = spot_centres(spark, sf)
    reached = centres.withColumn("run", F.explode(F.sequence(run(F.col("z") - 4), run(F.col("z") + 4)))).withColumn("s", 2 * F.col("s") ** 2)
    e = reached.repartition(max(centres.count() * len(ball) // ROWS + 1, partitions(spark)), "run").select("*", F.explode(near).alias("o")).filter(run(F.col("z") + F.col("o.z")) == F.col("run"))
    places = [(F.col(c) + F.col(f"o.{c}")).alias(c) for c in ("z", "y", "x")]
    return e.groupBy("run", *places).agg(F.sum(F.col("top") * F.exp(-F.col("o.d2") / F.col("s"))).alias("value")).drop("run")


#: The same views in DuckDB SQL.
SQL = {
    "voxels": "(select l_linestatus as sample, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as channel, l_quantity::int as z, round(l_discount*100)::int as y, round(l_tax*100)::int as x, (l_suppkey+1)::int as label, (l_partkey%100+1)::int as label2, l_extendedprice as atlas from lineitem)",
    "blobs": "(select event_id as blob_id, user_id as roi, (event_id*7%50)::double as z, (event_id*13%200)::double as y, (event_id*29%300)::double as x, value as radius, (event_id%3-1)::int as confirmed, (event_id%5%3-1)::int as truth, (user_id%4)::int as channel from events)",
    "places": "(select event_id as blob_id, (event_id//500)::double as z, ((event_id*event_id*31+event_id*7)%211)::double as y, ((event_id*event_id*17+event_id*13)%499)::double as x, value as radius, (event_id%3-1)::int as confirmed, (user_id%4)::int as channel from events)",
    "rois": "(select s_suppkey::bigint as roi_id, (s_suppkey%20)::int as z0, (s_suppkey*37%170)::int as y0, (s_suppkey*53%430)::int as x0, 6 as nz, 40 as ny, 60 as nx from supplier)",
    "grid": "(select z, y, x, min(label) as label, max(label2) as label2, avg(atlas) as atlas from (select (l_orderkey//20)::int as z, (l_partkey%10)::int as y, (l_suppkey%10)::int as x, (l_orderkey//60%3)::int as label, (l_orderkey//60%3 + case when l_partkey%10<2 then 5 else 0 end)::int as label2, l_extendedprice as atlas from lineitem) group by 1,2,3)",
    "metrics": "(select o_custkey as sample, c_nationkey as region, o_orderstatus as condition, o_totalprice as volume, c_acctbal as nuclei from orders join customer on o_custkey=c_custkey)",
    "ontology": "(select 1000000::bigint as id, 'root' as name, 0 as level, null::bigint as parent union all select 100000+r_regionkey, r_name, 1, 1000000 from region union all select 200000+n_nationkey, n_name, 2, 100000+n_regionkey from nation union all select s_suppkey+1, s_name, 3, 200000+s_nationkey from supplier)",
}
SQL["closure"] = f"(with recursive c as (select id as descendant, id as ancestor, 0 as depth, parent as up from {SQL['ontology']} union all select c.descendant, o.id, c.depth+1, o.parent from c join {SQL['ontology']} o on o.id=c.up) select ancestor, descendant, depth from c)"
