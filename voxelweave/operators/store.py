"""The experiment store as three keyed tables: boxes, their points, and matches of points, written into by whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import cut, shuffled
from .matching import numbered
from .points import latest_rows

#: What makes a row the same one when it is written again.
BOX = ("experiment", "series", "z0", "y0", "x0")
PLACE = ("z", "y", "x", "truth", "channel")
POINT = ("roi_id", *PLACE)
MATCH = ("roi_id", "blob1", "blob2")


@dataclass(frozen=True)
class Store:
    """``boxes(roi_id, experiment, series, z0, y0, x0, nz, ny, nx, ...)``, ``points(blob_id, roi_id, z, y, x, truth, channel, radius,
    confirmed)``, ``matches(match_id, roi_id, blob1, blob2, dist)``.

    Boxes of an experiment and place are one, unless the table has further columns, which then tell them apart.
    """

    boxes: DataFrame
    points: DataFrame
    matches: DataFrame


def empty(spark: SparkSession, more: str = "") -> Store:
    """``more``: columns with types that tell boxes of a place apart."""
    return Store(
        spark.createDataFrame([], f"roi_id long, experiment long, series int, z0 int, y0 int, x0 int, nz int, ny int, nx int{', ' * bool(more)}{more}"),
        spark.createDataFrame([], "blob_id long, roi_id long, z double, y double, x double, truth int, channel int, radius double, confirmed int"),
        spark.createDataFrame([], "match_id long, roi_id long, blob1 long, blob2 long, dist double"),
    )


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str], id_: str) -> DataFrame:
    """``old`` with the rows of ``new``: a known ``key`` keeps its id and takes the new values, new keys follow in order of key.

    ``new`` has the columns of ``old`` but for the id. Nulls in a key are equal. Of
    several new rows of a key the greatest stays, so writing a table again changes nothing.
    """
    kinds = {f.name: f.dataType for f in old.schema}
    rest = [c for c in old.columns if c != id_]
    new = cut(new.select(*[F.col(c).cast(kinds[c]).alias(c) for c in rest]))
    keyed = lambda d, *more: d.select(F.struct(*key).alias("_k"), *more)
    ids = numbered(keyed(new), keyed(old, id_), "_k", id_)
    rows = latest_rows(old.select(*rest), new, key).withColumn("_k", F.struct(*key))
    return cut(rows.join(shuffled(ids), "_k").select(*old.columns))


def inserted(store: Store, boxes: DataFrame, points: DataFrame, matches: DataFrame) -> Store:
    """The store with boxes, points and matches of one load.

    ``boxes`` has the columns of ``BOX``, those that the store tells boxes of a place apart by, and the sizes nz, ny, nx; a null series is
    0. ``points`` names its box by the same columns but for the sizes and has the points'
    columns but for the ids. ``matches`` names its box, too, and has dist and two structs ``one`` and ``two`` of ``PLACE``, the points as
    they are in the store after this load. Points of unknown boxes and matches
    of unknown points are left out, as a database would refuse them. Other columns are ignored.
    """
    zero = lambda d: d.withColumn("series", F.coalesce("series", F.lit(0)).cast("int"))
    box = [*BOX, *[c for c in store.boxes.columns if c not in (*BOX, "roi_id", "nz", "ny", "nx")]]
    held = upserted(store.boxes, zero(boxes), box, "roi_id")
    ids = held.select("roi_id", *box)
    of_box = lambda d, *own: zero(d).select(*box, *own).join(shuffled(ids), box)
    dots = upserted(store.points, of_box(points, *[c for c in store.points.columns if c not in ("blob_id", "roi_id")]), POINT, "blob_id")
    end = lambda n, name: dots.select("roi_id", F.struct(*PLACE).alias(n), F.col("blob_id").alias(name))
    kinds = ", ".join(f"{c}: {dots.schema[c].dataType.simpleString()}" for c in PLACE)
    ends = of_box(matches, "one", "two", "dist").withColumns({n: F.struct(*[F.col(f"{n}.{c}") for c in PLACE]).cast(f"struct<{kinds}>") for n in ("one", "two")})
    links = ends.join(shuffled(end("one", "blob1")), ["roi_id", "one"]).join(shuffled(end("two", "blob2")), ["roi_id", "two"])
    return Store(held, dots, upserted(store.matches, links, MATCH, "match_id"))
