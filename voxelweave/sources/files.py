"""Readers and writers of the file kinds that region work exchanges."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detection import formatted
from ..operators.ranks import quantiles, running
from ..plans.tables import cut, text_batches


def write_points(points: DataFrame, path: str) -> None:
    """z, y, x and r as compressed CSV with a header."""
    points.select("z", "y", "x", F.col("radius").alias("r")).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def read_points(spark: SparkSession, path: str, channel: int | None = 0) -> DataFrame:
    """A stored blob table of any version, with all columns: older ones lack flags and absolute places (see ``formatted``)."""
    return formatted(spark.read.option("mergeSchema", True).parquet(path), channel)


def volume_metadata(v: DataFrame, resolution: Sequence[float], magnification: float = 1.0, zoom: float = 1.0, value: str = "value") -> DataFrame:
    """One row about a volume: its shape, value type, resolutions and magnification, and the values near its ends (quantiles 0.005 and 0.995)."""
    ends = quantiles(v.withColumn("_all", F.lit(0)), ["_all"], value, {"near_min": 0.005, "near_max": 0.995})
    shape = v.agg(*[(F.max(c) + 1).alias(f"n{c}") for c in ("z", "y", "x")]).withColumn("_all", F.lit(0))
    own = {"value_type": v.schema[value].dataType.simpleString(), "magnification": magnification, "zoom": zoom} | dict(zip(("resolution_z", "resolution_y", "resolution_x"), resolution, strict=True))
    return shape.join(F.broadcast(ends), "_all", "left").drop("_all").withColumns({k: F.lit(x) for k, x in own.items()})  # one row each


def read_ontology_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested nodes below ``msg[0]``, children in arrays of any depth -> id, name, acronym, level, parent.

    Children stay text until their level is reached; goes on until a level has no nodes.
    """
    node = "array<struct<id long, name string, acronym string, st_level int, parent_structure_id long, children string>>"
    level = spark.read.schema(f"msg {node}").option("multiLine", True).json(path).select(F.explode(F.slice("msg", 1, 1)).alias("n"))
    out = None
    while True:
        level = cut(level)
        if level.isEmpty() and out is not None:
            return out
        rows = level.select("n.id", "n.name", F.coalesce("n.acronym", F.lit("")).alias("acronym"), F.coalesce("n.st_level", F.lit(1)).alias("level"), F.col("n.parent_structure_id").alias("parent"))
        out = rows if out is None else out.unionByName(rows)
        level = level.select(F.explode(F.from_json("n.children", node)).alias("n"))


def read_ontology_csv(spark: SparkSession, path: str) -> DataFrame:
    """A flat tree; name defaults to the id, level to 1, acronym to the empty string."""
    df = spark.read.option("header", True).csv(path)
    have = lambda c, default: F.coalesce(F.col(c), default) if c in df.columns else default
    return df.select(
        F.col("id").cast("long").alias("id"),
        have("name", F.col("id")).alias("name"),
        have("acronym", F.lit("")).alias("acronym"),
        have("level", F.lit("1")).cast("int").alias("level"),
        have("parent", F.lit(None)).cast("long").alias("parent"),
    )


def read_label_description(spark: SparkSession, path: str) -> DataFrame:
    """Lines of id, colour, visibility and a quoted name; # begins a comment, and lines of another form are an error."""
    line = r'^\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+([\d.]+)\s+(\d+)\s+(\d+)\s+"(.*)"'
    part = lambda i: F.regexp_extract("value", line, i)
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    whole = F.when(F.col("value").rlike(line), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a label description: "), F.col("value"))))
    rows = rows.select(whole.alias("value"))
    ints = {1: "id", 2: "r", 3: "g", 4: "b", 6: "vis", 7: "mesh"}
    return rows.select(*[part(i).cast("int").alias(n) for i, n in ints.items()], part(5).cast("double").alias("a"), part(8).alias("name"))


def merge_csvs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All rows, with the union of the columns."""
    out = None
    for p in paths:
        df = spark.read.option("header", True).csv(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_csv(dfs: Sequence[DataFrame], path: str, sort: Sequence[str]) -> None:
    """Rows of all tables, sorted, with NaN for null."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    out.orderBy(*sort).write.mode("overwrite").option("header", True).option("nullValue", "NaN").csv(path)


def read_raw_volume(spark: SparkSession, path: str, dtype: str, shape: tuple[int, int, int]) -> DataFrame:
    """A flat binary array as voxels (z, y, x, value); one record a row of x."""
    _, ny, nx = shape
    rows = spark.sparkContext.binaryRecords(path, nx * np.dtype(dtype).itemsize).zipWithIndex()

    def values(batches):
        for pdf in batches:
            data = [np.frombuffer(b, dtype).astype(np.float64) for b in pdf.data]
            at = np.repeat(pdf.row.to_numpy(), nx)
            yield pd.DataFrame({"z": at // ny, "y": at % ny, "x": np.tile(np.arange(nx), len(data)), "value": np.concatenate(data) if data else []})

    return spark.createDataFrame(rows.map(lambda r: (bytearray(r[0]), r[1])), "data binary, row long").mapInPandas(values, "z int, y int, x int, value double")


def read_planes(spark: SparkSession, path: str, pattern: str = r"_ch_?(\d+)", suffix: str = "") -> DataFrame:
    """Plane files of a folder -> path, channel (from the name by ``pattern``, else 0) and z (order of the names in a channel)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    channel = F.coalesce(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("int"), F.lit(0))
    ordered = files.select("path", "length", channel.alias("channel"), name.alias("name"), F.lit(1).alias("one"))
    return running(ordered, ["channel"], "name", "one").select("path", "length", "channel", F.col("before").cast("int").alias("z"))


def records(spark: SparkSession, rows: Sequence[dict], columns: dict[str, str]) -> DataFrame:
    """A table of records, or of a dict of lists, with ``columns`` (source key -> column name) in that order."""
    if isinstance(rows, dict):
        rows = [dict(zip(rows, x, strict=True)) for x in zip(*rows.values(), strict=True)]
    return spark.createDataFrame([tuple(r.get(k) for k in columns) for r in rows], list(columns.values()))


def read_plane_volume(spark: SparkSession, path: str, dtype: str | None = None, shape: tuple[int, int] | None = None, pattern: str = r"_ch_?(\d+)", suffix: str = ".npy") -> DataFrame:
    """Plane files of a folder as voxels (channel, z, y, x, value): channels and order as ``read_planes`` finds them.

    Files are NumPy's own format, or flat arrays where ``dtype`` and ``shape`` (y, x) are given. Only
    files that end in ``suffix`` count. A file that is no plane, or not of ``shape``, is an error that names
    it; without ``shape`` planes may differ in size. One file at a time is decoded, its rows passed on in slices.
    """
    ordered = read_planes(spark, path, pattern, suffix).select("path", "channel", "z")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "content").join(ordered, "path")

    def decoded(name: str, data: bytes) -> np.ndarray:
        try:
            a = np.load(io.BytesIO(data), allow_pickle=False) if dtype is None else np.frombuffer(data, dtype).reshape(shape)
        except ValueError as e:
            raise ValueError(f"not a plane: {name}") from e
        if a.ndim != 2 or shape is not None and a.shape != tuple(shape):
            raise ValueError(f"not a plane: {name}")
        return a

    def voxels(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                name, content, channel, z = (batch.column(c)[row] for c in ("path", "content", "channel", "z"))
                a = decoded(name.as_py(), content.as_py())
                step = max(1, 2**18 // max(a.shape[1], 1))
                for y0 in range(0, a.shape[0], step):
                    part = a[y0 : y0 + step].astype(np.float64)
                    y, x = np.indices(part.shape, np.int32)
                    same = lambda v: np.full(part.size, v.as_py(), np.int32)  # noqa: B023, E731
                    yield pa.record_batch({"channel": same(channel), "z": same(z), "y": (y + np.int32(y0)).ravel(), "x": x.ravel(), "value": part.ravel()})

    text_batches(spark)
    return files.mapInArrow(voxels, "channel int, z int, y int, x int, value double")
