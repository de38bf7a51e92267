"""Reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset and the master is local (tests on one machine) is a temporary folder
    made. On a cluster without the setting this is an error, as executors
    would write to folders that others don't see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(scratch, "own", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        scratch.own = root
    path = f"{root.rstrip('/')}/voxelweave-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


_made: list[tuple[SparkSession, str]] = []


def _remove(made: list[tuple[SparkSession, str]]) -> None:
    for spark, path in made:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the JVM is gone already; the cluster clears its checkpoint folder
            return


@atexit.register
def _clear() -> None:
    _remove(_made)


def free(*tables: DataFrame) -> None:
    """Removes tables that ``cut`` wrote and that nothing reads any more, as those of earlier rounds of a loop."""
    paths = {p for t in tables if (p := getattr(t, "_scratch", None))}
    _remove([x for x in _made if x[1] in paths])
    _made[:] = [x for x in _made if x[1] not in paths]


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there.

    Later jobs start from the files, so a lost executor costs a reread and no
    job runs a plan of unbounded depth.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of an equi-join that shuffles both sides.

    Spark takes the size of exploded rows for that of the rows before, and so
    would send the copies whole through the driver to all executors.
    """
    return df.hint("merge")


def text_batches(spark: SparkSession, rows: int = 2000, size: int = 16 * 2**20) -> None:
    """Bound the rows and the bytes of an Arrow batch, as whole texts may be long (a single longer text is a batch of its own).

    Only lowers the session's settings, and leaves them so: results are lazy, and run with the settings of their action.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = bytes_of(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def bytes_of(setting: str) -> int:
    """A size as Spark writes it, as ``64m``."""
    unit = setting.strip().lower().rstrip("b")
    scale = {"k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}.get(unit[-1:], 1)
    return int(unit.rstrip("kmgt")) * scale


def partitions(spark: SparkSession) -> int:
    """Partitions for an explicit shuffle: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, columns: Sequence[str]) -> str:
    """``name``, made longer until none of ``columns`` is called so, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
