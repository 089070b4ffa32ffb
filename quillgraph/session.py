"""Session set-up, table access and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "quillgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app).config(map=settings | {k.replace("__", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Only a local session without one (tests) gets a folder of its own."""
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    return _own[context.applicationId]


def cut(df: DataFrame, name: str = "cut", by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan restarts there, and the rows survive lost executors.

    With ``by`` there is a folder for each value of that column, and a filter on it reads no other.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def cut_watched(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict[str, float]]:
    """:func:`cut`, and what ``sums``, aggregates over all rows, come to while these are written."""
    seen = Observation()
    out = cut(df.observe(seen, *(v.alias(k) for k, v in sums.items())), name)
    got = seen.get or {}
    return out, {k: got.get(k) or 0 for k in sums}


def cut_counted(df: DataFrame, name: str, where: Column | None = None) -> tuple[DataFrame, int]:
    """:func:`cut`, and the number of rows, or of those with ``where``."""
    out, seen = cut_watched(df, name, n=F.count(F.lit(1)) if where is None else F.count_if(where))
    return out, int(seen["n"])


def forget(*tables: DataFrame) -> None:
    """Delete tables written by :func:`cut` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            if "/quillgraph/" in folder:
                place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                place.getFileSystem(conf).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
