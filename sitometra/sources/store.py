"""Tables written on the way, which cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one in local mode, and an error on a cluster."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table to the shared folder for checkpoints and go on from there.

    A written table outlives lost executors, is compressed, and is read by column;
    unlike a checkpoint it also leaves the plan's constraints behind, which iterations
    would pile up. It goes by forget(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    path = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    # The write has a plan of its own, so no later one looks for its shuffles: their files go as it ends.
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(df._written)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
