"""Tables written to the folder that driver and executors share; they cut lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder, on a local master alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="wordloom-")
    return _OWN[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/wordloom/{tag}-{uuid.uuid4().hex}"


#: Spark then removes the shuffle files of a query as soon as it has ended, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, tag: str, clean: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again. It cuts the lineage,
    survives lost executors, and later passes can prune its columns. With ``clean``
    the shuffle files of the write are removed at once; the session's setting is put back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(CLEANUP, "false")
    if clean:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
