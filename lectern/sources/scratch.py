"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_folder(spark: SparkSession, name: str = "table") -> str:
    """A new folder name under ``spark.checkpoint.dir``; under a temporary folder only where that is unset and all work is on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-lectern-"))
    return f"{root.rstrip('/')}/lectern-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """``df`` as a written table: evaluated once, and its lineage cut in a way that a lost executor does not undo."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_written(df: DataFrame) -> None:
    """Delete a table of ``written``, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/lectern-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
