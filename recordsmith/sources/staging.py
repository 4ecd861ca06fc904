"""Tables that are written once and read twice, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of a local-mode session without spark.checkpoint.dir, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; it is deleted when the driver's JVM ends.

    Without that setting a local-mode session gets a temporary folder, and a cluster an error.
    """
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="recordsmith-")
        base = _LOCAL[app]
    path = f"{base.rstrip('/')}/recordsmith/{app}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back, so that what is split from it is computed once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
