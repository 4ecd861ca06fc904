"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of working columns.
TMP = "_rs_"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that df does not have, also where columns differ in case only."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        made = TMP + name
        while made.lower() in taken:
            made += "_"
        taken.add(made.lower())
        out.append(made)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local-mode session may go without that setting; it gets a temporary
    folder. On a cluster a missing setting is an error, because a machine-local
    folder would lose rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="recordsmith-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Folders that blocks of scratch() write to, the innermost last; each thread and context has its own.
_SCRATCH: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end, but for lasting ones."""
    outer = _SCRATCH.get()
    folder = f"{outer[-1] if outer else _application_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set((*outer, folder))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        delete(spark, folder)


def _application_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/recordsmith/{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write one; nothing happens if it is not there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, never the
    stages before the written table, and a table that is read twice is computed once.
    A lasting table outlives the innermost scratch(), for what is read after it, but not the application.
    """
    spark = df.sparkSession
    folders = [_application_dir(spark), *_SCRATCH.get()]
    path = f"{folders[max(0, len(folders) - 1 - lasting)]}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def identity(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """What identifies a document where ids may be null or repeated: id and text hash.

    Rows that agree in both are one document and get the same decision.
    """
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))), F.xxhash64(text_or_empty(text))
