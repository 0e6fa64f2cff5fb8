"""Tables and files settled in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``). Where it is unset, a local session gets one of its own, as in tests; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        where = _own.setdefault(app, "") or tempfile.mkdtemp(prefix="spark-millrace-")
        _own[app] = where
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder as Parquet and reads it back.

    Unlike ``checkpoint()`` the table is columnar and compressed, and its size is known to
    the planner. It survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def folder(settled: DataFrame):
    """The folder of a settled table, and its file system."""
    spark = settled.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(settled.settled_at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*settled: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in settled:
        path, files = folder(df)
        files.delete(path, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    if not at(path).getFileSystem(spark._jsc.hadoopConfiguration()).rename(at(path), at(to)):
        raise OSError(f"{path} can't be moved to {to}")
