"""The folder that the whole cluster shares, for tables that outlive a job."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made for local sessions that name none, by application.
_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all tasks run on this machine, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if context.applicationId not in _OWN_DIRS:
            _OWN_DIRS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quaestor-")
        found = _OWN_DIRS[context.applicationId]
    return found.rstrip("/")


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time) of the files at a path (a file, a folder, or a pattern), in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    tops = [system.getFileStatus(where)] if system.exists(where) else list(system.globStatus(where) or [])
    out = []
    while tops:
        top = tops.pop()
        if top.isDirectory():
            tops += [s for s in system.listStatus(top.getPath()) if not s.getPath().getName().startswith(("_", "."))]
        else:
            out.append((str(top.getPath()), top.getLen(), top.getModificationTime()))
    return sorted(out)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, has a known size."""
    path = f"{folder or shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.parquet(path)
    table._written_to = path
    return table


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that nothing refers to. Spark deletes them once the JVM collects their handles, which would else happen by chance."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
