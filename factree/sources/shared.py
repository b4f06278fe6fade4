"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: dict[tuple[str, str], str] = {}


def _path(spark: SparkSession, path: str):
    """A path and its file system, on the driver's JVM."""
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(context._jsc.hadoopConfiguration())


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, and an error on a cluster, whose machines would
    not see each other's folders."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="factree-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; what is left in it goes when the driver's JVM ends."""
    key = (shared_root(spark), spark.sparkContext.applicationId)
    if key not in _folders:
        folder = f"{key[0]}/factree-{key[1]}"
        path, files = _path(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders[key] = folder
    return _folders[key]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside deletes its shuffle files as it ends. Otherwise they stay until the driver collects garbage, so that the
    files of many writes, several times the input, lie on the executors' disks together. Only for queries that no later one reads the shuffles of."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def scratch(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, computes once, leaves no shuffle files."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*written: DataFrame | None) -> None:
    """Deletes what scratch() wrote for these frames; frames of other origin stay. For tables that nothing lazy reads any more."""
    for df in written:
        path = getattr(df, "_scratch", None)
        if path is not None:
            delete(df.sparkSession, path)
            df._scratch = None


def delete(spark: SparkSession, path: str) -> None:
    found, files = _path(spark, path)
    files.delete(found, True)
