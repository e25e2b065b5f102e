"""Tables that cut the lineage of iterative operators, in the folder that all executors share.

A lazy result may read such a table, so it stays until it is discarded, or until sweep() or the driver's end.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from urllib.parse import urlparse

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Tables made by this driver and not deleted yet; names of catalog tables over some of them.
_MADE: list[str] = []
_NAMED: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder named by the session. Where it names none: the warehouse, if all executors can read it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        path = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local" and urlparse(path).scheme in ("", "file"):
            raise ValueError(f"{path} is local to one machine: name a shared folder in spark.checkpoint.dir")
    return path.rstrip("/")


def path_for(spark: SparkSession, name: str) -> str:
    if not _MADE:
        atexit.register(sweep)
    _MADE.append(f"{root(spark)}/graphloom-{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def named(table: str) -> None:
    """Has sweep() drop a catalog table too."""
    _NAMED.append(table)


def sweep() -> None:
    """Deletes all tables that this driver has made and not yet deleted; done anyway when it ends."""
    jvm, spark = SparkContext._jvm, SparkSession.getActiveSession()
    while _NAMED:
        table = _NAMED.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    while _MADE:
        path = _MADE.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone, or the table
            _delete(jvm, path, jvm.org.apache.hadoop.conf.Configuration())


def _delete(jvm, path: str, conf) -> None:
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(conf).delete(hadoop, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path_for(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by written(), once nothing reads it any more."""
    path = getattr(df, "_graphloom_path", None)
    if path is None:
        return
    spark = df.sparkSession
    _delete(spark._jvm, path, spark._jsc.hadoopConfiguration())
    if path in _MADE:
        _MADE.remove(path)
