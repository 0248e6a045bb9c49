"""Tables written between the steps of a run, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Without that setting local sessions use a temporary folder; sessions on a
    cluster are refused, because their executors could not read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used; removed by :func:`remove_staged` or when the driver ends."""
    path = f"{shared_dir(spark)}/plumbline/{what}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(remove_staged)
    _staged.append((spark, path))
    return path


def remove_staged() -> None:
    """Delete every staged table; for long sessions, between queries whose results have been read."""
    for spark, path in _staged:
        if spark.sparkContext._jsc is not None:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    _staged.clear()


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written and read again: its plan runs once, and a lost executor costs no recomputation of what stands before."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
