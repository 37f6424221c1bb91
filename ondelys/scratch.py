"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the session doesn't set it and runs in one process (tests) a
    folder of our own is made and set; on a cluster executors couldn't see it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="ondelys-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/ondelys-{uuid.uuid4().hex}/{name}"
    _WRITTEN.append((spark, path.rsplit("/", 1)[0]))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts lineage so that a lost executor costs a reread and not a recompute,
    and gives the optimizer real sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def clean() -> None:
    """Delete what this process staged, as far as its session still runs."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        with contextlib.suppress(Exception):
            if spark._jsc is not None and not spark._jsc.sc().isStopped():
                delete(spark, path)
