"""Shared scratch space: where jobs cut lineage, and how they do it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Where that is unset, a master in one machine (tests) gets a new folder there; on a cluster it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: the lineage ends there and nothing runs twice.

    The files outlive lost executors. ``free`` deletes them once nothing reads them any more; whoever owns the shared
    folder clears the rest after the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def free(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``cut`` returned. Only for those whose readers have all run and been cut themselves."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
