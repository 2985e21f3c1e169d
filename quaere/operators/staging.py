"""Tables that an operator writes down between its steps, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder; one of our own in local mode only, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quaere-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def place(spark: SparkSession, name: str = "step") -> str:
    """The path of a new table in the shared folder."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own: what reads it several times is planned from its columns and size, and a lost executor costs no step before it."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete this process's tables, once the results that read them are written."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
