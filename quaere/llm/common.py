"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, and the similarity from which two documents are near duplicates.
SHINGLE_WORDS = 5
NEAR = 0.8


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only in local mode, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quaere-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there: a lost executor costs nothing before it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_written: list[str] = []


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder as a table, for what is read more than once."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all staged tables of this process, once the results that read them are written."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than this share (1 / SPLIT) of a join's rows is joined by broadcast.
SPLIT = 1024


def split_join(many: DataFrame, one: DataFrame, on: str | list[str], total: int | None = None) -> DataFrame:
    """Inner join with a table that has each key once and, in ``n``, how many rows of ``many`` have it (``total`` in all).

    Frequent keys, SPLIT at most, are broadcast, so that their rows stay where they are; the others are dealt by key.
    """
    total = one.agg(F.sum("n")).first()[0] or 0 if total is None else total
    frequent = one.where(F.col("n") > total / SPLIT)
    if not frequent.limit(1).count():
        return many.join(one.drop("n"), on)
    near = many.join(F.broadcast(frequent.drop("n")), on)
    far = many.join(F.broadcast(frequent.select(on)), on, "left_anti").join(one.where(F.col("n") <= total / SPLIT).drop("n"), on)
    return near.unionByName(far)


def split_semi(many: DataFrame, one: DataFrame, on: str, total: int) -> DataFrame:
    """The rows of ``many`` whose key is in a table as in ``split_join``; frequent keys, SPLIT at most, are filtered by value."""
    frequent = [r[0] for r in one.where(F.col("n") > total / SPLIT).select(on).collect()]
    if not frequent:
        return many.join(one.select(on), on, "left_semi")
    rest = many.where(~F.col(on).isin(frequent)).join(one.where(F.col("n") <= total / SPLIT).select(on), on, "left_semi")
    return many.where(F.col(on).isin(frequent)).unionByName(rest.select(*many.columns))


#: Rows of a batch that Python workers are sent, at most: whole texts, and some of them are long.
BATCH_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark send Python workers no more than BATCH_ROWS rows at once (it may send fewer)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings; a null is an empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is built for one is bounded by some long texts and not by thousands."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
