"""Small helpers shared by the text operators."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable

__all__ = ["batch_rows", "by_value", "durable", "narrow", "sent_if_small", "shared_folder", "small_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names.

    Every operator starts here, so further columns of the input, whatever their names,
    cannot clash with the columns an operator adds.
    """
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def by_value(module) -> None:
    """Ship the functions of a module inside the job, so that workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(module)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows cross to Python at once, because texts may be long.

    The session's own value stays when it is lower.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


#: Rows of a few numbers each up to which a table is sent to every task.
SENT_ROWS = 200_000


def sent_if_small(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """The table, marked for broadcast if it is counted to have at most so many rows.

    For stored tables, which are cheap to count; a larger one is joined by a shuffle.
    """
    return F.broadcast(df) if df.count() <= rows else df


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Jobs that run inside send at most so many rows to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, where intermediate tables are written.

    Named by ``spark.checkpoint.dir``; on a local master without that setting, a private one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running this job")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return named.rstrip("/")
