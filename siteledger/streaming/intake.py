"""Uploads that arrive one at a time, appended to the ledger as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import deadline
from ..plans.report import intake
from ..schemas import table_exists

REQUEST = "request_id bigint, project_id bigint, period string, type string, daily_log_path string, submitted_at timestamp"


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(REQUEST).parquet(folder)


def ledger_stream(requests: DataFrame, settlement_day: int) -> DataFrame:
    """Accepted requests as ledger rows; requests sent again are still among them."""
    accepted = intake(requests).filter("accepted").drop("accepted", "error")
    return accepted.withColumn("deadline", deadline("period", F.lit(settlement_day)))


def append_new(batch: DataFrame, ledger: str) -> None:
    """Append the requests whose id the stored ledger does not hold, each once, however late they come.

    Of a request sent several times in one batch the earliest row stands. A batch that is
    run again after a failure finds its rows stored and adds nothing.
    """
    spark = batch.sparkSession
    stored = spark.read.schema(batch.schema).parquet(ledger).select("request_id")
    order = F.struct("submitted_at", *[c for c in batch.columns if c not in ("request_id", "submitted_at")])
    once = batch.groupBy("request_id").agg(F.min(F.struct(order.alias("o"))).alias("r"))
    rows = once.select("request_id", "r.o.*").select(*batch.columns)
    rows.join(stored, "request_id", "left_anti").write.mode("append").parquet(ledger)


def append_to_ledger(rows: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Append batch by batch to the Parquet folder ``ledger``, which is made if it is absent."""
    spark = rows.sparkSession
    if not table_exists(spark, ledger):
        spark.createDataFrame([], rows.schema).write.parquet(ledger)
    return (
        rows.writeStream.foreachBatch(lambda batch, _: append_new(batch, ledger))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
