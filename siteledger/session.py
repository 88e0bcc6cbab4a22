"""Session settings used by tests and the benchmark; jobs may bring their own."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "siteledger", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "Asia/Taipei")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, for intermediate tables; named by ``spark.checkpoint.dir``.

    A private folder is used only where none is configured and the master is local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running this job")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the checkpoint folder shared by the cluster.

    The folder named by ``spark.checkpoint.dir`` is used when the session has one.
    A private folder is set only where none is configured and the master is local.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = shared_folder(df.sparkSession)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
