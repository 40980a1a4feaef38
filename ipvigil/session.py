"""Session settings for a cluster, and the shared folder for lineage cuts and streaming state."""

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "ipvigil", **conf: str) -> SparkSession:
    """A session with runtime re-planning on. Partition counts are left to the cluster's own settings."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # the state of streams on disk, not in the executors' heap
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`, the storage all executors see.

    Only where the setting is missing and all tasks run in this process (a test) a temporary folder takes its place;
    on a cluster that would be another folder on every machine, so the setting is required there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to storage that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ipvigil-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ipvigil/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df, purpose: str = "cut", by: str | None = None):
    """Write `df` to the shared folder and read it back; survives the loss of any executor.

    Rows of one value of `by`, the last column, are read without those of the others.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.mode("overwrite").partitionBy(*([by] if by else [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
