"""Session set-up and the few cluster settings the library reads."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app="leakgauge", master=None, **conf):
    """A session with the settings the library relies on (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark):
    """Use the folder the cluster names; make one of our own only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def stored(df, name="table"):
    """Write a table that later steps read several times to the folder that driver and executors share, and read it back.

    What is planned on top of it starts at the files, so plans stay short however many steps lie behind; the
    optimiser knows its size. Whoever owns the folder clears it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
