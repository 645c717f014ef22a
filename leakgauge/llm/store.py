"""Reading tables, shared intermediate tables and text expressions the operators have in common."""

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import functions as F

import leakgauge
from leakgauge.session import ensure_checkpoint_dir

#: A word is a run of characters other than these.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark, name):
    """A new folder below the checkpoint folder that driver and executors share; the cluster's owner clears it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df, name="table"):
    """Write a table that several later steps read, and read it back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SENT = set()


def send_package(spark):
    """Give the tasks this package, once per application, unless they find it in the same PYTHONPATH."""
    root, context = Path(leakgauge.__file__).resolve().parents[1], spark.sparkContext
    if context.applicationId in _SENT or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/leakgauge", "zip", root, "leakgauge")
    context.addPyFile(archive)  # Spark hands the driver's copy to every executor
    _SENT.add(context.applicationId)


def narrow(df, **columns):
    """Only the named inputs under names of our own, so that other columns of the table cannot clash with ours."""
    send_package(df.sparkSession)
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def utf8(column):
    """The text's bytes; null counts as empty."""
    return F.encode(F.coalesce(column, F.lit("")), "utf-8")


def words_in(column):
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def sql_crc_fold(column, folds=5):
    """The cross-validation remainder of an identifier: crc32 of its decimal text modulo the folds (null: fold of '')."""
    return F.crc32(utf8(column.cast("string"))) % folds
