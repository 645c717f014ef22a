"""JSON scans: query batches, sensor streams and stored reports."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakgauge.contract import BATCH_SCHEMA, SENSOR_SCHEMA


def explode_batches(batches):
    """One row per query; ``seq`` is its place in the batch.

    The capture of the batch separates histories. A capture named by a single query only labels its alert.
    """
    keep = [c for c in batches.columns if c not in ("capture_id", "queries")]
    return batches.select(*keep, "capture_id", F.posexplode("queries").alias("seq", "q")).select(
        *keep,
        "capture_id",
        F.col("seq").cast("bigint").alias("seq"),
        "q.timestamp", "q.src_ip", "q.dst_ip", "q.requested_server_name",
        F.coalesce("q.query_type", F.lit("A")).alias("query_type"),
        F.coalesce("q.source", F.lit("API")).alias("source"),
        F.coalesce("q.capture_id", "capture_id").alias("alert_capture_id"),
    )


def read_batches(spark, path):
    """Stored requests: each file holds one or a list of them. ``request_id`` is the file and the place in it, so that
    no two requests share a history or an alert; a request that names no capture is one of its own."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.from_json("value", T.ArrayType(BATCH_SCHEMA), {"mode": "FAILFAST"}).alias("requests"),
    )
    requests = files.select("file", F.posexplode("requests").alias("place", "r")).select(
        F.concat_ws("#", "file", F.col("place").cast("string")).alias("request_id"), "r.*")
    return explode_batches(with_own_capture(requests))


def with_own_capture(requests):
    """Requests without a capture get one made from their id."""
    own = F.concat(F.lit("batch_"), F.sha2("request_id", 256))
    return requests.withColumn("capture_id", F.coalesce("capture_id", own))


def sensor_stream(spark, path, files_per_trigger=None):
    """Files of sensor batches as they arrive, each with its arrival number."""
    reader = spark.readStream.schema(SENSOR_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return explode_batches(reader.json(path))


def read_report(spark, path, defaults):
    """A stored report; top-level fields that are absent or null take the given default."""
    report = spark.read.option("multiLine", True).json(path)
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in report.columns else F.lit(value)
        for name, value in defaults.items()
    }
    return report.withColumns(filled)
