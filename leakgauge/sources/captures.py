"""Captures with a provenance table: content must match, and no capture may come twice."""

from pyspark.sql import functions as F

from leakgauge.contract import DataError
from leakgauge.operators.metrics import fingerprint
from leakgauge.sources.csv import read_raw


def read_capture(spark, path, provenance):
    """Read a (compressed) capture and refuse it unless its fingerprint is the recorded one.

    ``provenance`` has one row per capture: path, rows, fingerprint, capture_key.
    """
    recorded = provenance.where(F.col("path") == path).select("rows", "fingerprint").limit(2).collect()
    if len(recorded) != 1:
        raise DataError(f"{path} needs exactly one provenance row")
    capture = read_raw(spark, path)
    found = fingerprint(capture.drop("file_ord")).first()
    if (found["rows"], found["fingerprint"]) != tuple(recorded[0]):
        raise DataError(f"{path} does not have the recorded content")
    return capture


def repeated_captures(provenance):
    return provenance.groupBy("capture_key").agg(F.count(F.lit(1)).alias("imports")).where("imports > 1")


def require_distinct_captures(provenance):
    again = repeated_captures(provenance).limit(1).collect()
    if again:
        raise DataError(f"capture {again[0]['capture_key']} is imported more than once")
    return provenance
