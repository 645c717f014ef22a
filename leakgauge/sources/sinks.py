"""Table writers. Every batch writer refuses a path that already holds data."""

from pyspark.sql import functions as F

from leakgauge.contract import MODEL_FEATURES, PREDICTION_SCHEMA, DataError
from leakgauge.functions.clock import printed_seconds
from leakgauge.functions.domain import flatten_labels
from leakgauge.functions.verdict import ROW_IDENTITY, risk_tier, row_alert_id, rule_indicators
from leakgauge.plans.cleaning import cleaned_table

MODE = "errorifexists"


def printed_cleaned(cleaned):
    """The cleaned columns with the epoch printed to three decimals."""
    return cleaned_table(cleaned.withColumn("epoch_time", printed_seconds(F.col("epoch_us"))))


def write_cleaned_csv(cleaned, path):
    printed_cleaned(cleaned).write.mode(MODE).option("header", True).csv(path)


def write_cleaned(cleaned, path, partition_by=("event_date",)):
    """The default store: parquet, by day, so that time filters skip whole folders."""
    if "labels" in cleaned.columns:
        cleaned = flatten_labels(cleaned)
    table = cleaned.withColumn("event_date", F.to_date(F.timestamp_micros("epoch_us")))
    table.write.mode(MODE).partitionBy(*partition_by).parquet(path)


def with_features_in_place(original, features, row_id="row_id"):
    """All original columns, then the ten features; features already present keep their place."""
    fresh = features.select(row_id, *(F.col(f).alias(f"__{f}") for f in MODEL_FEATURES))
    joined = original.join(fresh, row_id)
    columns = [F.col(f"__{c}").alias(c) if c in MODEL_FEATURES else F.col(c) for c in original.columns]
    columns += [F.col(f"__{f}").alias(f) for f in MODEL_FEATURES if f not in original.columns]
    return joined.select(*columns)


def write_features(table, path, form="csv"):
    writer = table.write.mode(MODE)
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def split_manifest(df):
    return df.select(F.col("row_id").alias("input_row_id"), "split", "apex_domain")


def prediction_table(scored, extra=()):
    """Published prediction columns; ``extra`` adds columns of nested, diagnostic or stress runs."""
    names = [f.name for f in PREDICTION_SCHEMA.fields]
    table = scored.withColumnsRenamed({"row_id": "input_row_id", "score": "attack_probability"})
    return table.select(*(c for c in names if c in table.columns), *extra)


def write_table(df, path):
    df.write.mode(MODE).option("header", True).csv(path)


def write_report(report, path):
    """A one-row report as JSON with sorted keys; not-a-number values are refused."""
    doubles = [f.name for f in report.schema.fields if f.dataType.simpleString() in ("double", "float")]
    if doubles:
        bad = F.lit(False)
        for name in doubles:
            bad = bad | F.coalesce(F.isnan(name) | (F.abs(name) == float("inf")), F.lit(False))
        if not report.where(bad).isEmpty():
            raise DataError("a report may not hold values that are not finite")
    report.select(*sorted(report.columns)).coalesce(1).write.mode(MODE).option("ignoreNullFields", False).json(path)


def alert_rows(scored, threshold, columns=None):
    """Alerts of flagged rows, with an id that a repeated run reproduces."""
    capture = F.coalesce("alert_capture_id", "capture_id") if "alert_capture_id" in scored.columns else F.col("capture_id")
    return scored.where("prediction = 1").select(
        row_alert_id(scored.columns).alias("alert_id"),
        "timestamp", "requested_server_name", "src_ip", "dst_ip",
        risk_tier(F.col("score"), threshold).alias("risk_label"),
        F.col("score").alias("attack_score"),
        F.lit(float(threshold)).alias("decision_threshold"),
        rule_indicators(columns=columns).alias("rule_indicators"),
        capture.alias("capture_id"),
        *(c for c in ROW_IDENTITY[1:] if c in scored.columns),
    )


def append_alerts(alerts, path):
    alerts.write.mode("append").parquet(path)


def import_capture(packets, source, path, summary_path, max_packets=None):
    """Canonical capture table, and its one-row summary with the packet counters."""
    from leakgauge.sources.packets import import_summary, import_table, packet_counts, packet_events

    events = packet_events(packets, source, max_packets=max_packets)
    import_table(events).write.mode(MODE).option("header", True).csv(path)
    import_summary(events, packet_counts(packets, max_packets)).write.mode(MODE).json(summary_path)
