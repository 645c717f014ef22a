"""Scoring of batches and the verdict columns of scored rows."""

from pyspark.sql import functions as F

from leakgauge.contract import GROUP_KEYS
from leakgauge.functions.domain import normalize_domain
from leakgauge.functions.verdict import ROW_IDENTITY, indicator_reasons, risk_tier, row_alert_id, rule_indicators, verdict_text
from leakgauge.operators.validate import split_by_problem, with_timestamp_fallback
from leakgauge.plans.cleaning import derive_features, normalized, parse_lenient
from leakgauge.plans.forest import with_prediction


def with_verdict(scored, threshold):
    """Tier, text, indicators, reasons and (for flagged rows) the alert id."""
    return scored.withColumns({
        "verdict": verdict_text(F.col("prediction")),
        "threshold": F.lit(float(threshold)),
        "risk_label": risk_tier(F.col("score"), threshold),
        "rule_indicators": rule_indicators(columns=scored.columns),
        "alert_id": F.when(F.col("prediction") == 1, row_alert_id(scored.columns)),
    }).withColumn("reasons", indicator_reasons())


def history_keys(columns):
    """What shares a history: a client and apex within one request (or upload) of one capture."""
    return tuple(c for c in ("capture_id", "request_id", "file_ord") if c in columns)


def batch_features(parsed, order, window_seconds, layout=None):
    """Fresh history per capture and request; equal times are taken in arrival order."""
    return derive_features(parsed, (*history_keys(parsed.columns), *GROUP_KEYS), window_seconds, order, layout=layout)


def in_input_order(scored):
    """Rows as they came: by capture, request, file and place."""
    return scored.orderBy(*(c for c in ROW_IDENTITY if c in scored.columns))


def score_batch(raw, bundle, order=("seq",), layout=None, input_order=True):
    """Score a batch in one plan, in input order unless the caller does without."""
    features = batch_features(parse_lenient(raw), order, bundle.window_seconds, layout)
    scored = with_verdict(with_prediction(features, bundle.model, bundle.threshold), bundle.threshold)
    return in_input_order(scored) if input_order else scored


def score_upload(upload, bundle, ingest_us):
    """Uploaded rows: blank times are filled, unreadable ones are reported. Gives (scored in input order, rejected)."""
    timed = with_timestamp_fallback(upload, ingest_us, history_keys(upload.columns))
    good, bad = split_by_problem(timed)
    parsed = normalized(good.withColumn("normal_name", normalize_domain(F.col("requested_server_name"))))
    features = batch_features(parsed, ("row_id",), bundle.window_seconds)
    scored = with_verdict(with_prediction(features, bundle.model, bundle.threshold), bundle.threshold)
    return in_input_order(scored), bad


def batch_summary(scored, rejected=None):
    """Totals per capture and request, with the rows that were skipped because they could not be read."""
    keys = [c for c in ("capture_id", "request_id") if c in scored.columns]
    judged = scored.select(*keys, "prediction", F.lit(0).alias("skipped"))
    if rejected is not None:
        judged = judged.unionByName(rejected.select(*keys, F.lit(None).cast("int").alias("prediction"), F.lit(1).alias("skipped")))
    return judged.groupBy(*keys).agg(
        F.count("prediction").alias("total_queries"),
        F.count_if(F.col("prediction") == 1).alias("suspicious_queries"),
        F.count_if(F.col("prediction") != 1).alias("benign_queries"),
        F.sum("skipped").alias("invalid_rows_skipped"),
    )
