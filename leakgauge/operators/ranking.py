"""Ordered and top-k reports."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakgauge.contract import DataError

ALERT_LIMIT = 500


def newest_alerts(alerts, count=50, order="alert_seq"):
    """The latest processed alerts first; at most the 500 that are retained."""
    if not 1 <= count <= ALERT_LIMIT:
        raise ValueError(f"between 1 and {ALERT_LIMIT} alerts can be asked for")
    return alerts.orderBy(F.desc(order)).limit(count)


def false_positive_examples(scored, count=10):
    """The first flagged rows in time order, with their features."""
    return scored.where("prediction = 1").orderBy("epoch_us", "row_id").limit(count)


def ranked_importances(spark, names, values):
    """Importances from high to low with their share; one row per feature, so a tiny table."""
    if len(names) != len(values) or len(set(names)) != len(names):
        raise DataError("feature names and importances do not match")
    if any(not v >= 0 for v in values) or abs(sum(values) - 1) > 1e-6:
        raise DataError("importances must be non-negative and add up to one")
    table = spark.createDataFrame(
        [(i, n, float(v)) for i, (n, v) in enumerate(zip(names, values))],
        "position int, feature string, importance double",
    )
    rank = F.row_number().over(W.orderBy(F.desc("importance"), "position"))
    return table.select(
        rank.alias("rank"), "feature", "importance", (F.col("importance") * 100).alias("importance_percent")
    ).orderBy("rank")


def best_trial(trials, keys, trial="trial_id"):
    """Best row by the given descending keys; among equals the first trial wins."""
    return trials.orderBy(*(F.desc(k) for k in keys), trial).limit(1)


def distinct_sorted(df, column):
    return df.select(column).distinct().orderBy(column)
