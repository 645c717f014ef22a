"""Contract checks of the published raw datasets, each as one row of measurements."""

from pyspark.sql import functions as F

from leakgauge.contract import DATASET_COLUMNS
from leakgauge.functions.clock import parse_epoch_micros
from leakgauge.functions.domain import base_domain
from leakgauge.functions.lexical import dataset_features

TOLERANCE = 1e-5


def _missing(columns):
    return [
        F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"missing_{c}")
        for c in columns
    ]


def _distinct(df, column):
    """A narrow count of its own; several distinct counts in one aggregate would copy every row once per column."""
    return df.select(column).agg(F.count_distinct(column).alias("n")).scalar()


def repeated_rows(df):
    """Rows that equal an earlier row in every column."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))


def benign_contract(df, rows=None):
    """Column order, size, missing values, copies and the single label 0."""
    present = [c for c in DATASET_COLUMNS if c in df.columns]
    measured = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *_missing(present),
        F.count_if(~F.coalesce(F.col("label") == 0, F.lit(False))).alias("other_labels"),
        F.count_distinct("requested_server_name").alias("distinct_names"),
    ).withColumns({
        "columns": F.lit(len(df.columns)),
        "columns_match": F.lit(tuple(df.columns) == DATASET_COLUMNS),
        "duplicate_rows": repeated_rows(df).scalar(),
    })
    missing = sum((F.col(f"missing_{c}") for c in present), F.lit(0))
    passed = (
        F.col("columns_match") & (missing == 0) & (F.col("duplicate_rows") == 0)
        & (F.col("other_labels") == 0) & (F.col("distinct_names") > 0)
        & ((F.col("rows") == rows) if rows is not None else (F.col("rows") > 0))
    )
    return measured.withColumn("passed", passed)


def attack_contract(df, earliest_us, latest_us, rows=None):
    """As above for label 1, plus time bounds, name limits, recomputed features and diversity."""
    name = F.col("requested_server_name")
    again = dataset_features(name)
    labels = F.split(name, r"\.")
    checked = df.withColumns({f"__{k}": v for k, v in again.items()}).withColumns({
        "__us": parse_epoch_micros(F.col("timestamp")),
        "__base": F.when(F.contains(name, F.lit(".")), base_domain(name)),
    })

    def differs(column, tolerance=None):
        if tolerance is None:
            return F.col(f"__{column}") != F.col(column)
        return F.abs(F.col(f"__{column}") - F.col(column)) > tolerance

    outside = ~F.coalesce(F.col("__us").between(earliest_us, latest_us), F.lit(False))
    measured = checked.agg(
        F.count(F.lit(1)).alias("rows"),
        *_missing([c for c in DATASET_COLUMNS if c in df.columns]),
        F.count_if(~F.coalesce(F.col("label") == 1, F.lit(False))).alias("other_labels"),
        F.count_if(outside).alias("outside_time_bounds"),
        F.count_if((F.length(name) > 253) | F.exists(labels, lambda x: F.length(x) > 63)).alias("name_limit_violations"),
        F.count_if(differs("dns_query_length")).alias("length_mismatches"),
        F.count_if(differs("dns_query_entropy", TOLERANCE)).alias("entropy_mismatches"),
        F.count_if(differs("dns_subdomain_count")).alias("label_count_mismatches"),
        F.count_if(differs("dns_numerical_ratio", TOLERANCE)).alias("digit_share_mismatches"),
        F.min("dns_query_length").alias("min_length"), F.max("dns_query_length").alias("max_length"),
        F.round(F.min("dns_query_entropy"), 4).alias("min_entropy"),
        F.round(F.max("dns_query_entropy"), 4).alias("max_entropy"),
    ).withColumns({
        "distinct_names": _distinct(df, "requested_server_name"),
        "distinct_base_domains": _distinct(checked, "__base"),
        "distinct_sources": _distinct(df, "src_ip"),
        "distinct_resolvers": _distinct(df, "dst_ip"),
        "columns_match": F.lit(tuple(df.columns) == DATASET_COLUMNS),
        "duplicate_rows": repeated_rows(df).scalar(),
    })
    zero = [c for c in measured.columns if c.endswith(("_mismatches", "_violations")) or c.startswith("missing_")]
    zero += ["other_labels", "outside_time_bounds", "duplicate_rows"]
    clean = sum((F.col(c) for c in zero), F.lit(0)) == 0
    diverse = (F.col("distinct_base_domains") >= 2) & (F.col("distinct_sources") >= 2) & (F.col("distinct_resolvers") >= 2)
    size = (F.col("rows") == rows) if rows is not None else (F.col("rows") > 0)
    return measured.withColumn("passed", F.col("columns_match") & clean & diverse & size)


def require_single_class(df, label):
    """A capture with a known class may not hold rows of the other one."""
    from leakgauge.contract import DataError

    if not df.where(F.col("label") != label).isEmpty():
        raise DataError(f"the capture holds labels other than {label}")
    return df
