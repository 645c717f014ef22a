"""Row validation: the first broken rule as a column, and what to do with bad rows."""

from pyspark.sql import functions as F

from leakgauge.contract import DataError
from leakgauge.functions.clock import parse_epoch_micros, standard_text
from leakgauge.functions.domain import fqdn_problem, normalize_domain, stripped
from leakgauge.functions.net import is_valid_ip
from leakgauge.functions.once import computed_once
from leakgauge.operators.dedup import RAW_SIGNATURE
from leakgauge.plans.ordered import ROWS_PER_TASK, last_known, with_running


def _blank(name):
    return stripped(F.coalesce(F.col(name), F.lit(""))) == ""


def with_problem(raw):
    """Add the parsed time, the normalised name and the code of the first broken rule."""
    parsed = computed_once(raw, {
        "epoch_us": parse_epoch_micros(F.col("timestamp")),
        "normal_name": normalize_domain(F.col("requested_server_name")),
    }).withColumn("__name_problem", fqdn_problem(F.col("normal_name")))
    return parsed.withColumn(
        "problem",
        F.when(_blank("timestamp"), "empty_timestamp")
        .when(_blank("src_ip"), "empty_src_ip")
        .when(_blank("dst_ip"), "empty_dst_ip")
        .when(_blank("requested_server_name"), "empty_requested_server_name")
        .when(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "bad_label")
        .when(F.col("epoch_us").isNull(), "bad_timestamp")
        .when(~is_valid_ip(F.col("src_ip")), "bad_src_ip")
        .when(~is_valid_ip(F.col("dst_ip")), "bad_dst_ip")
        .when(F.col("__name_problem").isNotNull(), F.concat(F.lit("bad_name:"), "__name_problem")),
    ).drop("__name_problem")


def split_by_problem(flagged):
    """(good rows, bad rows with their position and reason)."""
    bad = flagged.where("problem IS NOT NULL")
    keep = [c for c in ("capture_id", "request_id", "file_ord", "batch_seq", "row_id", "seq") if c in flagged.columns]
    return flagged.where("problem IS NULL").drop("problem"), bad.select(*keep, "problem")


def with_strict_problem(raw):
    """As ``with_problem``, but the label must be written as exactly 0 or 1."""
    number = F.col("label_text").try_cast("double")
    strict = F.when(~F.coalesce(number.isin(0.0, 1.0), F.lit(False)), F.lit("bad_label")).otherwise(F.col("problem"))
    return with_problem(raw).withColumn("problem", strict)


def require_valid(raw):
    """Strict mode: any bad row fails the load."""
    flagged = with_strict_problem(raw)
    first_bad = F.min(F.when(F.col("problem").isNotNull(), F.struct("row_id", "problem")))
    found = flagged.agg(F.count(F.lit(1)).alias("rows"), first_bad.alias("bad")).first()
    if found["bad"]:
        raise DataError(f"row {found['bad']['row_id']}: {found['bad']['problem']}")
    if not found["rows"]:
        raise DataError("the input has no rows")
    return flagged.drop("problem")


def validation_report(flagged):
    """One row of totals. Rows with the signature of an earlier valid row count as duplicates."""
    valid = F.col("problem").isNull()
    signature = [
        F.when(valid, F.lower(c) if c == "requested_server_name" else F.col(c)).alias(f"__s{i}")
        for i, c in enumerate(RAW_SIGNATURE)
    ]
    label = f"__s{RAW_SIGNATURE.index('label')}"
    groups = flagged.groupBy(valid.alias("__valid"), *signature).agg(F.count(F.lit(1)).alias("n"))
    kept = F.count_if(F.col("__valid"))
    invalid = F.coalesce(F.sum(F.when(~F.col("__valid"), F.col("n"))), F.lit(0))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        kept.alias("valid_records"),
        invalid.alias("invalid_records"),
        (F.coalesce(F.sum(F.when(F.col("__valid"), F.col("n"))), F.lit(0)) - kept).alias("duplicate_records"),
        F.count_if(F.col("__valid") & (F.col(label) == 0)).alias("label_0"),
        F.count_if(F.col("__valid") & (F.col(label) == 1)).alias("label_1"),
        ((invalid == 0) & (kept > 0)).alias("is_successful"),
    )


def reason_counts(flagged, reason="problem"):
    return flagged.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("rows"))


def sample_problems(flagged, count=5):
    keys = [c for c in ("file_ord", "row_id") if c in flagged.columns]
    return flagged.where("problem IS NOT NULL").select(*keys, "problem").orderBy(*keys).limit(count)


def with_timestamp_fallback(df, ingest_us, keys=("capture_id",), order=("row_id",), limit=ROWS_PER_TASK):
    """Fill blank times: the last parsed time before the row in its capture, else the ingestion time.

    Only blank times fall back; unreadable ones stay and get a problem. Carried times have the
    millisecond precision of the standard text. ``ts_fallback`` tells which rule was used.
    """
    parsed = computed_once(df, {"epoch_us": parse_epoch_micros(F.col("timestamp"))})
    to_millis = F.col("epoch_us") - F.pmod(F.col("epoch_us"), F.lit(1000))
    carried = with_running(parsed, keys, order, limit=limit, __carried=last_known(to_millis))
    blank = _blank("timestamp")
    return carried.withColumns({
        "epoch_us": F.when(blank, F.coalesce("__carried", F.lit(ingest_us).cast("bigint"))).otherwise(F.col("epoch_us")),
        "ts_fallback": F.when(blank & F.col("__carried").isNotNull(), "previous_row").when(blank, "ingestion_time"),
    }).withColumns({
        "timestamp": F.when(F.col("epoch_us").isNull(), F.col("timestamp")).otherwise(standard_text(F.col("epoch_us"))),
        "problem": F.when(F.col("epoch_us").isNull(), "bad_timestamp"),
    }).drop("__carried")
