"""From raw query rows to cleaned rows and features."""

from pyspark.sql import functions as F

from leakgauge.contract import CLEANED_COLUMNS, GROUP_KEYS, WINDOW_SECONDS, DataError
from leakgauge.functions.clock import epoch_seconds, parse_epoch_micros, standard_text
from leakgauge.functions.domain import normalize_domain, with_domain_parts
from leakgauge.functions.lexical import with_lexical_features
from leakgauge.functions.once import computed_once
from leakgauge.operators.behavior import with_window_features
from leakgauge.operators.dedup import drop_repeated_events, drop_repeated_rows
from leakgauge.operators.validate import with_problem, with_strict_problem
from leakgauge.plans.ordered import ROWS_PER_TASK


def normalized(valid):
    """Decompose rows that already carry ``epoch_us`` and ``normal_name``."""
    named = valid.withColumn("requested_server_name", F.col("normal_name")).drop("normal_name")
    return with_domain_parts(named).withColumns({
        "epoch_time": epoch_seconds(F.col("epoch_us")),
        "timestamp": standard_text(F.col("epoch_us")),
    })


def parse_lenient(raw):
    """Scoring input: names are normalised but not judged; only an unreadable time is a problem.

    A table that brings exact times as ``epoch_us`` is not parsed again.
    """
    work = {"normal_name": normalize_domain(F.col("requested_server_name"))}
    if "epoch_us" not in raw.columns:
        work["epoch_us"] = parse_epoch_micros(F.col("timestamp"))
    return normalized(computed_once(raw, work)).where("epoch_us IS NOT NULL")


def clean(raw, deduplicate=True):
    """Drop-and-report mode: valid rows, first of each raw signature, decomposed."""
    valid = with_problem(raw).where("problem IS NULL").drop("problem")
    return normalized(drop_repeated_rows(valid) if deduplicate else valid)


def chronological(cleaned):
    """Global order by time, client, name and label; the row key makes it total and splits equal rows."""
    tie = [c for c in ("file_ord", "row_id") if c in cleaned.columns]
    return cleaned.orderBy("epoch_us", "src_ip", "requested_server_name", "label", *tie)


def load_strict(raw):
    """Model input: every row must be valid, repeated events are dropped, conflicting ones refused.

    One pass over narrow columns finds whatever speaks against the load, a second one delivers the rows.
    """
    if raw.isEmpty():
        raise DataError("the input has no rows")
    named = with_strict_problem(raw).withColumn("requested_server_name", F.col("normal_name"))
    return normalized(drop_repeated_events(named, "problem").drop("problem"))


def cleaned_table(cleaned):
    return cleaned.select(*CLEANED_COLUMNS)


def derive_features(
    cleaned, keys=GROUP_KEYS, window_seconds=WINDOW_SECONDS, order=("row_id",), limit=ROWS_PER_TASK, layout=None
):
    """All ten features; window features first, on the narrow row, then the name features."""
    windowed = with_window_features(cleaned, keys, window_seconds, order, limit=limit, layout=layout)
    return with_lexical_features(windowed)
