"""Duplicate removal that keeps the first row, and survives any number of copies.

Repeated keys are found by an aggregate over numbers of fixed width, which hashes and reduces copies where they are
read, so a row repeated in a third of the table never reaches a single task. Only keys that occur more than once are
joined back; below the broadcast threshold no row moves at all.
"""

from pyspark.sql import functions as F

from leakgauge.contract import DataError
from leakgauge.session import ensure_checkpoint_dir

RAW_SIGNATURE = ("timestamp", "src_ip", "dst_ip", "requested_server_name", "label")
EVENT_KEY = ("epoch_us", "src_ip", "dst_ip", "requested_server_name", "query_type")


# A row's place as one number: up to 2**19 files of up to 2**44 rows each.
FILE_SHIFT = 44


def row_place(columns):
    """Place of a row over all files: (file_ord, row_id), or row_id alone."""
    if "file_ord" not in columns:
        return F.col("row_id").cast("bigint")
    return F.shiftleft(F.col("file_ord").cast("bigint"), FILE_SHIFT).bitwiseOR(F.col("row_id").cast("bigint"))


def repeated_keys(df, key, *more, which="__rows > 1"):
    """Keys that occur more than once (or as told), with the place of their first row as ``__first``."""
    groups = df.groupBy(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(key))).agg(
        F.min(row_place(df.columns)).alias("__first"), F.count(F.lit(1)).alias("__rows"), *more)
    return groups.where(which)


def keep_first(df, key, repeated=None):
    """The first row, by place, of every key."""
    repeated = repeated_keys(df, key) if repeated is None else repeated
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    later = repeated.select(*(f"__k{i}" for i in range(len(key))), "__first")
    return df.join(later, same & (row_place(df.columns) != F.col("__first")), "left_anti")


def drop_repeated_rows(df):
    """Raw signature: times and addresses as written, the name in lower case, and the label."""
    marked = df.withColumn("__name", F.lower("requested_server_name"))
    key = [c if c != "requested_server_name" else "__name" for c in RAW_SIGNATURE]
    return keep_first(marked, key).drop("__name")


def _label_range():
    return F.min("label").alias("lowest"), F.max("label").alias("highest")


def conflicting_events(df):
    """Events that occur with more than one label."""
    found = repeated_keys(df, EVENT_KEY, *_label_range()).where("lowest <> highest")
    row_id = F.col("__first") if "file_ord" not in df.columns else F.col("__first").bitwiseAND(F.lit((1 << FILE_SHIFT) - 1))
    return found.select(
        *(F.col(f"__k{i}").alias(c) for i, c in enumerate(EVENT_KEY)), "lowest", "highest", row_id.alias("row_id"))


def _row_of(place, columns):
    return place & ((1 << FILE_SHIFT) - 1) if "file_ord" in columns else place


def drop_repeated_events(df, problem=None):
    """Normalised events; the same event under two labels is an error, as is a row with a problem.

    One aggregate finds problems, conflicts and copies; only its few rows of interest are kept, as a checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    place = row_place(df.columns)
    bad = F.lit(None).cast("bigint") if problem is None else F.min(F.when(F.col(problem).isNotNull(), place))
    repeated = repeated_keys(
        df, EVENT_KEY, *_label_range(), bad.alias("__bad"), which="__rows > 1 OR __bad IS NOT NULL").checkpoint()
    found = repeated.agg(
        F.min("__bad").alias("bad"), F.min(F.when(F.col("lowest") != F.col("highest"), F.col("__first"))).alias("conflict")).first()
    if found["bad"] is not None:
        why = df.where(place == found["bad"]).select(problem).first()[0]
        raise DataError(f"row {_row_of(found['bad'], df.columns)}: {why}")
    if found["conflict"] is not None:
        raise DataError(f"the event of row {_row_of(found['conflict'], df.columns)} has two labels")
    return keep_first(df, EVENT_KEY, repeated)


def removed_ids(df, kept):
    """Rows that are not in ``kept``, named by file and row where the table has files."""
    key = [c for c in ("file_ord", "row_id") if c in df.columns]
    return df.select(*key).join(kept.select(*key), key, "left_anti")
