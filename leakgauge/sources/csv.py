"""CSV scans: raw query logs under any accepted header, uploads, feature tables and predictions."""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakgauge.contract import (
    HEADER_ALIASES, PREDICTION_SCHEMA, RULE_FEATURES, UPLOAD_DEFAULTS, WINDOW_SECONDS, DataError,
)
from leakgauge.functions.domain import stripped

RAW_DEFAULTS = {
    "timestamp": "", "src_ip": "", "dst_ip": "", "requested_server_name": "",
    "query_type": "A", "source": "Unknown",
}


# About 40 MB of block offsets.
BLOCKS_TO_BROADCAST = 200_000


def _scan(spark, path, **options):
    reader = spark.read.option("header", True).option("escape", '"')
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.csv(path)


def with_row_numbers(scan, name="row_id"):
    """One-based row numbers of a file scan, in file order, without a sort of the rows.

    Within a block rows are read in order; how many rows the earlier blocks hold is a table with one row
    per block: counted within each file, then over the files. It is broadcast, so that no row moves, if files and
    partitions (whose sum is an upper bound of the blocks) are few enough; beyond, it is joined like any table.
    """
    blocks_at_most = len(scan.inputFiles()) + scan.rdd.getNumPartitions()
    sent = F.broadcast if blocks_at_most <= BLOCKS_TO_BROADCAST else (lambda table: table)
    read = scan.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__seen"),
    )
    blocks = read.groupBy("__file", "__block").agg(
        F.min("__seen").alias("__from"), F.count(F.lit(1)).alias("__rows")
    )
    in_file = W.partitionBy("__file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    over_files = W.orderBy("__file").rowsBetween(W.unboundedPreceding, -1)
    files = blocks.groupBy("__file").agg(F.sum("__rows").alias("__rows")).select(
        "__file", F.coalesce(F.sum("__rows").over(over_files), F.lit(0)).alias("__files_before"))
    offsets = blocks.withColumn("__blocks_before", F.coalesce(F.sum("__rows").over(in_file), F.lit(0))).join(files, "__file")
    offsets = offsets.withColumn("__offset", F.col("__files_before") + F.col("__blocks_before"))
    return (
        read.join(sent(offsets.select("__file", "__block", "__from", "__offset")), ["__file", "__block"])
        .withColumn(name, F.col("__offset") + F.col("__seen") - F.col("__from") + 1)
        .select(*scan.columns, name)
    )


def canonical(df, extra=()):
    """Map accepted headers to the canonical columns; everything is trimmed text, labels become 0, 1 or -1.

    If a table has several spellings of one column, the last one counts. ``label_text`` keeps the label
    as written for the strict loader. Columns named in ``extra`` are passed on as they are.
    """
    known = {}
    for column in df.columns:
        spelled = column.strip().lower()
        known[HEADER_ALIASES.get(spelled, spelled)] = column

    def text(name, default):
        if name not in known:
            return F.lit(default)
        return stripped(F.coalesce(F.col(f"`{known[name]}`").cast("string"), F.lit("")))

    columns = [F.col("row_id")] if "row_id" in df.columns else []
    columns += [F.col(c) for c in ("file_ord", "capture_id") if c in df.columns]
    columns += [text(name, default).alias(name) for name, default in RAW_DEFAULTS.items()]
    label_text = text("label", None)
    number = label_text.try_cast("double")
    label = F.coalesce(number.try_cast("int"), F.lit(-1)) if "label" in known else F.lit(0)
    return df.select(*columns, label.alias("label"), label_text.cast("string").alias("label_text"), *extra)


def read_raw(spark, paths, max_rows=None, **options):
    """Raw query logs. Each path may have its own headers; ``file_ord`` is its place in the list."""
    if isinstance(paths, str):
        paths = [paths]
    parts = []
    for position, path in enumerate(paths):
        numbered = with_row_numbers(_scan(spark, path, **options))
        if max_rows:
            numbered = first_rows(numbered, max_rows)
        parts.append(canonical(numbered.withColumn("file_ord", F.lit(position))))
    return reduce(lambda a, b: a.unionByName(b), parts)


def first_rows(df, count, row_id="row_id"):
    """The first ``count`` rows of an ordered source; none or zero means all."""
    return df.where(F.col(row_id) <= count) if count else df


def upload_columns(df):
    """Uploaded logs: first known name column, defaults for whatever is blank."""
    known = {c.strip(): c for c in df.columns}
    name = next((c for c in ("requested_server_name", "query", "domain") if c in known), None)
    if name is None:
        raise DataError("the upload has no column with domain names")

    def text(column, default=""):
        if column not in known:
            return F.lit(default)
        value = stripped(F.coalesce(F.col(f"`{known[column]}`").cast("string"), F.lit("")))
        return F.when(value == "", default).otherwise(value)

    return df.select(
        *(F.col(c) for c in ("row_id", "capture_id", "request_id") if c in df.columns),
        text("timestamp").alias("timestamp"),
        *(text(c, UPLOAD_DEFAULTS[c]).alias(c) for c in ("src_ip", "dst_ip")),
        text(name).alias("requested_server_name"),
        *(text(c, UPLOAD_DEFAULTS[c]).alias(c) for c in ("query_type", "source")),
    )


def read_upload(spark, path, capture_id, **options):
    scan = with_row_numbers(_scan(spark, path, **options))
    return upload_columns(scan.withColumns({"capture_id": F.lit(capture_id), "request_id": F.lit(path)}))


def has_rule_features(df):
    return {*RULE_FEATURES, "label"} <= set(df.columns)


def rule_table(df, window_seconds=WINDOW_SECONDS, max_rows=None):
    """Features and label of the voting rule: taken as they are when present, else derived."""
    from leakgauge.plans.cleaning import derive_features, parse_lenient

    df = first_rows(df, max_rows) if "row_id" in df.columns else (df.limit(max_rows) if max_rows else df)
    if has_rule_features(df):
        keep = ["row_id"] if "row_id" in df.columns else []
        return df.select(
            *keep,
            *(F.col(c).cast("double").alias(c) for c in RULE_FEATURES),
            F.col("label").cast("double").cast("int").alias("label"),
        )
    features = derive_features(parse_lenient(canonical(df)), window_seconds=window_seconds)
    return features.select("row_id", *(F.col(c).cast("double").alias(c) for c in RULE_FEATURES), "label")


def read_predictions(spark, path, schema=PREDICTION_SCHEMA):
    return spark.read.schema(schema).option("header", True).csv(path)
