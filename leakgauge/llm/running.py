"""Running totals and gapless numbers within groups of any size, without putting one group into one task."""

from pyspark.sql import Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1000


def bucketed(df, hex_key, rows):
    """Add `bucket`, an order-preserving cut of a hexadecimal key into about rows / ROWS_PER_BUCKET parts."""
    buckets = max(1, min(1 << 20, -(-rows // ROWS_PER_BUCKET)))
    top = F.conv(F.substring(hex_key, 1, 6), 16, 10).cast("long")
    return df.withColumn("bucket", F.floor(top * buckets / (1 << 24)).cast("long"))


def with_total_before(df, group, order, value, out):
    """Sum of `value` over the rows of the same group that come earlier by (bucket, order).

    A group is cut into its buckets: sums per (group, bucket) are combined before the shuffle, the totals of earlier
    buckets are a running sum over that small table, and rows are sorted only within a bucket. Rows that tie in every
    order column take an arbitrary order among themselves. Null is a group of its own.
    """
    sums = df.groupBy(*group, "bucket").agg(F.sum(value).alias("in_bucket"))
    earlier = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *(F.col(g).alias(f"at_{g}") for g in group), F.col("bucket").alias("at_bucket"),
        F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("before_bucket"),
    )
    inside = Window.partitionBy(*group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col("bucket") == F.col("at_bucket")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"at_{g}"))
    return (
        rows.join(starts, same)
        .withColumn(out, F.col("before_bucket") + F.col("inside"))
        .drop("inside", "before_bucket", "at_bucket", *(f"at_{g}" for g in group))
    )
