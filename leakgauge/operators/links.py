"""Joins and set checks between tables that should fit together.

No side is broadcast by hand: set tables (held-out domains, fold maps) can grow with the data, so the
optimiser broadcasts them below spark.sql.autoBroadcastJoinThreshold and splits skewed partitions beyond.
"""

from functools import reduce

from pyspark.sql import functions as F

from leakgauge.contract import DataError


def duplicate_ids(df, row_id="row_id"):
    return df.groupBy(row_id).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def by_row(df):
    """A table for a join by row number. Packed in files its ids look small to the optimiser, yet they are as many as the
    rows, so they are sorted and never broadcast."""
    return df.hint("merge")


def missing_ids(left, right, row_id="row_id"):
    return left.select(row_id).join(by_row(right.select(row_id)), row_id, "left_anti")


def join_predictions(saved, features, row_id="row_id"):
    """Saved predictions with the features of the same row; ids must be unique and known."""
    again = duplicate_ids(saved, row_id).limit(1).collect()
    if again:
        raise DataError(f"row {again[0][row_id]} has more than one prediction")
    lost = missing_ids(saved, features, row_id).limit(1).collect()
    if lost:
        raise DataError(f"row {lost[0][row_id]} has a prediction but no source row")
    extra = [c for c in features.columns if c == row_id or c not in saved.columns]
    return saved.join(by_row(features.select(*extra)), row_id)


def row_mismatches(left, right, columns=("apex_domain", "label"), row_id="row_id"):
    """Rows that exist on one side only, or disagree in any of the columns (null equals null)."""
    a = left.select(row_id, F.struct(*columns).alias("left_row"))
    b = right.select(row_id, F.struct(*columns).alias("right_row"))
    both = a.join(b, row_id, "full_outer")
    same = reduce(
        lambda x, y: x & y,
        [F.col(f"left_row.{c}").eqNullSafe(F.col(f"right_row.{c}")) for c in columns],
    )
    return both.select(
        row_id,
        F.when(F.col("left_row").isNull(), "missing_left")
        .when(F.col("right_row").isNull(), "missing_right")
        .when(~same, "different").alias("mismatch"),
    ).where("mismatch IS NOT NULL")


def require_same_rows(left, right, **options):
    bad = row_mismatches(left, right, **options).limit(1).collect()
    if bad:
        raise DataError(f"the tables differ: {bad[0].asDict()}")
    return left


def exclude_domains(df, held_out, column="apex_domain"):
    return df.join(held_out.select(column).distinct(), column, "left_anti").select(*df.columns)


def with_fold(df, fold_map, column="apex_domain"):
    return df.join(fold_map.select(column, "fold"), column).select(*df.columns, "fold")


def with_known_flag(df, known, column="apex_domain", flag="known_domain"):
    """Whether the domain occurs in the development data."""
    seen = known.select(column).distinct().withColumn(flag, F.lit(True))
    return df.join(seen, column, "left").select(*df.columns, F.coalesce(flag, F.lit(False)).alias(flag))


def union_captures(captures):
    """All rows of several captures; the name of each keeps their histories apart."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn("capture_id", F.lit(name)) for name, df in captures.items()],
    )


def complement(df, fold, column="fold"):
    return df.where(F.col(column) != fold)


def shared_domains(df, part="split", column="apex_domain"):
    """Domains that occur in more than one part."""
    return df.groupBy(column).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def require_disjoint(df, part="split", column="apex_domain"):
    bad = shared_domains(df, part, column).limit(1).collect()
    if bad:
        raise DataError(f"{bad[0][column]} occurs in several parts")
    return df


def incomplete_histories(evaluated, source, column="apex_domain", row_id="row_id"):
    """Ids missing from, or foreign to, the full history of the evaluated domains."""
    domains = evaluated.select(column).distinct()
    expected = source.select(row_id, column).join(domains, column, "left_semi").select(row_id)
    have = evaluated.select(row_id)
    absent = expected.join(by_row(have), row_id, "left_anti").withColumn("problem", F.lit("not_evaluated"))
    foreign = have.join(by_row(expected), row_id, "left_anti").withColumn("problem", F.lit("not_in_source"))
    return absent.unionByName(foreign)


def new_alerts(alerts, seen):
    """Alerts that were not reported before. The caller orders them, oldest first."""
    return alerts.join(seen.select("alert_id"), "alert_id", "left_anti").select(*alerts.columns)
