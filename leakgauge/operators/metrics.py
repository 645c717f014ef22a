"""Counts, rates and exact rank statistics."""

from functools import reduce
from operator import and_

from pyspark.sql import Window
from pyspark.sql import functions as F

from leakgauge.plans.ordered import ROWS_PER_TASK, running_sum, with_running


def count_where(condition):
    return F.count_if(condition)


def confusion(label="label", prediction="prediction"):
    actual, said = F.col(label) == 1, F.col(prediction) == 1
    return [
        F.count_if(actual & said).alias("tp"),
        F.count_if(~actual & ~said).alias("tn"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"),
    ]


def ratio(part, whole, empty=0.0):
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def with_rates(counts):
    """accuracy, precision, recall, f1 and false-positive rate; an empty denominator gives 0."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = F.col("precision"), F.col("recall")
    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "false_positive_rate": ratio(fp, fp + tn),
    }).withColumn("f1", ratio(2 * precision * recall, precision + recall))


def classification_metrics(df, label="label", prediction="prediction", by=()):
    return with_rates(df.groupBy(*by).agg(*confusion(label, prediction)))


def ranking_metrics(df, label="label", score="score", by=(), limit=ROWS_PER_TASK):
    """Exact, tie-aware ROC AUC and average precision.

    Rows are first reduced to one per distinct score; the curve is then walked from the highest score.
    """
    by = list(by)
    steps = df.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    ).withColumn("__down", -F.col(score))
    steps = with_running(
        steps, by, ["__down"], limit=limit, tp=running_sum(F.col("pos")), fp=running_sum(F.col("neg"))
    )
    sums = steps.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum((F.col("tp") - F.col("pos") / 2) * F.col("neg")).alias("area"),
        # As decimals, whose sum does not depend on the order in which the rows come.
        F.sum((F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).cast("decimal(38,18)")).cast("double").alias("gain"),
    )
    both = F.col("positives") * F.col("negatives")
    return sums.select(
        *by, "positives", "negatives",
        F.when(both > 0, F.col("area") / both).alias("roc_auc"),
        F.when(F.col("positives") > 0, F.col("gain") / F.col("positives")).alias("average_precision"),
    )


def domain_errors(df, label="label", prediction="prediction", group="apex_domain"):
    """Errors per domain; a rate without a denominator is null."""
    benign, attack = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    false_pos = F.count_if((F.col(label) == 0) & (F.col(prediction) == 1))
    false_neg = F.count_if((F.col(label) == 1) & (F.col(prediction) == 0))
    return (
        df.groupBy(group)
        .agg(
            benign.alias("benign"), attack.alias("attack"),
            false_pos.alias("false_positives"), false_neg.alias("false_negatives"),
        )
        .withColumns({
            "rows": F.col("benign") + F.col("attack"),
            "false_positive_rate": ratio(F.col("false_positives"), F.col("benign"), None),
            "recall": F.when(F.col("attack") > 0, 1 - F.col("false_negatives") / F.col("attack")),
        })
        .select(group, "rows", "benign", "attack", "false_positives", "false_negatives", "false_positive_rate", "recall")
    )


def policy_summary(per_domain, min_rows=100, by=()):
    """Pooled rates, fold means and worst cases from per (fold, domain) confusion counts.

    ``per_domain`` holds tp, tn, fp, fn per (by..., fold, apex_domain): a pre-aggregated table.
    """
    by = list(by)
    total = [F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")]
    pooled = with_rates(per_domain.groupBy(*by).agg(*total))
    folds = with_rates(per_domain.groupBy(*by, "fold").agg(*total)).groupBy(*by).agg(
        F.avg("recall").alias("mean_fold_recall"),
        F.avg("f1").alias("mean_fold_f1"),
        F.max("false_positive_rate").alias("worst_fold_fpr"),
    )
    benign = F.col("fp") + F.col("tn")
    domains = per_domain.groupBy(*by, "apex_domain").agg(F.sum("fp").alias("fp"), F.sum("tn").alias("tn"))
    large = domains.groupBy(*by).agg(
        F.coalesce(F.max(F.when(benign >= min_rows, F.col("fp") / benign)), F.lit(0.0)).alias("worst_large_domain_fpr"),
        F.count_if(benign >= min_rows).alias("checked_benign_domains"),
    )
    if by:
        return pooled.join(folds, by).join(large, by)
    return pooled.withColumns({
        c: side.select(c).scalar() for side in (folds, large) for c in side.columns
    })


def _ranked_values(df, value, by, limit, weight=None):
    """Distinct values with their count and the number of rows up to and including them.

    With ``weight`` the table already holds one row per value and that column counts the rows behind it. Counts are kept
    (memory, then disk) once a query works them out: borders, ranks and totals all read them.
    """
    known = df.where(F.col(value).isNotNull())
    if weight:
        counts = known.select(*by, value, F.col(weight).alias("n"))
    else:
        counts = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")).persist()
    ranked = with_running(counts, by, [value], limit=limit, upto=running_sum(F.col("n")))
    totals = ranked.groupBy(*by).agg(F.max("upto").alias("total"))
    if by:
        same = [f"__b{i}" for i in range(len(by))]
        totals = totals.withColumnsRenamed(dict(zip(by, same)))
        match = [F.col(b).eqNullSafe(F.col(s)) for b, s in zip(by, same)]
        return ranked.join(totals, match).drop(*same)
    return ranked.withColumn("total", totals.scalar())


def nearest_rank_quantiles(df, value, quantiles, by=(), limit=ROWS_PER_TASK, weight=None):
    """Element number round((n - 1) * q), halves to even, of the sorted values.

    Works on value counts, so nothing of the size of the data is sorted or held in one task.
    """
    by = list(by)
    ranked = _ranked_values(df, value, by, limit, weight)
    asked = ranked.withColumn("quantile", F.explode(F.array(*(F.lit(float(q)) for q in quantiles))))
    index = F.bround((F.col("total") - 1) * F.col("quantile"), 0).cast("bigint")
    return asked.where((index < F.col("upto")) & (index >= F.col("upto") - F.col("n"))).select(
        *by, "quantile", F.col(value).alias("value")
    )


def linear_quantiles(df, value, quantiles, by=(), limit=ROWS_PER_TASK):
    """Quantiles interpolated between the two neighbouring sorted values."""
    by = list(by)
    ranked = _ranked_values(df, value, by, limit)
    asked = ranked.withColumn("quantile", F.explode(F.array(*(F.lit(float(q)) for q in quantiles))))
    place = (F.col("total") - 1) * F.col("quantile")
    low, high = F.floor(place), F.ceil(place)
    first = F.col("upto") - F.col("n")
    inside = asked.withColumns({
        "__low": F.when((low >= first) & (low < F.col("upto")), F.col(value)),
        "__high": F.when((high >= first) & (high < F.col("upto")), F.col(value)),
        "__part": place - low,
    }).where("__low IS NOT NULL OR __high IS NOT NULL")
    return inside.groupBy(*by, "quantile").agg(
        F.max("__low").alias("__low"), F.max("__high").alias("__high"), F.max("__part").alias("__part")
    ).select(
        *by, "quantile", (F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__part")).alias("value")
    )


def long_features(df, features, keep=()):
    """One row per (row, feature)."""
    return df.select(*keep, *(F.col(f).cast("double").alias(f) for f in features)).unpivot(
        list(keep), list(features), "feature", "value"
    )


#: Rank error of the sketch is one row in ACCURACY; a band reaches MARGIN times as far to both sides of its quantile.
ACCURACY, MARGIN = 20_000, 4


def quantile_bands(df, features, quantiles, by=(), accuracy=ACCURACY):
    """One row per group, feature and quantile: rows with a value, and bounds between which its neighbours lie.

    One aggregate over the wide rows holds a mergeable sketch per feature, so what is shuffled depends on tasks and groups
    and not on rows. A bound is null where the band reaches the end.
    """
    reach = MARGIN / accuracy
    edges = sorted({min(1.0, max(0.0, q + side * reach)) for q in quantiles for side in (-1, 1)})
    sketches = []
    for i, name in enumerate(features):
        value = F.col(name).cast("double")
        sketches += [F.count(value).alias(f"__n{i}"), F.percentile_approx(value, edges, accuracy).alias(f"__e{i}")]
    edge = lambda i, at: F.lit(None).cast("double") if at <= 0 or at >= 1 else F.col(f"__e{i}")[edges.index(at)]
    bands = F.array(*(
        F.struct(F.lit(name).alias("feature"), F.lit(float(q)).alias("quantile"), F.col(f"__n{i}").alias("total"),
                 edge(i, q - reach).alias("low_edge"), edge(i, q + reach).alias("high_edge"))
        for i, name in enumerate(features) for q in quantiles
    ))
    return df.groupBy(*by).agg(*sketches).select(*by, F.inline(bands)).where("total > 0")


def refined_quantiles(df, features, quantiles, by=(), nearest=False, accuracy=ACCURACY, limit=ROWS_PER_TASK):
    """Exact quantiles of many columns in two passes: sketches give bands, then only the values inside bands are ranked.

    The second pass counts, in the task, the values below and above each band as one number each, and by value those inside it; with a
    sketch of ``accuracy`` these are at most about 2 * MARGIN / accuracy of the rows. ``nearest`` takes element
    round((n - 1) * q), otherwise neighbours are interpolated. A quantile whose ranks should lie outside its band is
    computed from all value counts (``linear_quantiles``, ``nearest_rank_quantiles``); as long as there is none, that branch reads nothing.
    Values that are null are no rows; a group without values has no quantiles. The table is read twice: give a stored one.
    """
    by = list(by)
    bands = quantile_bands(df, features, quantiles, by, accuracy)
    keys = [*by, "feature"]
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    per_feature = bands.groupBy(*(F.col(k).alias(names[k]) for k in keys)).agg(
        F.collect_list(F.struct("quantile", "total", "low_edge", "high_edge")).alias("__bands"))
    values = long_features(df, features, by).where("value IS NOT NULL")
    met = values.join(per_feature, reduce(and_, (F.col(k).eqNullSafe(F.col(names[k])) for k in keys)))
    met = met.select(*keys, "value", F.inline("__bands"))
    side = F.when(F.col("value") < F.col("low_edge"), -1).when(F.col("value") > F.col("high_edge"), 1).otherwise(0)
    cells = [*keys, "quantile"]
    counts = met.groupBy(*cells, "total", side.alias("side"), F.when(side == 0, F.col("value")).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(
        Window.partitionBy(*cells).orderBy("side", "value").rowsBetween(Window.unboundedPreceding, 0)))
    place = (F.col("total") - 1) * F.col("quantile")
    low, high = (F.bround(place, 0),) * 2 if nearest else (F.floor(place), F.ceil(place))
    at = lambda rank: F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")), F.col("value")))
    ranked = counts.groupBy(*cells).agg(at(low).alias("__low"), at(high).alias("__high"), F.max(place - low).alias("__part"))
    hit = F.col("__low").isNotNull() & F.col("__high").isNotNull()
    found = ranked.where(hit).select(
        *cells, (F.col("__low") + (F.col("__high") - F.col("__low")) * (F.lit(0.0) if nearest else F.col("__part"))).alias("value"))
    lost = ranked.where(~hit).select(*(F.col(k).alias(names[k]) for k in keys), F.col("quantile").alias("__quantile"))
    same_key = reduce(and_, (F.col(k).eqNullSafe(F.col(names[k])) for k in keys))
    again = values.join(lost.drop("__quantile").distinct(), same_key, "left_semi")
    whole = nearest_rank_quantiles if nearest else linear_quantiles
    rest = whole(again, "value", quantiles, keys, limit).join(
        lost, same_key & (F.col("quantile") == F.col("__quantile")), "left_semi")
    return found.unionByName(rest)


def feature_quantiles(df, features, quantiles, by=(), limit=ROWS_PER_TASK, accuracy=ACCURACY):
    return refined_quantiles(df, features, quantiles, by, accuracy=accuracy, limit=limit)


def value_counts(df, column):
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def split_summary(df, split="split"):
    """Rows, classes, domains and time range of each part; rows collapse to one per domain first."""
    label = F.col("label")
    by_apex = df.groupBy(split, "apex_domain").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(label == 0).alias("n0"), F.count_if(label == 1).alias("n1"),
        F.min("epoch_us").alias("first"), F.max("epoch_us").alias("last"),
    )
    return by_apex.groupBy(split).agg(
        F.sum("n").alias("rows"), F.sum("n0").alias("benign"), F.sum("n1").alias("attack"),
        F.count("apex_domain").alias("apex_domains"),
        F.count(F.when(F.col("n1") > 0, F.col("apex_domain"))).alias("attack_apex_domains"),
        F.min("first").alias("earliest_us"), F.max("last").alias("latest_us"),
    )


def attack_domains(df, split="split"):
    """Every attack apex of each part, sorted: a table, because a part may hold any number of them."""
    return df.where("label = 1 AND apex_domain IS NOT NULL").select(split, "apex_domain").distinct().orderBy(split, "apex_domain")


def distinct_counts(df, columns):
    """One narrow count per column; several in one aggregate would copy every row once per column."""
    counts = [df.select(c).agg(F.count_distinct(c).alias(f"distinct_{c}")) for c in columns]
    return counts[0].select("*", *(other.scalar().alias(other.columns[0]) for other in counts[1:]))


def traffic_statistics(scored, retained=500):
    """Totals of a scored table."""
    total = F.count(F.lit(1))
    bad = F.count_if(F.col("prediction") == 1)
    return scored.agg(
        total.alias("total_processed"),
        bad.alias("total_suspicious"),
        (total - bad).alias("total_benign"),
        ratio(bad, total).alias("suspicious_rate"),
        F.least(bad, F.lit(retained).cast("bigint")).alias("active_alerts_retained"),
        (total > 0).alias("has_live_data"),
    )


def masked_fpr(df, mask, prediction="prediction"):
    """Queries, flagged queries and their share under a mask; the share is null if the mask is empty."""
    queries, flagged = F.count_if(mask), F.count_if(mask & (F.col(prediction) == 1))
    return df.agg(
        queries.alias("queries"),
        flagged.alias("false_positives"),
        ratio(flagged, queries, None).alias("false_positive_rate"),
    )


def is_fast_gap(seconds, gap="time_interval"):
    return (F.col(gap) >= 0) & (F.col(gap) < seconds)


def fast_gap_share(df, seconds, by=()):
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(is_fast_gap(seconds).cast("double")).alias("share_of_fast_gaps"),
    )


def flagged_share(df, prediction="prediction", by=()):
    """Recall of a table that holds attacks only."""
    return df.groupBy(*by).agg(F.avg(F.col(prediction).cast("double")).alias("recall"))


def ranges(df, columns, places=4):
    return df.agg(*(
        f(c).alias(f"{n}_{c}") if places is None else F.round(f(c).cast("double"), places).alias(f"{n}_{c}")
        for c in columns for n, f in (("min", F.min), ("max", F.max))
    ))


def capture_span(df):
    return df.agg(
        ((F.max("epoch_us") - F.min("epoch_us")) / 1e6).alias("time_span_seconds"),
        F.count_distinct("apex_domain").alias("distinct_apex_domains"),
    )


def fingerprint(df):
    """Row count and order-free content hash; any engine with MD5 can recompute it."""
    text = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns)))
    prefix = F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("decimal(28,0)")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(prefix), F.lit(0)).cast("string").alias("fingerprint"),
    )
