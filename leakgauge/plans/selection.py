"""Choosing a forest and a threshold on out-of-fold scores, under a false-positive policy."""

import hashlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from leakgauge.contract import MODEL_FEATURES, SCORE_THRESHOLDS, DataError
from leakgauge.operators.links import complement, require_disjoint, with_fold
from leakgauge.operators.metrics import (
    classification_metrics, domain_errors, ranking_metrics, with_rates,
)
from leakgauge.operators.splits import domain_folds, require_both_classes
from leakgauge.plans.forest import (
    Bundle, fit_forest, model_input, regular_grid, wide_grid, with_prediction, with_score,
)
from leakgauge.session import stored


@dataclass(frozen=True)
class Policy:
    """Limits on the pooled and on the worst large-domain false-positive rate."""

    max_fpr: float = 0.01
    max_domain_fpr: float = 0.05
    min_rows: int = 100

    def __post_init__(self):
        if not (0 <= self.max_fpr <= 1 and 0 <= self.max_domain_fpr <= 1):
            raise ValueError("false-positive limits must lie between 0 and 1")
        if self.min_rows < 1:
            raise ValueError("min_rows must be positive")


def check_thresholds(thresholds):
    if not thresholds or any(not 0 < t < 1 for t in thresholds):
        raise ValueError("thresholds must lie between zero and one")
    return sorted(thresholds)


def reach_counts(scored, thresholds, keys):
    """Benign and attack rows per key and number of thresholds they reach (none included).

    The one aggregate over the rows; totals, hits, folds and domains all follow from its result, which Spark computes
    once per query because its exchange is the same everywhere.
    """
    reached = reduce(lambda a, b: a + b, [(F.col("score") >= t).cast("int") for t in check_thresholds(thresholds)])
    return scored.withColumn("reached", reached).groupBy(*keys, "reached").agg(
        F.count_if(F.col("label") == 0).alias("benign"), F.count_if(F.col("label") == 1).alias("attack"))


def class_sizes(counts, keys):
    return counts.groupBy(*keys).agg(F.sum("benign").alias("benign"), F.sum("attack").alias("attack"))


def threshold_hits(counts, thresholds, keys):
    """Rows per key and threshold they reach, by class: a sparse reverse cumulative count."""
    array = F.array(*(F.lit(float(t)) for t in check_thresholds(thresholds)))
    reaching = counts.where("reached > 0").withColumn("threshold", F.explode(F.slice(array, F.lit(1), F.col("reached"))))
    return reaching.groupBy(*keys, "threshold").agg(F.sum("attack").alias("tp"), F.sum("benign").alias("fp"))


def _complete(totals, hits, keys):
    """Confusion counts for every threshold, also where no row reaches it."""
    joined = totals.join(hits, [*keys, "threshold"], "left").fillna(0, ["tp", "fp"])
    return joined.withColumns({
        "tn": F.col("benign") - F.col("fp"), "fn": F.col("attack") - F.col("tp"),
    }).drop("benign", "attack")


def threshold_table(scored, thresholds, keys):
    """Confusion counts per key and threshold."""
    every = F.explode(F.array(*(F.lit(float(t)) for t in check_thresholds(thresholds))))
    counts = reach_counts(scored, thresholds, keys)
    totals = class_sizes(counts, keys).withColumn("threshold", every)
    return _complete(totals, threshold_hits(counts, thresholds, keys), keys)


def policy_trials(scored, policy, thresholds=SCORE_THRESHOLDS, group="apex_domain"):
    """One row per (trial, threshold) with pooled, per-fold and worst-domain figures, and eligibility.

    ``scored`` holds trial_id, fold, domain, label and score of every out-of-fold row.
    """
    keys = ["trial_id", "fold", group]
    counts = reach_counts(scored, thresholds, keys)
    per_domain, sizes = threshold_hits(counts, thresholds, keys), class_sizes(counts, keys)
    every = F.explode(F.array(*(F.lit(float(t)) for t in check_thresholds(thresholds))))
    fold_totals = sizes.groupBy("trial_id", "fold").agg(F.sum("benign").alias("benign"), F.sum("attack").alias("attack"))
    fold_hits = per_domain.groupBy("trial_id", "fold", "threshold").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    by_fold = with_rates(_complete(fold_totals.withColumn("threshold", every), fold_hits, ["trial_id", "fold"]))
    key = ["trial_id", "threshold"]
    means = by_fold.groupBy(*key).agg(
        F.avg("recall").alias("mean_fold_recall"), F.avg("f1").alias("mean_fold_f1"),
        F.max("false_positive_rate").alias("worst_fold_fpr"),
        *(F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")),
    )
    domain_sizes = sizes.groupBy("trial_id", group).agg(F.sum("benign").alias("benign")).where(F.col("benign") >= policy.min_rows)
    checked = domain_sizes.groupBy("trial_id").agg(F.count(F.lit(1)).alias("checked_benign_domains"))
    worst = (
        per_domain.groupBy("trial_id", group, "threshold").agg(F.sum("fp").alias("fp"))
        .join(domain_sizes, ["trial_id", group])
        .groupBy(*key).agg(F.max(F.col("fp") / F.col("benign")).alias("worst_large_domain_fpr"))
    )
    summary = with_rates(means).join(worst, key, "left").join(checked, "trial_id", "left").fillna(
        0, ["worst_large_domain_fpr", "checked_benign_domains"]
    )
    within = (F.col("false_positive_rate") <= policy.max_fpr) & (F.col("worst_large_domain_fpr") <= policy.max_domain_fpr)
    return summary.withColumn("eligible", within)


def best_policy_trial(trials):
    """Most mean fold recall, then least worst-domain and pooled rate, then the higher threshold."""
    best = trials.where("eligible").orderBy(
        F.desc("mean_fold_recall"), "worst_large_domain_fpr", "false_positive_rate", F.desc("threshold"), "trial_id"
    ).limit(1).collect()
    if not best:
        raise DataError("no candidate meets the false-positive policy")
    return best[0]


#: Forests that are fitted at the same time: their many short jobs leave most of a cluster idle when they run in turn.
FITS_AT_ONCE = 4


def at_once(spark, tasks, workers=FITS_AT_ONCE):
    """Results of the tasks in their order, a bounded number of them running at a time."""
    with ThreadPoolExecutor(workers) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]


def _finished(spark, path):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def out_of_fold_scores(rows, specs, folds, store=None, workers=FITS_AT_ONCE):
    """Every row scored once per candidate, by a forest that saw none of its domain.

    With ``store``, a folder that the cluster shares and that belongs to these rows, each (candidate, fold) is written
    there when it is done; a run that was stopped goes on from what it finds.
    """
    spark = rows.sparkSession

    def scored(trial_id, spec, fold):
        path = store and f"{store}/{hashlib.md5(repr(spec).encode()).hexdigest()}-{fold}-of-{folds}"
        if not store or not _finished(spark, path):
            model = fit_forest(complement(rows, fold), spec)
            held_out = with_score(rows.where(F.col("fold") == fold), model).select("fold", "row_id", "apex_domain", "label", "score")
            if store:
                held_out.write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path) if store else held_out
        return found.select(F.lit(trial_id).alias("trial_id"), "fold", "row_id", "apex_domain", "label", "score")

    parts = at_once(spark, [
        partial(scored, trial_id, spec, fold) for trial_id, spec in enumerate(specs, start=1) for fold in range(folds)
    ], workers)
    return reduce(lambda a, b: a.unionByName(b), parts)


@dataclass(frozen=True)
class Selected:
    """Outcome of a selection."""

    spec: object
    threshold: float
    validation: object
    trials: object
    scores: object


def select_by_groups(features, specs=None, folds=3, seed=42, policy=Policy(), thresholds=SCORE_THRESHOLDS, store=None):
    """Domain-disjoint cross-validation over candidates and thresholds.

    The prepared rows, the folds and the scores are written and read back, because every fit and every trial reads them
    again: each plan starts at a file, whatever lies behind the features. ``store`` as in ``out_of_fold_scores``.
    """
    specs = specs or regular_grid(seed=seed)
    features = stored(model_input(features).select("row_id", "apex_domain", "label", *MODEL_FEATURES), "prepared")
    fold_map = require_both_classes(stored(domain_folds(features, folds, seed), "folds"))
    rows = require_disjoint(stored(with_fold(features, fold_map), "folded"), "fold")
    scores = stored(out_of_fold_scores(rows, specs, folds, store), "scores")
    trials = policy_trials(scores, policy, thresholds)
    best = best_policy_trial(trials)
    return Selected(specs[best["trial_id"] - 1], best["threshold"], best, trials, scores)


def select_by_validation(train, validation, specs=None, thresholds=(0.3, 0.5, 0.7)):
    """Candidates fitted on the training part and compared on the validation part; no refit."""
    specs = specs or wide_grid()
    train = stored(model_input(train).select("label", *MODEL_FEATURES), "train")
    validation = model_input(validation)
    models = at_once(train.sparkSession, [partial(fit_forest, train, spec) for spec in specs])
    scored = reduce(lambda a, b: a.unionByName(b), [
        with_score(validation, m).select(F.lit(i).alias("candidate"), "label", "score") for i, m in enumerate(models)
    ])
    trials = with_rates(threshold_table(scored, thresholds, ["candidate"]))
    best = trials.orderBy(
        F.desc("f1"), "false_positive_rate", F.desc("recall"), F.desc("precision"), "candidate", "threshold"
    ).first()
    return models[best["candidate"]], specs[best["candidate"]], best["threshold"], trials


def nested_evaluation(features, specs=None, outer=5, inner=3, seed=42, policy=Policy(), thresholds=SCORE_THRESHOLDS, store=None):
    """Outer folds scored by models that were selected without them. ``store`` as in ``out_of_fold_scores``.

    Features are derived once for all folds: folds hold whole domains, and a history never crosses domains.
    """
    features = stored(features, "features")
    fold_map = require_both_classes(stored(domain_folds(features, outer, seed), "folds"))
    rows = stored(with_fold(features, fold_map).withColumnRenamed("fold", "outer_fold"), "outer")
    parts, chosen = [], []
    for fold in range(outer):  # each fold's rows are written when they are scored: no model is kept for later
        development = complement(rows, fold, "outer_fold")
        selected = select_by_groups(development, specs, inner, seed, policy, thresholds, store and f"{store}/outer-{fold}")
        model = fit_forest(model_input(development), selected.spec)
        parts.append(stored(with_prediction(rows.where(F.col("outer_fold") == fold), model, selected.threshold), "predicted"))
        chosen.append((selected.spec, selected.threshold))
    return reduce(lambda a, b: a.unionByName(b), parts), chosen


def evaluation_reports(predicted, fold="outer_fold"):
    """Pooled, per-fold and per-domain reports of predicted rows."""
    return {
        "pooled": classification_metrics(predicted),
        "folds": classification_metrics(predicted, by=[fold]),
        "ranking": ranking_metrics(predicted),
        "domains": domain_errors(predicted),
    }


def train_final(features, specs=None, folds=3, seed=42, policy=Policy(), thresholds=SCORE_THRESHOLDS):
    """Select on all development rows, refit on all of them."""
    selected = select_by_groups(features, specs, folds, seed, policy, thresholds)
    model = fit_forest(model_input(features), selected.spec)
    return Bundle(model, selected.threshold).check(), selected
