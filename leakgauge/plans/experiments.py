"""Held-out-domain and fast-burst experiments, comparisons and replay checks."""

from functools import reduce

from pyspark.sql import functions as F

from leakgauge.contract import (
    FAST_GAP_SECONDS, GROUP_KEYS, MODEL_FEATURES, RETIME_ORIGIN_US, SWEEP_GAPS_MS, WINDOW_SECONDS, DataError,
)
from leakgauge.functions.verdict import rule_prediction
from leakgauge.operators.behavior import retime
from leakgauge.operators.links import (
    exclude_domains, incomplete_histories, join_predictions, require_disjoint, require_same_rows,
    union_captures,
)
from leakgauge.operators.metrics import (
    classification_metrics, domain_errors, flagged_share, is_fast_gap, ranking_metrics,
)
from leakgauge.operators.quality import require_single_class
from leakgauge.plans.cleaning import derive_features
from leakgauge.plans.forest import Bundle, fit_forest, model_input, with_prediction
from leakgauge.plans.selection import select_by_groups
from leakgauge.session import stored

HISTORY = ("capture_id", *GROUP_KEYS)


def held_out_partition(rows, allocation, fold, must_include=None):
    """(training, evaluation, excluded domains) of a stored fold allocation that must fit the rows exactly."""
    require_same_rows(rows, allocation)
    require_disjoint(allocation, "outer_fold")
    chosen = allocation.where(F.col("outer_fold") == fold)
    excluded = chosen.select("apex_domain").distinct()
    if must_include is not None and excluded.where(F.col("apex_domain") == must_include).isEmpty():
        raise DataError(f"fold {fold} does not hold {must_include}")
    evaluation = rows.join(chosen.select("row_id"), "row_id", "left_semi")
    return exclude_domains(rows, excluded), evaluation, excluded


def stored_partition(rows, allocation, fold, must_include=None):
    """The held-out partition, each part written: an experiment reads it many times, and its features have long plans."""
    return tuple(stored(part, "partition") for part in held_out_partition(rows, allocation, fold, must_include))


def stored_captures(captures, excluded):
    """The accepted rows of every added capture, written."""
    return {
        name: stored((benign_capture if kind == "benign" else attack_capture)(stored(table, "capture"), excluded), "accepted")
        for name, (kind, table) in captures.items()
    }


def benign_capture(rows, excluded):
    """Imported benign rows without the held-out domains."""
    accepted = exclude_domains(require_single_class(rows, 0), excluded)
    if accepted.isEmpty():
        raise DataError("nothing remains of the capture once held-out domains are excluded")
    return accepted


def attack_capture(rows, excluded):
    """Attack rows for development; they may not touch held-out domains."""
    require_single_class(rows, 1)
    shared = rows.join(excluded, "apex_domain", "left_semi").limit(1).collect()
    if shared:
        raise DataError(f"attack rows reuse the held-out domain {shared[0]['apex_domain']}")
    return rows


def development_features(captures, window_seconds=WINDOW_SECONDS):
    """Features of several captures, each with a history of its own."""
    return derive_features(union_captures(captures), HISTORY, window_seconds)


def capture_report(captures):
    """Rows and fast gaps per added capture, from its features."""
    return captures.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("apex_domain").alias("apex_domains"),
        F.avg(is_fast_gap(FAST_GAP_SECONDS).cast("double")).alias("share_of_gaps_under_50ms"),
    )


def augmented_model(development, excluded, **selection):
    """Select and refit on development rows, which must not hold an excluded domain."""
    if not development.join(excluded, "apex_domain", "left_semi").isEmpty():
        raise DataError("a held-out domain is part of the development rows")
    selected = select_by_groups(development, **selection)
    return Bundle(fit_forest(model_input(development), selected.spec), selected.threshold).check(), selected


def diagnostic_predictions(evaluation_features, allocation, bundle, earlier="baseline_prediction"):
    """New and earlier predictions of the held-out rows side by side."""
    scored = with_prediction(evaluation_features, bundle.model, bundle.threshold)
    old = allocation.select("row_id", F.col("prediction").alias(earlier))
    return scored.join(old, "row_id")


def before_and_after(predicted, big_domain, earlier="baseline_prediction"):
    """Metrics of both models, over all rows and over one big domain."""
    scopes = F.explode(F.array_compact(F.array(
        F.lit("pooled"), F.when(F.col("apex_domain") == big_domain, F.lit("big_domain"))
    )))
    long = predicted.withColumn("scope", scopes)
    both = long.select("scope", F.lit("before").alias("model"), "label", F.col(earlier).alias("prediction")).unionByName(
        long.select("scope", F.lit("after").alias("model"), "label", "prediction")
    )
    return classification_metrics(both, by=["scope", "model"])


def held_out_experiment(rows, allocation, fold, captures, big_domain, must_include=None, **selection):
    """Retrain without the held-out domains but with extra captures; compare on the held-out rows."""
    training, evaluation, excluded = stored_partition(rows, allocation, fold, must_include)
    development = stored(development_features({"primary": training, **stored_captures(captures, excluded)}), "development")
    bundle, selected = augmented_model(development, excluded, **selection)
    features = development_features({"evaluation": evaluation})
    predicted = stored(diagnostic_predictions(features, allocation, bundle), "predicted")
    return {
        "bundle": bundle, "selected": selected, "predictions": predicted, "captures": capture_report(development),
        "metrics": before_and_after(predicted, big_domain), "ranking": ranking_metrics(predicted),
        "domains": domain_errors(predicted),
    }


def fast_benign_errors(predicted, earlier="previous_prediction"):
    """Benign rows that follow the query before them within 50 ms, and how many each model flags."""
    fast = predicted.where(is_fast_gap(FAST_GAP_SECONDS) & (F.col("label") == 0))
    return fast.agg(
        F.count(F.lit(1)).alias("fast_benign_rows"),
        F.count_if(F.col(earlier) == 1).alias("previous_false_positives"),
        F.count_if(F.col("prediction") == 1).alias("false_positives"),
    )


def retimed_copies(rows, gaps_ms=SWEEP_GAPS_MS, keys=GROUP_KEYS):
    """One copy of the rows per gap, re-timed; the gap is part of the history key."""
    copies = rows.withColumn("gap_ms", F.explode(F.array(*(F.lit(int(g)) for g in gaps_ms))))
    return retime(copies, F.col("gap_ms") * 1000, RETIME_ORIGIN_US, ("gap_ms", *keys))


def timing_sweep(stress, predict, gaps_ms=SWEEP_GAPS_MS, window_seconds=WINDOW_SECONDS):
    """Recall per gap. ``predict`` maps a name to a function that adds a prediction to feature rows."""
    features = stored(derive_features(retimed_copies(stress, gaps_ms), ("gap_ms", *GROUP_KEYS), window_seconds), "retimed")
    shares = [
        flagged_share(add(features), by=["gap_ms"]).withColumnRenamed("recall", name) for name, add in predict.items()
    ]
    return reduce(lambda a, b: a.join(b, "gap_ms"), shares)


def stress_predictions(features, bundle, previous):
    """Scores of both models on unseen attack rows."""
    old = with_prediction(features, previous.model, previous.threshold).withColumnsRenamed(
        {"score": "previous_attack_probability", "prediction": "previous_prediction"}
    )
    return with_prediction(old, bundle.model, bundle.threshold).withColumnRenamed("score", "attack_probability")


def unseen_domains(stress, development, excluded):
    """Stress rows, which may share no domain with development or held-out rows."""
    known = development.select("apex_domain").unionByName(excluded.select("apex_domain"))
    shared = require_single_class(stress, 1).join(known, "apex_domain", "left_semi").limit(1).collect()
    if shared:
        raise DataError(f"stress rows reuse the domain {shared[0]['apex_domain']}")
    return stress


def fast_burst_experiment(rows, allocation, fold, captures, stress, previous, big_domain, gaps_ms=SWEEP_GAPS_MS, **selection):
    """Add captures (fast bursts among them) to the development rows, select and refit, and hold the new model against
    the previous one: on the held-out rows, on fast benign rows, on unseen bursts, and over a sweep of gaps."""
    training, evaluation, excluded = stored_partition(rows, allocation, fold)
    development = stored(development_features({"primary": training, **stored_captures(captures, excluded)}), "development")
    stress = unseen_domains(stored(stress, "stress"), development, excluded)
    bundle, selected = augmented_model(development, excluded, **selection)
    held_out = development_features({"evaluation": evaluation})
    earlier = with_prediction(held_out, previous.model, previous.threshold).withColumnRenamed("prediction", "previous_prediction")
    predicted = stored(with_prediction(earlier.drop("score"), bundle.model, bundle.threshold), "predicted")
    stressed = stored(stress_predictions(development_features({"stress": stress}), bundle, previous), "stressed")
    models = {"previous_recall": previous, "recall": bundle}
    return {
        "bundle": bundle, "selected": selected, "captures": capture_report(development), "predictions": predicted,
        "metrics": before_and_after(predicted, big_domain, "previous_prediction"), "domains": domain_errors(predicted),
        "fast_benign": fast_benign_errors(predicted), "stress_predictions": stressed,
        "stress": stressed.agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct("apex_domain").alias("domains"),
            F.avg("previous_prediction").alias("previous_recall"), F.avg("prediction").alias("recall"),
        ),
        "sweep": timing_sweep(stress, {
            name: lambda df, b=b: with_prediction(df, b.model, b.threshold) for name, b in models.items()
        }, gaps_ms),
    }


def compare_detectors(saved, features, rule=None, votes=2):
    """Frozen rule and saved model predictions on identical rows."""
    joined = join_predictions(saved, features).withColumn("rule", rule_prediction(rule, votes))
    both = joined.select(F.lit("rule").alias("detector"), "label", F.col("rule").alias("prediction")).unionByName(
        joined.select(F.lit("model").alias("detector"), "label", "prediction")
    )
    return classification_metrics(both, by=["detector"])


def run_metrics(predicted):
    """Counts, rates and rank statistics of a run, in one row."""
    return classification_metrics(predicted).crossJoin(ranking_metrics(predicted))  # one row by one


def replay_checks(saved, source_features, bundle, saved_metrics=None, saved_features=None):
    """Recompute what was saved of a run and tell, check by check, whether it still holds.

    ``source_features`` are worked out once, here, from whatever their plan starts at. ``saved`` holds predictions;
    ``saved_metrics`` one row as ``run_metrics`` gives it, or part of it; ``saved_features`` (row_id and model features) is
    compared with the recomputed ones row by row. What was not saved is not reported.
    """
    source = stored(source_features.select("row_id", "apex_domain", "label", *MODEL_FEATURES), "source")
    again = with_prediction(join_predictions(
        saved.withColumnsRenamed({"prediction": "saved_prediction", "score": "saved_score", "label": "saved_label"})
        .drop("apex_domain"), source
    ), bundle.model, bundle.threshold)
    # Scored once: every check below reads these rows.
    again = stored(again.select(
        "row_id", "apex_domain", "label", "saved_label", "prediction", "saved_prediction", "score", "saved_score"), "again")
    broken = incomplete_histories(again, source).agg(F.count(F.lit(1)).alias("n")).scalar()
    checks = again.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count_if(~F.col("label").eqNullSafe(F.col("saved_label"))) == 0).alias("labels_identical"),
        (F.count_if(~F.col("prediction").eqNullSafe(F.col("saved_prediction"))) == 0).alias("predictions_identical"),
        (F.count_if(~F.col("score").eqNullSafe(F.col("saved_score"))) == 0).alias("scores_identical"),
    ).withColumn("complete_histories", broken == 0)
    if saved_metrics is not None:
        found = run_metrics(again)
        unknown = sorted(set(saved_metrics.columns) - set(found.columns))
        if unknown:
            raise DataError(f"saved metrics that a replay does not work out: {', '.join(unknown)}")
        as_saved = [F.col(c).cast("double") for c in saved_metrics.columns]
        same = found.select(*as_saved).exceptAll(saved_metrics.select(*as_saved))
        checks = checks.withColumn("metrics_identical", same.agg((F.count(F.lit(1)) == 0).alias("ok")).scalar())
    if saved_features is not None:
        now = source.select(F.col("row_id").alias("now_id"), *(F.col(f).cast("double").alias(f"now_{f}") for f in MODEL_FEATURES))
        both = saved_features.join(now, F.col("row_id") == F.col("now_id"), "full")
        changed = ~(F.col("row_id").eqNullSafe(F.col("now_id")))
        for f in MODEL_FEATURES:
            changed = changed | ~F.col(f).cast("double").eqNullSafe(F.col(f"now_{f}"))
        checks = checks.withColumn("changed_features", both.agg(F.count_if(changed).alias("n")).scalar())
    return checks
