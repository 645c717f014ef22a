"""Finding thresholds for the voting rule from training and validation data."""

import itertools
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakgauge.contract import (
    CANDIDATE_QUANTILES, RULE_FEATURES, THRESHOLD_FLOORS, DataError, check_model_inputs,
)
from leakgauge.operators.metrics import long_features, nearest_rank_quantiles, with_rates
from leakgauge.operators.ranking import best_trial
from leakgauge.plans.ordered import ROWS_PER_TASK, running_sum, with_running
from leakgauge.session import stored


def value_table(rows):
    """Rows per class, feature and value: all that thresholds are chosen from, far smaller than the rows.

    It is written and read back: the steps below read it some twenty times at once, and a cache that is not filled yet is
    worked out anew by each of them.
    """
    values = long_features(rows, RULE_FEATURES, ["label"])
    return stored(values.groupBy("label", "feature", "value").agg(F.count(F.lit(1)).alias("n")), "values")


def candidate_thresholds(train, keep=3, limit=ROWS_PER_TASK):
    """The ``keep`` best single-feature cut-offs per feature, scored on the training rows alone."""
    return best_cuts(value_table(train), keep, limit)


def best_cuts(counts, keep=3, limit=ROWS_PER_TASK):
    """Candidates are class quantiles, at least the floor of the feature.

    All features are handled together; a cut-off is scored by how many rows of each class lie at or above it.
    """
    quantiles = nearest_rank_quantiles(counts, "value", CANDIDATE_QUANTILES, ["label", "feature"], limit, "n")
    floors = F.create_map(*(F.lit(x) for pair in THRESHOLD_FLOORS.items() for x in pair))
    floor = F.try_element_at(floors, F.col("feature"))
    offered = quantiles.groupBy("feature", "value").agg(F.first("quantile").alias("q")).withColumn(
        "ok", F.col("value") >= F.coalesce(floor, F.lit(float("-inf")))
    )
    # A feature none of whose quantiles reaches its floor gets the floor itself.
    cuts = offered.groupBy("feature").agg(
        F.collect_list(F.when(F.col("ok"), F.col("value"))).alias("cuts"),  # at most 14 per feature
    ).withColumn("cut", F.explode(F.when(F.size("cuts") > 0, F.col("cuts")).otherwise(F.array(floor))))
    none = F.lit(0).cast("bigint")
    marks = cuts.select("feature", F.col("cut").alias("value"), none.alias("attack"), none.alias("benign"), "cut")
    steps = counts.select(
        "feature", "value",
        F.when(F.col("label") == 1, F.col("n")).otherwise(0).alias("attack"),
        F.when(F.col("label") == 0, F.col("n")).otherwise(0).alias("benign"),
        F.lit(None).cast("double").alias("cut"),
    ).groupBy("feature", "value", "cut").agg(F.sum("attack").alias("attack"), F.sum("benign").alias("benign"))
    both = steps.select(marks.columns).unionByName(marks).withColumns({
        # From high to low; a cut-off comes after the rows that equal it.
        "__down": -F.col("value"), "__last": F.col("cut").isNotNull().cast("int"),
    })
    swept = with_running(
        both, ["feature"], ["__down", "__last"], limit=limit,
        tp=running_sum(F.col("attack")), fp=running_sum(F.col("benign")),
    )
    totals = steps.groupBy("feature").agg(F.sum("attack").alias("attacks"), F.sum("benign").alias("benigns"))
    scored = with_rates(
        swept.where("cut IS NOT NULL").select("feature", "cut", "tp", "fp").join(totals, "feature").select(
            "feature", F.col("cut").alias("threshold"), "tp", "fp",
            (F.col("benigns") - F.col("fp")).alias("tn"), (F.col("attacks") - F.col("tp")).alias("fn"),
        )
    )
    # At most two classes times seven quantiles per feature are ranked here.
    order = W.partitionBy("feature").orderBy(F.desc("f1"), "false_positive_rate", F.desc("recall"), "threshold")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def threshold_grid(candidates):
    """All combinations of candidate thresholds with 2, 3 or 4 votes, numbered in trial order."""
    chosen = {name: [] for name in RULE_FEATURES}
    for row in candidates.orderBy("feature", "place").collect():  # at most 4 * keep numbers
        chosen[row["feature"]].append(row["threshold"])
    combos = itertools.product(*(chosen[name] for name in RULE_FEATURES))
    return [
        (*thresholds, votes)
        for thresholds in combos
        for votes in range(2, len(RULE_FEATURES) + 1)
    ]


def grid_metrics(validation, grid):
    """Confusion counts and rates of every trial, from one pass over the validation rows.

    A row matters only through the largest candidate threshold each of its features reaches, so rows are
    first reduced to counts per combination of those: a few hundred groups, whatever the number of rows.
    """
    levels = [sorted({trial[i] for trial in grid}) for i in range(len(RULE_FEATURES))]
    reached = {
        name: F.coalesce(*(F.when(F.col(name) >= t, F.lit(t)) for t in reversed(levels[i])), F.lit(float("-inf")))
        for i, name in enumerate(RULE_FEATURES)
    }
    counts = validation.select("label", *(expr.alias(name) for name, expr in reached.items())).groupBy(
        "label", *RULE_FEATURES
    ).agg(F.count(F.lit(1)).alias("n"))
    trial = F.array(*(
        F.struct(
            F.lit(i).alias("trial_id"),
            *(F.lit(float(t)).alias(f"t_{name}") for name, t in zip(RULE_FEATURES, trial)),
            F.lit(trial[-1]).alias("votes"),
        )
        for i, trial in enumerate(grid)
    ))
    tried = counts.withColumn("trial", F.explode(trial)).select("label", "n", *RULE_FEATURES, "trial.*")
    votes = reduce(lambda a, b: a + b, [(F.col(c) >= F.col(f"t_{c}")).cast("int") for c in RULE_FEATURES])
    said, attack = votes >= F.col("votes"), F.col("label") == 1

    def total(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    keys = ["trial_id", *(f"t_{c}" for c in RULE_FEATURES), "votes"]
    return with_rates(tried.groupBy(*keys).agg(
        total(attack & said).alias("tp"), total(~attack & ~said).alias("tn"),
        total(~attack & said).alias("fp"), total(attack & ~said).alias("fn"),
    ))


def select_thresholds(train, validation, keep=3, limit=ROWS_PER_TASK):
    """Best trial by validation F1, then lower false-positive rate, recall, precision, first trial."""
    check_model_inputs(RULE_FEATURES)
    if keep < 1:
        raise ValueError("at least one candidate per feature is needed")
    counts = value_table(train)
    classes = {r["label"] for r in counts.select("label").distinct().limit(3).collect()}
    if classes != {0, 1}:
        raise DataError("training rows must hold both classes")
    trials = grid_metrics(validation, threshold_grid(best_cuts(counts, keep, limit)))
    ordered = trials.withColumn("__fpr", -F.col("false_positive_rate"))
    best = best_trial(ordered, ["f1", "__fpr", "recall", "precision"]).drop("__fpr").persist()
    if best.isEmpty():
        raise DataError("there are no validation rows")
    return best


def rule_of(best):
    """(thresholds, votes) of a selected trial row."""
    return {name: best[f"t_{name}"] for name in RULE_FEATURES}, best["votes"]
