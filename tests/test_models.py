import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from leakgauge.contract import MODEL_FEATURES, SCORE_THRESHOLDS, DataError
from leakgauge.operators import links, metrics, ranking, rules, splits
from leakgauge.plans import experiments, forest, selection

QUICK = forest.ForestSpec(depth=3, leaf=1, trees=4)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, apex_domain string, label int, score double, prediction int")


@pytest.fixture(scope="module")
def traffic(spark):
    """Twelve domains, six per class; attacks have long names."""
    rng = random.Random(1)
    rows = []
    for i in range(240):
        attack = i % 12 >= 6
        length = rng.randrange(40, 60) if attack else rng.randrange(8, 30)
        rows.append((i, f"d{i % 12}.com", int(attack), float(length), length - 5.0, 3.0, 3 + rng.random(), 0.1, 0.1, length - 8.0, 1.0, 1.0, float(rng.randrange(60))))
    schema = "row_id bigint, apex_domain string, label int, " + ", ".join(f"{f} double" for f in MODEL_FEATURES)
    return spark.createDataFrame(rows, schema).cache()


def test_scores_against_definitions(spark):
    rng = random.Random(7)
    rows = [(i, "a", int(rng.random() < 0.3), rng.randrange(20) / 20, 0) for i in range(300)]
    pos, neg = [r[3] for r in rows if r[2]], [r[3] for r in rows if not r[2]]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    average, recall = 0.0, 0.0
    for t in sorted({r[3] for r in rows}, reverse=True):
        tp = sum(p >= t for p in pos)
        average += (tp / len(pos) - recall) * tp / (tp + sum(n >= t for n in neg))
        recall = tp / len(pos)
    for limit in (10**6, 5):
        got = metrics.ranking_metrics(labelled(spark, rows), limit=limit).first()
        assert got.roc_auc == pytest.approx(auc, abs=1e-12) and got.average_precision == pytest.approx(average, abs=1e-12)


def test_rates_and_empty_denominators(spark):
    rows = [(0, "a", 0, 0.0, 0), (1, "a", 0, 0.0, 1), (2, "a", 1, 0.0, 0), (3, "b", 1, 0.0, 1)]
    got = metrics.classification_metrics(labelled(spark, rows)).first()
    assert (got.f1, got.false_positive_rate, got.accuracy) == (0.5, 0.5, 0.5)
    none = metrics.classification_metrics(labelled(spark, rows).withColumn("prediction", F.lit(0))).first()
    assert none.precision == none.f1 == 0.0
    by_domain = {r.apex_domain: r for r in metrics.domain_errors(labelled(spark, rows)).collect()}
    assert (by_domain["a"].false_positive_rate, by_domain["a"].recall) == (0.5, 0.0)
    assert by_domain["b"].false_positive_rate is None and by_domain["b"].recall == 1.0
    assert metrics.masked_fpr(labelled(spark, rows), F.lit(False)).first().false_positive_rate is None


@pytest.mark.parametrize("limit", [10**6, 10])
def test_quantiles_against_sorted_lists(spark, limit):
    rng = random.Random(3)
    values = [rng.randrange(50) / 7 for _ in range(173)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered, asked = sorted(values), (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    nearest = {r.quantile: r.value for r in metrics.nearest_rank_quantiles(df, "v", asked, limit=limit).collect()}
    assert nearest == {q: ordered[round(172 * q)] for q in asked}
    linear = {r.quantile: r.value for r in metrics.linear_quantiles(df, "v", asked, limit=limit).collect()}
    for q in asked:
        low = int(172 * q)
        expected = ordered[low] + (ordered[min(low + 1, 172)] - ordered[low]) * (172 * q - low)
        assert linear[q] == pytest.approx(expected)


@pytest.mark.parametrize("accuracy, margin", [(20_000, 4), (40, 4), (40, 0.001)])
@pytest.mark.parametrize("nearest", [False, True])
def test_two_pass_quantiles_equal_ranked_values(spark, monkeypatch, accuracy, margin, nearest):
    """A margin too small for the sketch's error sends quantiles to the exact branch; the answer stays the same."""
    monkeypatch.setattr(metrics, "MARGIN", margin)
    rng = random.Random(7)
    draw = [lambda: rng.random(), lambda: float(rng.randrange(5)), lambda: rng.lognormvariate(0, 9), lambda: None]
    rows = [(g, draw[0](), None if rng.random() < 0.2 else draw[1](), draw[2 if g == "x" else 3](), None)
            for g in rng.choices(["x", "y", None], (90, 9, 1), k=4000)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, d double").repartition(5)
    names, asked = ["a", "b", "c", "d"], (0, 0.01, 0.5, 0.95, 1)
    full = metrics.nearest_rank_quantiles if nearest else metrics.linear_quantiles
    as_dict = lambda out: {(r.g, r.feature, r.quantile): r.value for r in out.collect()}
    want = as_dict(full(metrics.long_features(df, names, ["g"]), "value", asked, ["g", "feature"]))
    got = as_dict(metrics.refined_quantiles(df, names, asked, ["g"], nearest, accuracy))
    assert got == want and len(got) == 5 * (3 * 2 + 1)
    assert metrics.refined_quantiles(df.where("false"), names, asked, ["g"]).count() == 0


def test_bands_shuffle_sketches_and_few_rows(spark):
    df = spark.range(200_000).select(F.hash("id").cast("double").alias("v"), F.lit(1).alias("g"))
    bands = metrics.quantile_bands(df, ["v"], (0.5,), ["g"]).collect()
    assert len(bands) == 1 and bands[0].total == 200_000
    inside = df.where(F.col("v").between(bands[0].low_edge, bands[0].high_edge)).count()
    assert 0 < inside <= 200_000 * 2 * (metrics.MARGIN + 1) / metrics.ACCURACY


def test_row_split_sizes(spark):
    df = spark.range(20).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"))
    got = {(r.split, r.label): r["count"] for r in splits.stratified_split(df).groupBy("split", "label").count().collect()}
    assert got == {("train", 0): 6, ("train", 1): 6, ("validation", 0): 2, ("validation", 1): 2, ("test", 0): 2, ("test", 1): 2}
    assert splits.stratified_split(df).collect() == splits.stratified_split(df).collect()
    assert splits.stratified_split(df, seed=1).collect() != splits.stratified_split(df).collect()
    with pytest.raises(ValueError):
        splits.stratified_split(df, (0.6, 0.4))
    with pytest.raises(DataError):
        splits.stratified_split(df.withColumn("label", F.lit(2)))


@pytest.mark.parametrize("limit", [10**6, 5])
def test_domain_folds_balance_domains(spark, limit):
    rows = [(f"b{d}.com", 0) for d in range(15) for _ in range(1000 if d == 0 else 3)] + [(f"a{d}.com", 1) for d in range(15) for _ in range(4)]
    df = spark.createDataFrame(rows, "apex_domain string, label int")
    folds = splits.domain_folds(df, 5, limit=limit)
    per_fold = {(r.fold, r.majority): r["count"] for r in folds.groupBy("fold", "majority").count().collect()}
    assert per_fold == {(f, m): 3 for f in range(5) for m in (0, 1)}
    assert folds.count() == 30
    splits.require_both_classes(folds)
    with pytest.raises(DataError):
        splits.domain_folds(df.where("label = 0"), 5)


def test_domain_split_is_disjoint(spark, traffic):
    parts = splits.split_by_domain(traffic)
    links.require_disjoint(parts)
    assert {r.split for r in parts.select("split").distinct().collect()} == {"train", "validation", "test"}
    assert parts.count() == 240


def test_threshold_search(spark):
    columns = "label int, query_length double, entropy double, query_frequency double, unique_subdomains double"
    train = spark.createDataFrame([(0, 10.0, 2.0, 1.0, 1.0), (0, 12.0, 2.5, 1.0, 1.0), (1, 50.0, 4.2, 9.0, 9.0), (1, 55.0, 4.5, 8.0, 8.0)], columns)
    validation = spark.createDataFrame([(0, 11.0, 2.2, 1.0, 1.0), (1, 52.0, 4.3, 9.0, 9.0)], columns)
    best = rules.select_thresholds(train, validation).first()
    assert best.f1 == 1.0
    rule, votes = rules.rule_of(best)
    assert votes == 2 and rule["query_frequency"] >= 2
    with pytest.raises(DataError):
        rules.select_thresholds(train.where("label = 0"), validation)
    with pytest.raises(DataError):
        rules.select_thresholds(train, validation.limit(0))
    with pytest.raises(ValueError):
        rules.select_thresholds(train, validation, 0)
    quiet = train.withColumns({"query_frequency": F.lit(1.0), "unique_subdomains": F.lit(1.0)})
    floors = {r.feature: r.threshold for r in rules.candidate_thresholds(quiet).collect() if "_" in r.feature and r.feature != "query_length"}
    assert floors == {"query_frequency": 2.0, "unique_subdomains": 2.0}


def policy_rows(spark):
    """1,000 easy benign rows, 100 of one cloud domain of which ten score high, and 100 attacks."""
    rows = [(i, f"easy{i % 10}.com", 0, 0.1, 0) for i in range(1000)]
    rows += [(1000 + i, "cloud.com", 0, 0.95 if i < 10 else 0.1, 0) for i in range(100)]
    rows += [(2000 + i, f"bad{i % 5}.com", 1, 0.9, 0) for i in range(100)]
    return labelled(spark, rows).withColumns({"fold": F.length("apex_domain") % 2, "trial_id": F.lit(1)})


def test_policy_watches_large_domains(spark):
    trials = {r.threshold: r for r in selection.policy_trials(policy_rows(spark), selection.Policy(), SCORE_THRESHOLDS).collect()}
    assert len(trials) == len(SCORE_THRESHOLDS) == 52
    half = trials[0.5]
    assert half.false_positive_rate < 0.01 and half.worst_large_domain_fpr == 0.1 and not half.eligible
    dense = policy_rows(spark).withColumn("prediction", (F.col("score") >= 0.5).cast("int")).groupBy("fold", "apex_domain").agg(*metrics.confusion())
    again = metrics.policy_summary(dense).first()
    for name in ("tp", "fp", "tn", "fn", "mean_fold_recall", "worst_fold_fpr", "worst_large_domain_fpr", "checked_benign_domains"):
        assert again[name] == pytest.approx(half[name])
    with pytest.raises(DataError, match="policy"):
        selection.best_policy_trial(selection.policy_trials(policy_rows(spark), selection.Policy(0.0, 0.0), (0.5,)))


def test_equal_trials_take_the_higher_threshold(spark):
    rows = policy_rows(spark).where("apex_domain <> 'cloud.com'")
    assert selection.best_policy_trial(selection.policy_trials(rows, selection.Policy(), (0.5, 0.9))).threshold == 0.9


def test_policy_arguments():
    for wrong in (dict(max_fpr=-1), dict(max_domain_fpr=2), dict(min_rows=0)):
        with pytest.raises(ValueError):
            selection.Policy(**wrong)
    with pytest.raises(ValueError):
        selection.check_thresholds((0.0,))


def test_model_input_is_checked(spark, traffic):
    with pytest.raises(DataError, match="entropy"):
        forest.model_input(traffic.drop("entropy"))
    for bad in (float("inf"), float("nan"), None):
        with pytest.raises(Exception, match="finite"):
            forest.model_input(traffic.withColumn("entropy", F.lit(bad).cast("double"))).collect()


def test_bundle_round_trip(spark, traffic, tmp_path):
    bundle = forest.Bundle(forest.fit_forest(traffic, QUICK), 0.7)
    forest.save_bundle(spark, bundle, str(tmp_path / "m"))
    loaded = forest.load_bundle(spark, str(tmp_path / "m"))
    before = forest.with_prediction(traffic, bundle.model, 0.7).select("row_id", "score", "prediction")
    after = forest.with_prediction(traffic, loaded.model, loaded.threshold).select("row_id", "score", "prediction")
    assert sorted(before.collect()) == sorted(after.collect())
    assert forest.with_prediction(traffic.limit(0), loaded.model, 0.7).count() == 0
    for wrong in (dict(threshold=1.0), dict(features=("entropy",)), dict(schema_version=2)):
        with pytest.raises(DataError):
            forest.Bundle(**{**dict(model=bundle.model, threshold=0.7), **wrong}).check()
    ranked = forest.importances(spark, bundle.model).collect()
    assert [r.rank for r in ranked] == list(range(1, 11)) and sum(r.importance for r in ranked) == pytest.approx(1)
    with pytest.raises(DataError):
        ranking.ranked_importances(spark, ["a", "b"], [0.5, 0.1])
    with pytest.raises(ValueError):
        ranking.newest_alerts(traffic, 501)


def test_group_selection_and_final_model(spark, traffic):
    bundle, selected = selection.train_final(traffic, [QUICK], folds=2, thresholds=(0.5, 0.8))
    assert selected.validation.eligible and bundle.threshold in (0.5, 0.8)
    assert selected.scores.count() == 240
    reports = selection.evaluation_reports(
        forest.with_prediction(traffic, bundle.model, bundle.threshold).withColumn("outer_fold", F.lit(0))
    )
    assert reports["pooled"].first().recall > 0.9 and reports["domains"].count() == 12


def test_retimed_copies_and_sweep(spark):
    rows = spark.createDataFrame(
        [(i, "10.0.0.1", "x.net", f"s{i}", f"s{i}.x.net", 1_000_000 * i) for i in range(5)],
        "row_id bigint, src_ip string, apex_domain string, subdomain string, requested_server_name string, epoch_us bigint",
    )
    burst = lambda df: df.withColumn("prediction", (F.col("query_frequency") >= 3).cast("int"))
    got = {r.gap_ms: r.recall for r in experiments.timing_sweep(rows, {"recall": burst}, (1, 60_000, 61_000)).collect()}
    assert got == {1: 0.6, 60_000: 0.0, 61_000: 0.0}


def test_held_out_partition(spark):
    rows = labelled(spark, [(i, f"d{i // 2}.com", 0, 0.0, 0) for i in range(8)]).select("row_id", "apex_domain", "label")
    fold = reduce(lambda c, d: c.when(F.col("apex_domain") == d[0], d[1]), [("d0.com", 4), ("d1.com", 0), ("d2.com", 4), ("d3.com", 1)], F.when(F.lit(False), 0))
    allocation = rows.withColumn("outer_fold", fold)
    training, evaluation, excluded = experiments.held_out_partition(rows, allocation, 4, "d0.com")
    assert sorted(r.row_id for r in training.collect()) == [2, 3, 6, 7]
    assert sorted(r.row_id for r in evaluation.collect()) == [0, 1, 4, 5]
    with pytest.raises(DataError, match="does not hold"):
        experiments.held_out_partition(rows, allocation, 4, "d1.com")
    with pytest.raises(DataError, match="several parts"):
        experiments.held_out_partition(rows, allocation.withColumn("outer_fold", F.when(F.col("row_id") == 0, 1).otherwise(F.col("outer_fold"))), 4)
    with pytest.raises(DataError, match="reuse"):
        experiments.attack_capture(rows.withColumn("label", F.lit(1)), excluded)
    with pytest.raises(DataError, match="nothing remains"):
        experiments.benign_capture(evaluation, excluded)
