"""Scoring of requests and uploads, selection, experiments and writers as their callers use them."""

import json

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakgauge.contract import MODEL_FEATURES, DataError
from leakgauge.operators import links, splits
from leakgauge.plans import cleaning, experiments, forest, scoring, selection
from leakgauge.plans.forest import Bundle
from leakgauge.sources import csv, packets, sinks
from leakgauge.sources import json as batches

QUICK = forest.ForestSpec(depth=3, leaf=1, trees=4)
LONG = "q" * 40


def entry(second, name, **more):
    return {"timestamp": f"2026-10-12 14:00:{second:02d}", "src_ip": "10.0.0.1", "dst_ip": "8.8.8.8", "requested_server_name": name, **more}


@pytest.fixture()
def stored_requests(spark, tmp_path):
    """Two requests under one capture in one file, one without a capture in another; equal queries in all of them."""
    query = entry(1, f"{LONG}.evil.info")
    (tmp_path / "a.json").write_text(json.dumps([{"capture_id": "c", "queries": [query, entry(2, "www.good.org")]}, {"capture_id": "c", "queries": [query]}]))
    (tmp_path / "b.json").write_text(json.dumps({"queries": [query, query]}))
    return batches.read_batches(spark, str(tmp_path))


def test_requests_share_neither_history_nor_alerts(stored_requests, tiny_model):
    scored = scoring.score_batch(stored_requests, Bundle(tiny_model, 0.5)).collect()
    assert [(r.request_id.rsplit("/", 1)[1], r.seq, r.query_frequency) for r in scored if r.capture_id == "c"] == [
        ("a.json#0", 0, 1), ("a.json#0", 1, 1), ("a.json#1", 0, 1)]
    assert sorted(r.query_frequency for r in scored if r.capture_id != "c") == [1, 2]
    alerts = [r for r in scored if r.prediction == 1]
    assert len(alerts) == 4 == len({r.alert_id for r in alerts}) and all(len(r.alert_id) == 68 for r in alerts)
    assert all((r.alert_id is None) == (r.verdict == "benign") for r in scored)


def test_alerts_of_later_requests_are_not_lost(spark, stored_requests, tiny_model, tmp_path):
    scored = scoring.score_batch(stored_requests, Bundle(tiny_model, 0.5))
    alerts = sinks.alert_rows(scored, 0.5, scored.columns)
    first = alerts.where("request_id LIKE '%a.json#0'")
    sinks.append_alerts(first, str(tmp_path / "alerts"))
    seen = spark.read.parquet(str(tmp_path / "alerts"))
    assert links.new_alerts(alerts, seen).count() == 3
    sinks.append_alerts(links.new_alerts(alerts, seen), str(tmp_path / "alerts"))
    assert links.new_alerts(alerts, spark.read.parquet(str(tmp_path / "alerts"))).isEmpty()


def test_a_broken_request_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"queries": [')
    with pytest.raises(Exception):
        batches.read_batches(spark, str(tmp_path / "x.json")).collect()


def test_upload_summary_and_order(spark, tmp_path, tiny_model):
    path = tmp_path / "u.csv"
    path.write_text("timestamp,src_ip,query\n2026-10-12 14:00:09,10.0.1.5,b.good.org\nnever,10.0.1.5,c.good.org\n,10.0.1.5,%s.evil.info\n2026-10-12 14:00:01,10.0.1.5,a.good.org\n" % LONG)
    scored, rejected = scoring.score_upload(csv.read_upload(spark, str(path), "cap"), Bundle(tiny_model, 0.5), 1_000_000)
    assert [r.row_id for r in scored.collect()] == [1, 3, 4]
    assert [(r.row_id, r.problem) for r in rejected.collect()] == [(2, "bad_timestamp")]
    summary = scoring.batch_summary(scored, rejected).first()
    assert (summary.total_queries, summary.suspicious_queries, summary.benign_queries, summary.invalid_rows_skipped) == (3, 1, 2, 1)
    assert scoring.batch_summary(scored).first().invalid_rows_skipped == 0


def test_duplicates_of_two_files(spark, tmp_path):
    head = "timestamp,src_ip,dst_ip,requested_server_name,label\n"
    (tmp_path / "a.csv").write_text(head + "1,10.0.0.1,8.8.8.8,a.com,0\n2,10.0.0.1,8.8.8.8,b.com,0\n")
    (tmp_path / "b.csv").write_text(head + "3,10.0.0.1,8.8.8.8,c.com,0\n2,10.0.0.1,8.8.8.8,B.com,0\n")
    raw = csv.read_raw(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    from leakgauge.operators import dedup
    kept = dedup.drop_repeated_rows(raw)
    assert [tuple(r) for r in dedup.removed_ids(raw, kept).collect()] == [(1, 2)]
    strict = cleaning.load_strict(raw)
    assert {(r.file_ord, r.row_id) for r in strict.collect()} == {(0, 1), (0, 2), (1, 1)}
    (tmp_path / "c.csv").write_text(head + "2,10.0.0.1,8.8.8.8,b.com,1\n")
    with pytest.raises(DataError, match="row 2 has two labels"):
        cleaning.load_strict(csv.read_raw(spark, [str(tmp_path / "a.csv"), str(tmp_path / "c.csv")]))


def test_no_row_is_sorted_whole_for_duplicates(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, "1", "a", "b", "c.com", 0)], "file_ord int, row_id bigint, timestamp string, src_ip string, dst_ip string, requested_server_name string, label int")
    from leakgauge.operators import dedup
    plan = dedup.drop_repeated_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_capture_import(spark, tmp_path):
    rows = [(i, i, True, 0, "udp", 4, 1, "10.0.0.1", "8.8.8.8", "a.com", 1) for i in (1, 2)] + [(3, 3, True, 1, "udp", 4, 1, "10.0.0.1", "8.8.8.8", "a.com", 1)]
    decoded = spark.createDataFrame(rows, "packet_number bigint, at bigint, is_dns boolean, qr int, transport string, ip_version int, qdcount int, src_ip string, dst_ip string, qname string, qtype int")
    decoded = decoded.withColumn("ts", F.timestamp_micros(1_717_777_777_123_455 + F.col("at")))
    sinks.import_capture(decoded, "net", str(tmp_path / "t"), str(tmp_path / "s"))
    table = spark.read.option("header", True).csv(str(tmp_path / "t")).orderBy("timestamp").collect()
    assert [r.timestamp for r in table] == ["1717777777.123456", "1717777777.123457"]
    summary = spark.read.json(str(tmp_path / "s")).first()
    assert (summary.rows, summary.packets, summary.non_query_packets, summary.accepted_queries, summary.duplicate_events) == (2, 3, 1, 2, 0)
    events = packets.packet_events(decoded, "net")
    assert packets.import_summary(events).columns == ["rows", "distinct_apex_domains", "time_span_seconds"]


def test_written_tables_are_read_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.com", 0, 1, 0.75)], "row_id bigint, apex_domain string, label int, prediction int, score double")
    table = sinks.prediction_table(rows)
    sinks.write_table(table, str(tmp_path / "p"))
    assert csv.read_predictions(spark, str(tmp_path / "p")).collect() == table.collect()
    with pytest.raises(Exception):
        sinks.write_table(table, str(tmp_path / "p"))


@pytest.fixture(scope="module")
def burst_rows(spark):
    """Six apexes per class with plain traffic; attack names are long."""
    rows = []
    for i in range(360):
        attack = i % 12 >= 6
        apex = f"d{i % 12}.com"
        sub = f"{'x' * (30 + i % 9)}{i}" if attack else f"w{i % 5}"
        rows.append((i, f"10.0.0.{i % 3}", "8.8.8.8", f"{sub}.{apex}", int(attack), 1_700_000_000_000_000 + i * 400_000))
    df = spark.createDataFrame(rows, "row_id bigint, src_ip string, dst_ip string, requested_server_name string, label int, epoch_us bigint")
    return cleaning.normalized(df.withColumn("normal_name", F.col("requested_server_name"))).cache()


@pytest.fixture(scope="module")
def allocation(burst_rows):
    folds = splits.domain_folds(burst_rows, 3)
    placed = links.with_fold(burst_rows, folds).withColumnRenamed("fold", "outer_fold")
    return placed.select("row_id", "apex_domain", "label", "outer_fold", F.lit(0).alias("prediction")).cache()


EASY = dict(specs=[QUICK], folds=2, policy=selection.Policy(1.0, 1.0, 1), thresholds=(0.3, 0.5))


def test_fast_burst_experiment(spark, burst_rows, allocation):
    features = cleaning.derive_features(burst_rows)
    previous = Bundle(forest.fit_forest(forest.model_input(features), QUICK), 0.5)
    attacks = links.exclude_domains(burst_rows.where("label = 1"), allocation.where("outer_fold = 1"))
    stress = burst_rows.where("label = 1").withColumn("apex_domain", F.concat(F.lit("new."), "apex_domain"))
    result = experiments.fast_burst_experiment(burst_rows, allocation, 1, {"bursts": ("attack", attacks)}, stress, previous, "d1.com", gaps_ms=(1, 100), **EASY)
    held = allocation.where("outer_fold = 1").count()
    assert result["predictions"].count() == held
    pooled = {r.model: r for r in result["metrics"].where("scope = 'pooled'").collect()}
    assert set(pooled) == {"before", "after"} and all(r.tp + r.tn + r.fp + r.fn == held for r in pooled.values())
    assert tuple(result["stress"].first())[:2] == (180, 6)
    assert sorted(r.gap_ms for r in result["sweep"].collect()) == [1, 100]
    assert {r.capture_id for r in result["captures"].collect()} == {"primary", "bursts"}
    assert result["fast_benign"].count() == 1
    with pytest.raises(DataError, match="stress rows reuse"):
        experiments.unseen_domains(burst_rows.where("label = 1"), features, allocation)


def test_held_out_experiment_watches_the_big_domain(burst_rows, allocation):
    big = allocation.where("outer_fold = 1").orderBy("apex_domain").first()["apex_domain"]
    more = links.exclude_domains(burst_rows.where("label = 0"), allocation.where("outer_fold = 1"))
    result = experiments.held_out_experiment(burst_rows, allocation, 1, {"second": ("benign", more)}, big, must_include=big, **EASY)
    assert {r.scope for r in result["metrics"].collect()} == {"pooled", "big_domain"}
    with pytest.raises(DataError):
        experiments.held_out_partition(burst_rows, allocation, 1, "absent.example")


def test_selection_by_validation_and_nested_folds(burst_rows):
    features = cleaning.derive_features(burst_rows).cache()
    train, validation = features.where("row_id % 3 > 0"), features.where("row_id % 3 = 0")
    model, spec, threshold, trials = selection.select_by_validation(train, validation, [QUICK, forest.ForestSpec(depth=2, trees=3)])
    assert trials.count() == 6 and threshold in (0.3, 0.5, 0.7)
    assert trials.where("tp + fn + tn + fp <> 120").isEmpty()
    predicted, chosen = selection.nested_evaluation(features, [QUICK], outer=3, inner=2, policy=EASY["policy"], thresholds=(0.3, 0.5))
    assert len(chosen) == 3 and predicted.count() == 360 == predicted.select("row_id").distinct().count()
    assert predicted.groupBy("apex_domain").agg(F.count_distinct("outer_fold").alias("n")).where("n > 1").isEmpty()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_what_experiments_return_starts_at_files(spark, burst_rows, allocation):
    """Rows with a long plan behind them are worked out once: no window and no source row is left in what is returned."""
    features = cleaning.derive_features(burst_rows)
    for _ in range(3):
        features = features.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("apex_domain"))).drop("n").where("row_id >= 0")
    easy = dict(policy=EASY["policy"], thresholds=(0.3, 0.5))
    predicted, _ = selection.nested_evaluation(features, [QUICK], outer=2, inner=2, **easy)
    selected = selection.select_by_groups(features, [QUICK], 2, **easy)
    attacks = links.exclude_domains(burst_rows.where("label = 1"), allocation.where("outer_fold = 1"))
    big = allocation.where("outer_fold = 1").orderBy("apex_domain").first()["apex_domain"]
    result = experiments.held_out_experiment(burst_rows, allocation, 1, {"more": ("attack", attacks)}, big, must_include=big, **EASY)
    for df in (predicted, selected.scores, selected.trials, result["predictions"], result["metrics"], result["captures"]):
        assert "Window" not in plan_of(df) and "InMemoryRelation" not in plan_of(df) and "LogicalRDD" not in plan_of(df)


def test_a_fit_deals_its_rows_by_rows_and_trees(spark, burst_rows, monkeypatch):
    seen, real = [], forest.Pipeline.fit

    def fit(self, df, *args):
        seen.append((df.rdd.getNumPartitions(), plan_of(df)))
        return real(self, df, *args)

    monkeypatch.setattr(forest.Pipeline, "fit", fit)
    monkeypatch.setattr(forest, "ROW_TREES", 100)
    rows = forest.model_input(cleaning.derive_features(burst_rows))
    forest.fit_forest(rows, QUICK)
    forest.fit_forest(rows.unionByName(rows), QUICK)
    assert [n for n, _ in seen] == [-(-360 * QUICK.trees // 100), -(-720 * QUICK.trees // 100)]
    assert not any("Window" in plan for _, plan in seen)


def test_replay_scores_its_rows_once(spark, burst_rows, tiny_model):
    features = cleaning.derive_features(burst_rows)
    saved = forest.with_prediction(features, tiny_model, 0.5).select("row_id", "apex_domain", "label", "prediction", "score")
    assert "UDF" not in plan_of(experiments.replay_checks(saved, features, Bundle(tiny_model, 0.5)))


def test_replay_notices_a_changed_score(burst_rows):
    features = cleaning.derive_features(burst_rows)
    bundle = Bundle(forest.fit_forest(forest.model_input(features), QUICK), 0.5)
    saved = forest.with_prediction(features, bundle.model, 0.5).select("row_id", "apex_domain", "label", "prediction", "score")
    assert tuple(experiments.replay_checks(saved, features, bundle).first()) == (360, True, True, True, True)
    touched = saved.withColumn("score", F.when(F.col("row_id") == 7, 0.123).otherwise(F.col("score")))
    assert experiments.replay_checks(touched, features, bundle).first().scores_identical is False
    fewer = saved.where("row_id <> 7")
    assert experiments.replay_checks(fewer, features, bundle).first().complete_histories is False


def test_detectors_are_compared_on_the_same_rows(burst_rows):
    features = cleaning.derive_features(burst_rows)
    saved = features.select("row_id", "label", F.col("label").alias("prediction"))
    rows = {r.detector: r for r in experiments.compare_detectors(saved, features.drop("label")).collect()}
    assert rows["model"].f1 == 1.0 and rows["rule"].tp + rows["rule"].fn == 180


def test_replay_reports_a_changed_metric_and_a_changed_feature(spark, burst_rows, tiny_model):
    from leakgauge.operators.metrics import classification_metrics
    from leakgauge.plans.forest import model_input, with_prediction

    features = cleaning.derive_features(burst_rows).where("row_id is not null")
    bundle = Bundle(tiny_model, 0.5)
    saved = with_prediction(features, tiny_model, 0.5).select("row_id", "apex_domain", "label", "prediction", "score")
    scored, table = classification_metrics(saved), model_input(features).select("row_id", *MODEL_FEATURES)
    check = lambda m, f: experiments.replay_checks(saved, features, bundle, m, f).first()
    same = check(scored, table)
    assert same.metrics_identical is True and same.changed_features == 0
    other = table.withColumn("entropy", F.when(F.col("row_id") == table.first().row_id, 9.5).otherwise(F.col("entropy")))
    moved = check(scored.withColumn("tp", F.col("tp") + 1), other)
    assert moved.metrics_identical is False and moved.changed_features == 1
    assert check(scored, table.limit(3)).changed_features == features.count() - 3


def test_replay_compares_rank_statistics_and_refuses_unknown_metrics(burst_rows, tiny_model):
    features = cleaning.derive_features(burst_rows)
    bundle = Bundle(tiny_model, 0.5)
    saved = forest.with_prediction(features, tiny_model, 0.5).select("row_id", "apex_domain", "label", "prediction", "score")
    scored = experiments.run_metrics(saved)
    check = lambda m: experiments.replay_checks(saved, features, bundle, m).first().metrics_identical
    assert check(scored) is True
    assert check(scored.withColumn("roc_auc", F.col("roc_auc") - 0.25)) is False
    assert check(scored.withColumn("average_precision", F.col("average_precision") - 0.25)) is False
    with pytest.raises(DataError, match="log_loss"):
        check(scored.withColumn("log_loss", F.lit(0.1)))


def test_average_precision_does_not_depend_on_the_order_of_rows(spark):
    """Chunks over several tasks are summed in another order than one sorted table."""
    from leakgauge.operators.metrics import ranking_metrics

    label = (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10)) < 3).cast("int").alias("label")
    df = spark.range(3000).select(label, (F.col("id") * 7919 % 3001 / 3001).alias("score"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len({ranking_metrics(df, **how).first().average_precision for how in ({}, {"limit": 300}, {"limit": 700})}) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_row_ids_are_never_broadcast(spark, tmp_path):
    spark.range(100).selectExpr("id AS row_id", "'a' AS apex_domain", "0 AS label").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    broken = links.incomplete_histories(rows.where("row_id <> 7"), rows)
    assert broken.count() == 1
    found = [links.missing_ids(rows, rows), links.join_predictions(rows.select("row_id"), rows), broken]
    kinds = [df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("BroadcastHashJoin") for df in found]
    assert kinds[:2] == [0, 0] and kinds[2] <= 2  # the domains' alone


def test_a_stopped_selection_goes_on(spark, burst_rows, tmp_path, monkeypatch):
    from leakgauge.plans.forest import ForestSpec, model_input


    rows = model_input(cleaning.derive_features(burst_rows)).withColumn("fold", (F.col("row_id") % 2).cast("int")).cache()
    specs = [ForestSpec(depth=2, leaf=5, trees=2), ForestSpec(depth=3, leaf=5, trees=2)]
    fitted, fit = [], selection.fit_forest

    def stops(df, spec):
        fitted.append(spec)
        if len(fitted) == 3:
            raise RuntimeError("stopped")
        return fit(df, spec)

    monkeypatch.setattr(selection, "fit_forest", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        selection.out_of_fold_scores(rows, specs, 2, str(tmp_path / "scores"), workers=1)
    # One worker takes the tasks in order; those after the failure still ran and were kept.
    done = len(fitted) - 1
    found = selection.out_of_fold_scores(rows, specs, 2, str(tmp_path / "scores"), workers=1)
    assert len(fitted) == done + 2 and found.count() == 2 * rows.count()
    whole = selection.out_of_fold_scores(rows, specs, 2)
    key = lambda df: sorted((r.trial_id, r.row_id, round(r.score, 12)) for r in df.collect())
    assert key(found) == key(whole)
