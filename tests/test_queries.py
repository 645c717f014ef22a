"""A cross-section of the registered queries beside their SQL; tests/compare.py runs them all."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, differences
from leakgauge.contract import MODEL_FEATURES

SAMPLE = (
    "csv_alias_scan", "packet_counters", "parsed_timestamps", "domain_parts", "validation_report", "cleaned_table",
    "timestamp_fallback", "window_features_with_ties", "window_features_hot_groups", "model_feature_table",
    "feature_medians", "ranking_metrics", "row_mismatches", "stratified_split", "policy_trials", "sensor_replay",
)


@pytest.fixture(scope="module")
def tables(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, tables, sf_dir, name):
    assert differences(spark, tables, queries()[name], oracle_sql()[name], sf_dir) == ""


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ("raw_duplicates_removed", "raw_duplicates_of_two_files"))
def test_rows_broken_alike_are_no_copies(spark, tmp_path, sf_dir, name):
    """Without their time, rows of one client and page may agree in all else; only planted copies are removed."""
    spark.read.parquet(f"{sf_dir}/pages.parquet").write.parquet(f"{tmp_path}/pages.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id in (1, 2)").withColumns({
        "event_id": F.col("event_id") * 31 * pages, "user_id": F.lit(7).cast("long"), "event_type": F.lit("view")})
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")  # multiples of 31 lose their time
    got = queries()[name](spark, str(tmp_path)).collect()
    assert len(got) == sum(31 * pages * i % 20 == 0 for i in (1, 2))


def test_quantiles_work_out_their_rows_once(spark, sf_dir):
    """Ranks and totals share the value counts; the windows behind them stand in the plan of the cached table alone."""
    plan = queries()["nearest_rank_quantiles"](spark, sf_dir)._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan and "user_id" not in plan.split("InMemoryRelation")[0]
    assert "user_id" not in queries()["feature_medians"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_split_rows_are_read_from_a_file(spark, sf_dir):
    from leakgauge import queries as made

    for part in made.split_features(spark, sf_dir):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "InMemoryRelation" not in plan


def test_values_of_thresholds_are_counted_once(spark, sf_dir):
    plan = queries()["candidate_thresholds"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "Expand" not in plan


@pytest.fixture()
def small_forest(monkeypatch):
    from leakgauge import queries as made

    monkeypatch.setattr(made, "PUBLISHED", made.forest.ForestSpec(depth=5, leaf=5, trees=10))


def test_replay_starts_at_the_log(spark, sf_dir, monkeypatch, small_forest):
    """A log that changed after the run was saved shows in the features and in the scores."""
    from leakgauge import views

    real, calls = views.typed_queries, []

    def later(spark, sf_dir):
        calls.append(sf_dir)
        name, rows = F.col("requested_server_name"), real(spark, sf_dir)
        if len(calls) == 1:
            return rows
        other = F.when(F.col("row_id") % 10 == 3, F.concat(F.lit("https://q7q7q7q7q7q7q7q7q7q7."), F.substring_index(name, "/", -2))).otherwise(name)
        return rows.withColumn("requested_server_name", other)

    monkeypatch.setattr(views, "typed_queries", later)
    row = queries()["replay_checks"](spark, sf_dir).first()
    assert len(calls) == 2 and row.changed_features >= 100 and row.scores_identical is False and row.labels_identical is True


def test_replay_uses_the_saved_model(spark, sf_dir, monkeypatch, small_forest):
    """Another threshold, or window, in the saved model shows."""
    from dataclasses import replace

    from leakgauge.plans import forest

    real = forest.load_bundle
    monkeypatch.setattr(forest, "load_bundle", lambda *args: replace(real(*args), threshold=0.999))
    row = queries()["replay_checks"](spark, sf_dir).first()
    assert (row.predictions_identical, row.metrics_identical, row.scores_identical, row.changed_features) == (False, False, True, 0)
    monkeypatch.setattr(forest, "load_bundle", lambda *args: replace(real(*args), window_seconds=1.0))
    assert queries()["replay_checks"](spark, sf_dir).first().changed_features > 0


def test_replay_of_an_unchanged_log(spark, sf_dir, small_forest):
    assert queries()["replay_checks"](spark, sf_dir).first().asDict() == {
        "rows": 1000, "labels_identical": True, "predictions_identical": True, "scores_identical": True,
        "complete_histories": True, "metrics_identical": True, "changed_features": 0,
    }


def test_features_of_the_log_are_its_own(spark, sf_dir):
    """Neither host, host label nor rounded figures stand in for what the log says."""
    from leakgauge import views

    got = {r.row_id: r for r in views.logged_features(spark, sf_dir).collect()}
    plain = {r.row_id: r for r in views.features(spark, sf_dir).collect()}
    assert got.keys() == plain.keys() and len(got) == 1000
    for name in ("apex_domain", "label", "epoch_us", *MODEL_FEATURES):
        assert all(got[i][name] == plain[i][name] for i in got), name
    assert any(r.entropy != round(r.entropy, 9) for r in got.values())
