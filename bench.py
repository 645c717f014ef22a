"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

from leakgauge import build_session
from leakgauge import queries as q
from leakgauge import views
from leakgauge.plans import forest, scoring
from leakgauge.plans.ordered import layout_if_small
from leakgauge.sources.csv import read_raw

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
HEADLINE = (
    "suspicious_pairs", "model_feature_table", "window_features_six_hours", "lexical_features", "cleaned_table",
    "validation_report", "strict_load", "ranking_metrics", "policy_trials", "sensor_replay",
)


def run(df):
    """Compute every row and column, write nothing."""
    df.write.format("noop").mode("overwrite").save()


def timed(make):
    best = None
    for _ in range(REPEATS):
        start = time.perf_counter()
        run(make())
        took = time.perf_counter() - start
        best = took if best is None else min(best, took)
        print(f"{took:8.2f}s", file=sys.stderr, flush=True)
    return round(best, 3)


def main():
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
    })
    spark.sparkContext.setLogLevel("OFF")
    times = {name: timed(lambda name=name: q.QUERIES[name](spark, SF_DIR)) for name in HEADLINE}

    rows = views.host_features(spark, SF_DIR).persist()
    run(rows)
    start = time.perf_counter()
    model = forest.fit_forest(forest.model_input(rows), forest.ForestSpec(depth=12, leaf=5, trees=150))
    times["forest_fit_150_trees"] = round(time.perf_counter() - start, 3)
    times["forest_scoring"] = timed(lambda: forest.with_prediction(rows, model, 0.5))
    bundle = forest.Bundle(model, 0.5, 21600.0)

    log = f"{tempfile.mkdtemp(prefix='spark-')}/log"
    views.raw_queries(spark, SF_DIR).select("timestamp", "src_ip", "dst_ip", "requested_server_name", "label").write.csv(log, header=True)

    def end_to_end():
        raw = read_raw(spark, log).withColumnRenamed("row_id", "seq")
        return scoring.score_batch(
            raw.withColumn("capture_id", F.lit("bench")), bundle, layout=layout_if_small(views.read_table(spark, SF_DIR, "events")))

    times["log_to_predictions"] = timed(end_to_end)
    events = rows.count()
    print(json.dumps({
        "metric": "sum of headline query times",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows": events,
        "feature_rows_per_sec": round(events / times["model_feature_table"]),
        "scoring_rows_per_sec": round(events / times["forest_scoring"]),
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
