"""Live scoring: parsed stream, history, model, alerts, totals and digests."""

from pyspark.sql import functions as F

from leakgauge.contract import WINDOW_SECONDS
from leakgauge.functions.domain import base_domain
from leakgauge.functions.lexical import with_lexical_features
from leakgauge.operators.links import new_alerts
from leakgauge.plans.forest import with_prediction
from leakgauge.plans.scoring import with_verdict
from leakgauge.sources.sinks import alert_rows
from leakgauge.streaming.history import LATE, parse_stream, stream_window_features

ERROR_SAMPLE = 20


def scored_stream(raw, bundle, late="reject", ttl_ms=None):
    """(scored rows, unreadable rows). Late rows are in the first, with status 'rejected' and no features."""
    parsed = parse_stream(raw)
    history = stream_window_features(
        parsed.where("problem IS NULL"), bundle.window_seconds or WINDOW_SECONDS, late, ttl_ms
    )
    return with_lexical_features(history), parsed.where("problem IS NOT NULL")


def live_rows(raw, bundle, late="reject", ttl_ms=None):
    """One stream of everything that arrives, so that a batch's answer is complete: status 'accepted', 'rejected' (late)
    or 'unreadable', with the code in ``error`` where a row is not accepted."""
    readable, unreadable = scored_stream(raw, bundle, late, ttl_ms)
    late_code = F.when(F.col("status") == "rejected", LATE)
    bad = unreadable.withColumns({"status": F.lit("unreadable"), "error": F.col("problem")})
    return readable.withColumn("error", late_code).unionByName(bad, allowMissingColumns=True)


def score_micro_batch(rows, bundle):
    """Accepted rows of one micro-batch with score and verdict."""
    return with_verdict(
        with_prediction(rows.where("status = 'accepted'"), bundle.model, bundle.threshold), bundle.threshold
    )


def ingest_writer(bundle, alerts_path, counts_path, errors_path=None):
    """A foreachBatch function for ``live_rows``: alerts, counts and first errors of each micro-batch, written once per
    batch number. ``rejected`` counts late and unreadable rows.

    The tables are partitioned by batch, and a repeated batch overwrites its own partition, so a restart
    after a lost driver or executor adds nothing twice.
    """
    def write(rows, batch_id):
        rows = rows.persist()
        scored = score_micro_batch(rows, bundle).persist()
        counts = scored.groupBy("capture_id").agg(
            F.count(F.lit(1)).alias("accepted"), F.count_if(F.col("prediction") == 1).alias("suspicious")
        )
        rejected = rows.where("status <> 'accepted'").groupBy("capture_id").agg(
            F.count(F.lit(1)).alias("rejected"), F.count_if(F.col("status") == "unreadable").alias("unreadable"))
        per_capture = counts.join(rejected, "capture_id", "full_outer").fillna(0)
        _put(per_capture, counts_path, batch_id)
        _put(alert_rows(scored, bundle.threshold, scored.columns), alerts_path, batch_id)
        if errors_path:
            _put(first_errors(rows), errors_path, batch_id)
        scored.unpersist()
        rows.unpersist()

    return write


def _put(df, path, batch_id):
    (
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    )


def live_totals(counts):
    """Cumulative processed, suspicious and benign rows per capture, from the per-batch counts.

    Works on the stored table, and on a stream of it in complete mode.
    """
    return counts.groupBy("capture_id").agg(
        F.sum("accepted").alias("total_processed"),
        F.sum("suspicious").alias("total_suspicious"),
        (F.sum("accepted") - F.sum("suspicious")).alias("total_benign"),
    )


def rejection_sample(rejected, unreadable, count=ERROR_SAMPLE):
    """The first errors of a batch: unreadable rows, then late ones."""
    first = unreadable.select("capture_id", "seq", F.lit(0).alias("kind"), F.col("problem").alias("error"))
    late = rejected.where("status = 'rejected'").select("capture_id", "seq", F.lit(1).alias("kind"), F.lit(LATE).alias("error"))
    return first.unionByName(late).orderBy("kind", "seq").limit(count)


def first_errors(rows, count=ERROR_SAMPLE):
    """The first errors of a batch of ``live_rows``: unreadable rows, then late ones."""
    bad = rows.where("status <> 'accepted'").withColumn("kind", (F.col("status") != "unreadable").cast("int"))
    return bad.select("capture_id", "batch_seq", "seq", "kind", "error").orderBy("kind", "batch_seq", "seq").limit(count)


def alert_digest(fresh, order="alert_seq", shown=3):
    """Number of alerts, and the first few distinct base domains and hosts among them (oldest first)."""
    def first_values(value):
        firsts = fresh.groupBy(value.alias("v")).agg(F.min(order).alias("at")).orderBy("at").limit(shown)
        return firsts.agg(F.array_sort(F.collect_list(F.struct("at", "v")))["v"].alias("vs")).scalar()

    return fresh.agg(F.count(F.lit(1)).alias("alerts")).withColumns({
        "domains": first_values(base_domain(F.col("requested_server_name"))),
        "hosts": first_values(F.col("src_ip")),
    })


SEEN = "alert_id string, batch_id bigint"


def digest_writer(seen_path, publish, primed, keep_batches=None):
    """A foreachBatch function that reports alerts not seen before.

    With ``primed`` false the very first batch is only recorded, so that connecting to a busy table is silent. Whether
    a batch is the first is read from the table of seen alerts (each batch leaves a mark there), so a restart reports
    what arrived meanwhile. With ``keep_batches`` only the alerts of that many batches before count as seen; as the
    table is partitioned by batch, older ones are not read.
    """
    def write(alerts, batch_id):
        spark = alerts.sparkSession
        try:
            seen = spark.read.schema(SEEN).parquet(seen_path).where(F.col("batch_id") < batch_id)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            seen = spark.createDataFrame([], SEEN)
        first = seen.isEmpty()
        if keep_batches is not None:
            seen = seen.where(F.col("batch_id") >= batch_id - keep_batches)
        fresh = new_alerts(alerts, seen).persist()
        if (primed or not first) and not fresh.isEmpty():
            publish(alert_digest(fresh), batch_id)
        mark = spark.createDataFrame([(None,)], "alert_id string")
        _put(fresh.select("alert_id").unionByName(mark), seen_path, batch_id)
        fresh.unpersist()

    return write


def reset_tables(spark, paths):
    """Empty the tables of a run; start the next one with a new checkpoint location."""
    for path in paths:
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
