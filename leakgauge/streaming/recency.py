"""Captures remembered by recency: only the most recently used captures keep their history.

A batch of a sensor uses its capture. A capture that is used again after `most` or more other captures starts anew, so a
history is named by its capture and by the batch it began with (`history_since`); window features take both as their key.

Recency is a sequence over all uses, but the state before any of them is a list of at most `most` captures. Uses are cut
into at most `CHUNKS` stretches of arrival numbers, each stretch is summed up by its own most recent captures, these
summaries (at most CHUNKS x most names) give the list at the start of every stretch, and the stretches are swept at once.
"""

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from leakgauge.contract import DataError
from leakgauge.plans.ordered import ROWS_PER_TASK, last_known, with_running

#: Fixed value: captures whose history is kept.
MOST_CAPTURES = 256
CHUNKS, CHUNK_BATCHES = 256, 1024
SINCE = "history_since"
HELD = "place long, capture_id string, since long, batch long"


def capture_uses(rows):
    """One row per arrival batch and capture; a row without a capture uses none."""
    return rows.where("capture_id IS NOT NULL").groupBy("batch_seq", "capture_id").agg(F.min("seq").alias("seq"))


def used(recent, capture, most):
    """Mark a capture as the latest of `recent` (oldest first); whether it was not there."""
    fresh = capture not in recent
    recent[capture] = None
    recent.move_to_end(capture)
    if len(recent) > most:
        recent.popitem(last=False)
    return fresh


def latest(uses, most, *within):
    """The `most` most recently used captures of each group of uses, and their place (1: the latest)."""
    last = uses.groupBy(*within, "capture_id").agg(F.max(F.struct("batch_seq", "seq")).alias("at"))
    order = Window.partitionBy(*within).orderBy(F.col("at").desc(), F.col("capture_id").desc())
    return last.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def with_restarts(uses, most=MOST_CAPTURES, held=()):
    """Uses with `fresh`: whether the capture has no history that is still kept. ``held``: captures, oldest first."""
    low, high = uses.agg(F.min("batch_seq"), F.max("batch_seq")).first()
    if low is None:
        return uses.withColumn("fresh", F.lit(True))
    width = max(CHUNK_BATCHES, -(-(high - low + 1) // CHUNKS))
    cut = uses.withColumn("chunk", F.floor((F.col("batch_seq") - low) / width).cast("long"))
    summaries = {}
    for row in latest(cut, most, "chunk").orderBy("chunk", F.desc("place")).select("chunk", "capture_id").collect():
        summaries.setdefault(row["chunk"], []).append(row["capture_id"])
    recent, starts = OrderedDict.fromkeys(list(held)[-most:]), {}
    for chunk in sorted(summaries):
        starts[chunk] = list(recent)
        for capture in summaries[chunk]:
            used(recent, capture, most)

    def sweep(key, stretch):
        kept = OrderedDict.fromkeys(starts[int(key[0])])
        stretch = stretch.sort_values(["batch_seq", "seq", "capture_id"], ignore_index=True)
        fresh = [used(kept, capture, most) for capture in stretch["capture_id"]]
        return stretch[["batch_seq", "capture_id", "seq"]].assign(fresh=pd.Series(fresh, dtype=bool))

    return cut.groupBy("chunk").applyInPandas(sweep, "batch_seq long, capture_id string, seq long, fresh boolean")


def capture_histories(uses, most=MOST_CAPTURES, held=(), limit=ROWS_PER_TASK):
    """Uses with `history_since`, the arrival number their history began with. ``held``: (capture, since), oldest first."""
    began = dict(held)
    marked = with_restarts(uses, most, list(began)).withColumn("began", F.when(F.col("fresh"), F.col("batch_seq")))
    named = with_running(marked, ("capture_id",), ("batch_seq", "seq"), limit=limit, last=last_known(F.col("began")))
    since = F.coalesce("began", "last")
    if began:
        names = F.create_map(*(F.lit(v) for pair in list(began.items())[-most:] for v in pair))
        since = F.coalesce(since, F.try_element_at(names, F.col("capture_id")).cast("long"))
    return named.select("batch_seq", "capture_id", "seq", since.alias(SINCE))


def with_capture_history(rows, most=MOST_CAPTURES, held=(), limit=ROWS_PER_TASK):
    """Rows with the beginning of the history they belong to; null where there is no capture."""
    histories = capture_histories(capture_uses(rows), most, held, limit)
    return rows.join(histories.drop("seq"), ["batch_seq", "capture_id"], "left")


def recency_writer(rows_path, held_path, most=MOST_CAPTURES):
    """A foreachBatch function over a parsed stream: each micro-batch goes to its own folder of ``rows_path`` with
    `history_since`; a second stream reads those and adds window features.

    The captures that are kept (at most ``most``) are a small table. Micro-batches write it in turn to two folders, so the one a
    repeated micro-batch starts from is still there, and rows that were written whole are not written again.
    """
    def write(rows, batch_id):
        spark = rows.sparkSession
        held = []
        if batch_id:
            stored = spark.read.schema(HELD).parquet(f"{held_path}/{(batch_id - 1) % 2}").orderBy("place").collect()
            if any(r["batch"] != batch_id - 1 for r in stored):
                raise DataError(f"the kept captures in {held_path} are not those of micro-batch {batch_id - 1}")
            held = [(r["capture_id"], r["since"]) for r in stored]
        rows = rows.persist()
        try:
            if not _written(spark, f"{rows_path}/batch_id={batch_id}"):
                with_capture_history(rows, most, held).write.mode("overwrite").parquet(f"{rows_path}/batch_id={batch_id}")
            histories = capture_histories(capture_uses(rows), most, held)
            last = latest(histories, most).select("place", "capture_id", F.col("at.batch_seq").alias("batch_seq"))
            since = last.join(histories, ["batch_seq", "capture_id"]).orderBy(F.desc("place")).collect()
            recent = OrderedDict(held)
            for row in since:
                used(recent, row["capture_id"], most)
                recent[row["capture_id"]] = row[SINCE]
            kept = [(place, capture, begin, batch_id) for place, (capture, begin) in enumerate(recent.items())]
            spark.createDataFrame(kept, HELD).coalesce(1).write.mode("overwrite").parquet(f"{held_path}/{batch_id % 2}")
        finally:
            rows.unpersist()

    return write


def _written(spark, folder):
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
