"""Mixing sources to target weights by weighted fair queueing (native expressions only).

Every source is a queue of shuffled documents. A document's virtual finish time is the number of words of its source up
to and with it, divided by the source's target; the copies of all sources form one queue, sorted over the whole table by
that time, which is cut where the total budget is used up. A source whose target exceeds its size starts over, at most
`REPEATS` times in all.

Defined cases: a null text has size 0; null is a source of its own and comes last; a document of size 0 takes nothing;
repeated rows are served one by one, and rows alike in identifier, text and source are interchangeable; a very long text
is a number here and is served in two pieces if need be; an empty table gives an empty mix; other columns are ignored.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .running import ROWS_PER_BUCKET, bucketed, with_total_before
from .store import kept, narrow, words_in

#: Weights by the rank of a source, repeating, and how often a source may be used up.
WEIGHTS = (5, 2, 1)
REPEATS = 3


def source_targets(sizes, weights=WEIGHTS, repeats=REPEATS):
    """One row per source with its size, weight and target.

    Weights share all words; a target above `repeats` times its source's size stops there and the excess is shared
    again by weight. With the sources in ascending order of cap over weight those that stop are a prefix, so one
    running sum over the sources settles all rounds of sharing. The table has one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn(
        "place", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    )
    weight = reduce(lambda rest, i: F.when(F.col("place") == i, weights[i]).otherwise(rest), range(len(weights)), F.lit(0))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    queued = (
        ranked.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("shares", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("stops", F.col("cap").cast("double") * F.col("shares") <= F.col("left").cast("double") * F.col("weight"))
    )
    capped = lambda name: F.coalesce(F.sum(F.when(F.col("stops"), F.col(name))).over(everything), F.lit(0))
    open_words = F.sum("source_size").over(everything) - capped("cap")
    open_weight = F.sum("weight").over(everything) - capped("weight")
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(
        open_words.cast("double") * F.col("weight") / open_weight
    )
    return queued.select("source", "source_size", "weight", target.alias("target"))


def with_places(docs, id_col="doc_id", text_col="text", source_col="source", budget=None):
    """One row per document: its place in its source's queue, the source's target and quota and the total budget."""
    raw = narrow(docs, doc_id=id_col, text=text_col, source=source_col)
    draw = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.md5(F.coalesce("text", F.lit("")))))
    sizes = kept(raw.select("doc_id", "source", words_in(F.col("text")).alias("size"), draw.alias("draw")), "sizes")
    everything = Window.partitionBy()
    targets = source_targets(sizes).withColumn("total", F.sum("source_size").over(everything))
    if budget is None:
        targets = targets.withColumn("until", F.lit(1.0))
    else:
        targets = targets.withColumns({
            "until": F.least(F.lit(1.0), F.lit(float(budget)) / F.sum("target").over(everything)),
            "total": F.least("total", F.lit(int(budget))),
        })
    targets = targets.withColumn("quota", F.ceil(F.col("target") * F.col("until")).cast("long")).withColumnRenamed("source", "of")
    rows = sizes.count()
    placed = with_total_before(bucketed(sizes, "draw", rows), ["source"], ["draw", "doc_id", "size"], "size", "start")
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of", "bucket")
    return kept(joined, "places"), rows


def served(places, rows):
    """The mix: the copies of all sources in order of virtual finish time, cut where the total budget is used up.

    A copy that is not finished when its source has had its quota is served in two pieces, of which the first finishes at
    that moment; so all pieces of the queue hold at least the budget, and a long document holds up no other source. Each
    source finishes its shuffled documents evenly over virtual time, hence ranges of equal width are ranges of about
    equal rows: the queue is partitioned into them, sorted within each, and totals of earlier ranges come from a table with
    a row per range. What rounding quotas up has added, less than a word a source, is cut from the end of the queue.
    """
    queue = places.where((F.col("size") > 0) & (F.col("start") < F.col("quota")))
    last_turn = F.floor((F.col("quota") - F.col("start") - 1) / F.col("source_size"))
    queue = queue.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), last_turn)))
    queue = queue.withColumn("begin", F.col("start") + F.col("turn") * F.col("source_size"))
    end = F.col("begin") + F.col("size")
    finish = F.when(end >= F.col("quota"), F.col("until")).otherwise(F.least(F.col("until"), end / F.col("target")))
    ranges = max(1, min(1 << 20, rows // ROWS_PER_BUCKET))
    queue = queue.withColumns({
        "piece": F.least(F.col("size"), F.col("quota") - F.col("begin")),
        "virtual_start": F.col("begin") / F.col("target"),
        "virtual_finish": finish,
    }).withColumn("bucket", F.floor(F.col("virtual_finish") / F.col("until") * ranges).cast("long"))
    order = ["virtual_finish", F.col("source").asc_nulls_last(), "draw", "doc_id", "size", "turn"]
    sorted_queue = with_total_before(queue, [], order, "piece", "before")
    words = F.greatest(F.lit(0).cast("long"), F.least(F.col("piece"), F.col("total") - F.col("before")))
    return sorted_queue.withColumn("words", words)


def queued_documents(docs, budget=None, **columns):
    """One row per document with its copies in the mix: turn, virtual start and finish, and the words the mix takes.

    A document that the mix does not reach has no copies; one of size 0 has one of no words.
    """
    places, rows = with_places(docs, budget=budget, **columns)
    copy = lambda turn, start, finish, words: F.struct(
        turn.cast("long").alias("turn"), start.cast("double").alias("virtual_start"),
        finish.cast("double").alias("virtual_finish"), words.cast("long").alias("words"))
    of_document = ["doc_id", "source", "size", "source_size", "weight", "target"]
    # start tells apart the documents of a source that have words
    reached = served(places, rows).groupBy(*of_document, "start").agg(F.array_sort(F.collect_list(
        copy(*(F.col(c) for c in ("turn", "virtual_start", "virtual_finish", "words"))))).alias("copies")).drop("start")
    none = F.lit(None)
    empty = F.array(copy(F.lit(0), none, none, F.lit(0)))
    others = places.where((F.col("size") == 0) | (F.col("start") >= F.col("quota"))).select(
        *of_document, F.when(F.col("size") == 0, empty).otherwise(F.slice(empty, 1, 0)).alias("copies"))
    return reached.unionByName(others)


def mixed(docs, budget=None, **columns):
    """The mix itself: a row per copy that is taken, globally sorted by virtual finish time."""
    copies = served(*with_places(docs, budget=budget, **columns)).where("words > 0")
    return copies.select("doc_id", "source", "size", "turn", "virtual_start", "virtual_finish", "words").orderBy(
        "virtual_finish", F.col("source").asc_nulls_last(), "doc_id", "turn")


def taken_words(docs, **columns):
    """Per document: the words the mix takes of it, repeats counted."""
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c.words)
    return queued_documents(docs, **columns).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


SQL = """
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))) AS draw
  FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sizes GROUP BY source
), queued AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0) AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS shares
  FROM by_source
  WINDOW earlier AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), settled AS (
  SELECT *, (3 * source_size)::DOUBLE * shares <= words_left::DOUBLE * weight AS stops FROM queued
), targets AS (
  SELECT source, source_size,
         CASE WHEN stops THEN (3 * source_size)::DOUBLE
              ELSE (sum(source_size) OVER () - coalesce(sum(CASE WHEN stops THEN 3 * source_size END) OVER (), 0))::DOUBLE
                   * weight / (sum(weight) OVER () - coalesce(sum(CASE WHEN stops THEN weight END) OVER (), 0))::DOUBLE
         END AS target
  FROM settled
), placed AS (
  SELECT s.*, source_size, target, ceil(target)::BIGINT AS quota, row_number() OVER () AS place,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY draw, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), queue AS (
  SELECT *, start + turn * source_size AS begin, least(size, quota - start - turn * source_size) AS piece,
         CASE WHEN start + turn * source_size + size >= quota THEN 1.0::DOUBLE
              ELSE least(1.0::DOUBLE, (start + turn * source_size + size)::DOUBLE / target) END AS virtual_finish
  FROM placed, (VALUES (0), (1), (2)) AS turns(turn)
  WHERE size > 0 AND start + turn * source_size < quota
), sorted AS (
  SELECT place, piece, coalesce(sum(piece) OVER (ORDER BY virtual_finish, source NULLS LAST, draw, doc_id, size, turn
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM queue
), words AS (
  SELECT place, sum(greatest(0, least(piece, (SELECT sum(size) FROM sizes) - before))) AS taken FROM sorted GROUP BY place
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM placed LEFT JOIN words USING (place)
"""
