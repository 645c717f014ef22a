"""A corpus from raw documents in five stages: quality, near duplicates, benchmark passages, mixing, shards.

Every stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next
one's documents. All but the last return the columns they were given. Of a group of near duplicates one row stays, whatever
its identifier; in the mix, rows that agree in identifier, source and size share their copies. Nulls, empty texts and other columns pass as the operators' modules define; an empty table stays
empty.
"""

from pyspark.sql import functions as F

from leakgauge.llm import contamination, mixing, quality, shards, similar
from leakgauge.llm.store import kept, table, words_in

SHARDS = 8


def good_documents(spark, docs, sf_dir):
    """Documents whose quality score reaches the threshold."""
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.scorer(model)(F.col("text")) >= quality.THRESHOLD)


def distinct_documents(spark, docs, sf_dir):
    """One row of each group of near duplicates (SimHash over five-word shingles, 0.8), that of the smallest identifier."""
    return similar.first_of_groups(docs)


def clean_documents(spark, docs, sf_dir):
    """Documents without a passage of the benchmark."""
    return contamination.without_passages(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark, docs, sf_dir):
    """Each document as often as the mix takes it; a copy that the budget cuts counts if half of it is taken."""
    queued = mixing.queued_documents(docs)
    times = F.size(F.filter("copies", lambda c: (c.words * 2 >= F.col("size")) & ((c.words > 0) | (c.turn == 0))))
    by_id = queued.groupBy(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size")).agg(
        F.ceil(F.sum(times) / F.count(F.lit(1))).cast("int").alias("mix_times")).where("mix_times > 0")
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("given"))  # no name of theirs meets ours
    same = F.col("given.doc_id").eqNullSafe(F.col("mix_id")) & F.col("given.source").eqNullSafe(F.col("mix_source"))
    joined = given.join(by_id, same & (words_in(F.col("given.text")) == F.col("mix_size")))
    return joined.withColumn("mix_turn", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select("given.*")


def sharded_documents(spark, docs, sf_dir):
    """All documents with their shard, and the shard they would have if one more were appended."""
    return shards.with_shards(docs, SHARDS)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("mixing", mixed_documents),
    ("sharding", sharded_documents),
]

#: No stage but the last two can be written in SQL; tests hold the whole against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
