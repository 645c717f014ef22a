"""Connected components of a link table by alternating large and small stars."""

from pyspark.sql import functions as F

from .store import kept


def _stars(edges, large):
    """Link every node's larger neighbours (or its smaller ones and itself) to the smallest of it and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.where("b < a")
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    joined = around.join(least, F.col("a") == F.col("node"))
    linked = joined.where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        linked = linked.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return linked.distinct()


def component_of(edges):
    """(node, component): the smallest node that can be reached, for every node with a link.

    Each round is written to the shared folder, so that neither the plan nor what a lost executor costs grows with the
    number of rounds; a round's rows never exceed the links plus the nodes. A hot node's stars are summed before the
    shuffle and its joins may be split.
    """
    current = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        current = kept(_stars(_stars(current, large=True), large=False), "links")
        state = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state
