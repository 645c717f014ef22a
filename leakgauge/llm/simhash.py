"""Near duplicates by 64-bit SimHash, linked through pivot distance tables.

A fingerprint's table holds its Hamming distances to `PIVOTS` reference fingerprints. By the triangle inequality two
fingerprints within distance r differ by at most r in every coordinate, so a pair is discarded by its largest
coordinate difference and only survivors are compared bit by bit.

Fingerprints are compared inside buckets of 32 equal bits: with two differing bits at most, two of four 16-bit blocks
agree, so the six pairs of blocks meet every link. Equal fingerprints are one row before that. A bucket returns a
spanning forest of its links, never all pairs, and a bucket of more than `TILE` rows is dealt out as pairs of tiles.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any other; fewer
words than a shingle give one shingle; repeated rows are documents of their own; a null identifier joins its component
without naming it; an empty table gives no rows; other columns are ignored.
"""

import functools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .components import component_of
from .store import kept, narrow

SHINGLE, SEED, RADIUS, TILE = 3, 42, 2, 4096
PIVOTS = np.random.default_rng(4).integers(0, 1 << 64, 24, dtype=np.uint64)
BLOCK_PAIRS = [(i, j) for i in range(4) for j in range(i)]
#: Hashes are taken and counted in runs of this many, so that a long text needs no more memory than a short one.
RUN = 65_536


def fingerprint(text):
    """Bits that are set in over half of the shingles' XXH64 hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    total, ones = 0, np.zeros(64, np.int64)
    for start in range(0, max(1, len(words) - SHINGLE + 1), RUN):
        part = words[start:start + RUN + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)))) if len(part) >= SHINGLE else [b" ".join(part)]
        hashes = np.fromiter(map(_xxh, shingles), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
        total += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


_xxh = functools.partial(xxhash.xxh64_intdigest, seed=SEED)


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    marks = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
    return pd.Series(marks.view(np.int64))


def fingerprints(docs, id_col="doc_id", text_col="text"):
    """(doc_id, mark): the fingerprint as a signed long."""
    return narrow(docs, doc_id=id_col, text=text_col).select("doc_id", _fingerprints("text").alias("mark"))


def pivot_table(marks):
    """Distances to the pivots, one row per fingerprint."""
    return np.bitwise_count(marks[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def close_pairs(a, b, radius=RADIUS, chunk=256):
    """Index pairs of fingerprints of a and b within the radius: by pivot coordinates first, by the bits last."""
    table_a, table_b = pivot_table(a), pivot_table(b)
    order = np.argsort(table_b[:, 0], kind="stable")
    first = table_b[order, 0]
    for start in range(0, len(a), chunk):
        ta = table_a[start:start + chunk]
        low = np.searchsorted(first, ta[:, 0] - radius, "left")
        high = np.searchsorted(first, ta[:, 0] + radius, "right")
        size = high - low
        i = np.repeat(np.arange(len(ta)), size)
        j = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
        for p in range(1, len(PIVOTS)):
            near = np.abs(ta[i, p] - table_b[j, p]) <= radius
            i, j = i[near], j[near]
        i = i + start
        near = np.bitwise_count(a[i] ^ b[j]) <= radius
        yield i[near], j[near]


class Forest:
    """Union of a task's rows; says which links join two parts."""

    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _bucket_links(pdf):
    marks = pdf["mark"].to_numpy(np.int64).view(np.uint64)
    left = np.flatnonzero(pdf["side"].to_numpy() != 1)
    right = np.flatnonzero(pdf["side"].to_numpy() != 0)
    forest, out = Forest(len(marks)), []
    for i, j in close_pairs(marks[left], marks[right]):
        out += [(x, y) for x, y in zip(left[i].tolist(), right[j].tolist()) if x != y and forest.join(x, y)]
    signed = pdf["mark"].to_numpy(np.int64)
    found = np.array(out, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": signed[found[:, 0]], "b": signed[found[:, 1]]})


def _small_buckets(batches):
    """Links of rows that come sorted by bucket; a bucket may go on in the next batch."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = (pdf["bucket"] == pdf["bucket"].iat[-1]) & (pdf["block"] == pdf["block"].iat[-1])
        rest = pdf[last]
        yield from _whole_buckets(pdf[~last])
    if rest is not None:
        yield from _whole_buckets(rest)


def _whole_buckets(pdf):
    if len(pdf):
        for _, group in pdf.groupby(["block", "bucket"], sort=False):
            yield _bucket_links(group.reset_index(drop=True))


def links(marks):
    """Spanning links (a, b) of the fingerprints in `marks` (distinct, column mark) within the radius."""
    part = lambda i: F.shiftrightunsigned(F.col("mark"), 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = F.array(*(F.struct(F.lit(k).alias("block"), (part(i) * 65536 + part(j)).alias("bucket")) for k, (i, j) in enumerate(BLOCK_PAIRS)))
    rows = marks.select("mark", F.explode(keys).alias("k")).select("mark", "k.block", "k.bucket")
    sizes = rows.groupBy("block", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = kept(sizes, "buckets")
    rows = rows.join(sizes, ["block", "bucket"])
    whole = rows.where(F.col("n") <= TILE).select("mark", "block", "bucket", F.lit(2).alias("side"))
    few = whole.repartition("block", "bucket").sortWithinPartitions("block", "bucket").mapInPandas(_small_buckets, "a long, b long")
    tiles = F.ceil(F.col("n") / TILE)
    large = rows.where(F.col("n") > TILE).withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("mark"), "tiles"))
    dealt = large.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "mark", "block", "bucket", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
        F.when(F.col("tile") < F.col("other"), 0).when(F.col("tile") > F.col("other"), 1).otherwise(2).alias("side"),
    )
    many = dealt.groupBy("block", "bucket", "low", "high").applyInPandas(_bucket_links, "a long, b long")
    return few.unionByName(many).distinct()


def near_groups(docs, id_col="doc_id", text_col="text"):
    """Per document: fingerprint and the smallest identifier of its component."""
    marked = kept(fingerprints(docs, id_col, text_col), "marks")
    marks = kept(marked.groupBy("mark").agg(F.min("doc_id").alias("least")), "distinct")
    linked = component_of(links(marks.select("mark")))
    named = marks.join(linked, marks.mark == linked.node, "left").select(
        "mark", "least", F.coalesce("component", "mark").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_mark = named.join(names, "component").select(F.col("mark").alias("of"), "component_id")
    fingerprint_hex = F.lower(F.lpad(F.hex("mark"), 16, "0"))
    return marked.join(by_mark, F.col("mark") == F.col("of")).select(
        "doc_id", fingerprint_hex.alias("fingerprint"), "component_id")
