"""Exact deduplication by content-defined chunk recipes.

White space is deleted, the text is cut where a rolling hash of the last 32 bytes says so, and a document becomes the
ordered list of its chunks' identifiers. Only digests travel, each chunk's once per task; equal identifier lists are
equal texts.

Defined cases: a null text counts as empty; empty texts are equal to each other; a text of any length is one row of
chunks; repeated rows count in the size of their group, and all rows with the identifier that stays are kept; a null
identifier is larger than every other; an empty table gives no rows; other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .store import kept, narrow

#: These characters do not count when texts are compared.
IGNORED = dict.fromkeys([0x20, *range(0x09, 0x0E)])
#: A cut wherever the rolling hash ends in this many zero bits, but no chunk outside these lengths.
CUT_BITS, SHORTEST, LONGEST = 12, 512, 16_384
#: Chunks a task remembers having sent; beyond that it sends a digest again, which changes nothing.
REMEMBERED = 200_000
_GEAR = np.random.default_rng(8).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data):
    """Ends of the chunks of some bytes; a cut depends on the 32 bytes before it and on the cut before."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    rolling = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        rolling[width:] += rolling[:-width] << np.uint32(width)
    marks = np.flatnonzero((rolling >> np.uint32(32 - CUT_BITS)) == 0) + 1
    ends, last, i = [], 0, 0
    while n - last > SHORTEST:
        i = np.searchsorted(marks, last + SHORTEST, "left")
        end = min(int(marks[i]) if i < len(marks) else n, last + LONGEST, n)
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def chunks(text):
    data = (text or "").translate(IGNORED).encode()
    start = 0
    for end in cut_points(data):
        yield data[start:end]
        start = end


RECIPE = "doc_id long, n_points long, text_sha256 string, keys array<long>, digests array<binary>"


def _recipes(batches):
    """Per document the chunks' 64-bit keys and, once per task, the SHA-256 digest behind each key."""
    told = set()
    for batch in batches:
        n_points, hashes, all_keys, all_digests = [], [], [], []
        for text in batch.column("text").to_pylist():
            whole, keys, digests = hashlib.sha256(), [], []
            for chunk in chunks(text):
                whole.update(chunk)
                pair = xxhash.xxh3_64_intdigest(chunk) - (1 << 63), hashlib.sha256(chunk).digest()
                keys.append(pair[0])
                digests.append(None if pair in told else pair[1])
                if len(told) < REMEMBERED:
                    told.add(pair)
            n_points.append(len(text or ""))
            hashes.append(whole.hexdigest())
            all_keys.append(keys)
            all_digests.append(digests)
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "n_points": pa.array(n_points, pa.int64()),
            "text_sha256": pa.array(hashes, pa.string()), "keys": pa.array(all_keys, pa.list_(pa.int64())),
            "digests": pa.array(all_digests, pa.list_(pa.binary())),
        })


def chunk_recipes(docs, id_col="doc_id", text_col="text"):
    return narrow(docs, doc_id=id_col, text=text_col).mapInArrow(_recipes, RECIPE)


def doubtful_keys(recipes):
    """Chunk keys behind which there is more than one SHA-256 digest: normally none."""
    pairs = recipes.select(F.explode(F.arrays_zip("keys", "digests")).alias("c")).where("c.digests is not null")
    return (
        pairs.select(F.col("c.keys").alias("key"), F.col("c.digests").alias("digest")).distinct()
        .groupBy("key").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("key")
    )


def exact_groups(docs, id_col="doc_id", text_col="text"):
    """Per document: the row of its group that stays, the group's size, and whether it is that row.

    The key of a group is the ordered list of chunk identifiers, as a digest of fixed size; a key that is not verified
    (two digests behind it) is replaced by the digest of the whole text for the documents that use it.
    """
    recipes = kept(chunk_recipes(docs, id_col, text_col), "recipes")
    doubtful = kept(doubtful_keys(recipes), "doubtful")
    rows = recipes.withColumn("identity", F.sha2(F.array_join(F.transform("keys", lambda k: k.cast("string")), ","), 256))
    if not doubtful.isEmpty():
        users = recipes.select("text_sha256", F.explode("keys").alias("key")).join(doubtful, "key", "left_semi").select(
            F.col("text_sha256").alias("unverified")).distinct()
        rows = rows.join(users, F.col("text_sha256") == F.col("unverified"), "left").withColumn(
            "identity", F.coalesce("unverified", "identity"))
    rows = rows.select("doc_id", "n_points", "text_sha256", "identity")
    first = F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"))
    groups = rows.groupBy("identity").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("group_size"))
    several = kept(groups.where("group_size > 1").select(F.col("identity").alias("of"), "best", "group_size"), "copies")
    joined = rows.join(several, F.col("identity") == F.col("of"), "left")
    keep_id = F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return joined.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256",
    )


SQL = """
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM normal
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""
