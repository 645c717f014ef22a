"""Sharding by jump consistent hashing (native expressions only).

The shard of a document follows from its identifier and the number of shards alone, without a table of ring points.
When a shard is appended, only documents that move into it change their place.

Defined cases: a null text has one byte of size and the checksum of the empty string; a null identifier hashes like 0
and so has one shard; repeated identifiers share a shard; ties within a shard are numbered in arbitrary order among rows
that agree in everything; an empty table gives no rows; other columns are ignored.
"""

from pyspark.sql import functions as F

from .running import bucketed, with_total_before
from .store import kept, narrow, utf8

#: Fixed values of the published algorithm: multiplier of the generator, and the range of its high bits.
MULTIPLIER = 2862933555777941757
RANGE = 1 << 31
LOW = (1 << 32) - 1
#: Steps that are tried first; the number of steps is about the logarithm of the number of shards.
FIRST_STEPS = 40


def _next(high, low):
    """The generator's next state, key * MULTIPLIER + 1 modulo 2**64, in two halves of 32 bits. Sums of products of
    16-bit digits stay far below 2**63."""
    k = [low.bitwiseAND(F.lit(0xFFFF)), F.shiftright(low, 16), high.bitwiseAND(F.lit(0xFFFF)), F.shiftright(high, 16)]
    m = [F.lit(MULTIPLIER >> 16 * i & 0xFFFF).cast("long") for i in range(4)]
    c = [sum((k[i] * m[n - i] for i in range(1, n + 1)), k[0] * m[n]) for n in range(4)]
    low_sum = c[0] + 1 + F.shiftleft(c[1].bitwiseAND(F.lit(0xFFFF)), 16)
    high_sum = c[2] + F.shiftright(c[1], 16) + F.shiftleft(c[3].bitwiseAND(F.lit(0xFFFF)), 16) + F.shiftright(low_sum, 32)
    return F.struct(high_sum.bitwiseAND(F.lit(LOW)).alias("high"), low_sum.bitwiseAND(F.lit(LOW)).alias("low"))


def _let(value, use):
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def jump_shard(key, shards):
    """Shard number of a long key. Each step draws where the key would jump next as shards are appended."""
    def step(state, _):
        def moved(k):
            jump = F.floor((state.jump_to + 1) * (F.lit(float(RANGE)) / (F.shiftright(k.high, 1) + 1))).cast("long")
            return F.struct(k.alias("key"), state.jump_to.alias("shard"), jump.alias("jump_to"))

        return F.when(state.jump_to < shards, _let(_next(state.key.high, state.key.low), moved)).otherwise(state)

    def steps(start, count):
        return F.aggregate(F.sequence(F.lit(1), F.lit(count)), start, step)

    zero, whole = F.lit(0).cast("long"), F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    halves = F.struct(F.shiftrightunsigned(whole, 32).alias("high"), whole.bitwiseAND(F.lit(LOW)).alias("low"))
    start = F.struct(halves.alias("key"), F.lit(-1).cast("long").alias("shard"), zero.alias("jump_to"))
    first = steps(start, min(shards, FIRST_STEPS))
    if shards <= FIRST_STEPS:
        return first.shard.cast("int")
    return _let(first, lambda f: F.when(f.jump_to >= shards, f.shard).otherwise(steps(f, shards - FIRST_STEPS).shard)).cast("int")


def placed(docs, shards=8, id_col="doc_id", text_col="text"):
    """Per document: size, checksum, shard, the shard after one more is appended, and its gapless slot in the shard."""
    raw = narrow(docs, doc_id=id_col, text=text_col)
    rows = kept(raw.select(
        "doc_id", (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(utf8(F.col("text"))).alias("text_crc32"), jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("draw"), F.lit(1).cast("long").alias("one"),
    ), "placed")
    numbered = with_total_before(bucketed(rows, "draw", rows.count()), ["shard"], ["draw", "doc_id", "text_crc32", "size"], "one", "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )


def with_shards(docs, shards=8, id_col="doc_id"):
    """The rows of `docs` with the columns shard and grown_shard (columns of these names are replaced)."""
    key = F.col(f"`{id_col}`")
    return docs.withColumns({"shard": jump_shard(key, shards), "grown_shard": jump_shard(key, shards + 1)})


def write_shards(docs, path, shards=8, id_col="doc_id"):
    """Write whole rows into one folder per shard; a shard is split over many files."""
    number = jump_shard(F.col(f"`{id_col}`"), shards)
    docs.withColumn("shard_number", number).write.partitionBy("shard_number").parquet(path)


SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)
), checked AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
         xor(4294967295, list_reduce(
           list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM documents, crc_table
), jumps AS (
  SELECT DISTINCT shards, coalesce(doc_id, 0) AS id, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS key,
         -1::BIGINT AS shard, 0::BIGINT AS jump_to
  FROM documents, (SELECT unnest([8, 9]) AS shards)
  UNION ALL
  SELECT shards, id, next_key, jump_to, floor((jump_to + 1) * (2147483648.0::DOUBLE / ((next_key // 8589934592)::BIGINT + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (key % 4294967296 * 2862933555777941757 + (key // 4294967296 * 2862933555777941757) % 4294967296 * 4294967296 + 1)
                  % 18446744073709551616 AS next_key FROM jumps WHERE jump_to < shards)
), settled AS (
  SELECT id, max(shard) FILTER (shards = 8) AS shard, max(shard) FILTER (shards = 9) AS grown_shard FROM jumps GROUP BY id
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, text_crc32, size) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard
FROM checked JOIN settled ON coalesce(doc_id, 0) = id
"""
