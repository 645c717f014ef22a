"""Near duplicates by SimHash: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

A text's fingerprint has `64 * WORDS` bits, each set in over half of its shingles' hashes (ties by a fixed draw). At a
similarity of 0.8 two fingerprints of 2,048 bits differ in 310 bits on average, at 0.65 in 430; pairs beyond `WITHIN` bits
are discarded, which loses 1 in 2,000 of the pairs at 0.8 and none well above it (`WITHIN_SMALL` for sets under `SMALL`
shingles, whose distances spread wider). Fingerprints are compared inside buckets: `BANDS` keys of `ROWS` minima each, so
that a pair of similarity s shares none with probability (1 - s**10)**64: 0.0007 at 0.8, 0.000002 at 0.85. What is left
counts only after the whole shingle sets were compared. Texts with equal sets are one node before that, and buckets with
the same nodes are one bucket.

A bucket is never compared whole at once: first its nodes are compared with one of them, then with another, and what
verified links have joined is left out from then on. The rest is compared where it meets, through pivot distance tables:
distances to `PIVOTS` fingerprints of the bucket itself; a pair whose coordinates differ by more than `WITHIN` somewhere
goes without a look at its bits, survivors are verified on their sets at once, and a task returns a spanning forest of its
links. Buckets over `TILE` rows or `TILE_SHINGLES` shingles are dealt as pairs of tiles. So no step returns more pairs than
it has rows, whatever the size of a group.

Defined cases: a null text counts as empty; texts without words are one node; fewer words than a shingle give one
shingle; case is folded for A-Z; very long texts are hashed in runs; repeated rows are documents of their own; a null
identifier joins its component without naming it; an empty table gives no rows; other columns are ignored.
"""

import functools
import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from .components import component_of
from .simhash import Forest
from .store import kept, send_package

SHINGLE, SIMILARITY, BANDS, ROWS, STARS = 5, 0.8, 64, 10, 2
WORDS, WITHIN, WITHIN_SMALL, SMALL, PIVOTS, TILE, TILE_SHINGLES = 32, 368, 448, 16, 8, 2048, 4_000_000
_RANDOM = np.random.default_rng(5)
_FACTOR = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_SHIFT = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_LANES = _RANDOM.integers(0, 1 << 64, WORDS, dtype=np.uint64)
_TIES = _RANDOM.random(64 * WORDS) < 0.5
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_word = functools.partial(xxhash.xxh64_intdigest, seed=7)


def _mixed(x):
    x = (x ^ x >> np.uint64(32)) * _MIX
    return (x ^ x >> np.uint64(29)) * _ODD


def shingle_set(text):
    """Sorted 64-bit hashes of the different shingles of a text."""
    words = np.fromiter(map(_word, (text or "").encode().lower().split()), np.uint64)
    length = min(SHINGLE, len(words))
    if not length:
        return words
    hashes = np.full(len(words) - length + 1, length, np.uint64)
    for i in range(length):
        hashes = _mixed(hashes + words[i:i + len(hashes)]) if i == 0 else _mixed(hashes * _ODD + words[i:i + len(hashes)])
    return np.unique(hashes)


def band_keys(shingles, run=4096):
    """The keys of a set that is not empty."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(high), run):
        least = np.minimum(least, (high[start:start + run] * _FACTOR + _SHIFT).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = _mixed(keys * _ODD + column)
    return keys


def fingerprint(shingles, run=256):
    """The fingerprint of a set as `WORDS` unsigned longs."""
    twice = _TIES - np.int64(len(shingles))
    for start in range(0, len(shingles), run):
        hashes = _mixed(shingles[start:start + run, None] ^ _LANES)
        twice += 2 * np.unpackbits(hashes.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(twice > 0).view(np.uint64)


@F.pandas_udf(StructType().add("mark", BinaryType()).add("size", LongType()).add("keys", ArrayType(LongType())))
def _signatures(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in texts]
    return pd.DataFrame({
        "mark": [hashlib.md5(s.tobytes()).digest() for s in sets], "size": [len(s) for s in sets],
        "keys": [band_keys(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets],
    })


@F.pandas_udf(StructType().add("bits", BinaryType()).add("shingles", ArrayType(LongType())))
def _sets(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in texts]
    return pd.DataFrame({
        "bits": [fingerprint(s).tobytes() for s in sets], "shingles": [s.view(np.int64) for s in sets],
    })


def _words(bits):
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), WORDS)


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.bitwise_count(_words(a) ^ _words(b)).sum(axis=1, dtype=np.int32))


def _limit(size, other):
    return F.when(F.least(size, other) < SMALL, WITHIN_SMALL).otherwise(WITHIN)


def _sizes_fit(size, other):
    """Sizes too far apart leave no room for the similarity."""
    return F.least(size, other) * 5 >= F.greatest(size, other) * 4


def _verified(pairs, sets):
    """Those of the pairs (a, b) whose whole sets are similar, written."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    return kept(pairs.join(left, "a").join(right, "b").where(common * 5 >= union * 4).select("a", "b"), "similar")  # SIMILARITY


def _placed(shared, linked):
    """Rows of the buckets whose nodes are not yet in one component, with their component."""
    rows = shared.join(linked, shared.node == linked.linked_node, "left").select(
        "key", "node", "size", "bits", F.coalesce("component", "node").alias("component"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return rows.join(mixed.select("key"), "key")


def _star(open_rows, turn):
    """Pairs of one node of each bucket with the others outside its component that its fingerprint is near to."""
    pivots = open_rows.groupBy("key").agg(F.min_by(F.struct("node", "size", "component", "bits"), F.xxhash64("node", F.lit(turn))).alias("p"))
    rows = open_rows.join(pivots, "key").where((F.col("component") != F.col("p.component")) & _sizes_fit(F.col("size"), F.col("p.size")))
    near = rows.where(_distance("bits", "p.bits") <= _limit(F.col("size"), F.col("p.size")))
    return near.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def near_pairs(rows, left, right):
    """Index pairs of a bucket's rows, one of `left` and one of `right`, in different components and near each other."""
    words, size = _words(list(rows["bits"])), rows["size"].to_numpy()
    component = rows["component"].to_numpy()
    apart = lambda i, j: np.bitwise_count(words[i] ^ words[j]).sum(axis=-1, dtype=np.int32)
    pivot, tables = 0, []
    for _ in range(PIVOTS):  # each pivot is the row farthest from those before it
        tables.append(apart(np.arange(len(words)), pivot))
        pivot = int(np.min(tables, axis=0).argmax())
    table = np.stack(tables, axis=1)
    for i in left:
        j = right[(component[right] != component[i]) & (np.minimum(size[right], size[i]) * 5 >= np.maximum(size[right], size[i]) * 4)]
        within = np.where(np.minimum(size[j], size[i]) < SMALL, WITHIN_SMALL, WITHIN)
        survives = np.abs(table[j] - table[i]).max(axis=1, initial=0) <= within
        j, within = j[survives], within[survives]
        yield i, j[apart(j, i) <= within]


def _tile_links(pdf):
    """Spanning links of a bucket's rows, one of each tile: near fingerprints in different components with similar sets."""
    side, node, sets = pdf["side"].to_numpy(), pdf["node"].tolist(), pdf["shingles"].tolist()
    forest, found = Forest(len(node)), []
    for _, same in pdf.groupby("component").indices.items():
        for i in same[1:]:
            forest.join(int(same[0]), int(i))
    for i, near in near_pairs(pdf, np.flatnonzero(side != 1), np.flatnonzero(side != 0)):
        for j in near.tolist():
            if forest.root(int(i)) != forest.root(j):
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common * 5 >= (len(sets[i]) + len(sets[j]) - common) * 4:  # SIMILARITY
                    forest.join(int(i), j)
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
    return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])


def _rest(open_rows, sets):
    """What links a bucket's nodes that are still in different components; every near pair of them is compared."""
    sizes = open_rows.groupBy("key").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("size") / TILE_SHINGLES, F.lit(1.0))).alias("tiles"))
    rows = open_rows.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
    dealt = rows.join(sets.select("node", "shingles"), "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "key", "node", "size", "component", "bits", "shingles", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
        F.when(F.col("tile") < F.col("other"), 0).when(F.col("tile") > F.col("other"), 1).otherwise(2).alias("side"))
    return kept(dealt.groupBy("key", "low", "high").applyInPandas(_tile_links, "a long, b long"), "similar")


def links(shared, sets):
    """Verified links (a, b) that join all nodes of the buckets `shared` (key, node, size, bits) that similarity joins."""
    found, tested = None, None
    linked = shared.sparkSession.createDataFrame([], "linked_node long, component long")
    for turn in range(STARS):
        pairs = _star(kept(_placed(shared, linked), "open"), turn)
        pairs = kept(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = _verified(pairs, sets)
        found = new if found is None else found.unionByName(new)
        linked = component_of(found).withColumnRenamed("node", "linked_node")
    rest = _rest(kept(_placed(shared, linked), "open"), sets)
    return rest if found is None else found.unionByName(rest)


def buckets_of(nodes):
    """(key, node) of the buckets with several nodes; of buckets with the same nodes one is left."""
    rows = nodes.select("node", F.explode("keys").alias("key"))
    several = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    several = kept(several.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "buckets")
    return kept(rows.join(several, "key"), "shared")


def grouped(docs, id_col="doc_id", text_col="text"):
    """The rows as given (`given`) with a number of their own (`row`), and (row, doc_id, component) without the texts."""
    send_package(docs.sparkSession)
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("given"))
    numbered = given.withColumn("row", F.monotonically_increasing_id())
    text = F.col("given")[text_col]
    marked = numbered.withColumn("s", _signatures(text)).select("row", "given", "s.*")
    marked = kept(marked.withColumn("doc_id", F.col("given")[id_col]), "signatures")  # written once, so numbers stay
    nodes = kept(marked.groupBy("mark", "size").agg(F.min("row").alias("node"), F.first("keys").alias("keys")), "nodes")
    shared = buckets_of(nodes)
    wanted = kept(nodes.join(shared.select("node").distinct(), "node").select("node", "size"), "wanted")
    texts = marked.select("row", "given").join(wanted, F.col("row") == F.col("node")).select("node", "size", _sets(text).alias("s"))
    sets = kept(texts.select("node", "size", "s.bits", "s.shingles"), "sets")
    linked = component_of(links(shared.join(sets.select("node", "size", "bits"), "node"), sets))
    named = nodes.join(linked, nodes.node == linked.node, "left").select(
        F.col("mark").alias("of"), F.coalesce("component", nodes.node).alias("component"))
    narrow = marked.select("row", "doc_id", "mark").join(named, F.col("mark") == F.col("of")).select("row", "doc_id", "component")
    return marked.select("row", "given"), kept(narrow, "grouped")


def similar_groups(docs, id_col="doc_id", text_col="text"):
    """Per document: the smallest identifier of its component."""
    _, rows = grouped(docs, id_col, text_col)
    names = rows.groupBy(F.col("component").alias("of")).agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, F.col("component") == F.col("of")).select("doc_id", "component_id")


def row_bits(rows, name):
    """(word, bits): the row numbers `name` as bits of words of 64, a sixty-fourth of their rows.

    A join with them is on the word. It moves no text as long as the optimiser takes this table for small, and is exact
    above that too.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(name).bitwiseAND(F.lit(63)).cast("int"))
    return rows.groupBy(F.shiftright(name, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def first_of_groups(docs, id_col="doc_id", text_col="text"):
    """One row of each component, as given: the smallest identifier, null last, and of several such rows one."""
    given, rows = grouped(docs, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = rows.groupBy("component").agg(F.min(order)["row"].alias("first"))
    bits = kept(row_bits(first, "first"), "first")
    stays = F.getbit("bits", F.col("row").bitwiseAND(F.lit(63)).cast("int")) == 1
    return given.join(bits, F.shiftright("row", 6) == F.col("word")).where(stays).select("given.*")
