"""Removal of repeated byte strings by suffix sorting with bucket pointers.

A byte goes if it lies in a string of `LENGTH` bytes that also starts anywhere else, in the same text or another.

1. Anchors. Of the `GRAM`-byte grams of a string of LENGTH bytes the one with the least hash (the last of equals) is its
   anchor, so equal strings have equal anchors at equal places. Neighbouring strings with one anchor form a segment,
   which is known by the anchor's and its own content's digest; only these numbers travel.
2. Anchors are the first buckets. One of a single member is done; one whose members all have the same content is equal
   to full depth and needs no refinement; of the others one member of each content is refined.
3. Those members are sorted: buckets of equal 8-grams are refined by the bucket numbers at later offsets, level by level,
   to depth LENGTH. Starts that share a last bucket are repeats.
   Depths are kept equal within a level, because a start that differs only beyond LENGTH bytes must not leave its bucket.
   An anchor with very many different surroundings is counted string by string instead, without bringing it together.
4. Spans are united per document; only documents that lose a part are read again for their digest.

Defined cases: a null text has no bytes; texts below LENGTH bytes lose nothing; strings may overlap their copy; all copies
go, the first one too; repeated rows are copies of each other; the digest of no bytes is that of the empty string; an
empty table gives no rows; other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .store import kept, narrow, utf8

LENGTH, GRAM = 400, 64
#: Surroundings of an anchor beyond which its strings are counted one by one; bytes that are sorted together.
MANY, TOGETHER = 2000, 2 << 20
#: A content with more than one in SHARES of all places is looked up without a shuffle; there are fewer than SHARES of them.
SHARES = 1000
#: Bytes that are hashed together; the place of a gram in them fits into PLACE bits of a key.
PLACE = 20
BUFFER = 1 << (PLACE - 1)
_RNG = np.random.default_rng(2)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << PLACE) - 1)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _rolling(codes, width):
    """Hashes of all runs of `width` (a power of two) bytes."""
    h, done, factor = _BYTE[codes], 1, 0xD6E8FEB86659FD93
    while done < width:
        h = h[:-done] * np.uint64(factor) + h[done:]
        factor = factor * factor % (1 << 64)
        done *= 2
    return h


def _sliding_least(keys, width):
    """Least key of every run of `width` keys."""
    least, done = keys, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    return np.minimum(least[:len(keys) - width + 1], least[width - done:])


def segments(pieces):
    """For byte strings that are hashed together: (piece, anchor, first, last) of each run of strings with one anchor.

    All numbers but the piece's are places in the concatenation; a string starts at first .. last.
    """
    codes = np.frombuffer(b"".join(pieces), np.uint8)
    if len(codes) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    h = _rolling(codes, GRAM)
    h ^= h >> np.uint64(32)
    h *= _ODD
    keys = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    anchor = (_LOW - (_sliding_least(keys, LENGTH - GRAM + 1) & _LOW)).astype(np.int64)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    whole = np.zeros(len(anchor), bool)
    for begin, end in zip((ends - sizes).tolist(), ends.tolist()):
        whole[begin:max(begin, end - LENGTH + 1)] = True
    at = np.flatnonzero(whole)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    cut = np.flatnonzero((np.diff(anchor[at]) != 0) | (np.diff(at) != 1))
    first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
    return np.searchsorted(ends, first, "right"), anchor[first], first, last


def _pack(first, last, anchor):
    return (first << 20) | ((last - first) << 10) | (anchor - first)


def _unpack(at):
    first = at >> 20
    return first, first + ((at >> 10) & 1023), first + (at & 1023)


def _anchors(batches):
    for batch in batches:
        rows, keys, contents, places = [], [], [], []

        def put(pieces, owners):
            data = b"".join(p for p in pieces)
            begins = np.cumsum([0, *map(len, pieces)])
            for k, a, f, e in zip(*(x.tolist() for x in segments(pieces))):
                row, offset = owners[k]
                shift = offset - int(begins[k])
                rows.append(row)
                keys.append(_signed(xxhash.xxh3_64_intdigest(data[a:a + GRAM])))
                contents.append(_signed(xxhash.xxh3_64_intdigest(data[f:e + LENGTH])))
                places.append(_pack(f + shift, e + shift, a + shift))

        pieces, owners, size = [], [], 0
        for row, data in enumerate(batch.column("data")):
            data = data.as_py() or b""
            for offset in range(0, len(data) - LENGTH + 1, BUFFER // 2):
                piece = data[offset:offset + BUFFER // 2 + LENGTH - 1]
                if size + len(piece) > BUFFER:
                    put(pieces, owners)
                    pieces, owners, size = [], [], 0
                pieces.append(piece)
                owners.append((row, offset))
                size += len(piece)
        put(pieces, owners)
        take = pa.array(rows, pa.int64())
        yield pa.record_batch({
            "anchor": pa.array(keys, pa.int64()), "content": pa.array(contents, pa.int64()),
            "doc_id": batch.column("doc_id").take(take), "text_hash": batch.column("text_hash").take(take),
            "place": pa.array(places, pa.int64()),
        })


def repeated_starts(data, starts):
    """Which of the starts have a string of LENGTH bytes that another of them has, too.

    Every start's string must lie in one segment of the data.
    """
    codes = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
    for width in (1, 2, 4):
        codes = (codes[:-width] << np.uint64(8 * width)) | codes[width:]
    bucket = np.zeros(len(data) + LENGTH, np.int64)
    active, fresh = np.arange(len(data)), 1

    def refine(active, keys):
        """Number the buckets anew; return the starts that still share one."""
        nonlocal fresh
        order = np.argsort(keys, kind="stable")
        change = np.append(True, keys[order[1:]] != keys[order[:-1]])
        number = np.cumsum(change) - 1
        bucket[active[order]] = number + fresh
        fresh += len(order)
        shared = np.bincount(number)[number] > 1
        return np.sort(active[order[shared]])

    active = refine(active, codes[:len(data)])
    depth = 8
    while depth * 2 <= LENGTH and len(active):
        active = refine(active, (bucket[active] << 32) | bucket[active + depth])
        depth *= 2
    last = np.intersect1d(active, starts)
    if len(last) and depth < LENGTH:
        last = refine(last, (bucket[last] << 32) | bucket[last + LENGTH - depth])
    return last


def _sorted_together(rows):
    """Spans of repeated strings in the segments of some anchors."""
    data = b"".join(r["data"] for r in rows)
    begins = np.cumsum([0, *(len(r["data"]) for r in rows)])
    counts = [len(r["data"]) - LENGTH + 1 for r in rows]
    starts = np.concatenate([b + np.arange(c) for b, c in zip(begins.tolist(), counts)])
    found = repeated_starts(data, starts)
    if not len(found):
        return
    cut = np.flatnonzero(np.diff(found) != 1)
    for first, last in zip(found[np.append(0, cut + 1)].tolist(), found[np.append(cut, len(found) - 1)].tolist()):
        k = int(np.searchsorted(begins, first, "right")) - 1  # starts of two segments are never neighbours
        if rows[k]["alone"]:
            shift = (rows[k]["place"] >> 20) - int(begins[k])
            yield rows[k]["doc_id"], rows[k]["text_hash"], first + shift, last + shift + LENGTH


SPANS = "doc_id long, text_hash long, start long, end long"
_SPAN_TYPES = {"doc_id": pa.int64(), "text_hash": pa.int64(), "start": pa.int64(), "end": pa.int64()}


def _span_batch(spans):
    columns = list(zip(*spans)) or [[]] * 4
    return pa.record_batch({n: pa.array(c, t) for (n, t), c in zip(_SPAN_TYPES.items(), columns)})


def _sort_segments(batches):
    """Rows come sorted by anchor; whole anchors are sorted together up to TOGETHER bytes."""
    rows, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if size > TOGETHER and row["anchor"] != rows[-1]["anchor"]:
                yield _span_batch(list(_sorted_together(rows)))
                rows, size = [], 0
            rows.append(row)
            size += len(row["data"])
    if rows:
        yield _span_batch(list(_sorted_together(rows)))


SEGMENTS = "anchor long, doc_id long, text_hash long, place long, alone boolean, many boolean, data binary"
_SEGMENT_TYPES = (pa.int64(),) * 4 + (pa.bool_(),) * 2 + (pa.binary(),)


def _cut_segments(batches):
    def out(rows):
        columns, names = list(zip(*rows)) or [[]] * 7, [n.split()[0] for n in SEGMENTS.split(", ")]
        return pa.record_batch({n: pa.array(c, t) for n, c, t in zip(names, columns, _SEGMENT_TYPES)})

    for batch in batches:
        rows = []
        for doc_id, text_hash, data, found in zip(*(batch.column(n) for n in ("doc_id", "text_hash", "data", "found"))):
            doc_id, text_hash, data = doc_id.as_py(), text_hash.as_py(), data.as_py()
            for s in found.as_py():
                first, last, _ = _unpack(s["place"])
                rows.append((s["anchor"], doc_id, text_hash, s["place"], s["alone"], s["many"], data[first:last + LENGTH]))
                if len(rows) == 5000:
                    yield out(rows)
                    rows = []
        yield out(rows)


def _cut_strings(batches):
    """A row per string of a segment, known by 128 bits."""
    for batch in batches:
        out = {n: [] for n in ("high", "low", "doc_id", "text_hash", "start", "alone")}
        for row in batch.to_pylist():
            first, data = row["place"] >> 20, row["data"]
            for k in range(len(data) - LENGTH + 1):
                digest = xxhash.xxh3_128_intdigest(data[k:k + LENGTH])
                for name, value in zip(out, (_signed(digest >> 64), _signed(digest & (1 << 64) - 1), row["doc_id"], row["text_hash"], first + k, row["alone"])):
                    out[name].append(value)
        types = (pa.int64(),) * 5 + (pa.bool_(),)
        yield pa.record_batch({n: pa.array(v, t) for (n, v), t in zip(out.items(), types)})


def _of(table, prefix):
    return table.withColumnRenamed("doc_id", f"{prefix}_id").withColumnRenamed("text_hash", f"{prefix}_hash")


def _same(prefix):
    return F.col("doc_id").eqNullSafe(F.col(f"{prefix}_id")) & (F.col("text_hash") == F.col(f"{prefix}_hash"))


def copied_places(places, contents):
    """Places (rows of anchor, content and others) whose content has n > 1 in the table of contents; much repeated ones stay in their tasks."""
    copied = contents.where("n > 1").select(F.col("anchor").alias("a"), F.col("content").alias("c"), "n")
    most = (contents.agg(F.sum("n")).first()[0] or 0) // SHARES
    often, seldom = F.broadcast(copied.where(F.col("n") > most).drop("n")), copied.where(F.col("n") <= most).drop("n")
    same = (F.col("anchor") == F.col("a")) & (F.col("content") == F.col("c"))
    rest = places.join(often, same, "left_anti").join(seldom, same)
    return places.join(often, same).unionByName(rest).drop("a", "c")


def repeated_spans(texts):
    """Spans (they may overlap) of repeated strings in rows of doc_id, text_hash, data."""
    found = kept(texts.where(F.octet_length("data") >= LENGTH).mapInArrow(
        _anchors, "anchor long, content long, doc_id long, text_hash long, place long"), "anchors")
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("one"), F.max("content").alias("other"))
    again = kept(anchors.where("n > 1").select(F.col("anchor").alias("of"), (F.col("one") != F.col("other")).alias("mixed")), "again")
    rows = kept(found.join(again, F.col("anchor") == F.col("of")).drop("of"), "recurring")

    mixed = rows.where("mixed")
    contents = mixed.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "doc_id", "text_hash")).alias("w"))
    contents = kept(contents, "contents")
    whole = rows.where("not mixed").select("doc_id", "text_hash", "place").unionByName(
        copied_places(mixed, contents).select("doc_id", "text_hash", "place"))
    start = F.shiftright("place", 20)
    ready = whole.select("doc_id", "text_hash", start.alias("start"), (
        start + F.shiftright("place", 10).bitwiseAND(F.lit(1023)) + LENGTH).alias("end"))

    kinds = contents.groupBy("anchor").agg((F.count(F.lit(1)) > MANY).alias("many"))
    kinds = kept(kinds.where("many").select(F.col("anchor").alias("a"), "many"), "many")
    sought = contents.join(kinds, F.col("anchor") == F.col("a"), "left").select(
        "w.doc_id", "w.text_hash", F.struct("anchor", "w.place", (F.col("n") == 1).alias("alone"), F.coalesce("many", F.lit(False)).alias("many")).alias("s"))
    by_text = sought.groupBy("doc_id", "text_hash").agg(F.collect_list("s").alias("found"))
    cut = texts.join(_of(by_text, "of"), _same("of")).select("doc_id", "text_hash", "data", "found").mapInArrow(_cut_segments, SEGMENTS)
    cut = kept(cut, "segments")
    few = cut.where("not many").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_segments, SPANS)
    spans = ready.unionByName(few)
    if not kinds.isEmpty():
        strings = kept(cut.where("many").mapInArrow(
            _cut_strings, "high long, low long, doc_id long, text_hash long, start long, alone boolean"), "strings")
        twice = strings.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
            F.col("high").alias("h"), F.col("low").alias("l"))
        more = strings.where("alone").join(twice, (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")))
        spans = spans.unionByName(more.select("doc_id", "text_hash", "start", (F.col("start") + LENGTH).alias("end")))
    return spans


def united(spans):
    """Overlapping and touching spans as one, in order."""
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return out


def _unite(batches):
    for batch in batches:
        all_spans = [united((s["start"], s["end"]) for s in spans) for spans in batch.column("spans").to_pylist()]
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
            "n_removed": pa.array([sum(e - s for s, e in spans) for spans in all_spans], pa.int64()),
            "spans": pa.array(all_spans, pa.list_(pa.list_(pa.int64()))),
        })


def kept_bytes(data, spans):
    at, parts = 0, []
    for start, end in spans:
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]])


def _digests(batches):
    for batch in batches:
        found = [hashlib.sha256(kept_bytes(d.as_py(), s.as_py())).hexdigest() for d, s in zip(batch.column("data"), batch.column("spans"))]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "digest": pa.array(found)})


def _texts(docs, id_col, text_col):
    return narrow(docs, doc_id=id_col, text=text_col).select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), utf8(F.col("text")).alias("data"))


def removed_spans(docs, id_col="doc_id", text_col="text"):
    """Per document that loses something: doc_id, text_hash, n_removed and the maximal removed runs [start, end)."""
    spans = repeated_spans(_texts(docs, id_col, text_col)).groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))
    return spans.mapInArrow(_unite, "doc_id long, text_hash long, n_removed long, spans array<array<long>>")


def removal_report(docs, id_col="doc_id", text_col="text"):
    """Per document: bytes, removed bytes, removed runs, and the SHA-256 digest of the bytes that are left."""
    texts = _texts(docs, id_col, text_col)
    spans = kept(removed_spans(docs, id_col, text_col), "spans")
    base = kept(texts.select("doc_id", "text_hash", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("whole")), "base")
    joined = kept(base.join(_of(spans, "of"), _same("of"), "left").select(
        "doc_id", "text_hash", "n_bytes", "whole", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), "spans"), "joined")
    partly = joined.where("n_removed > 0 and n_removed < n_bytes").select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"])
    digests = texts.join(_of(partly, "of"), _same("of")).select("doc_id", "text_hash", "data", "spans").mapInArrow(
        _digests, "doc_id long, text_hash long, digest string").distinct()
    left = F.when(F.col("n_removed") == 0, F.col("whole")).when(
        F.col("n_removed") == F.col("n_bytes"), F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("digest"))
    return joined.join(_of(digests, "of"), _same("of"), "left").select(
        "doc_id", "n_bytes", "n_removed", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), left.alias("kept_sha256"))


SQL = """
WITH texts AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), strings AS (
  SELECT doc_id, k, hash(array_slice(b, k + 1, k + 400)) AS d
  FROM (SELECT doc_id, b, unnest(range(0, n - 399)) AS k FROM texts WHERE n >= 400)
), repeated AS (
  SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before
  FROM (SELECT doc_id, k FROM strings QUALIFY count(*) OVER (PARTITION BY d) > 1)
), runs AS (
  SELECT doc_id, k, sum(CASE WHEN before IS NULL OR k > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM repeated
), spans AS (
  SELECT doc_id, min(k) AS s, max(k) + 400 AS e FROM runs GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS done FROM spans
), cut AS (
  SELECT p.doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * done + 1, 2 * (s - done)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept
  FROM pieces p JOIN texts t ON t.doc_id = p.doc_id GROUP BY p.doc_id
)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM texts t LEFT JOIN cut c ON c.doc_id = t.doc_id
"""
