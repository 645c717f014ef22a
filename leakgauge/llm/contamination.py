"""Benchmark decontamination by the q-gram lemma.

An occurrence is a region of a document within edit distance e of a benchmark item, both with letters folded and white
space runs as one space; e is a tenth of the item's characters. A letter is folded if its fold is one code point, in any
script. An item of m characters and its occurrence share at
least m - q + 1 - q e q-grams on at most e + 1 diagonals, so shared q-grams are counted in overlapping bands of diagonals,
bands that reach the bound are kept, and an alignment within the band decides.

Items of fewer than q characters have no q-gram and no edit to spend: they are searched exactly, by hashes of their own
length, where they stand as whole words. A letter or digit of a script that parts words by spaces (code points below
U+0E00) must not run on across either end; in other scripts any place counts.

Defined cases: null and empty texts and items match nothing, nor do items of white space; an item of less than 5 q
characters can have a smaller budget, so that its bound is at least one q-gram; equal items are found each; repeated documents are searched each; a text of any length is searched in overlapping pieces; empty tables give no
rows; other columns are ignored.
"""

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .store import narrow

Q, BUDGET = 8, 0.1
#: Characters of the benchmark that a task holds at a time; a larger benchmark is searched for part by part.
PART_CHARS = 2 << 20
#: Characters of a document that are searched at a time.
PIECE = 1 << 19
FILTER_BITS = 22
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.array([0x20, *range(0x09, 0x0E)], np.uint32)


#: Letters with two cases lie below the first; words are parted by spaces below the second.
_CASED, _SPACED = 0x1F000, 0x0E00


@lru_cache(1)
def _tables():
    """The folded code point of each code point, and which ones belong to words that spaces part."""
    folded = np.arange(_CASED, dtype=np.uint32)
    for code in range(_CASED):
        for fold in (chr(code).casefold(), chr(code).lower()):
            if len(fold) == 1:
                folded[code] = ord(fold)
                break
    return folded, np.array([chr(code).isalnum() for code in range(_SPACED)])


def normal(text):
    """Folded code points, runs of white space as one space, and their places."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    cased = codes < _CASED
    codes[cased] = _tables()[0][codes[cased]]
    blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    codes[blank] = 0x20
    stay = ~blank
    stay[1:] |= ~blank[:-1]
    places = np.flatnonzero(stay)
    codes = codes[places]
    edge = slice(int(len(codes) > 0 and codes[0] == 0x20), len(codes) - int(len(codes) > 1 and codes[-1] == 0x20))
    return codes[edge], places[edge]


def short_grams(codes, width):
    """Hashes of all strings of `width` characters, fewer than q: their code points in 64 bits, exact up to three of them."""
    h = np.zeros(max(0, len(codes) - width + 1), np.uint64)
    for k in range(width):
        h = h * np.uint64(0x110001) + codes[k:len(h) + k].astype(np.uint64) + np.uint64(1)
    return h


def grams(codes):
    """Hashes of all q-grams, by doubling."""
    h, width = (codes.astype(np.uint64) + np.uint64(1)) * _ODD, 1
    while width < Q:
        h ^= h >> np.uint64(31)
        h = h[:-width] * np.uint64(0xD6E8FEB86659FD93) + (h[width:] ^ (h[width:] << np.uint64(7))) if len(h) > width else h[:0]
        width *= 2
    return h ^ (h >> np.uint64(29))


def budget(m, share=BUDGET):
    """Edits allowed for an item of m characters: a share of them, as far as one shared q-gram stays certain."""
    return max(0, min(int(m * share), (m - Q) // Q))


@dataclass
class Part:
    """Some benchmark items, their budgets and bounds, and the places of their q-grams, sorted by hash."""
    ids: list
    codes: list
    edits: np.ndarray
    bound: np.ndarray
    longest: int
    hashes: np.ndarray
    firsts: np.ndarray
    sizes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    present: np.ndarray
    short: dict

    @classmethod
    def of(cls, rows, share=BUDGET):
        every_row = [(i, normal(t)[0]) for i, t in rows]
        short = {}
        for i, c in every_row:
            if 0 < len(c) < Q and c.tolist() != [0x20]:
                short.setdefault(len(c), {}).setdefault(int(short_grams(c, len(c))[0]), []).append((i, c))
        rows = [(i, c) for i, c in every_row if len(c) >= Q]
        lengths = np.array([len(c) for _, c in rows], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *(grams(c) for _, c in rows)])
        order = np.argsort(every, kind="stable")
        item = np.repeat(np.arange(len(rows)), lengths - Q + 1)[order]
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(m - Q + 1) for m in lengths)])[order]
        hashes, firsts, sizes = np.unique(every[order], return_index=True, return_counts=True)
        present = np.zeros(1 << FILTER_BITS, bool)
        present[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        edits = np.array([budget(m, share) for m in lengths.tolist()], np.int64)
        return cls(
            [i for i, _ in rows], [c for _, c in rows], edits, lengths - Q + 1 - Q * edits,
            int((lengths + edits).max(initial=0)), hashes, firsts, sizes, item, place, present,
            {width: (np.sort(np.array(list(table), np.uint64)), table) for width, table in short.items()},
        )


def shared_bands(part, codes):
    """(item, first diagonal, last diagonal) of the bands that reach their item's bound."""
    h = grams(codes)
    at = np.flatnonzero(part.present[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    known = np.searchsorted(part.hashes, h[at])
    known[known == len(part.hashes)] = 0
    same = part.hashes[known] == h[at] if len(part.hashes) else np.zeros(0, bool)
    at, known = at[same], known[same]
    size = part.sizes[known]
    entry = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(part.firsts[known], size)
    item = part.item[entry]
    width = part.edits[item] + 1
    band = (np.repeat(at, size) - part.place[entry]) // width + (1 << 40)
    key, count = np.unique((item << 42) + band, return_counts=True)
    if len(key) > 1:  # a band and its neighbour make one double band; double bands overlap by half
        count[:-1] += np.where(key[1:] == key[:-1] + 1, count[1:], 0)
    found = key[count >= part.bound[key >> 42]]
    if not len(found):
        return
    diagonal, place = np.repeat(at, size) - part.place[entry], part.place[entry]
    for i in np.unique(found >> 42).tolist():
        mine = item == i
        yield from ((i, *span) for span in _dense(diagonal[mine], place[mine], int(part.edits[i]), int(part.bound[i])))


def _dense(diagonal, place, edits, bound):
    """Spans of diagonals in which some edits + 1 neighbours hold `bound` different q-grams of the item."""
    order = np.argsort(diagonal, kind="stable")
    diagonal, place = diagonal[order], place[order]
    end = np.searchsorted(diagonal, diagonal + edits, "right")
    span = None
    for k in np.flatnonzero(end - np.arange(len(end)) >= bound).tolist():
        if k and diagonal[k] == diagonal[k - 1] or len(np.unique(place[k:end[k]])) < bound:
            continue
        first, last = int(diagonal[k]), int(diagonal[end[k] - 1])
        if span and first <= span[1]:
            span[1] = last
            continue
        if span:
            yield span
        span = [first, last]
    if span:
        yield span


def aligned(item, codes, first, last, most):
    """Least edit distance of the item to a region of `codes` whose path stays on the diagonals first - most .. last + most.

    Returns (distance, start, end), with the shortest region among the best that end first, or None above `most`.
    """
    low, width = first - most, last - first + 2 * most + 1
    m, n, far = len(item), len(codes), 1 << 20
    column = low + np.arange(width)
    cost = np.where((column >= 0) & (column <= n), 0, far)
    begin = column.copy()
    slots = np.arange(width)
    for r in range(m):
        column = low + r + np.arange(width)  # place of the character that a diagonal step compares
        inside = (column >= 0) & (column < n)
        match = np.zeros(width, bool)
        match[inside] = codes[column[inside]] == item[r]
        step = np.where(inside, cost + ~match, far)
        drop = np.append(cost[1:] + 1, far)  # a character of the item that the region lacks
        fresh = np.where(step <= drop, step, drop)
        start = np.where(step <= drop, begin, np.append(begin[1:], 0))
        outside = (column + 1 < 0) | (column + 1 > n)
        fresh[outside] = far
        source = np.minimum.accumulate((fresh - slots) * far + slots) & (far - 1)  # further characters of the region
        cost, begin = fresh[source] + slots - source, start[source]
        cost[outside] = far
        if cost.min() > most:
            return None
    best = int(np.argmin(cost))
    return (int(cost[best]), int(begin[best]), low + m + best) if cost[best] <= most else None


def _text_of(codes):
    return codes.astype(np.uint32).tobytes()


def short_occurrences(part, codes):
    """(item, start, end) of the short items that stand in the text as whole words; regions of one item do not overlap."""
    if not part.short:
        return
    spaced = _tables()[1]
    wordy = np.zeros(len(codes) + 2, bool)
    wordy[1:-1] = spaced[np.minimum(codes, _SPACED - 1)] & (codes < _SPACED)
    runs_on = wordy[:-1] & wordy[1:]  # at k: a word goes on from character k - 1 to character k
    for width, (hashes, table) in part.short.items():
        h = short_grams(codes, width)
        at = np.flatnonzero(~runs_on[:len(h)] & ~runs_on[width:width + len(h)])
        known = np.searchsorted(hashes, h[at])
        known[known == len(hashes)] = 0
        end = {}
        for k in at[hashes[known] == h[at]].tolist():
            for number, (i, item) in enumerate(table[int(h[k])]):
                slot = (int(h[k]), number)
                if k >= end.get(slot, 0) and np.array_equal(codes[k:k + width], item):
                    end[slot] = k + width
                    yield i, k, k + width


def occurrences(part, text):
    """(item, start, end, distance) of the regions of a text, as offsets of its characters; one per place and item."""
    codes, places = normal(text)
    out = [(i, int(places[a]), int(places[b - 1]) + 1, 0) for i, a, b in short_occurrences(part, codes)]
    found = {}
    step = max(PIECE, 2 * part.longest)
    for begin in range(0, max(1, len(codes)), step):
        piece = codes[begin:begin + step + part.longest]
        for i, first, last in shared_bands(part, piece):
            item, most = part.codes[i], int(part.edits[i])
            low, high = max(0, first - most), min(len(piece), last + most + len(item) + 1)
            region = piece[low:high]
            exact = _exact(region, item)
            hit = (0, exact, exact + len(item)) if exact is not None else aligned(item, region, first - low, last - low, most)
            if hit:
                distance, a, b = hit
                span = (distance, begin + low + a, begin + low + b)
                found.setdefault(i, []).append(span)
    for i, spans in found.items():
        taken = []
        for distance, a, b in sorted(set(spans)):
            if all(b <= c or a >= d for c, d in taken):
                taken.append((a, b))
                out.append((part.ids[i], int(places[a]), int(places[b - 1]) + 1, distance))
    return out


def _exact(region, item):
    data, wanted, at = _text_of(region), _text_of(item), -1
    while (at := data.find(wanted, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return None


def benchmark_parts(benchmark, id_col="item_id", text_col="text"):
    """The benchmark in parts of about PART_CHARS characters, dealt by a hash of the item."""
    items = narrow(benchmark, item_id=id_col, text=text_col).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // PART_CHARS))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        if rows:
            yield Part.of([(r.item_id, r.text) for r in rows])


def contaminated(docs, benchmark, id_col="doc_id", text_col="text", item_id="item_id", item_text="text"):
    """A row per occurrence: doc_id, item_id, start and end in the text, distance, similarity; clean documents have none.

    Documents are not shuffled. The benchmark goes to the tasks in parts of about PART_CHARS characters, one search each.
    """
    texts = narrow(docs, doc_id=id_col, text=text_col).where("text is not null")
    schema = "doc_id long, item_id long, start long, end long, distance long"

    def searcher(part):
        def search(batches):
            for batch in batches:
                ids, out = batch.column("doc_id").to_pylist(), []
                for doc_id, text in zip(ids, batch.column("text").to_pylist()):
                    out += [(doc_id, *hit) for hit in occurrences(part, text)]
                columns = list(zip(*out)) or [[]] * 5
                names = ("doc_id", "item_id", "start", "end", "distance")
                yield pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

        return search

    found = None
    for part in benchmark_parts(benchmark, item_id, item_text):
        hits = texts.mapInArrow(searcher(part), schema)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found


def without_passages(docs, benchmark, text_col="text", item_id="item_id", item_text="text"):
    """The rows of `docs` whose text holds no occurrence of any item; a filter, nothing is moved."""
    def searcher(part):
        @F.pandas_udf(BooleanType())
        def clean(texts: pd.Series) -> pd.Series:
            return pd.Series([t is None or not occurrences(part, t) for t in texts], dtype=bool)

        return clean

    for part in benchmark_parts(benchmark, item_id, item_text):
        docs = docs.where(searcher(part)(F.col(f"`{text_col}`")))
    return docs
