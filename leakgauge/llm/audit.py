"""Filter interaction audit: what five filters remove together, in every order, and each one's exact Shapley value.

A text's failures are five bits. Rows are counted by (part, bits), at most 32 groups a part, and from these the removals
of all 32 coalitions of filters are tabulated. Differences of coalitions give the counts of every step of every order;
the Shapley values are the solution of the kernel-weighted least squares whose parts sum to the removal of all five,
solved in rational numbers.

Whether a text repeats a smaller identifier's is decided by the SHA-256 of whole texts: equal rows are counted before the
shuffle, and a text held by a third of all rows is one row per part and label after it.

Defined cases: a null text counts as empty; an empty text fails A only, and E if it repeats; a null identifier is neither
smaller nor larger than another, so its row never fails E and makes no other fail; rows that share identifier and text do
not make each other fail; a document with several labels is good (toxic) if one of them says 1; without labels it is
neither; a null source is the part ''; an empty table gives no rows; other columns are ignored.
"""

from fractions import Fraction
from functools import cache
from itertools import permutations
from math import comb

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .store import WORD, narrow, words_in

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
MEASURES = ("n", "good", "toxic")
STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def own_failures(text):
    """Bits of the filters A to D that a text fails."""
    text = F.coalesce(text, F.lit(""))
    words = words_in(text)
    distinct = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = (words < 50, distinct * 100 < words * 65, capitals * 100 > F.length(text) * 5, text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failure_counts(docs, labels, id_col="doc_id", text_col="text", source_col="source"):
    """Per part and failure bits: rows, good rows and toxic rows."""
    rows = narrow(docs, doc_id=id_col, text=text_col, source=source_col)
    rows = rows.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), own_failures(F.col("text")).alias("bits"),
        F.unhex(F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256)).alias("mark"),
    )
    marked = narrow(labels, label_id="doc_id", quality="quality", toxic="toxic").where("label_id is not null").groupBy("label_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    labelled = rows.join(marked, F.col("doc_id") == F.col("label_id"), "left").select(
        "doc_id", "part", "bits", "mark", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # Identifiers spread a hot text over tasks; then (identifier, count) pairs meet per text, part and label.
    kind = ("mark", "part", "bits", "good", "toxic")
    by_id = labelled.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    of_kind = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min(known).alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    least = F.min("first.doc_id").over(Window.partitionBy("mark"))  # a row per part and label of one text
    firsts = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = of_kind.withColumn("least", least).withColumn("stay", F.col("nameless") + F.coalesce(firsts, F.lit(0)))
    pieces = F.explode(F.array(
        F.struct(F.col("bits").alias("bits"), F.col("stay").alias("n")),
        F.struct((F.col("bits") + 16).alias("bits"), (F.col("n") - F.col("stay")).alias("n"))))
    counted = split.select("part", "good", "toxic", pieces.alias("p")).where("p.n > 0")
    return counted.groupBy("part", F.col("p.bits").alias("bits")).agg(
        F.sum("p.n").alias("n"), F.sum(F.col("good") * F.col("p.n")).alias("good"), F.sum(F.col("toxic") * F.col("p.n")).alias("toxic"))


def coalitions(counts):
    """One row a part: the removals of all 32 coalitions by measure, and the rows of the part."""
    removed = [
        F.array(*(F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(c)) != 0, F.col(m))), F.lit(0)) for c in range(ALL + 1))).alias(m)
        for m in MEASURES
    ]
    return counts.groupBy("part").agg(*removed, F.sum("n").alias("rows"))


def solved(matrix, right):
    """The solution of a square system by elimination in rationals; `right` holds one row of right-hand sides per equation."""
    rows = [[Fraction(v) for v in (*m, *r)] for m, r in zip(matrix, right)]
    for c in range(len(rows)):
        pivot = next(i for i in range(c, len(rows)) if rows[i][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [v / rows[c][c] for v in rows[c]]
        for i, row in enumerate(rows):
            if i != c and row[c]:
                rows[i] = [v - row[c] * w for v, w in zip(row, rows[c])]
    return [row[len(matrix):] for row in rows]


def kernel(members, size):
    """Weight of a coalition of so many members."""
    return Fraction(size - 1, comb(size, members) * members * (size - members))


@cache
def least_squares(size=len(FILTERS)):
    """Rows that turn the values of all coalitions into the constrained optimum, one row a filter."""
    inner = range(1, (1 << size) - 1)
    bit = lambda c, i: c >> i & 1
    weight = {c: kernel(c.bit_count(), size) for c in inner}
    normal = [[sum(weight[c] for c in inner if bit(c, i) and bit(c, j)) for j in range(size)] + [1] for i in range(size)]
    normal.append([1] * size + [0])
    right = [[weight[c] * bit(c, i) if c in weight else 0 for c in range(1 << size)] for i in range(size)]
    right.append([int(c == (1 << size) - 1) for c in range(1 << size)])
    return solved(normal, right)[:size]


def shapley(values, size=len(FILTERS)):
    """Exact Shapley values of a game whose empty coalition has the value 0."""
    return [sum(m * v for m, v in zip(row, values)) for row in least_squares(size)]


def steps(n, good, toxic, rows):
    """Every step of every order from the coalitions' removals."""
    filters = range(len(FILTERS))
    fair = [int(120 * f) for f in shapley(n)]
    unique = [n[ALL] - n[ALL & ~(1 << f)] for f in filters]
    for order in permutations(filters):
        before, name = 0, "".join(FILTERS[f] for f in order)
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = n[after] - n[before]
            yield (name, step, rows - n[after], removed, n[1 << f] - removed, unique[f],
                   good[after] - good[before], toxic[after] - toxic[before], fair[f])
            before = after


def _reported(batches):
    names = [field.split()[0] for field in STEPS.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            columns = list(zip(*steps(row["n"], row["good"], row["toxic"], row["rows"])))
            types = [pa.string(), pa.int32(), *[pa.int64()] * 7]
            arrays = [pa.array([row["part"]] * len(columns[0]), pa.string()), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.record_batch(arrays, names=names)


def filter_audit(docs, labels, id_col="doc_id", text_col="text", source_col="source"):
    """A row per part, order and step."""
    return coalitions(failure_counts(docs, labels, id_col, text_col, source_col)).mapInArrow(_reported, STEPS)


#: Counts every order directly and sums the orders for the Shapley values, without coalitions or least squares.
SQL = """
with marked as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic
  from labels where doc_id is not null group by doc_id),
texts as (
  select d.doc_id, coalesce(source, '') part, coalesce(text, '') t, coalesce(l.good, 0) good, coalesce(l.toxic, 0) toxic,
    min(d.doc_id) over (partition by coalesce(text, '')) least
  from documents d left join marked l on d.doc_id = l.doc_id),
words as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') w from texts),
bits as (
  select part, good, toxic,
    (case when len(w) < 50 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end)
    + (case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) then 4 else 0 end)
    + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end) + (case when doc_id > least then 16 else 0 end) b
  from words),
counted as (select part, b, count(*) n, sum(good) g, sum(toxic) x from bits group by part, b),
letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, m)),
orders as (
  select a.f || b.f || c.f || d.f || e.f filter_order, [a.m, b.m, c.m, d.m, e.m] ms
  from letters a, letters b, letters c, letters d, letters e where a.m + b.m + c.m + d.m + e.m = 31 and (a.m | b.m | c.m | d.m | e.m) = 31),
stepped as (
  select filter_order, s step, ms[s] m, coalesce(list_sum(ms[1:s - 1]), 0)::bigint earlier from orders, range(1, 6) r(s)),
done as (
  select part, filter_order, step::int step, m,
    coalesce(sum(n) filter (b & (earlier | m) = 0), 0)::bigint kept,
    coalesce(sum(n) filter (b & m <> 0 and b & earlier = 0), 0)::bigint removed,
    coalesce(sum(n) filter (b & m <> 0 and b & earlier <> 0), 0)::bigint redundant,
    coalesce(sum(n) filter (b = m), 0)::bigint unique_fails,
    coalesce(sum(g) filter (b & m <> 0 and b & earlier = 0), 0)::bigint good_lost,
    coalesce(sum(x) filter (b & m <> 0 and b & earlier = 0), 0)::bigint toxic_lost
  from counted, stepped group by part, filter_order, step, m)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, m))::bigint shapley
from done
"""
