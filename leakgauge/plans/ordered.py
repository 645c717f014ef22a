"""Running values along an ordered group, for groups of any size.

A plain window function sends a whole group to one task. That is the cheapest plan while every group
fits, and the wrong one when a single client, domain or capture holds a large share of all rows. Unless
a table is known to be small, groups above a limit are therefore cut into ordered chunks:

1. one aggregate counts the groups and draws order keys by their hash, about `DRAWN` per limit; the keys
   of a group over the limit, sorted, are its borders;
2. every row finds its chunk among its group's borders, first among every S-th (S is the root of their number), then
   among the S between two of those, by binary search; chunks depend on the rows' contents alone, so what a lost
   executor took with it comes out the same again, without a checkpoint;
3. compute the running value inside each (group, chunk) with an ordinary window;
4. add what the earlier chunks of the same group bring.

Borders and carried values have at most `DRAWN` entries per `limit` rows of the table, which bounds what
is broadcast. Nothing runs before the query itself does. The order key must identify a row within its
group, otherwise ties come in no fixed order.
"""

from dataclasses import dataclass

from pyspark.sql import Column, Window as W
from pyspark.sql import functions as F

#: Rows of a group that one task may hold; order keys that are drawn per so many rows; a table of fewer bytes is small.
ROWS_PER_TASK, DRAWN, SMALL_BYTES = 4_000_000, 8, 256 << 20
#: Steps of the binary search: a level may have twice as many borders as the first, a group the square of that.
_STEPS = [1 << p for p in range(12, -1, -1)]


@dataclass(frozen=True)
class Running:
    """One running value: its kind and the expression it runs over."""

    kind: str
    value: Column


def running_sum(value):
    """Sum up to and including the row."""
    return Running("sum", value)


def previous(value):
    """Value of the row before, null on the first."""
    return Running("previous", value)


def following(value):
    """Value of the row after, null on the last."""
    return Running("following", value)


def last_known(value):
    """Last value before the row that is not null."""
    return Running("last_known", value)


def highest_before(value):
    """Largest value before the row."""
    return Running("highest_before", value)


@dataclass(frozen=True)
class Layout:
    """How rows are spread: whole groups per task, or groups over `rows` rows in ordered chunks."""

    chunked: bool
    rows: int = ROWS_PER_TASK


def choose_layout(df, limit=ROWS_PER_TASK):
    """Whole groups if the optimiser's estimate of the table is small, else chunks; runs nothing."""
    if limit >= ROWS_PER_TASK and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES:
        return Layout(False)
    return Layout(True, limit)


def layout_if_small(source, limit=ROWS_PER_TASK, part=None):
    """Whole groups if the source of a table has few rows (a count from file footers), or if no ``part`` of it has many.

    An estimate grows with every join above the source; a count of the source does not. The source must
    have at least as many rows as the table. ``part`` is a column of the source that all rows of a group share, so that no
    group is larger than its part; it is counted only when the source is large. Else it is undecided.
    """
    if source.count() <= limit:
        return Layout(False)
    if part is None:
        return None
    largest = source.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return Layout(False) if largest <= limit else None


def with_running(df, group, order, layout=None, limit=ROWS_PER_TASK, borders_from=None, **values):
    """Add one column per running value.

    ``group`` and ``order`` are column names, the order ascending. ``borders_from`` may name a table with
    the same groups and order keys that is cheaper to work out than ``df``.
    """
    group, order = list(group), list(order)
    layout = layout or choose_layout(df, limit)
    if not layout.chunked:
        window = W.partitionBy(*group).orderBy(*order) if group else W.orderBy(*order)
        return df.withColumns({name: _local(run, window) for name, run in values.items()})
    return _chunked(df, group, order, group_borders(df if borders_from is None else borders_from, group, order, layout.rows), values)


def group_borders(df, group, order, rows):
    """One row (`__h0`, ..., `__borders`) per group of over `rows` rows: the order keys at which it is cut, sorted."""
    drawn = F.pmod(F.xxhash64(*group, *order), F.lit(max(1, rows // DRAWN))) == 0
    found = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__n"), F.sort_array(F.collect_list(F.when(drawn, F.struct(*order)))).alias("__borders"))
    return found.where(F.col("__n") > rows).select(*(F.col(g).alias(f"__h{i}") for i, g in enumerate(group)), "__borders")


def _chunk(borders, key):
    """How many of the sorted borders are at most the key."""
    def search(at, step):
        beyond = at + step
        return F.when((beyond <= F.size(borders)) & (F.get(borders, beyond - 1) <= key), beyond).otherwise(at)

    return F.when(borders.isNotNull(), F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), search)).otherwise(0)


def _local(run, window):
    if run.kind == "previous":
        return F.lag(run.value).over(window)
    if run.kind == "following":
        return F.lead(run.value).over(window)
    if run.kind == "sum":
        return F.sum(run.value).over(window.rowsBetween(W.unboundedPreceding, 0))
    before = window.rowsBetween(W.unboundedPreceding, -1)
    return (F.last(run.value, ignorenulls=True) if run.kind == "last_known" else F.max(run.value)).over(before)


def _summary(run, order):
    """What one (chunk, group) passes on to its neighbours."""
    key = F.struct(*order)
    if run.kind == "sum":
        return F.sum(run.value)
    if run.kind == "previous":
        return F.max_by(F.struct(run.value.alias("v")), key)
    if run.kind == "following":
        return F.min_by(F.struct(run.value.alias("v")), key)
    if run.kind == "last_known":
        return F.max(F.when(run.value.isNotNull(), F.struct(*order, run.value.alias("v"))))["v"]
    return F.max(run.value)


def _carried(run, name, window):
    before = window.rowsBetween(W.unboundedPreceding, -1)
    if run.kind == "sum":
        return F.sum(name).over(before)
    if run.kind == "previous":
        return F.lag(name).over(window)["v"]
    if run.kind == "following":
        return F.lead(name).over(window)["v"]
    if run.kind == "last_known":
        return F.last(name, ignorenulls=True).over(before)
    return F.max(name).over(before)


def _same(left, right, group, prefix):
    match = F.lit(True)
    for i, g in enumerate(group):
        match = match & left[g].eqNullSafe(right[f"{prefix}{i}"])
    return match


def _levels(hot, group):
    """Borders in two tables: every S-th border per group, and per part between two of these the S - 1 others.

    A joined row carries a copy of the borders beside it, so one list of all of them would cost rows x borders.
    """
    keys = [f"__h{i}" for i in range(len(group))]
    sized = hot.withColumn("__step", F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("__borders"))).cast("int")))
    parts = sized.withColumn("__parts", F.expr("size(__borders) div __step").cast("int"))
    tops = parts.select(*keys, "__step", F.expr(
        "transform(sequence(0, __parts), p -> get(__borders, (p + 1) * __step - 1))").alias("__at")).withColumn(
        "__tops", F.filter("__at", lambda b: b.isNotNull())).drop("__at")
    leaves = parts.select(*keys, "__borders", "__step", F.explode(F.sequence(F.lit(0), F.col("__parts"))).alias("__of_part"))
    inner = F.slice("__borders", F.col("__of_part") * F.col("__step") + 1, F.col("__step") - 1)
    return tops, leaves.select(*(F.col(k).alias(k.replace("h", "l")) for k in keys), "__of_part", inner.alias("__leaf"))


def _with_chunk(df, group, order, hot):
    """Add ``__hot``, whether the row's group is cut, and ``__chunk``, how many of its borders are at most the row's key."""
    tops, leaves = _levels(hot, group)
    key = F.struct(*order)
    found = df.join(F.broadcast(tops), _same(df, tops, group, "__h"), "left").select(
        *df.columns, "__step", _chunk(F.col("__tops"), key).alias("__part"))
    same = (F.col("__part") == F.col("__of_part")) & _same(found, leaves, group, "__l")
    return found.join(F.broadcast(leaves), same, "left").select(
        *df.columns, F.col("__step").isNotNull().alias("__hot"),
        (F.coalesce(F.col("__part") * F.col("__step"), F.lit(0)) + _chunk(F.col("__leaf"), key)).alias("__chunk"))


def _chunked(df, group, order, hot, values):
    rows = _with_chunk(df, group, order, hot)
    cut = rows.where("__hot").drop("__hot")
    rows = rows.drop("__hot")
    sums = cut.groupBy("__chunk", *group).agg(*(_summary(run, order).alias(name) for name, run in values.items()))
    along = W.partitionBy(*group).orderBy("__chunk") if group else W.orderBy("__chunk")
    carry = sums.select(
        F.col("__chunk").alias("__of_chunk"),
        *(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)),
        *(_carried(run, name, along).alias(f"__c_{name}") for name, run in values.items()),
    )
    window = W.partitionBy("__chunk", *group).orderBy(*order)
    local = rows.withColumns({
        **{name: _local(run, window) for name, run in values.items()},
        "__first": F.row_number().over(window) == 1,
        "__last": F.lead(F.lit(1)).over(window).isNull(),
    })
    match = (F.col("__chunk") == F.col("__of_chunk")) & _same(local, carry, group, "__g")
    joined = local.join(F.broadcast(carry), match, "left")
    return joined.withColumns({name: _combine(run, name) for name, run in values.items()}).select(
        *df.columns, *values
    )


def _combine(run, name):
    here, before = F.col(name), F.col(f"__c_{name}")
    if run.kind == "sum":  # like a plain sum: null only as long as there is nothing to add
        return F.when(before.isNull(), here).otherwise(before + F.coalesce(here, F.lit(0)))
    if run.kind == "previous":
        return F.when(F.col("__first"), before).otherwise(here)
    if run.kind == "following":
        return F.when(F.col("__last"), before).otherwise(here)
    if run.kind == "last_known":
        return F.coalesce(here, before)
    return F.greatest(here, before)
