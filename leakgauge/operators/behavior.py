"""Trailing-window features per client and apex domain.

For a query at time t the window is [t - W, t]. Queries are taken one after the other in (time, arrival)
order, so of several queries at the same instant each sees the earlier ones only. A RANGE frame would
show it all of them, and a frame that collects sub-domains costs rows x window; so the counts come from a
sweep instead: every query adds one at its time and takes it back just after t + W, and a sub-domain is
counted from the first query of a run of queries at most W apart until W after the last one.
"""

from pyspark.sql import functions as F

from leakgauge.contract import FIRST_INTERVAL, GROUP_KEYS, WINDOW_SECONDS, DataError
from leakgauge.plans.ordered import (
    ROWS_PER_TASK, choose_layout, following, last_known, previous, running_sum, with_running,
)


def window_micros(seconds):
    if seconds <= 0:
        raise ValueError("the window must be longer than zero seconds")
    return round(seconds * 1_000_000)


def with_window_features(
    df, keys=GROUP_KEYS, window_seconds=WINDOW_SECONDS, order=("row_id",), time="epoch_us",
    subdomain="subdomain", limit=ROWS_PER_TASK, layout=None, ignored=None,
):
    """Add query_frequency, unique_subdomains and time_interval.

    ``keys`` names whatever separates histories (add a capture or split column to isolate them), ``order``
    the arrival order among equal times. Rows need not arrive sorted. Rows whose column ``ignored`` is true count in no
    window and get no features.
    """
    width = window_micros(window_seconds)
    keys, order = list(keys), list(order)
    columns = df.columns
    layout = layout or choose_layout(df, limit)
    if not layout.chunked:
        # One exchange serves both windows below.
        df = df.repartition(*keys)
    marked = with_running(
        df, [*keys, subdomain, *([ignored] if ignored else [])], [time, *order], layout,
        __before=previous(F.col(time)), __after=following(F.col(time)),
    )
    starts = F.when(F.col("__before") >= F.col(time) - width, 0).otherwise(1)
    ends = F.when(F.col("__after") <= F.col(time) + width, 0).otherwise(-1)
    counted = F.lit(True) if ignored is None else ~F.col(ignored)
    weigh = lambda value: F.when(counted, value).otherwise(0) if ignored else value
    row = F.struct(*(c for c in columns if c not in keys))
    arrival = {f"__o{i}": F.col(name) for i, name in enumerate(order)}

    def step(at, kind, count, distinct, payload, own_time):
        return F.struct(
            at.alias("__at"), F.lit(kind).alias("__kind"), weigh(F.lit(count)).alias("__count"),
            weigh(distinct).alias("__distinct"), own_time.alias("__time"), payload.alias("__row"),
            *(c.alias(n) for n, c in arrival.items()),
        )

    own_time = F.when(counted, F.col(time)) if ignored else F.col(time)
    now = step(F.col(time), 0, 1, starts, row, own_time)
    later = step(F.col(time) + width, 1, -1, ends, F.lit(None).cast(_type_of(df, row)), F.lit(None).cast("bigint"))
    steps = marked.select(*keys, F.explode(F.array(now, later)).alias("s")).select(*keys, "s.*")
    # The borders of the sweep need the steps' times only, not what the first pass adds.
    both = F.array(F.struct(F.col(time).alias("__at"), F.lit(0).alias("__kind")), F.struct((F.col(time) + width).alias("__at"), F.lit(1).alias("__kind")))
    plain_steps = df.select(*keys, *(c.alias(n) for n, c in arrival.items()), F.explode(both).alias("s")).select(*keys, "s.*", *arrival)
    swept = with_running(
        steps, keys, ["__at", "__kind", *arrival], layout, borders_from=plain_steps,
        query_frequency=running_sum(F.col("__count")),
        unique_subdomains=running_sum(F.col("__distinct")),
        __previous=last_known(F.col("__time")),  # expiry steps hold no time, so this skips them
    )
    interval = F.col(time) / 1e6 - F.col("__previous") / 1e6
    found = {
        "query_frequency": F.col("query_frequency").cast("int"),
        "unique_subdomains": F.col("unique_subdomains").cast("int"),
        "time_interval": F.coalesce(interval, F.lit(FIRST_INTERVAL)),
    }
    if ignored:
        found = {name: F.when(counted, value) for name, value in found.items()}
    return (
        swept.where("__kind = 0")
        .select(*keys, "__row.*", "query_frequency", "unique_subdomains", "__previous")
        .withColumns(found)
        .select(*columns, "query_frequency", "unique_subdomains", "time_interval")
    )


def _type_of(df, column):
    return df.select(column.alias("c")).schema["c"].dataType


def with_order_violations(df, keys=GROUP_KEYS, order=("row_id",), time="epoch_us", limit=ROWS_PER_TASK):
    """Flag rows that are earlier than the row that arrived before them in their group."""
    found = with_running(df, keys, order, limit=limit, __previous=previous(F.col(time)))
    return found.withColumn(
        "out_of_order", F.coalesce(F.col("__previous") > F.col(time), F.lit(False))
    ).drop("__previous")


def require_chronological(df, **options):
    """Refuse a table whose groups do not arrive in time order."""
    bad = with_order_violations(df, **options).where("out_of_order").limit(1).collect()
    if bad:
        raise DataError(f"a query of {bad[0]['src_ip']} is earlier than the one before it")
    return df


def retime(df, gap_us, origin_us, keys=GROUP_KEYS, order=("row_id",), time="epoch_us", limit=ROWS_PER_TASK):
    """Keep the order inside each group, but put a fixed gap between its queries.

    ``gap_us`` may be a number or a column; every group starts at the same origin.
    """
    gap = gap_us if not isinstance(gap_us, (int, float)) else F.lit(int(gap_us))
    ranked = with_running(df, keys, [time, *order], limit=limit, __rank=running_sum(F.lit(1)))
    moved = F.lit(origin_us).cast("bigint") + (F.col("__rank") - 1) * gap
    return ranked.withColumn(time, moved.cast("bigint")).drop("__rank")
