"""Keeping costly expressions from being worked out twice."""

from pyspark.sql import functions as F


def bound(value, body):
    """``body`` applied to ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df, columns):
    """Add columns that later filters do not repeat.

    A filter on a plain column moves below the projection and takes a copy of the expression with it; the
    one-row generator used here stays where it is.
    """
    row = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select("*", F.inline(F.array(row)))
