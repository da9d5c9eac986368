"""Joins that stay even when one key holds a third of all rows, and broadcasts of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Keys that are broadcast at most: those that hold over a ``HOT``-th of all rows.
HOT = 10_000
#: A key of so many rows is no burden to a task.
LIGHT = 100_000
#: Rows of a few columns that are broadcast at most.
SMALL = 1 << 21


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, rows: int, hot: int = HOT, light: int = LIGHT) -> DataFrame:
    """``left`` with the row of its ``key`` in ``right``, an inner join that leaves ``count`` out.

    ``right`` holds each key once, and in ``count`` how many of ``left``'s ``rows``
    rows have it.  Keys with over ``rows / hot`` rows are at most ``hot`` in number;
    they are broadcast, so their rows are not shuffled.  All others are shuffled,
    and none of them holds more than that share of the rows, or than ``light``.
    """
    if rows <= light:
        return left.join(right.drop(count), key)
    many = F.col(count) > max(light, rows / hot)
    frequent = right.filter(many).drop(count)
    rest = right.filter(~many).drop(count)
    heavy = left.join(F.broadcast(frequent), key)
    light = left.join(F.broadcast(frequent.select(key)), key, "left_anti").join(rest, key)
    return heavy.unionByName(light)


def checked(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """``rows``, marked for broadcasting if they are at most ``most``; else left to the planner."""
    return F.broadcast(rows) if rows.count() <= most else rows
