"""Curves and time series as array expressions, and their joins.

A curve is two arrays, ``xs`` ascending and ``ys``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _at(xs: Column, x: Column) -> Column:
    """The place of the last knot at or before ``x``, from 1 to the last but one."""
    return F.greatest(F.lit(1), F.least(F.size(xs) - 1, F.size(F.filter(xs, lambda k: k <= x))))


def _line(xs: Column, ys: Column, x: Column) -> Column:
    i = _at(xs, x)
    x0, x1, y0, y1 = (F.element_at(c, j) for c, j in ((xs, i), (xs, i + 1), (ys, i), (ys, i + 1)))
    return F.when(x1 == x0, y0).otherwise(y0 + (x - x0) * (y1 - y0) / F.nullif(x1 - x0, F.lit(0.0)))


def lookup(xs: Column, ys: Column, x: Column) -> Column:
    """Between knots along the line, beyond them the end's value; null without knots."""
    first, last = F.try_element_at(xs, F.lit(1)), F.try_element_at(xs, F.lit(-1))
    return F.when(F.size(xs) < 1, None).when(x <= first, F.try_element_at(ys, F.lit(1))).when(x >= last, F.try_element_at(ys, F.lit(-1))).otherwise(_line(xs, ys, x))


def extended(xs: Column, ys: Column, x: Column) -> Column:
    """As ``lookup``, but beyond the last knot the last line goes on."""
    return F.when((F.size(xs) >= 2) & (x > F.try_element_at(xs, F.lit(-1))), _line(xs, ys, x)).otherwise(lookup(xs, ys, x))


def interval(xs: Column, ys: Column, x: Column) -> Column:
    """The value of the first knot at or above ``x``; the last one's beyond it."""
    above = F.size(xs) - F.size(F.filter(xs, lambda k: k >= x)) + 1
    return F.when(F.size(xs) < 1, None).otherwise(F.element_at(ys, F.least(above, F.size(xs))))


def inverse(xs: Column, ys: Column, y: Column) -> Column:
    """``x`` where the curve of ascending ``ys`` has ``y``."""
    return lookup(ys, xs, y)


def slope(xs: Column, ys: Column, x: Column) -> Column:
    """Steepness of the line ``x`` lies on; 0 with fewer than two knots."""
    i = _at(xs, x)
    rise, run = F.element_at(ys, i + 1) - F.element_at(ys, i), F.element_at(xs, i + 1) - F.element_at(xs, i)
    return F.when(F.size(xs) < 2, 0.0).otherwise(F.coalesce(rise / F.nullif(run, F.lit(0.0)), F.lit(0.0)))


def area(xs: Column, ys: Column, x: Column) -> Column:
    """Area under the curve from its first knot to ``x``: the volume up to a depth of an area curve."""
    first = F.element_at(xs, 1)
    whole = F.transform(F.sequence(F.lit(1), F.size(xs) - 1), lambda i: F.greatest(F.lit(0.0), F.least(x, F.element_at(xs, i + 1)) - F.element_at(xs, i)) * (F.element_at(ys, i) + lookup(xs, ys, F.least(F.greatest(x, F.element_at(xs, i)), F.element_at(xs, i + 1)))) / 2)
    beyond = F.greatest(F.lit(0.0), x - F.element_at(xs, -1)) * F.element_at(ys, -1)
    return F.when((F.size(xs) < 2) | (x <= first), 0.0).otherwise(F.aggregate(whole, F.lit(0.0), lambda a, b: a + b) + beyond)


def series_at(series: DataFrame, asked: DataFrame, key: str = "series", linear: bool = True) -> DataFrame:
    """``asked(key, t)`` with ``value`` of ``series(key, t, value)``: the last one at or before ``t``, blended with the next if ``linear``.

    An as-of join by one sort of both tables by key and time; before the first value there is none.
    """
    both = series.select(key, F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value"), F.lit(0).alias("asks")).unionByName(asked.select(key, F.col("t").cast("double").alias("t"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("asks")))
    before = Window.partitionBy(key).orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy("t", "asks").rowsBetween(1, Window.unboundedFollowing)
    knot = F.when(F.col("asks") == 0, F.struct("t", "value"))
    held = both.withColumn("a", F.last(knot, ignorenulls=True).over(before)).withColumn("b", F.first(knot, ignorenulls=True).over(after)).filter("asks = 1")
    blend = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * (F.col("t") - F.col("a.t")) / F.nullif(F.col("b.t") - F.col("a.t"), F.lit(0.0))
    return held.select(key, "t", (F.coalesce(F.when(F.col("b").isNotNull(), blend), F.col("a.value")) if linear else F.col("a.value")).alias("value"))
