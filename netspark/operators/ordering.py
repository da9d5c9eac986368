"""Order-dependent columns without gathering a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netspark.plans.workspace import materialise

#: Parts a table is cut into, by ranges of its key.
PARTS = 64


#: Rows a part holds at least.
PART_ROWS = 100_000


def _parted(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """``rows`` with ``__part``, the range of ``key`` a row falls in, in the key's order; nulls come first."""
    parts = min(parts, rows.count() // PART_ROWS)
    if parts < 2:
        return rows.withColumn("__part", F.lit(0))
    cuts = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts).alias("q")).first()["q"] or []
    listed = F.array(*[F.lit(x).cast(rows.schema[key].dataType) for x in sorted(set(cuts))])
    return rows.withColumn("__part", F.coalesce(F.size(F.filter(listed, lambda x: x < F.col(key))), F.lit(0)) if cuts else F.lit(0))


def running(rows: DataFrame, key: str, value: Column, name: str, ties: tuple[str, ...] = (), parts: int = PARTS) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over all rows before in the order of ``key`` and ``ties``.

    Ranges of the key are summed each in a task, and moved by what the ranges before
    hold; only one number a range is ordered as a whole.
    """
    held = materialise(_parted(materialise(rows, "rows").withColumn("__value", value), key, parts), "parted")
    sums = held.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__base")  # at most `parts` rows
    inside = Window.partitionBy("__part").orderBy(F.col(key).asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = held.withColumn("__own", F.coalesce(F.sum("__value").over(inside), F.lit(0))).join(F.broadcast(before), "__part")
    return summed.withColumn(name, F.col("__base") + F.col("__own")).drop("__part", "__value", "__own", "__base")


def dense_index(rows: DataFrame, key: str, name: str, parts: int = PARTS) -> DataFrame:
    """``rows`` with ``name``, their place from 0 by a key that no two share."""
    return running(rows, key, F.lit(1).cast("long"), name, parts=parts)
