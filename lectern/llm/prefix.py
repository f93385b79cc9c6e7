"""Running totals per group that do not need a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: list[str], slot: Column, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group that come before this one.

    ``slot`` cuts a group into slices in the order of the rows. Rows are sorted
    within (group, slice) only; slices are joined by the sums of those before
    them, one narrow row per slice. Null group keys form a group of their own.
    The rows of ``df`` are read twice.
    """
    keys = [*group, "_slot"]
    rows = df.withColumn("_slot", slot)
    before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("_sum")).select(
        *[F.col(k).alias(f"{k}_s") for k in keys], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"{k}_s")) for k in keys]
    on = same[0]
    for part in same[1:]:
        on = on & part
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(sums, on).withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_shift"))
    return placed.drop("_slot", "_shift", *[f"{k}_s" for k in keys])
