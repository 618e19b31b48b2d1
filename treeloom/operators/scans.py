"""Running totals in order, in slices, so that no group has to pass through one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.session import stage, stage_counted

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, 0)


def running_sums(
    df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], rows_per_slice: int = 1_000_000
) -> DataFrame:
    """Add running sums per group in the order of the columns ``order``, which tell all rows apart.

    Slices hold about equally many rows whatever the values are: Spark samples the range bounds of
    group and order, so neither a large group nor a burst of equal times becomes one task. The slices
    are staged, as bounds drawn anew after a lost task could differ. Rows are summed inside their
    slice; slice totals, a row for each group in a slice, are carried forward. Nulls come first.
    """
    known, n_rows = stage_counted(df.withColumns({f"_v_{n}": c for n, c in sums.items()}))
    n_slices = max(1, -(-n_rows // rows_per_slice))
    sliced = stage(known.repartitionByRange(n_slices, *group, *order).withColumn("_slice", F.spark_partition_id()))
    keys = [*group, "_slice"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*UP_TO)
    local = sliced.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(inside) for n in sums})
    totals = sliced.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(*BEFORE)
    carried = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
    )
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    out = local.join(carried, same)
    return out.withColumns({n: F.col(f"_c_{n}") + F.col(f"_l_{n}") for n in sums}).drop(
        "_slice", *[f"_k_{k}" for k in keys], *[f"{p}{n}" for n in sums for p in ("_v_", "_l_", "_c_")]
    )


def unmatched_closers(df: DataFrame, group: list[str], order: str, delta: str, width: int = 65536) -> DataFrame:
    """Closing rows (delta -1) that no earlier opening row (delta +1) is left for.

    A closing row is unmatched exactly when it takes the running sum below zero and below every
    earlier value. Sum and minimum are carried from slice to slice of ``width`` positions.
    """
    keys = [*group, "_slice"]
    sliced = df.withColumn("_slice", F.floor(F.col(order) / width))
    inside = Window.partitionBy(*keys).orderBy(order)
    local = sliced.withColumn("_sum", F.sum(delta).over(inside.rowsBetween(*UP_TO))).withColumn(
        "_low", F.min("_sum").over(inside.rowsBetween(*BEFORE))
    )
    slices = local.groupBy(*keys).agg(F.sum(delta).alias("_total"), F.min("_sum").alias("_min"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(*BEFORE)
    carried = (
        slices.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .withColumn("_floor", F.coalesce(F.min(F.col("_base") + F.col("_min")).over(earlier), F.lit(0)))
        .select(*keys, "_base", "_floor")
    )
    low = F.least(F.lit(0), F.col("_floor"), F.coalesce(F.col("_base") + F.col("_low"), F.lit(0)))
    return (
        local.join(carried, keys)
        .filter((F.col(delta) < 0) & (F.col("_base") + F.col("_sum") < low))
        .drop("_slice", "_sum", "_low", "_base", "_floor")
    )
