"""Consecutive numbers and running values within groups that may be too large for one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def numbered(df: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
    """Adds 1, 2, 3 ... per group by ``order``.

    The rows are range-partitioned by (group, order), so a large group spans many partitions.  Rows are
    counted within (group, partition); the offsets come from the small table of counts per partition.
    """
    ranged = df.repartitionByRange(*group, order).withColumn("_part", F.spark_partition_id())
    placed = cut_lineage(ranged)
    inner = W.partitionBy(*group, "_part").orderBy(order)
    counts = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = placed.withColumn("_rn", F.row_number().over(inner))
    return local.join(offsets, [*group, "_part"]).withColumn(name, F.col("_rn") + F.col("_before")).drop("_rn", "_before", "_part")


def running(df: DataFrame, group: list[str], order: list[str], value: str, name: str, total: Callable[[Column | str], Column] = F.sum) -> DataFrame:
    """Adds the running sum (or ``F.max``) of ``value`` in ``order``, the row itself included; nulls count for nothing.

    Rows are range-partitioned by group and order, so one long group spans many tasks: each runs over its own rows, and
    what stands before a task's rows comes from the small table of totals per (group, partition).  Rows of equal order
    have no order among each other.  Without a group the whole table is one.
    """
    placed = cut_lineage(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    inner = W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = placed.groupBy(*group, "_part").agg(total(value).alias("_total"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_part").alias("_at"), total("_total").over(before).alias("_before"))
    same = [F.col("_part") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]]
    local = placed.withColumn("_local", total(value).over(inner))
    zero = F.lit(0)
    value_so_far = F.coalesce("_before", zero) + F.coalesce("_local", zero) if total is F.sum else F.greatest("_before", "_local")
    return local.join(offsets, same).withColumn(name, value_so_far).select(*df.columns, name)
