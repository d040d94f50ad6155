"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores in front until the table has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 64) -> DataFrame:
    """Rows with the columns of their group; a group with a large part of all rows costs no single task.

    ``groups`` has one row per key and its number of rows.  Fewer than ``share`` groups can hold more than
    ``total / share`` rows each: that proves the size of the broadcast side.  All others go through a shuffle.
    """
    heavy = F.col(size) * F.lit(share) > F.lit(total)
    extra = [c for c in groups.columns if c != key]
    found = free_name(rows, "_hot")
    hot = groups.filter(heavy).select(key, F.struct(*extra).alias(found))
    marked = rows.join(F.broadcast(hot), key, "left")
    straight = marked.filter(F.col(found).isNotNull()).select(*rows.columns, *[F.col(found)[c].alias(c) for c in extra])
    rest = marked.filter(F.col(found).isNull()).select(*rows.columns)
    return straight.unionByName(rest.join(groups.filter(~heavy), key))


def ranked(df: DataFrame, order: list[str | Column], rank: str = "rank") -> DataFrame:
    """Adds 0, 1, 2 ... over the whole table in the given order, without one task that holds it.

    Rows are range-partitioned, sorted and written; places come from the counts per partition.
    """
    spot, slot, ahead = free_name(df, "_place"), free_name(df, "_part"), free_name(df, "_before")
    place = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(spot, F.monotonically_increasing_id())
    )
    part, inner = F.shiftright(spot, 33), F.col(spot).bitwiseAND(F.lit((1 << 33) - 1))
    counts = place.groupBy(part.alias(slot)).agg(F.count("*").alias("_n"))
    order_of = W.orderBy(slot).rowsBetween(W.unboundedPreceding, -1)  # a row per partition of the table
    before = counts.select(slot, F.coalesce(F.sum("_n").over(order_of), F.lit(0)).alias(ahead))
    return (
        place.withColumn(slot, part).join(F.broadcast(before), slot)
        .withColumn(rank, F.col(ahead) + inner).drop(slot, spot, ahead)
    )


def small_batches(batches, rows: int = 512):
    """Arrow batches cut to a few hundred rows, so that what a task holds as Python objects stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def trim_memory() -> None:
    """Gives freed memory back to the system where the C library can; idle Python workers would keep it."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def uniform(*keys: Column | str) -> Column:
    """A reproducible number in [0, 1) from the keys: 52 bits of their MD5."""
    text = F.concat_ws(":", *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def base32_sha1(column: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits make four base32 digits, eight times."""
    digest = F.sha1(column)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

