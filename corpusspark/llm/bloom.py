"""Bloom filters as tables of bitmaps, built and tested by built-in functions.

A code sets two of 16 slots per row; the filter has at most ``MAX_SLOTS`` slots, so what is broadcast is bounded by
128 MB whatever the input.  Beyond that more rows pass as possible members, which costs work and no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

HASHES = 2
MAX_SLOTS = 1 << 30


def _slot(code: Column, i: int, slots: int) -> Column:
    """1 .. slots."""
    return F.pmod(F.xxhash64(code, F.lit(i)), F.lit(slots)) + F.lit(1)


def slots_for(rows: int, max_slots: int = MAX_SLOTS) -> int:
    return min(max_slots, max(1 << 15, 1 << (16 * rows - 1).bit_length()))


def slot_filter(codes: DataFrame, code: str, slots: int, least: int = 1) -> DataFrame:
    """(bucket, bits) of the slots that at least ``least`` rows set.  Equal codes meet in partial counts before the shuffle."""
    each = F.explode(F.array_distinct(F.array(*[_slot(F.col(code), i, slots) for i in range(HASHES)])))
    enough = codes.select(each.alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return enough.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def with_flag(rows: DataFrame, code: str, bits: DataFrame, slots: int, flag: str) -> DataFrame:
    """Marks rows whose slots are all in the filter; no shuffle, the filter's size is bounded by ``slots``."""
    out, tests = rows, []
    for i in range(HASHES):
        bucket, found, at = free_name(out, f"_bucket{i}"), free_name(out, f"_bits{i}"), F.bitmap_bit_position(_slot(F.col(code), i, slots))
        side = bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(found))
        out = out.withColumn(bucket, F.bitmap_bucket_number(_slot(F.col(code), i, slots))).join(F.broadcast(side), bucket, "left")
        byte = F.conv(F.hex(F.substring(F.col(found), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        mask = F.call_function("shiftleft", F.lit(1), F.pmod(at, F.lit(8)).cast("int"))
        tests.append(F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False)))
    both = tests[0]
    for t in tests[1:]:
        both = both & t
    return out.withColumn(flag, both).select(*rows.columns, flag)
