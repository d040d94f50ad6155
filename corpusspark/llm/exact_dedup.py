"""Exact deduplication in two passes over a Bloom filter; DataFrame functions only.

Pass 1 sets two slots per row and keeps the slots that two or more rows set: the Bloom filter of possibly
repeated texts, as bitmaps of 32,768 slots.  Pass 2 tests every row against it.  A row with a slot that no other
row set is unique for certain and passes straight through; only the others are shuffled and compared exactly.
The filter has 16 slots per row, never more than ``max_slots``: its broadcast is bounded by ``max_slots / 8``
bytes (128 MB), and beyond that it only lets more rows into the exact pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bloom import MAX_SLOTS, slot_filter, slots_for, with_flag
from .common import free_name, join_groups

#: The characters that do not count: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def repeated_filter(codes: DataFrame, code: str, slots: int) -> DataFrame:
    """Pass 1: the filter of the slots that at least two rows set."""
    return slot_filter(codes, code, slots, 2)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_slots: int = MAX_SLOTS) -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without blanks; null counts as empty, and empty texts equal each other.
    Of equal texts the longest original stays (code points), then the smallest id (null ids last).  When one row
    stands in the table several times, exactly one of its copies is kept.  Other columns are ignored.  An empty
    table gives an empty result.  The texts are read once; everything after works on a narrow written table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.char_length(text).alias("_chars"), F.sha2(normalised(text), 256).alias("text_sha256"),
    ).withColumn("_row", F.monotonically_increasing_id()))
    total = narrow.count()
    slots = slots_for(total, max_slots)
    bits = cut_lineage(repeated_filter(narrow, "text_sha256", slots))
    flagged = cut_lineage(with_flag(narrow, "text_sha256", bits, slots, "_maybe"))
    alone = flagged.filter(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = flagged.filter("_maybe").drop("_maybe")
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("_row").alias("r")))
    groups = maybe.groupBy("text_sha256").agg(best.alias("_best"), F.count("*").alias("group_size"))
    exact = join_groups(maybe, cut_lineage(groups), "text_sha256", "group_size", total).select(
        "doc_id", F.col("_best.d").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best.r")).alias("kept"), "text_sha256")
    return alone.unionByName(exact)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_slots: int = MAX_SLOTS) -> DataFrame:
    """The rows that stay, with all their columns, by the rule of :func:`dedup_report`.

    Unique rows never leave their partition.  Possible copies are cut to one per group and task before the shuffle
    (a first-row window), so a group with a third of all rows sends one row per task.
    """
    code, flag, place = free_name(docs, "_code"), free_name(docs, "_maybe"), free_name(docs, "_place")
    rows = docs.withColumn(code, F.sha2(normalised(F.col(text_col)), 256))
    codes = cut_lineage(rows.select(code))
    slots = slots_for(codes.count(), max_slots)
    bits = cut_lineage(repeated_filter(codes, code, slots))
    marked = with_flag(rows, code, bits, slots, flag)
    straight = marked.filter(~F.col(flag)).select(*docs.columns)
    order = [F.char_length(F.coalesce(F.col(text_col), F.lit(""))).desc(), F.col(id_col).asc_nulls_last(), F.col(text_col).asc_nulls_last()]
    first = marked.filter(F.col(flag)).withColumn(place, F.row_number().over(W.partitionBy(code).orderBy(*order)))
    return straight.unionByName(first.filter(F.col(place) == 1).select(*docs.columns))
