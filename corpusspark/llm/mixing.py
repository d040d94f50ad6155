"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the mixture's characters over its present characters.  Each document
gets a Poisson number of copies with that mean: the distribution is inverted at a number that only the seed and the
document's id decide, so lost tasks give the same copies again.  Copies are exploded and ordered by a second hash over
the whole output: one range shuffle, the only one that moves texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import free_name, join_groups, uniform

#: Largest rate that is inverted in one step, and the copies of a row that one array holds.
PART_RATE, CHUNK = 1024, 4096


def source_rates(docs: DataFrame, weights: DataFrame | None = None, repetition: float = 1.0, source_col: str = "source",
                 text_col: str = "text") -> DataFrame:
    """(source, rows, chars, rate): mean copies per document.

    ``weights`` (source, weight) are relative; sources that it does not name, or names with null or a negative weight,
    get none.  Without a table all sources weigh the same.  ``repetition`` scales the mixture against the input's
    characters.  A null source is a source of its own, named ''.  Sources without characters have rate 0.
    """
    source = F.coalesce(F.col(source_col), F.lit("")).alias("source")
    sizes = cut_lineage(docs.select(source, F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("c")).groupBy("source").agg(
        F.count("*").alias("rows"), F.sum("c").alias("chars")))
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        wanted = weights.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("source")).agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))
        weighed = sizes.join(wanted, "source", "left").fillna(0.0, ["weight"])
    weighed = weighed.withColumn("weight", F.when(F.col("chars") > 0, F.col("weight")).otherwise(0.0))
    chars, weight = weighed.agg(F.sum("chars"), F.sum("weight")).first()
    rate = F.lit(repetition) * F.col("weight") / F.lit(weight or 1.0) * F.try_divide(F.lit(chars or 0), F.col("chars"))
    return weighed.select("source", "rows", "chars", F.coalesce(F.when(F.col("weight") > 0, rate), F.lit(0.0)).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """P(copies <= 0), P(copies <= 1) ... far into the tail; terms in logarithms.  For rates up to ``PART_RATE``."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    logs = F.aggregate(F.sequence(F.lit(1), last), F.array(-rate), lambda s, k: F.concat(s, F.array(F.element_at(s, -1) + F.log(rate) - F.log(k.cast("double")))))
    sums = F.aggregate(logs, F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.exp(x))))
    return F.when(rate > 0, F.slice(sums, 2, F.size(sums) - 1)).otherwise(F.array(F.lit(1.0)))


def _copies(steps: Column, parts: Column, keys: list[Column]) -> Column:
    """Inverts the distribution at the row's number; a rate in several parts is a sum of independent draws, one per part."""
    def drawn(*more: Column) -> Column:
        u = uniform(*keys, *more)
        return F.size(F.filter(steps, lambda c: c <= u)).cast("long")

    rest = F.aggregate(F.sequence(F.lit(2).cast("long"), parts), F.lit(0).cast("long"), lambda n, j: n + drawn(j))
    return drawn() + F.when(parts > 1, rest).otherwise(F.lit(0).cast("long"))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 0, id_col: str = "doc_id", source_col: str = "source",
              copy: str = "copy", copies: str = "copies", order: str = "order_key") -> DataFrame:
    """docs' columns with copy (from 1), copies and order_key, a row per copy, globally ordered by order_key.

    rates (source, rows, rate).  Rows that repeat an id get the same number of copies each; null ids count as one id.
    Added columns get underscores in front where the table has their names already.  An empty table gives an empty one.

    A rate above ``PART_RATE`` (a tiny source beside a huge one) is drawn as the sum of equal parts below it, so its
    cost grows with the copies it makes.  More than ``CHUNK`` copies of a row are made in chunks dealt over the tasks.
    """
    copy, copies, order = free_name(docs, copy), free_name(docs, copies), free_name(docs, order)
    name, steps, size, parts, chunk = (free_name(docs, x) for x in ("_source", "_steps", "_rows", "_parts", "_chunk"))
    rate, in_parts = F.col("rate"), F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1).cast("long"))
    table = cut_lineage(rates.select(F.col("source").alias(name), poisson_steps(rate / in_parts).alias(steps), in_parts.alias(parts), F.col("rows").alias(size)))
    total, most = table.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(parts), F.lit(1))).first()
    rows = docs.withColumn(name, F.coalesce(F.col(source_col), F.lit("")))
    drawn = _copies(F.col(steps), F.col(parts), [F.lit(seed), F.col(id_col)])
    counted = join_groups(rows, table, name, size, total).withColumn(copies, drawn).select(*docs.columns, copies).filter(F.col(copies) > 0)
    one = F.lit(1).cast("long")
    if most == 1:  # no row can have more copies than a short array holds
        many = counted.withColumn(copy, F.explode(F.sequence(one, F.col(copies))))
    else:
        few = counted.filter(F.col(copies) <= CHUNK).withColumn(copy, F.explode(F.sequence(one, F.col(copies))))
        cut = counted.filter(F.col(copies) > CHUNK).withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{copies}` - 1) div {CHUNK}"))))
        first = F.col(chunk) * CHUNK + 1
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = cut.repartition(tasks, id_col, chunk).withColumn(copy, F.explode(F.sequence(first, F.least(first + (CHUNK - 1), F.col(copies)))))
        many = few.unionByName(dealt.drop(chunk))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(copy).cast("string"))), 1, 15), 16, 10).cast("long")
    out = many.select(*docs.columns, copy, copies, key.alias(order))
    return out.repartitionByRange(order, id_col, copy).sortWithinPartitions(order, id_col, copy)


def checked_mixture(docs: DataFrame, rates: DataFrame, seed: int = 0, id_col: str = "doc_id", source_col: str = "source",
                    text_col: str = "text") -> DataFrame:
    """:func:`replicate` of the whole rows; a copy whose text differs in length or checksum from what was sent ends the job.

    The order column is read through that test, so no reader of it can leave the texts out of the shuffle.
    """
    sent = free_name(docs, "_sent")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.struct(F.char_length(text), F.crc32(text.cast("binary")))
    out = replicate(docs.withColumn(sent, digest), rates, seed, id_col, source_col)
    order = out.columns[-1]
    fault = F.raise_error(F.concat(F.lit("text of a copy differs from what was sent: "), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return out.withColumn(order, F.when(F.col(sent) == digest, F.col(order)).otherwise(fault.cast("long"))).drop(sent)
