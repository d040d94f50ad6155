"""Size checks that decide whether a side of a join may be broadcast, and salted joins beyond that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
SALTS = 16


def at_most(df: DataFrame, number: str, limit: int | None) -> DataFrame:
    """Rows whose ``number`` is at most ``limit``; all rows without one."""
    return df if limit is None else df.where(F.col(number) <= limit)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when the table has at most ``rows`` rows of ``size`` bytes together; reads no further than that many rows."""
    bytes_of = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    count, taken = df.limit(rows + 1).agg(F.count("*"), F.coalesce(bytes_of, F.lit(0))).first()
    return count <= rows and taken <= size


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
                rows: int = BROADCAST_ROWS, spread: list[str] | None = None) -> DataFrame:
    """Join a large table with a table that is usually small.

    The small side is broadcast only when counting it shows that it fits.  Otherwise both sides are
    shuffled; ``spread`` names columns of the large side whose hash cuts each key into ``SALTS`` pieces,
    so that one key holding a third of all rows still runs in many tasks.
    """
    if fits(small, rows):
        return big.join(F.broadcast(small), keys, how)
    if not spread:
        return big.join(small, keys, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
