"""Which search strings occur in which texts: one pass over each text finds all strings of a dictionary.

The strings form an automaton (Aho-Corasick), so a text is read once however many strings there are and however short
they are.  A dictionary of checked size is broadcast and texts stay where they are.  A larger one is cut into pieces;
texts, cut into chunks of bounded bytes, meet every piece in a cell of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import accumulate, chain
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import BROADCAST_ROWS, fits

#: Strings of a dictionary piece and bytes of text of a chunk when the dictionary is too large to be broadcast.
PIECE_ROWS, CHUNK_BYTES = 200_000, 32 << 20
SLICE_ROWS = 256
#: Length of short strings, and how many of them are looked for one by one.
SHORT, FEW_SHORT = 2, 256
#: Strings of at least this length are long: an automaton takes about 50 bytes for each character.
HEAD = 32
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package
_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}


class Strings:
    """The (string, value) rows of one key: an automaton, and beside it the short strings if they are few and the long ones.

    Short strings occur all over a text and the automaton stops at each place, where looking for one stops at the first place.
    Of long strings, which may be whole texts, an automaton of their own has the heads; the rest is compared where a head stands.
    """

    def __init__(self, rows: list[tuple]) -> None:
        short = {needle: value for needle, value in rows if len(needle) <= SHORT}
        self.short = list(short.items()) if len(short) <= FEW_SHORT else []
        self.automaton, self.heads = ahocorasick.Automaton(), ahocorasick.Automaton()
        long: dict[str, list[tuple]] = {}
        for needle, value in rows:
            if len(needle) >= HEAD:
                long.setdefault(needle[:HEAD], []).append((needle, value))
            elif not self.short or needle not in short:
                self.automaton.add_word(needle, value)
        for head, of_head in long.items():
            self.heads.add_word(head, of_head)
        self.automaton.make_automaton()
        self.heads.make_automaton()

    def found(self, text: str) -> list:
        values = set(map(itemgetter(1), self.automaton.iter(text))) if len(self.automaton) else set()
        values.update([value for needle, value in self.short if needle in text])
        for end, of_head in self.heads.iter(text) if len(self.heads) else ():
            values.update([value for needle, value in of_head if text.startswith(needle, end + 1 - HEAD)])
        return sorted(values)


class Dictionary:
    """Strings of (key, string, value) rows by key."""

    def __init__(self, rows: list[tuple]) -> None:
        by_key: dict[tuple, list[tuple]] = {}
        for *key, needle, value in rows:
            by_key.setdefault(tuple(key), []).append((needle, value))
        self.strings = {key: Strings(of_key) for key, of_key in by_key.items()}

    def found(self, key: tuple, text: str | None) -> list:
        """The values of the different strings of that key in the text, sorted."""
        strings = self.strings.get(key)
        return strings.found(text) if strings and text else []


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    """The lists as a column; their values are converted in one go."""
    offsets = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(list(chain.from_iterable(rows)), kind))


def _scan(batch: pa.RecordBatch, dictionary: Dictionary, same: list[str], fields: list[str], keep: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(start, SLICE_ROWS)
        keys = list(zip(*[part.column(c).to_pylist() for c in same])) if same else [()] * part.num_rows
        lists = [_lists(list(map(dictionary.found, keys, part.column(f).to_pylist())), kind) for f in fields]
        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *lists], [*keep, *[f"{f}_found" for f in fields]])


def found_in(needles: DataFrame, texts: DataFrame, fields: list[str], keep: list[str] | None = None, same: list[str] | None = None,
             value: str = "needle", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The columns ``keep`` of each text with arrays ``<field>_found``: the values of the strings that the field contains.

    ``needles`` has different rows of a non-empty string column ``needle``, a column ``value`` (string, int or long) and the
    columns ``same``, which must equal those of the text's row.  Null and empty fields contain nothing.
    """
    same, keep = same or [], texts.columns if keep is None else keep
    narrow = texts.select(*dict.fromkeys([*keep, *same, *fields]))
    entries = needles.select(*same, "needle", F.col(value).alias("_value"))
    value_type = entries.schema["_value"].dataType
    schema = T.StructType([*[narrow.schema[c] for c in keep], *[T.StructField(f"{f}_found", T.ArrayType(value_type)) for f in fields]])
    kind = _ARROW[value_type]
    if fits(entries, broadcast_rows):
        rows = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in entries.collect()])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dictionary = Dictionary(rows.value)
            for batch in batches:
                yield from _scan(batch, dictionary, same, fields, keep, kind)

        return narrow.mapInArrow(scan, schema)

    count = entries.count()
    size = narrow.agg(F.coalesce(F.sum(sum((F.coalesce(F.octet_length(f), F.lit(0)) for f in fields), F.lit(64))), F.lit(0))).first()[0]
    pieces, chunks = max(1, -(-count // PIECE_ROWS)), max(1, -(-size // CHUNK_BYTES))
    row = F.xxhash64(*narrow.columns)

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = narrow.withColumn("_row", row).withColumn("_chunk", F.pmod("_row", F.lit(chunks)).cast("int")).withColumn("_piece", each(pieces))
    right = entries.withColumn("_piece", F.pmod(F.xxhash64("needle"), F.lit(pieces)).cast("int")).withColumn("_chunk", each(chunks))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        dictionary = Dictionary(list(zip(*[b[c].to_pylist() for c in (*same, "needle", "_value")])))
        parts = [p for batch in a.to_batches() for p in _scan(batch, dictionary, same, fields, [*keep, "_row"], kind)]
        return pa.Table.from_batches(parts) if parts else pa.table({f.name: pa.array([], f.type) for f in target})

    wide = T.StructType([*schema.fields[: len(keep)], T.StructField("_row", T.LongType()), *schema.fields[len(keep):]])
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(wide)
    met = left.groupBy("_piece", "_chunk").cogroup(right.groupBy("_piece", "_chunk")).applyInArrow(cell, wide)
    if pieces == 1:
        return met.drop("_row")
    # Equal rows find the same strings in every piece, so each of them gets the union.
    copies = F.count("*").alias("_copies")
    each_piece = met.groupBy(*keep, "_row", *[f"{f}_found" for f in fields]).agg(copies)
    whole = each_piece.groupBy(*keep, "_row").agg(
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{f}_found")))).alias(f"{f}_found") for f in fields],
        (F.sum("_copies") / pieces).cast("long").alias("_copies"))
    return whole.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*keep, *[f"{f}_found" for f in fields])


def contained(needles: DataFrame, texts: DataFrame, text: str, same: list[str] | None = None,
              broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``texts`` with each distinct ``needle`` that the column ``text`` contains.

    ``needles`` has a string column ``needle`` (empty and null ones count for nothing) and the columns ``same``, which
    must equal those of the text's row.
    """
    same = same or []
    distinct = needles.select(*same, "needle").where(F.char_length("needle") > 0).distinct()
    found = found_in(distinct, texts, [text], same=same, broadcast_rows=broadcast_rows)
    return found.withColumn("needle", F.explode(f"{text}_found")).drop(f"{text}_found")
