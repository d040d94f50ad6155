"""Pipe tables of Markdown documents as rows, folded out of each text where it stands."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import LINE_BREAK, WHITESPACE

_BREAK, _RULE = re.compile(LINE_BREAK), re.compile(":?-{3,}:?")
SLICE_ROWS = 256
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package


def _cells(line: str) -> list[str]:
    return [c.strip(WHITESPACE) for c in line.strip(WHITESPACE).strip("|").split("|")]


def _is_table(line: str) -> bool:
    s = line.strip(WHITESPACE)
    return s.startswith("|") and s.endswith("|") and s.count("|") >= 2


def _is_rule(line: str) -> bool:
    return "---" in line and all(_RULE.fullmatch(c) for c in _cells(line))


def rows_of(text: str) -> list[tuple[int, list[str], list[str]]]:
    """(line of the header, header cells, cells) of all table rows, in one pass over the lines.

    A table starts at the first line of a run of table lines that a separator follows; a row counts when it has as many
    cells as the header.  A separator without pipes ends the run of its header, and the run after it holds the rows.
    """
    lines = _BREAK.split(text)
    if lines[-1] == "":
        lines.pop()
    out: list[tuple[int, list[str], list[str]]] = []
    table = [_is_table(x) for x in lines]
    at, handed = 0, -1  # ``handed``: a header whose rows are in the run that begins two lines below it
    while at < len(lines):
        if not table[at]:
            at += 1
            continue
        end = at
        while end < len(lines) and table[end]:
            end += 1
        own = next((j for j in range(at, end) if j + 1 < len(lines) and _is_rule(lines[j + 1])), -1)
        header = handed if 0 <= handed == at - 2 else own
        if header >= 0:
            names = _cells(lines[header])
            for line in lines[max(at, header + 2) : end]:
                cells = _cells(line)
                if len(cells) == len(names):
                    out.append((header, names, cells))
        handed = own if own == end - 1 else -1
        at = end
    return out


def table_rows(documents: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, row_index, table_line, headers, cells): rows of all tables in reading order; see :func:`rows_of`.

    Texts stay in their task and only the extracted rows leave it: nothing is shuffled.
    """
    held = documents.where(F.col(text).rlike(r"(?m)^[ \t|]*:?-{3,}")).select(*key, F.col(text).alias("_text"))
    cells = T.ArrayType(T.StringType())
    schema = T.StructType([*held.schema.fields[:-1], T.StructField("row_index", T.IntegerType()), T.StructField("table_line", T.IntegerType()),
                           T.StructField("headers", cells), T.StructField("cells", cells)])
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                found = [(i, n, *row) for i, t in enumerate(part.column("_text").to_pylist()) for n, row in enumerate(rows_of(t), 1)]
                if found:
                    at, *columns = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(c).take(pa.array(at, pa.int32())) for c in key], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                        [*key, "row_index", "table_line", "headers", "cells"])

    return held.mapInArrow(fold, schema)


def cell_named(names: list[str], headers: str = "headers", cells: str = "cells") -> Column:
    """Value of the first column whose lower-cased name is one of ``names``; empty when there is none."""
    hit = F.filter(F.arrays_zip(headers, cells), lambda z: F.lower(z[headers]).isin([n.lower() for n in names]))
    return F.coalesce(F.try_element_at(hit, F.lit(1))[cells], F.lit(""))
