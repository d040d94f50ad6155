"""Small column expressions over strings and arrays.  All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped around values: the ASCII white space plus the wide and no-break spaces.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
CJK = "一-鿿"
CJK_TEXT = "[㐀-鿿]"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` mentions it.

    Without it every mention copies the whole expression into the plan, and nested copies multiply.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(WHITESPACE))


def strings(values) -> Column:
    """A literal string array; also right for an empty list."""
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(value: Column, needles) -> Column:
    return any_of(value.contains(n) for n in needles)


def starts_with_any(value: Column, prefixes) -> Column:
    return any_of(value.startswith(p) for p in prefixes)


def ends_with_any(value: Column, suffixes) -> Column:
    return any_of(value.endswith(s) for s in suffixes)


def lines_of(value: Column) -> Column:
    """Lines of a text; a break at the very end does not open another line."""
    return let(
        F.split(value, LINE_BREAK),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def grams(value: Column, size: int) -> Column:
    """All substrings of one length, left to right.  The text is split into characters once: work grows with its length."""
    chars = F.split(value, "")
    shifted = [F.slice(chars, k + 1, F.greatest(F.size(chars) - (size - 1), F.lit(1))) for k in range(size)]
    joined_up = F.transform(F.arrays_zip(*[s.alias(f"c{k}") for k, s in enumerate(shifted)]), lambda z: F.concat(*[z[f"c{k}"] for k in range(size)]))
    return F.when(F.char_length(value) >= size, joined_up).otherwise(strings([]))


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def drop_prefix(value: Column, prefix: str) -> Column:
    return F.when(value.startswith(prefix), F.substring(value, F.lit(len(prefix) + 1), F.char_length(value))).otherwise(value)


def drop_suffix(value: Column, suffix: str) -> Column:
    return F.when(
        value.endswith(suffix), F.substring(value, F.lit(1), F.char_length(value) - len(suffix))
    ).otherwise(value)


def index_path(path: Column) -> Column:
    """Path below the page folder (no ``wiki/`` in front)."""
    return drop_prefix(slashes(path), "wiki/")


def repo_path(path: Column) -> Column:
    """Path below the root folder (with ``wiki/`` in front)."""
    normalized = slashes(path)
    return F.when(normalized.startswith("wiki/"), normalized).otherwise(F.concat(F.lit("wiki/"), normalized))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    """Last suffix, lower-cased, with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def canonical_path(path: Column) -> Column:
    """Resolve ``.`` and ``..``.  A path that climbs above its start keeps a leading ``..``."""
    folded = F.aggregate(
        F.split(path, "/"),
        strings([]),
        lambda acc, part: F.when((part == "") | (part == "."), acc)
        .when(
            (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        )
        .otherwise(F.concat(acc, F.array(part))),
    )
    return F.array_join(folded, "/")


def collapse_spaces(value: Column) -> Column:
    return strip(F.regexp_replace(value, r"(?U)\s+", " "))


def has_cjk(value: Column) -> Column:
    return value.rlike(CJK_TEXT)


def joined(values: Column) -> Column:
    """Array to text, for reports and comparisons."""
    return F.array_join(values, "|")
