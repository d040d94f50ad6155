"""Scores of (query, entry) pairs in cells of bounded size: each task adds up posting lists and keeps the best of its cell.

A cell holds some entries of a root and some of its queries.  A word that a quarter of the entries hold is a row of points
for all of them, a rarer one is a list of entries, so a pair costs a few additions of numbers that stand side by side.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package
#: Words that at least 1 / DENSE of a cell's entries hold are rows of points.
DENSE = 4
SLICE_ROWS, SLICE_PAIRS = 512, 1 << 19
TOP = (1 << 31) - 1


def _pairs(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, id) of every id in a column of lists."""
    lists = column.combine_chunks()
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pc.list_flatten(column.combine_chunks())


def _slices(column: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same, some rows at a time: the lists of a cell's entries are the larger part of its memory."""
    for start in range(0, len(column), SLICE_ROWS):
        row, ids = _pairs(column.slice(start, SLICE_ROWS))
        yield row + start, ids


class Postings:
    """Points of the words of a cell; words are numbered by their place in ``words``.

    ``pairs`` has a number (word * n_entries + entry) * len(points) + kind for each place of a word, with points[kind].
    """

    def __init__(self, pairs: np.ndarray, points: list[int], n_words: int, n_entries: int) -> None:
        pairs.sort()
        kinds, gains = len(points), np.array(points, dtype=np.int32)
        entries, sums, counts = [], [], np.zeros(n_words + 1, dtype=np.int64)
        # Slices that end between two pairs keep the numbers of a step short, whatever the cell holds.
        bounds = [0]
        while bounds[-1] < len(pairs):
            end = min(bounds[-1] + SLICE_PAIRS, len(pairs))
            bounds.append(int(np.searchsorted(pairs, (pairs[end - 1] // kinds + 1) * kinds)))
        for start, end in zip(bounds, bounds[1:]):
            pair, kind = np.divmod(pairs[start: end], kinds)
            firsts = np.flatnonzero(np.diff(pair, prepend=-1))
            sums.append(np.add.reduceat(gains[kind], firsts, dtype=np.int32))
            word, entry = np.divmod(pair[firsts], n_entries)
            entries.append(entry.astype(np.int32))
            counts[1:] += np.bincount(word, minlength=n_words)
        self.entry, self.points = (np.concatenate([np.zeros(0, dtype=np.int32), *x]) for x in (entries, sums))
        self.start = np.cumsum(counts)
        self.rows = {}
        for w in np.flatnonzero(np.diff(self.start) * DENSE >= n_entries).tolist():
            self.rows[w] = np.zeros(n_entries, dtype=np.int32)
            self._add_listed(w, self.rows[w])

    def _add_listed(self, word: int, scores: np.ndarray) -> None:
        at = slice(self.start[word], self.start[word + 1])
        scores[self.entry[at]] += self.points[at]

    def add(self, word: int, scores: np.ndarray) -> None:
        row = self.rows.get(word)
        if row is not None:
            scores += row
        else:
            self._add_listed(word, scores)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest positive scores, the first ones of those that are equal to the least."""
    positive = np.flatnonzero(scores > 0)
    if len(positive) <= k:
        return positive
    values = scores[positive]
    least = np.partition(values, len(values) - k)[len(values) - k]
    above = positive[values > least]
    return np.concatenate([above, positive[values == least][: k - len(above)]])


def packed(scores: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Score and entry number in one: ascending values are descending scores, then ascending numbers."""
    return ((TOP - scores.astype(np.int64)) << 32) | numbers.astype(np.int64)


def unpacked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return TOP - (values >> 32), values & 0xFFFFFFFF


def scored_cell(entries: pa.Table, queries: pa.Table, fields: list[tuple[str, int]], whole: list[tuple[str, int]],
                priors: dict[tuple[str, str], int], schema: pa.Schema) -> pa.Table:
    """The k best entries of every query of the cell, ties in the order of path and entry_pos.

    A schema with a column ``best`` asks for a row per query that lists them, each as its score and its number ``no`` in that
    order (:func:`packed`); another one for a row per query and entry.

    ``fields`` are the lists of word ids of an entry and the points of a word in them.  ``whole`` are the lists in which the
    query as a whole may stand: the first one that has it counts.  ``priors`` has the points of (kind, flags).
    """
    if not entries.num_rows or not queries.num_rows:
        return schema.empty_table()
    listed = "best" in schema.names
    order = ["no"] if listed else ["path", "entry_pos"]
    order = pc.sort_indices(entries, [(c, "ascending") for c in order], null_placement="at_start")
    n = entries.num_rows
    # The lists stay as they came; their rows are renamed to places in the order.
    place_of = np.empty(n, dtype=np.int64)
    place_of[order.to_numpy()] = np.arange(n)
    query_of, tokens = _pairs(queries["tokens"])
    wholes = queries["whole"].to_pylist()
    words = np.unique(np.concatenate([tokens, np.array([w for w in wholes if w is not None], dtype=np.int64)]))
    place = {w: int(np.searchsorted(words, w)) for w in set(wholes) - {None}}
    is_whole = np.zeros(len(words) + 1, dtype=bool)
    is_whole[list(place.values())] = True
    # Room for every place of a word, of which those that no query asks for stay untouched.
    by_place, used, in_whole = np.empty(sum(len(_flat(entries[name])) for name, _ in fields), dtype=np.int64), 0, []
    ranks = {name: i for i, (name, _) in enumerate(whole)}
    for i, (name, _) in enumerate(fields):
        for row, word in _slices(entries[name]):
            at = np.minimum(np.searchsorted(words, word), max(len(words) - 1, 0))
            kept = words[at] == word if len(words) else np.zeros(len(word), dtype=bool)
            pair = at[kept] * n + place_of[row[kept]]
            by_place[used: used + len(pair)] = pair * len(fields) + i
            used += len(pair)
            if name in ranks:
                in_whole.append(pair[is_whole[at[kept]]] * len(whole) + ranks[name])
    by_place, in_whole = by_place[:used], np.concatenate([np.zeros(0, dtype=np.int64), *in_whole])
    by_word = Postings(by_place, [points for _, points in fields], len(words), n)
    # The first of the lists that has the whole query counts.
    in_whole.sort()
    first = np.flatnonzero(np.diff(in_whole // len(whole), prepend=-1))
    del by_place
    by_whole = Postings(in_whole[first], [points for _, points in whole], len(words), n)
    entries = entries.select([c for c in entries.column_names if c not in dict(fields)]).take(order)

    kinds, kind_of = np.unique(np.array(entries["kind"].to_pylist(), dtype=object).astype(str), return_inverse=True)
    prior = {f: np.array([priors[k, f] for k in kinds], dtype=np.int32)[kind_of] for f in set(queries["flags"].to_pylist())}
    bounds = np.searchsorted(query_of, np.arange(queries.num_rows + 1))
    token_place = np.searchsorted(words, tokens)
    found, owner, gained = [], [], []
    for i, (flags, k, w) in enumerate(zip(queries["flags"].to_pylist(), queries["k"].to_pylist(), wholes)):
        scores = prior[flags].copy()
        for t in token_place[bounds[i]: bounds[i + 1]].tolist():
            by_word.add(t, scores)
        if w is not None:
            by_whole.add(place[w], scores)
        chosen = best(scores, k)
        found.append(chosen)
        owner.append(np.full(len(chosen), i))
        gained.append(scores[chosen])
    if listed:
        values = packed(np.concatenate(gained), entries["no"].to_numpy()[np.concatenate(found)])
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        return pa.table([lists.cast(f.type) if f.name == "best" else queries[f.name].cast(f.type) for f in schema], schema=schema)
    entry, query = pa.array(np.concatenate(found)), pa.array(np.concatenate(owner))
    from_query, from_entry = queries.select(["query_id", "root_id", "k"]).take(query), entries.select(["entry_pos", "path"]).take(entry)
    columns = {**{c: from_query[c] for c in from_query.column_names}, **{c: from_entry[c] for c in from_entry.column_names}, "score": pa.chunked_array([pa.array(np.concatenate(gained))])}
    return pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema)
