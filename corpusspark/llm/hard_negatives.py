"""Hard negatives by a secondary-sort shuffle.

A pair's anchor, descending score, kind and id are packed into one binary key.  Pairs are partitioned by anchor and sorted by
that key inside their partitions (``repartition`` and ``sortWithinPartitions``, the DataFrame form of
repartitionAndSortWithinPartitions: the sort runs in the JVM and spills).  A streaming iterator then sees each anchor's pairs
from the best score down: a positive opens a window of scores, a negative goes to every open window it lies in, and
nothing of an anchor is kept but its few windows.

Anchors meet all rows in cells of bounded blocks (``ROW_BLOCK`` x ``ANCHOR_BLOCK``).  What a cell sends is cut to what can
matter: first its best positives of each anchor; then, with the windows known, the first negatives of each window.  Both
cuts are exact, because the first of all are among the first of each cell.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small_batches

ROW_BLOCK, ANCHOR_BLOCK, TILE = 4096, 4096, 256
PAIRS = "anchor long, anchor_id long, kind int, score long, id long, row long"
MINED = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()),
                   ("positive_score", pa.int64()), ("negative_score", pa.int64())])
#: Pairs a sorted partition should hold.
PARTITION_PAIRS = 1 << 20
KEY = ">QQBBQQ"
_SIGN, _LONG = 1 << 63, (1 << 64) - 1


def whole_vectors(vectors: DataFrame, id_col: str, label: Column, vec_col: str) -> DataFrame:
    """(id, label, vector, row) of the rows that take part: label, vector and every component present and finite."""
    x = F.col(vec_col)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("vector")) \
        .filter("label is not null").withColumn("row", F.monotonically_increasing_id())


def _matrix(table: pa.Table, scale: float) -> np.ndarray:
    """floor(scale * x) as float64, one row per vector, shorter vectors filled with zeros."""
    column = table["vector"].combine_chunks()
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(out * scale)


def _scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact integer inner products (anchors x rows); beyond a long they stand at its end."""
    width = min(rows.shape[1], anchors.shape[1])
    rows, anchors = rows[:, :width], anchors[:, :width]
    if width * np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) < 2.0**53:
        return (anchors @ rows.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(anchors).dot(whole(rows).T)
    return np.minimum(np.maximum(exact, -_SIGN), _SIGN - 1).astype(np.int64)


def _window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The negative scores n with low * positive <= 100 * n <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def _first(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores among the marked ones; equal scores in the order they stand."""
    at = np.flatnonzero(among)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def _cell(rows: pa.Table, anchors: pa.Table, scale: float, kind: int, k: int, low: int, high: int) -> pa.Table:
    """The pairs of a cell that can matter: best positives (kind 0) or first negatives of each window (kind 1)."""
    rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])  # nulls last
    ids, places, labels = rows["id"].to_pylist(), rows["row"].to_numpy(), rows["label"].to_numpy()
    theirs, sources, groups = anchors["id"].to_pylist(), anchors["row"].to_numpy(), anchors["label"].to_numpy()
    windows = anchors["positives"].to_pylist() if kind else None
    left, right = _matrix(rows, scale), _matrix(anchors, scale)
    found = []
    for start in range(0, len(sources), TILE):
        for i, scores in enumerate(_scores(left, right[start : start + TILE]), start):
            if kind:
                other = labels != groups[i]
                best = set()
                for positive in set(windows[i]):
                    least, most = _window(positive, low, high)
                    best.update(_first(scores, other & (scores >= least) & (scores <= most), k).tolist())
            else:
                best = _first(scores, (labels == groups[i]) & (places != sources[i]), k).tolist()
            found += [(int(sources[i]), theirs[i], kind, int(scores[j]), ids[j], int(places[j])) for j in best]
    columns = list(zip(*found)) if found else [[]] * 6
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table({f.split()[0]: pa.array(c, t) for f, c, t in zip(PAIRS.split(", "), columns, types)})


def _meet(rows: DataFrame, anchors: DataFrame, shape: tuple[int, int], scale: float, kind: int, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """Every row block with every anchor block: a cell per task turn, each of bounded size."""
    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.withColumn("_r", block(shape[0])).withColumn("_a", every(shape[1]))
    right = anchors.withColumn("_a", block(shape[1])).withColumn("_r", every(shape[0]))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        return _cell(a, b, scale, kind, k, low, high)

    return left.groupBy("_a", "_r").cogroup(right.groupBy("_a", "_r")).applyInArrow(cell, PAIRS)


def packed_key() -> Column:
    """anchor, descending score, positives first, id (null last), row: bytes that sort in this order."""
    def part(c: Column) -> Column:
        return F.lpad(F.hex(c.bitwiseXOR(F.lit(-_SIGN))), 16, "0")

    flag = F.concat(F.lit("0"), F.col("kind").cast("string"), F.when(F.col("id").isNull(), "01").otherwise("00"))
    return F.unhex(F.concat(part(F.col("anchor")), part(F.bitwise_not("score")), flag, part(F.coalesce("id", F.lit(0).cast("long"))), part(F.col("row"))))


def _open_windows(positives: int, negatives: int, low: int, high: int):
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, windows = None, []
        for batch in small_batches(batches, 8192):
            out = []
            for key, anchor_id in zip(batch.column("key").to_pylist(), batch.column("anchor_id").to_pylist()):
                anchor, score, kind, unknown, other, _ = struct.unpack(KEY, key)
                if anchor != current:
                    current, windows = anchor, []
                score, other = (score ^ _LONG) - _SIGN, None if unknown else other - _SIGN
                if not kind:
                    if len(windows) < positives:
                        windows.append([other, score, *_window(score, low, high), 0])
                    continue
                for window in windows:
                    positive_id, positive, least, most, given = window
                    if least <= score <= most and given < negatives:
                        window[4] += 1
                        out.append((anchor_id, positive_id, given + 1, other, positive, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), MINED.types)], schema=MINED)

    return mine


def mine(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = 5,
         negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """Per anchor and positive the first ``negatives`` rows of another label with low % <= negative / positive <= high %.

    ``is_anchor`` is a condition on the column ``id``.  A row's score is the inner product of the vectors' components
    ``floor(scale * x)``, exact at any size; beyond a long it stands at the long's end.  Higher scores come first, then
    smaller ids (null ids last), then repeated rows one by one.  Positives are the anchor's first ``positives`` other rows of
    its label; a repeated row is another row.  Rows without label or with a null, missing or non-finite component take no
    part.  Vectors of unequal length compare as if filled with zeros; an empty one scores 0.  Anchors without positives or
    without negatives in a window give no row; an empty table gives an empty result; other columns are ignored.
    """
    rows = cut_lineage(whole_vectors(vectors, id_col, label, vec_col))
    spark = rows.sparkSession
    chosen = rows.filter(is_anchor)
    total, asked = rows.count(), chosen.count()
    shape = max(1, -(-total // ROW_BLOCK)), max(1, -(-asked // ANCHOR_BLOCK))
    order = W.partitionBy("anchor").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    best = cut_lineage(_meet(rows, chosen, shape, scale, 0, positives).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= positives).drop("_n"))
    windows = best.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("score").alias("positives"))  # at most ``positives`` of them
    known = cut_lineage(chosen.join(windows, "row"))
    pairs = best.unionByName(_meet(rows, known, shape, scale, 1, negatives, low, high))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), asked * shape[0] * positives * (negatives + 1) // PARTITION_PAIRS)
    keyed = pairs.select("anchor", "anchor_id", packed_key().alias("key")).repartition(parts, "anchor").sortWithinPartitions("key")
    return keyed.select("key", "anchor_id").mapInArrow(_open_windows(positives, negatives, low, high), ", ".join(
        f"{f.name} {'int' if f.type == pa.int32() else 'long'}" for f in MINED))
