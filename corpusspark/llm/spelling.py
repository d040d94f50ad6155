"""Spelling variants by dense prefix-suffix tiling.

Two words differ by exactly one inserted, deleted or replaced code point when the lengths of their common prefix and common
suffix together reach the longer word's length minus one.  Blocks of words lie as padded code-point matrices, once from the
left and once from the right, and a tile compares all pairs of two blocks column by column.

Only words that can be near share a block.  With ``m`` the shorter length, the edit leaves either the first ``m // 2`` code
points alone or the last ``m - m // 2``; a word stands in the prefix and the suffix group of its own length and of the
length below.  A group of any size is cut into blocks of bounded size and its pairs of blocks into cells, so a very common
beginning is many tasks.  Cells return counts and a best neighbour per word, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import join_groups, small_batches

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGE = 6, 5, 5, 199
#: A block holds about this many words, or fewer long ones: about ``BLOCK * USUAL`` code points.
BLOCK, USUAL = 1024, 32
TILE = 1 << 20
FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): the lower-cased letter runs of all texts, some of them with a deleted letter, that occur often enough.

    A run loses the code point ``h % length`` when ``damage`` divides ``h``, the CRC-32 of ``<doc_id>:<run>``; a null id
    counts as empty.  Null texts have no words.  Counts are added up before the shuffle, so frequent words cost a row per task.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    coded = low.withColumn("code", F.crc32(F.concat("id", F.lit(":"), F.col("run")).cast("binary")))
    place = (F.col("code") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    words = coded.select(F.when(F.col("code") % damage == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _groups(words: DataFrame) -> DataFrame:
    """Each word in its prefix and suffix groups: (key, front, m, word, n)."""
    sized = words.withColumn("len", F.char_length("word")).withColumn("m", F.explode(F.array("len", F.col("len") - 1)))
    half = F.expr("m div 2").cast("int")
    part = F.when(F.col("front"), F.substring("word", F.lit(1), half)).otherwise(F.substring("word", F.col("len") - F.col("m") + half + 1, F.col("m") - half))
    each = sized.withColumn("front", F.explode(F.array(F.lit(True), F.lit(False))))
    return each.select(F.concat_ws(":", "front", "m", F.xxhash64(part)).alias("key"), "front", "m", "word", "n", (F.col("len") == F.col("m")).alias("short"))


def _cells(words: DataFrame) -> DataFrame:
    """Rows of the groups' cells: pairs of blocks (i <= j), each word with the block it is in."""
    rows = cut_lineage(_groups(words))
    groups = rows.groupBy("key").agg(F.count("*").alias("size"), F.max("short").alias("any_short")).filter("size > 1 and any_short").drop("any_short")
    placed = join_groups(rows, cut_lineage(groups), "key", "size", rows.count())
    blocks = F.least("size", F.ceil(F.col("size") * F.greatest("m", F.lit(USUAL)) / (BLOCK * USUAL)))
    cut = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")))
    other = cut.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return other.select("key", "front", "m", "word", "n", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))


class _Block:
    """Words by descending count, then in code-point order, as matrices padded with zeros."""

    def __init__(self, words: list[tuple[int, str]]) -> None:
        self.rows = sorted(words, key=lambda r: (-r[0], r[1]))
        texts = [w for _, w in self.rows]
        self.lengths = np.array([len(w) for w in texts], np.int32)
        width = int(self.lengths.max(initial=0))
        self.left, self.right = (self._matrix(t, width) for t in (texts, [w[::-1] for w in texts]))

    @staticmethod
    def _matrix(texts: list[str], width: int) -> np.ndarray:
        """Code points, a column per place: the layout that a tile walks through."""
        filled = "".join(t.ljust(width, "\0") for t in texts)
        try:
            points = np.frombuffer(filled.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            points = np.frombuffer(filled.encode("utf-32-le"), np.uint32)
        return np.ascontiguousarray(points.reshape(len(texts), width).T)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of all pairs of columns."""
    running = np.ones((a.shape[1], b.shape[1]), bool)
    length = np.zeros(running.shape, np.uint8 if min(len(a), len(b)) < 256 else np.int32)
    for x, y in zip(a, b):
        running &= x[:, None] == y[None, :]
        if not running.any():
            break
        length += running
    return length


def _compare(a: _Block, b: _Block, front: bool, m: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, count of the best, the best) of the words of both blocks; of one block when they are the same."""
    step = max(1, TILE // max(1, len(b.rows)))
    counts, best = np.zeros(len(b.rows), np.int64), np.full(len(b.rows), -1)
    for start in range(0, len(a.rows), step):
        stop = start + step
        prefix = _common(a.left[:, start:stop], b.left)
        total = prefix.astype(np.int32) + _common(a.right[:, start:stop], b.right)
        mine, theirs = a.lengths[start:stop, None], b.lengths[None, :]
        near = (total >= np.maximum(mine, theirs) - 1) & (np.minimum(mine, theirs) == m)
        near &= (prefix >= m // 2) if front else (prefix < m // 2)  # a pair counts in one of its two groups
        if a is b:
            near[np.arange(near.shape[0]), np.arange(start, start + near.shape[0])] = False
        for i in np.flatnonzero(near.any(1)):
            yield a.rows[start + i][1], int(near[i].sum()), *b.rows[int(near[i].argmax())]
        if a is not b:
            counts += near.sum(0)
            new = (best < 0) & near.any(0)
            best[new] = start + near[:, new].argmax(0)
    for j in np.flatnonzero(counts):
        yield b.rows[j][1], int(counts[j]), *a.rows[best[j]]


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted cells; holds one pair of blocks at a time."""
    current, blocks, out = None, {}, []

    def close() -> None:
        if current and len(blocks) + (current[1] == current[2]) == 2:
            a, b = _Block(blocks[current[1]]), None
            b = a if current[1] == current[2] else _Block(blocks[current[2]])
            out.extend(_compare(a, b, current[3], current[4]))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND)
        out.clear()
        return batch

    for batch in small_batches(batches, 8192):
        columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "front", "m", "block", "n", "word")]
        for *cell, block, n, word in zip(*columns):
            if cell != current:
                close()
                current, blocks = cell, {}
                if len(out) > 50_000:
                    yield flush()
            blocks.setdefault(block, []).append((n, word))
    close()
    if out:
        yield flush()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words with a near one; the best has the largest n, then is first in code-point order."""
    cells = _cells(words).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = cells.mapInArrow(_tile, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("c"), F.col("best").alias("w"))).alias("best")).select(
        "word", "n_near", (-F.col("best.c")).alias("best_n"), F.col("best.w").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form, by doubling: each round follows as many forms as all rounds before together.

    A form occurs at least ``RATIO`` times as often as its word, so chains are short and have no circles.
    """
    roots = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        roots = step.drop("moved")


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n) -> word, n, n_near, form, form_n, root; a row per word.

    The form is the near word of largest n (ties: smallest in code-point order) if it occurs at least ``ratio`` (2 or more)
    times as often, else null; the root is where following forms ends.  Words are different, not null and hold no U+0000;
    their length is free.  An empty table gives an empty result.
    """
    words = cut_lineage(words.select("word", "n"))
    enough = F.col("best_n") >= F.lit(ratio) * F.col("n")
    told = cut_lineage(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")))
    roots = _roots(told.filter("form is not null"))
    return told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants among the words of all documents; repeated rows count again, other columns are ignored."""
    return variant_groups(vocabulary(docs, id_col, text_col)).select("word", "form", "root", "n", "n_near", "form_n")
