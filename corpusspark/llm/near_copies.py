"""Similarity join on word shingles by a MinHash LSH forest, followed by exact verification.

A text's set holds its different runs of five words.  Each of the forest's trees labels a text by ``DEPTH`` MinHash values.
The labels of a tree, sorted, are its prefix trie: neighbours in that order share the longest prefixes, and one sorted pass
tells for every label how deep it has company (:func:`_reach`); labels without any drop out there.  Texts with equal sets
are one entry, so copies cost nothing further.

Matching starts at whole labels and shortens the prefix step by step.  A step compares only entries that share the shorter
prefix and did not share the longer one in any tree.  After each step an entry's likely partners tell how many more it
should still have: it leaves the search once that number is below ``1 - recall``; two entries that have left are not
compared again.  Entries that still lack partners go on, down to the prefix that finds a pair at the threshold itself with
the target recall.  So groups of close copies, which fill the large nodes, are settled by long prefixes.

Work is laid out in cells.  A node with up to ``BLOCK`` entries is one cell; a larger one is cut into blocks, a cell
per pair of blocks, so a group of near copies of any size is many tasks of bounded size.  A pair counts in the first tree
where it meets.  The steps see only signatures and name the entries that have a likely partner; in the end those get
their texts, and the sets are compared exactly.  Cells return counts and one root per linked entry, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bloom import slot_filter, slots_for, with_flag
from .common import free_name, join_groups, small_batches, trim_memory
from .components import smallest_in_component

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH, STEP = 32, 10, 2
BLOCK = 256
#: An entry's least similar partner is taken to be this many standard deviations less similar than its signature says.
DOUBT = 3.0
#: Signatures are compared with this many standard deviations to spare before the exact test.
SPARE = 5.0
SLICE, KNOWN_WORDS, PAIRS = 1 << 20, 400_000, 1 << 16
#: A text with a word: a character that str.split keeps.
WORDED = "[^" + "".join(f"\\u{c:04x}" for c in range(1 << 16) if chr(c).isspace()) + "]"

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF for k in range(64)], np.uint64)


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, from the full label down, that finds a pair at the threshold with the target recall."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def prefix_steps(threshold: float, recall: float) -> list[int]:
    """Prefix lengths in the order they are matched: the whole label first, the shortest that can be needed last."""
    last = prefix_length(threshold, recall=recall)
    return [*range(DEPTH, last, -STEP), last]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """word -> place of its hash."""

    def __init__(self):
        super().__init__()
        self.values: list[int] = []

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self.values)
        self.values.append(xxhash.xxh64_intdigest(word))
        return place


def shingle_sets(texts: list[str | None], known: _Hashes, words: int = WORDS) -> list[np.ndarray]:
    """Sorted hashes of each text's runs of ``words`` words.  Words are what white space parts; a shorter text is one
    run; a text without words has none."""
    if len(known) > KNOWN_WORDS:
        known.clear()
        known.values.clear()
    split = [(t or "").split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    places = np.fromiter((known[w] for s in split for w in s), np.int64, int(counts.sum()))
    if not len(places):
        return [np.zeros(0, np.uint64) for _ in texts]
    hashed = np.array(known.values, np.uint64)[places]
    padded = np.concatenate([hashed, np.zeros(words - 1, np.uint64)])
    total = len(hashed)
    runs = np.zeros(total, np.uint64)
    for k in range(words):
        runs += padded[k : k + total] * _MULTIPLIERS[k]
    runs = _mix(runs)
    out, start = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(runs[start : start + n - words + 1]))
        elif n:
            short = (hashed[start : start + n] * _MULTIPLIERS[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(_mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out


def set_key(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for the set; none for an empty set."""
    if not len(shingles):
        return None
    a = int(_mix(shingles + np.uint64(1)).sum(dtype=np.uint64))
    b = int(np.bitwise_xor.reduce(_mix(shingles ^ np.uint64(0x5851F42D4C957F2D)))) ^ len(shingles)
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """(sets, size) bytes: a hash of the smallest image of the set under each of ``size`` functions.  No set is empty."""
    low = np.concatenate(sets)
    low = (low >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *[len(s) for s in sets][:-1]])
    out = np.empty((size, len(sets)), np.uint8)
    factors = _mix(np.arange(2 * size, dtype=np.uint64) + np.uint64(77))
    for i in range(size):
        image = (low ^ np.uint32(factors[size + i] >> np.uint64(32))) * (np.uint32(factors[i] >> np.uint64(32)) | np.uint32(1))
        image ^= image >> np.uint32(15)
        least = np.minimum.reduceat(image, starts)
        out[i] = (least * np.uint32(2654435761)) >> np.uint32(24)
    return out.T


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in small_batches(batches):
            texts = batch.column("text").to_pylist()
            keys: list[bytes | None] = []
            sketches: list[bytes | None] = []
            for a, b in _slices(texts):
                sets = shingle_sets(texts[a:b], known)
                found = [s for s in sets if len(s)]
                signed = iter([row.tobytes() for row in signatures(found, size)] if found else [])
                keys += [set_key(s) for s in sets]
                sketches += [next(signed) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "digest", "key", "sketch"])
        del known
        trim_memory()

    return run


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold complete cells; rows come sorted by cell."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None and rest.num_rows else table
        cells = table.column("cell").to_numpy()
        cut = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _pieces(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """The tables again, cut between cells so that a piece has a few times SLICE bytes of text (or one cell)."""
    for table in tables:
        cells = table.column("cell").to_numpy()
        ends = np.append(np.flatnonzero(cells[1:] != cells[:-1]) + 1, len(cells))
        upto = np.cumsum(pc.fill_null(pc.binary_length(table.column("text")), 0).to_numpy())
        start = 0
        for i, end in enumerate(ends.tolist()):
            taken = upto[start - 1] if start else 0
            if i + 1 == len(ends) or upto[ends[i + 1] - 1] - taken > 8 * SLICE:
                yield table.slice(start, end - start)
                start = end


def _bytes(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _reach(steps: list[int]):
    """For labels in sorted order: the longest of ``steps`` at which a label shares its prefix with a neighbour.

    Labels without company at the last step go no further.  The first and last label of a task may have it in the next
    task and stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, not yet given
        before: np.ndarray | None = None

        def told(part: pa.RecordBatch, labels: np.ndarray, left: np.ndarray | None, right: np.ndarray | None) -> pa.RecordBatch:
            around = np.concatenate([labels[:1] if left is None else left[None], labels, labels[-1:] if right is None else right[None]])
            common = np.logical_and.accumulate(around[1:] == around[:-1], 1).sum(1) - 1  # the first byte is the tree
            reach = np.maximum(common[:-1], common[1:])
            reach = np.array([max((s for s in steps if s <= r), default=0) for r in range(DEPTH + 1)], np.int32)[np.clip(reach, 0, DEPTH)]
            kept = reach > 0
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(reach)], [*part.schema.names, "reach"]).filter(pa.array(kept))

        for batch in batches:
            if not batch.num_rows:
                continue
            labels = _bytes(pa.Table.from_batches([batch]), "label")
            if held is not None:
                yield told(held, _bytes(pa.Table.from_batches([held]), "label"), before, labels[0])
                before = _bytes(pa.Table.from_batches([held]), "label")[-1]
            if batch.num_rows > 1:
                yield told(batch.slice(0, batch.num_rows - 1), labels[:-1], before, labels[-1])
                before = labels[-2]
            held = batch.slice(batch.num_rows - 1)
        if held is not None:
            yield told(held, _bytes(pa.Table.from_batches([held]), "label"), before, None)

    return run


def _likely(table: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row pairs of the same cell that meet here first, not both settled, and whose signatures agree in ``least`` places or
    more, with that number."""
    cells, tree, side, depth, upper = (table.column(c).to_numpy() for c in ("cell", "tree", "side", "depth", "upper"))
    cross, open_ = (table.column(c).to_numpy() for c in ("cross", "open"))
    sketch = _bytes(table, "sketch")
    reach = np.searchsorted(cells, cells, side="right") - np.arange(len(cells))  # rows of the cell from here on
    step, left = 1, np.flatnonzero(reach > 1)
    while len(left):
        right = left + step
        first = left[(~cross[left] | (side[left] != side[right])) & (open_[left] | open_[right])]
        for a in range(0, len(first), PAIRS):
            i = first[a : a + PAIRS]
            same = sketch[i] == sketch[i + step]
            agree = same.sum(1)
            enough = agree >= least
            i, same, agree = i[enough], same[enough], agree[enough]
            common = np.logical_and.accumulate(same.reshape(len(i), TREES, DEPTH), 2).sum(2)
            meets = common >= depth[i][:, None]
            new = (common.max(1, initial=0) < upper[i]) & (meets.argmax(1) == tree[i])
            if new.any():
                yield i[new], i[new] + step, agree[new]
        step += 1
        left = left[reach[left] > step]


CELL = "key binary, cell long, tree int, side int, cross boolean, depth int, upper int, open boolean, sketch binary"


def _named(least: int):
    """A step over the cells: the rows that have a likely partner, their partners there and the least agreement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            partners, agree = np.zeros(table.num_rows, np.int64), np.full(table.num_rows, TREES * DEPTH, np.int32)
            for i, j, same in _likely(table, least):
                for r in (i, j):
                    np.add.at(partners, r, 1)
                    np.minimum.at(agree, r, same.astype(np.int32))
            told = table.append_column("partners", pa.array(partners)).append_column("agree", pa.array(agree))
            yield from told.filter(pa.array(partners > 0)).to_batches()

    return run


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections; many pairs of few sets by a product of incidence blocks."""
    rows = np.unique(np.concatenate([i, j]))
    sizes = [len(sets[r]) for r in rows.tolist()]
    if len(i) < 4 * len(rows):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    _, column = np.unique(np.concatenate([sets[r] for r in rows.tolist()]), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    product, width = np.zeros((len(rows), len(rows)), np.float32), 1 << 13
    for a in range(0, int(column[-1]) + 1, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        block = np.zeros((len(rows), width), np.float32)
        block[row[lo:hi], column[lo:hi] - a] = 1
        product += block @ block.T
    return product[np.searchsorted(rows, i), np.searchsorted(rows, j)].astype(np.int64)


def _verified(least: int, threshold: float):
    """The last pass: exact similarity.  Per linked row its links in this cell and the smallest key it is joined to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for table in _pieces(_whole_cells(batches)):
            texts, keys = table.column("text").to_pylist(), table.column("key").to_pylist()
            cells = table.column("cell").to_numpy()
            sets: list[np.ndarray] = []
            for a, b in _slices(texts):
                sets += shingle_sets(texts[a:b], known)
            del texts
            size = np.array([len(s) for s in sets], np.int64)
            links, root = np.zeros(len(keys), np.int64), list(range(len(keys)))

            def top(r: int) -> int:
                while root[r] != r:
                    root[r] = root[root[r]]
                    r = root[r]
                return r

            for i, j in _by_cell(cells, _likely(table, least)):
                both = _shared(sets, i, j)
                near = both >= threshold * (size[i] + size[j] - both) - 1e-9
                i, j = i[near], j[near]
                np.add.at(links, i, 1)
                np.add.at(links, j, 1)
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    a, b = top(a), top(b)
                    if a != b:
                        if keys[b] < keys[a]:
                            a, b = b, a
                        root[b] = a
            at = np.flatnonzero(links).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[r] for r in at], pa.binary()), pa.array([keys[top(r)] for r in at], pa.binary()), pa.array(links[at], pa.int64())], ["key", "root", "links"])
            del sets, keys
        del known
        trim_memory()

    return run


def _by_cell(cells: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs again, those of a cell together: positions only, at most BLOCK * BLOCK of a cell."""
    found = list(pairs)
    if not found:
        return
    i, j = np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])
    order = np.argsort(cells[i], kind="stable")
    i, j = i[order], j[order]
    cuts = np.flatnonzero(np.concatenate([[True], cells[i][1:] != cells[i][:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield i[a:b], j[a:b]


def _digest(text: Column) -> Column:
    """What stands for a text, letter by letter."""
    return F.unhex(F.sha2(text, 256))


def _forest(entries: DataFrame, steps: list[int]) -> DataFrame:
    """(key, label, reach): the sorted tries.  A label is its tree (one byte) and the entry's values there; only labels with
    company at the last step remain."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    label = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(sketch, tree * {DEPTH} + 1, {DEPTH})"))
    labels = entries.select("key", "sketch", tree).select("key", label.alias("label"))
    return cut_lineage(labels.repartitionByRange("label", "key").sortWithinPartitions("label", "key").mapInArrow(
        _reach(steps), "key binary, label binary, reach int"))


def _matched(entries: DataFrame, forest: DataFrame, steps: list[int], threshold: float, recall: float, deviation: float, least: int) -> DataFrame:
    """Rows of the cells (``CELL``) with likely partners, over all steps; see the module's text."""
    settled, found, upper = None, [], DEPTH + 1
    for depth in steps:
        met = forest.filter(F.col("reach") >= depth).select(
            "key", F.conv(F.hex(F.substring("label", 1, 1)), 16, 10).cast("int").alias("tree"),
            F.xxhash64(F.substring("label", 1, depth + 1)).alias("bucket"), F.substring("label", 1, upper + 1).alias("child"))
        if settled is None:
            met = met.withColumn("open", F.lit(True))
        else:
            met = met.join(settled.withColumn("_settled", F.lit(True)), "key", "left").withColumn("open", F.col("_settled").isNull()).drop("_settled")
        met = cut_lineage(met)
        nodes = met.groupBy("bucket").agg(F.count("*").alias("n"), F.max("open").alias("any_open"), F.min("child").alias("a"), F.max("child").alias("b"))
        # at whole labels a node is one child, and its entries are what is compared
        worth = F.col("any_open") & (F.col("n") > 1) & (F.lit(True) if depth == DEPTH else F.col("a") != F.col("b"))
        many = cut_lineage(nodes.filter(worth).select("bucket", "n"))
        parts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
        placed = join_groups(met.drop("child"), many, "bucket", "n", met.count()).select(
            "key", "tree", "open", "bucket", parts.alias("parts"), F.pmod(F.xxhash64(F.lit(7), "key"), parts).cast("int").alias("side"))
        # the two blocks of a cell mark their own rows: a pair of different blocks is cross in both, a block alone in neither
        laid = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
            F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other"), F.lit(depth)).alias("cell"), "tree", "side",
            (F.col("side") != F.col("other")).alias("cross"), F.lit(depth).alias("depth"), F.lit(upper).alias("upper"), "open", "key")
        cells = laid.join(entries.select("key", "sketch"), "key").repartition("cell").sortWithinPartitions("cell")
        found.append(cut_lineage(cells.select(*[c.split()[0] for c in CELL.split(", ")]).mapInArrow(_named(least), f"{CELL}, partners long, agree int")))
        if depth == steps[-1]:
            break
        told = found[0]
        for part in found[1:]:
            told = told.unionByName(part)
        similar = F.greatest(F.lit(threshold), F.col("agree") / (TREES * DEPTH) - DOUBT * deviation)
        chance = 1 - F.pow(1 - F.pow(similar, F.lit(depth)), F.lit(TREES))
        settled = cut_lineage(told.groupBy("key").agg(F.sum("partners").alias("partners"), F.min("agree").alias("agree")).filter(
            F.col("partners") * (1 / chance - 1) < 1 - recall).select("key"))
        upper = depth
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.drop("partners", "agree")


def _classified(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, best, size, n_links, n_copies) per row with words, and the doc_id of every other row.

    best (u, doc_id, digest) is the class's first row: the smallest id, null ids last, then the smallest digest.  size
    counts the class's rows.
    """
    steps, size = prefix_steps(threshold, recall), TREES * DEPTH
    deviation = (threshold * (1 - threshold) / size) ** 0.5
    least = int(np.ceil((threshold - SPARE * deviation) * size))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = cut_lineage(rows.withColumn("digest", _digest(F.col("text"))).mapInArrow(_sketch(size), "doc_id long, digest binary, key binary, sketch binary"))
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "digest"))
    entries = cut_lineage(sketched.filter("key IS NOT NULL").groupBy("key").agg(
        first_row.alias("best"), F.first("sketch").alias("sketch"), F.count("*").alias("n_copies")))
    needed = _matched(entries, _forest(entries, steps), steps, threshold, recall, deviation, least)
    # an entry's text is found by its digest, one text per digest; only texts that are needed are shuffled: a filter of
    # bounded size says which may be, the join decides
    wanted = cut_lineage(needed.select("key").distinct().join(entries.select("key", F.col("best.digest").alias("digest")), "key"))
    slots = slots_for(wanted.count())
    bits = cut_lineage(slot_filter(wanted, "digest", slots))
    maybe = with_flag(rows.filter("text IS NOT NULL").select(_digest(F.col("text")).alias("digest"), "text"), "digest", bits, slots, "_maybe").filter("_maybe")
    texts = maybe.groupBy("digest").agg(F.first("text").alias("text"))
    joined = needed.join(wanted, "key").join(texts, "digest")
    second = joined.repartition("cell").sortWithinPartitions("cell", "key")
    linked = cut_lineage(second.select(*[c.split()[0] for c in CELL.split(", ")], "text").mapInArrow(
        _verified(least, threshold), "key binary, root binary, links long"))
    totals = linked.groupBy("key").agg(F.sum("links").alias("n_links"))
    roots = smallest_in_component(linked.filter("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    known = entries.select("key", "best", "n_copies").join(totals, "key", "left").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn(
        "root", F.coalesce("root", "key"))
    known = cut_lineage(known.withColumn("n_links", F.coalesce("n_links", F.lit(0))))
    total, n_entries = sketched.count(), known.count()
    classes = cut_lineage(known.groupBy("root").agg(F.min("best").alias("best"), F.sum("n_copies").alias("size"), F.count("*").alias("_entries")))
    final = cut_lineage(join_groups(known.drop("best"), classes, "root", "_entries", n_entries).select("key", "best", "size", "n_links", "n_copies"))
    worded = sketched.filter("key IS NOT NULL").select("doc_id", "digest", "key")
    return join_groups(worded, final, "key", "n_copies", total).drop("key"), sketched.filter("key IS NULL").select("doc_id")


def near_copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                      recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_copies per row of ``docs``.

    Two texts are linked when the Jaccard similarity of their sets of five-word runs is at least ``threshold``; classes
    are what links connect, class_id is the smallest doc_id.  n_links counts the other different sets that are linked
    with the row's, n_copies the rows with an equal set.  Texts without words (null, empty, blanks) are linked with
    nothing and are classes of their own, with class_id = doc_id.  Null ids take part; they are no class_id unless the
    class has no other.  Repeated rows are copies; an id may stand for different texts.
    """
    worded, others = _classified(docs, id_col, text_col, threshold, recall)
    alone = others.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return worded.select("doc_id", F.col("best.doc_id").alias("class_id"), "n_links", "n_copies").unionByName(alone)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class stays, with all its columns: that of the smallest id, null ids last, then by digest of the text.

    Rows are told apart by id and text: rows that repeat an id with texts of different classes are rows of those
    classes, and of rows that repeat both one stays.  Rows without words are no copies and all stay.
    """
    worded, _ = _classified(docs, id_col, text_col, threshold, RECALL)
    code, flag, place = free_name(docs, "_code"), free_name(docs, "_maybe"), free_name(docs, "_place")

    def named(i: Column, digest: Column) -> Column:
        return F.concat_ws(":", F.hex(digest), F.coalesce(i.cast("long").cast("string"), F.lit("null")))

    several = worded.filter("size > 1").select(
        named(F.col("doc_id"), F.col("digest")).alias(code), (named(F.col("doc_id"), F.col("digest")) != named(F.col("best.doc_id"), F.col("best.digest"))).alias("_drop"))
    decided = cut_lineage(several.groupBy(code).agg(F.max("_drop").alias("_drop"), F.count("*").alias("_n")).filter("_drop OR _n > 1"))  # all other rows stay without a shuffle
    slots = slots_for(decided.count())
    marked = with_flag(docs.withColumn(code, named(F.col(id_col), _digest(F.col(text_col)))), code, cut_lineage(slot_filter(decided, code, slots)), slots, flag)
    maybe = F.col(flag) & F.coalesce(F.col(text_col).rlike(WORDED), F.lit(False))
    straight = marked.filter(~maybe).select(*docs.columns)
    # rows of one id and text are in one class, so the first stands for all before anything is joined
    once = marked.filter(maybe).withColumn(place, F.row_number().over(W.partitionBy(code).orderBy(code))).filter(F.col(place) == 1)
    return straight.unionByName(once.join(decided.filter("_drop").select(code), code, "left_anti").select(*docs.columns))
