"""The MinHash forest: adaptive prefixes, measured recall, sorted tries; languages nobody labelled."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusspark.llm import language_id, near_copies


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def base(rng, n=200):
    return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]


def edited(rng, words, share):
    """The words with some replaced one by one until the similarity falls to ``share`` or just above."""
    out, text = list(words), " ".join(words)
    while True:
        before = list(out)
        out[rng.randrange(len(out))] = f"x{rng.randint(0, 10**9)}"
        if similarity(text, " ".join(out)) < share:
            return before


def test_recall_at_the_threshold(spark):
    rng = random.Random(11)
    rows, pairs = [], 0
    for i in range(400):
        words = base(rng)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(rng, words, 0.8)))]
        assert similarity(rows[-1][1], rows[-2][1]) >= 0.8
        pairs += 1
    found = near_copies.near_copy_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.doc_id % 2 and r.class_id == r.doc_id - 1 for r in found) >= 0.99 * pairs
    assert all(r.class_id in (r.doc_id, r.doc_id - 1) for r in found)


def test_depth_varies_by_entry(spark, monkeypatch):
    """A group of very close copies is settled by whole labels; a pair at the threshold goes on to the shortest prefix."""
    rng = random.Random(12)
    words = base(rng, 3000)
    rows = []
    for i in range(12):
        near = list(words)
        near[i * 7] = f"one{i}"
        rows.append((i, " ".join(near)))
    far = base(rng)
    rows += [(100, " ".join(far)), (101, " ".join(edited(rng, far, 0.8)))] + [(200 + i, " ".join(base(rng))) for i in range(30)]
    seen = []

    def matched(*args, run=near_copies._matched):
        out = run(*args)
        seen.append((args[0].select("key", F.col("best.doc_id").alias("doc_id")), out))
        return out

    monkeypatch.setattr(near_copies, "_matched", matched)
    found = {r.doc_id: r for r in near_copies.near_copy_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i].class_id == 0 and found[i].n_links == 11 for i in range(12)) and found[101].class_id == 100
    names, cells = seen[0]
    told = cells.join(names, "key").groupBy("doc_id").agg(F.max("depth").alias("first"), F.min("depth").alias("last"), F.max(F.col("open").cast("int")).alias("open")).collect()
    depth = {r.doc_id: (r.first, r.last) for r in told}
    assert all(depth[i] == (near_copies.DEPTH, near_copies.DEPTH) for i in range(12))
    assert set(depth) == {*range(12), 100, 101}


def test_settled_entries_still_meet_open_ones(spark):
    """An entry that found its copies by long prefixes is still found by one that has none yet."""
    rng = random.Random(13)
    rows, expected = [], 0
    for i in range(60):
        words = base(rng)
        close = list(words)
        close[0] = "changed"
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(close)), (10 * i + 2, " ".join(edited(rng, words, 0.8)))]
        expected += 1
    found = {r.doc_id: r.class_id for r in near_copies.near_copy_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[10 * i + 2] == 10 * i for i in range(60)) >= 59
    assert all(found[10 * i + 1] == 10 * i for i in range(60))


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_reach_over_sorted_labels(size):
    rng = np.random.default_rng(3)
    labels = sorted({bytes([t]) + bytes(rng.integers(0, 2, near_copies.DEPTH).astype(np.uint8)) for t in (0, 1, 2) for _ in range(150)})
    labels += [labels[-1]]
    batches = [pa.RecordBatch.from_arrays([pa.array([str(i).encode() for i in range(s, min(s + size, len(labels)))], pa.binary()),
                                           pa.array(labels[s : s + size], pa.binary())], ["key", "label"]) for s in range(0, len(labels), size)]
    steps = [10, 8, 6]
    found = {int(k): r for b in near_copies._reach(steps)(iter(batches)) for k, r in zip(b.column("key").to_pylist(), b.column("reach").to_pylist())}
    for i, x in enumerate(labels):
        best = max((s for s in steps for j, y in enumerate(labels) if i != j and y[: s + 1] == x[: s + 1]), default=0)
        if i in (0, len(labels) - 1):
            best = near_copies.DEPTH  # the edges of a task stay
        assert found.get(i, 0) == best


def test_languages_nobody_labelled_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter("text IS NOT NULL")
    strange = {
        "fi": "Tämä on suomenkielinen teksti joka kertoo kissasta ja koirasta jotka asuvat talossa metsän reunalla ja syövät kalaa joka päivä ",
        "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью ",
        "tr": "Bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler ve birbirlerine karşı ",
        "zh": "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
        "hex": "3fa94bc7d01e88af52c6e0b9 ", "code": "for (int i=0;i<n;i++) { x[i] = foo(bar[i]); } return x; ",
    }
    odd = [(10**9 + i, t * (1 + 1500 // len(t)), None) for i, t in enumerate(strange.values())]
    kept = {r.doc_id for r in language_id.keep_identified(docs.unionByName(spark.createDataFrame(odd, docs.schema))).select("doc_id").collect()}
    assert not kept & {i for i, *_ in odd}
    prose = docs.filter("lang IS NOT NULL").select("doc_id", "text").collect()
    clean = {r.doc_id for r in prose if len(r.text) >= 400}
    assert len(clean - kept) <= 0.002 * len(clean)
