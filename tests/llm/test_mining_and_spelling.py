"""Hard negatives, closed syncmers and spelling variants against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from corpusspark.llm import hard_negatives, spelling, syncmers

# --- hard negatives -------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, row string, id string, vector string, _a string, _r string, key string"


def vectors():
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, 0.3), 2) for _ in range(4)], rng.randint(0, 3)) for i in range(230)]
    rows += [rows[50], rows[50], rows[100], rows[7]]  # repeated rows, anchors among them
    rows += [(None, [0.5, 0.5, 0.1, 0.2], 1), (None, [0.5, 0.5, 0.1, 0.2], 2), (300, None, 1), (301, [], 2), (302, [0.1, None, 0.2, 0.3], 0),
             (303, [float("nan"), 0.0, 0.0, 0.0], 1), (304, [float("inf"), 0.0, 0.0, 0.0], 1), (350, [0.2, 0.1, 0.0, 0.3], None),
             (400, [0.0, 0.0, 0.0, 0.0], 3), (450, [0.3, 0.2], 0), (451, [0.3, 0.2, 0.4, 0.4, 0.4], 0), (452, [0.0] * 4, 3)]
    return [r + ("x",) * 6 for r in rows]


def mined(rows, positives=5, negatives=3):
    part = [(i, v, la) for i, v, la, *_ in rows if v is not None and la is not None and all(x is not None and math.isfinite(x) for x in v)]
    part = [(i, [math.floor(256 * x) for x in v], (la + 1) % 10 if i is not None and i % 7 == 0 else la) for i, v, la in part]
    out = Counter()
    for a, (i, v, la) in enumerate(part):
        if i is None or i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j, lb) for b, (j, w, lb) in enumerate(part) if b != a]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4] == la][:positives]:
            window = [s for s in scored if s[4] != la and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:negatives]
            for rank, n in enumerate(window, 1):
                out[i, p[3], rank, n[3], -p[0], -n[0]] += 1
    return out


def single(rows):
    """The rows as Spark's floats hold them."""
    import numpy as np
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], *rest) for i, v, *rest in rows]


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def mine(df, **options):
    return hard_negatives.mine(df, F.col("id") % 50 == 0, label(), **options)


@pytest.mark.parametrize("block", [4096, 17])
def test_hard_negatives_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", block if block > 17 else 3)
    found = mine(spark.createDataFrame(vectors(), VECTORS).repartition(3)).collect()
    assert Counter(tuple(r) for r in found) == mined(single(vectors()))
    assert found[0].__fields__ == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_ties_and_zero_windows(spark):
    """A positive that scores 0 opens a window for negatives that score 0, smaller ids included."""
    rows = [(0, [0.0, 0.0], 1), (50, [0.5, 0.5], 1), (3, [0.1, 0.1], 2), (1, [0.2, 0.1], 2), (2, [0.3, 0.0], 1), (60, [0.5, 0.4], 2), (61, [0.5, 0.4], 2)]
    rows = [r + ("x",) * 6 for r in rows]
    found = mine(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter(tuple(r) for r in found) == mined(single(rows))
    assert any(r.anchor_id == 0 and r.positive_score == 0 for r in found)


def test_hard_negatives_exact_beyond_doubles(spark):
    rows = [(0, [1e12, 3.0], 1), (1, [1e12, 1.0], 1), (2, [9e11, 2.0], 2), (3, [9e11, 1.0], 2), (4, [3e38, 1.0], 2)]
    rows = [r + ("x",) * 6 for r in rows]
    rows[3] = (3, [float(9e11), 1.5]) + rows[3][2:]
    found = mine(spark.createDataFrame(rows, VECTORS)).collect()
    top = (1 << 63) - 1
    assert all(r.positive_score <= top and r.negative_score <= top for r in found)


def test_hard_negatives_of_empty_tables(spark):
    assert mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert mine(spark.createDataFrame([(1, [0.1], 1) + ("x",) * 6], VECTORS)).count() == 0


# --- closed syncmers ------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, key string, rank int, rows string, sketch string"


def signed(x, bits=64):
    return x - (1 << bits) if x >> (bits - 1) else x


def xx(*parts):
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else (p & (1 << 64) - 1).to_bytes(8, "little")
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return signed(seed)


def brute_anchors(text):
    """(32-bit code, position) of the closed syncmers."""
    tokens = [xx(t) for t in regex.findall(r"\p{Ll}{1,4}|[^ \t\n\x0b\f\r]", text)]
    inner = [xx(*tokens[i : i + 2]) for i in range(len(tokens) - 1)]
    out = []
    for i in range(len(tokens) - 5):
        window = inner[i : i + 5]
        if min(window) in (window[0], window[4]):
            out.append((signed(xx(window[0], window[2], window[4]) & 0xFFFFFFFF, 32), i))
    if tokens and not out:
        last = xx(tokens[-1])
        out = [(signed(xx(*inner, last) & 0xFFFFFFFF, 32), 0)]
    return out


def brute_sketch(text):
    seen, out = set(), {}
    for code, place in sorted(brute_anchors(text)):
        if code in seen:
            code = signed(xx(code, place // 64) & 0xFFFFFFFF, 32)
            out.setdefault(code, place)
        seen.add(code)
        out[code] = min(out.get(code, place), place)
    return sorted(out.items())[:64]


def brute_likeness(a, b):
    a, b = [[c for c, _ in s] for s in (a, b)]
    top = min([s[-1] for s in (a, b) if len(s) == 64], default=(1 << 31) - 1)
    a, b = [{c for c in s if c <= top} for s in (a, b)]
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def run(n):
        return " ".join(rng.choice(words).capitalize() if rng.random() < 0.1 else rng.choice(words) for _ in range(n))

    rows = [(1, None), (2, ""), (3, " \n\t"), (4, run(20_000)), (5, "one"), (6, "日本語の文章はここにありますが、空白はありません。" * 5), (7, run(40)),
            (8, (run(9) + "\n") * 200), (9, "a" * 5000), (9, "b" * 31), (9, "b" * 31), (None, run(30)), (None, None), (10, "QWxhZGRpbjpvcGVuIHNlc2FtZQ9" * 9),
            (11, "😀é" * 40 + "x")]
    rows += [(20 + i, run(rng.randint(1, 150))) for i in range(40)]
    rows += [(70, rows[15][1]), (71, rows[15][1]), (71, rows[15][1])]
    return [r + ("x", 1, "y", "z") for r in rows]


def test_fingerprints_match_brute_force(spark):
    rows = sorted(((i, t or "") for i, t, *_ in texts()), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256(r[1].encode()).hexdigest()))
    expected = Counter()
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        mine, other, following = brute_sketch(t), brute_sketch(edited), brute_sketch(n)

        def told(s):
            return "".join(f"{c & 0xFFFFFFFF:08X}{p:08X}" for c, p in s)

        expected[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), told(mine), told(other), brute_likeness(mine, other), brute_likeness(mine, following)] += 1
    found = syncmers.fingerprint_report(spark.createDataFrame(texts(), DOCS).repartition(5)).collect()
    assert Counter(tuple(r) for r in found) == expected


def test_fingerprints_of_few_rows(spark):
    assert syncmers.fingerprint_report(spark.createDataFrame([], DOCS)).count() == 0
    alone = syncmers.fingerprint_report(spark.createDataFrame([(1, "abcdefgh ijk", "k", 1, "r", "s")], DOCS)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert alone[0].edited_sha256 == hashlib.sha256(b"abcdefabcdef").hexdigest()


def test_anchors_do_not_depend_on_context(spark):
    """A passage has the same anchors at a shifted position wherever it stands, but for its edges."""
    passage = texts()[6][1]
    rows = [(1, passage), (2, "Quite another beginning, of some length: " + passage + " and an end.")]
    found = syncmers.anchor_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    alone = {r.code: r.position for r in found if r.doc_id == 1}
    inside = {r.code: r.position for r in found if r.doc_id == 2}
    assert alone.keys() <= inside.keys() and len(alone) > 10
    assert len({inside[c] - alone[c] for c in alone}) == 1
    expected = Counter((1, p, c) for c, p in brute_anchors(passage))
    assert Counter(tuple(r) for r in found if r.doc_id == 1) == expected


# --- spelling variants ----------------------------------------------------------------------------------------------


def spelled(docs):
    counts = Counter()
    for i, t, *_ in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def grouped(words):
    near = defaultdict(list)
    ordered = sorted(words)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items()}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def spelling_docs():
    rng = random.Random(4)
    base = ["committee", "Straße" * 2, "naïveté", "recommend", "accommodate", "ababababab", "aaaaaaaaaa", "aaaaaaaaaaa", "aaaaaaaab", "überall", "x" * 300, "MISSPELL"]
    docs = [(None, "committee null_id"), (1, None), (2, ""), (3, "12 !? short")]
    for k in range(700):
        picked = []
        for _ in range(20):
            w = rng.choice(base)
            if rng.random() < 0.35:
                p = rng.randint(0, 2) * 3
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + "q" + w[p + 1 :], w[:p] + "z" + w[p:]])
                if rng.random() < 0.2:
                    w = w[:-1] + "y"
            picked.append(w)
        docs.append((k, rng.choice([" ", ", ", "-", "1"]).join(picked)))
    return docs + docs[-30:]


@pytest.mark.parametrize("block", [1024, 3])
def test_spelling_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    docs = [d + ("w", 1, "k") for d in spelling_docs()]
    found = spelling.spelling_report(spark.createDataFrame(docs, "doc_id long, text string, word string, n int, key string").repartition(4)).collect()
    expected = grouped(spelled(docs))
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert sum(r.form is not None for r in found) > 20


def test_deep_chains_beyond_latin_and_long_words(spark):
    """Forms are followed to the last; words may hold any code point and have any length."""
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "слово": 7, "слова": 70, "日" * 4000: 9, "日" * 3999: 50,
             "a😀c": 1, "ac": 9, "é": 2, "e": 10, "": 1}
    found = spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == grouped(words)
    assert next(r for r in found if r.word == "aaaaaa").root == "abbbbb"


def test_spelling_of_empty_tables(spark):
    assert spelling.spelling_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling_report(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")).count() == 0
