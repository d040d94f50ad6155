"""The training-data operators against brute force on small tables with nulls, empties, long texts, ties and repeats."""

import base64
import gzip
import hashlib

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from corpusspark.llm import (
    catalog, components, exact_dedup, html_extract, html_layouts, language_id, mixing, near_copies, nearest, piece_sampling, shards,
    url_reputation, warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _code string, kept boolean"


def words(rng, n, stem="w"):
    return " ".join(f"{stem}{rng.randint(0, 5000)}" for _ in range(n))


def documents():
    """Nulls, empties, blanks, one long text, a hot group, near copies, repeated rows; columns with clashing names."""
    rng = random.Random(5)
    base = words(rng, 120)
    tokens = base.split()
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, words(rng, 20_000), "en", "b"), (5, "one two", "en", None),
            (5, "one two", "en", None), (6, "one  two ", "de", "b"), (None, "null id text here now", "de", "b"), (None, None, None, None), (7, "12345 !!", "en", "c")]
    rows += [(100 + i, base if i % 2 else base + " ", "en", "hot") for i in range(60)]
    for i in range(30):
        near = list(tokens)
        near[i % 7] = f"changed{i}"
        rows.append((200 + i, " ".join(near), "fr", "hot"))
    rows += [(300 + i, words(rng, rng.randint(3, 60)), rng.choice(["en", "de", "fr"]), rng.choice("abc")) for i in range(60)]
    return [(i, t, la, s, len(t or ""), "x", True) for i, t, la, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup_report(docs, no_docs):
    groups = defaultdict(list)
    for i, t, *_ in documents():
        groups[bare(t)].append((-len(t or ""), i is None, i))
    found = exact_dedup.dedup_report(docs).collect()
    assert len(found) == len(documents())
    kept = Counter()
    for r in found:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.keep_id == min(groups[key])[2] and r.group_size == len(groups[key])
        kept[key] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and kept.keys() == groups.keys()
    assert exact_dedup.dedup_report(no_docs).count() == 0


def test_exact_dedup_keeps_rows_and_columns(docs, no_docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(bare(r.text) for r in kept.collect()) == sorted({bare(t) for _, t, *_ in documents()})
    assert exact_dedup.drop_copies(no_docs).count() == 0


def test_full_filter_only_costs_shuffle(docs):
    """With a filter far too small every row is possibly repeated, and the result is the same."""
    small = exact_dedup.dedup_report(docs, max_slots=2).toPandas()
    large = exact_dedup.dedup_report(docs).toPandas()
    key = ["text_sha256", "doc_id", "kept"]
    pd.testing.assert_frame_equal(small.sort_values(key, ignore_index=True), large.sort_values(key, ignore_index=True))


def test_filter_lets_unique_rows_pass(spark):
    codes = spark.range(4000).select(F.concat(F.lit("k"), (F.col("id") % 3900).cast("string")).alias("c"))
    slots = exact_dedup.slots_for(4000)
    flagged = exact_dedup.with_flag(codes, "c", exact_dedup.repeated_filter(codes, "c", slots), slots, "m")
    assert flagged.filter("m").select("c").distinct().count() < 400
    repeated = codes.groupBy("c").count().filter("count > 1").select("c")
    assert repeated.join(flagged.filter("not m"), "c").count() == 0


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def near_classes(rows):
    sets = defaultdict(list)
    for i, t, *_ in rows:
        sets[shingles(t)].append(i)
    sets.pop(frozenset(), None)
    keys = list(sets)
    links, joined = Counter(), {k: k for k in range(len(keys))}

    def top(a):
        while joined[a] != a:
            a = joined[a]
        return a

    for a in range(len(keys)):
        for b in range(a):
            if len(keys[a] & keys[b]) >= 0.8 * len(keys[a] | keys[b]):
                links[a] += 1
                links[b] += 1
                joined[top(a)] = top(b)
    members = defaultdict(list)
    for a, k in enumerate(keys):
        members[top(a)] += sets[k]
    ids = {i: min((x for x in m if x is not None), default=None) for m in members.values() for i in m}
    return ids, {i: links[a] for a, k in enumerate(keys) for i in sets[k]}, {i: len(sets[k]) for k in keys for i in sets[k]}


def test_near_copies_match_all_pairs(docs, no_docs):
    ids, links, copies = near_classes(documents())
    found = near_copies.near_copy_classes(docs).collect()
    assert len(found) == len(documents())
    for r in found:
        if r.doc_id is None:
            continue
        assert (r.class_id, r.n_links, r.n_copies) == (ids.get(r.doc_id, r.doc_id), links.get(r.doc_id, 0), copies.get(r.doc_id, 1))
    assert near_copies.near_copy_classes(no_docs).count() == 0


def near_texts():
    """(base, a near copy, an unrelated text), 100 words each."""
    rng = random.Random(21)
    base = words(rng, 100).split()
    return " ".join(base), " ".join([*base[:-1], "end"]), words(rng, 100)


def test_near_copies_with_repeated_and_null_ids(spark):
    """Texts are compared as themselves, once each, whatever ids they stand under."""
    base, near, other = near_texts()
    rows = [(1, base), (1, base), (1, base), (2, near), (9, other), (9, near + " tail"), (None, other), (None, base + " more"), (None, words(random.Random(2), 90))]
    sets = [shingles(t) for _, t in rows]
    found = near_copies.near_copy_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expected = []
    for (i, _), s in zip(rows, sets, strict=True):
        links = {frozenset(o) for o in sets if o != s and len(s & o) >= 0.8 * len(s | o)}
        one = len(s & sets[0]) >= 0.8 * len(s | sets[0])
        expected.append((i, 1 if one else 9 if s == sets[4] else None, len(links), sets.count(s)))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_near_copies_in_blocks(docs, monkeypatch):
    """A group over several blocks has the same links: only the layout changes."""
    monkeypatch.setattr(near_copies, "BLOCK", 5)
    _, links, _ = near_classes(documents())
    found = near_copies.near_copy_classes(docs).filter("doc_id >= 200").collect()
    assert {r.doc_id: r.n_links for r in found} == {i: links[i] for i in links if i is not None and i >= 200}


def test_drop_near_copies(docs, no_docs):
    ids, _, _ = near_classes(documents())
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.select("doc_id").collect()]
    named = [i for i, *_ in documents() if i is not None]
    assert sorted(i for i in got if i is not None) == sorted({i for i in named if ids.get(i, i) == i})
    assert got.count(None) == 2
    assert near_copies.drop_near_copies(no_docs).count() == 0


def test_drop_near_copies_decides_per_row(spark):
    """Clean rows stay under a repeated id; null ids take part; rows without words stay."""
    base, near, other = near_texts()
    lone, third = words(random.Random(3), 90), words(random.Random(4), 90)
    rows = [(3, base), (5, near), (5, other), (5, lone), (5, lone), (6, other + " x"), (None, base + " more"), (None, third), (None, third + " y"), (None, None),
            (7, " \u2003"), (7, " \u2003"), (8, ""), (8, "")]
    kept = [tuple(r) for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    expected = [(3, base), (5, other), (5, lone), (None, None), (7, " \u2003"), (7, " \u2003"), (8, ""), (8, "")]
    assert sorted(map(repr, (r for r in kept if r[0] is not None or r[1] is None))) == sorted(map(repr, expected))
    assert len([r for r in kept if r[0] is None and r[1] in (third, third + " y")]) == 1 and len(kept) == len(expected) + 1


def test_prefix_shortens_to_the_target():
    assert near_copies.prefix_length(0.8, 32, 10, 0.9999) == 6
    assert 1 - (1 - 0.8**7) ** 32 < 0.9999 <= 1 - (1 - 0.8**6) ** 32


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(80)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    expected = {}
    for start in sorted(near):
        if start not in expected:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in expected:
                    expected[x] = start
                    todo += near[x]
    found = {r.node: r.root for r in components.smallest_in_component(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: v for k, v in expected.items() if near[k] != {k}}


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 24))
    x = (centres[rng.integers(0, 8, 900)] + 0.6 * rng.normal(size=(900, 24))).astype(np.float32)
    x[300:560] = x[300]  # one vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 24), (2040, [None] + [1.0] * 23), (2060, [float("nan")] * 24), (2080, [float("inf")] + [0.0] * 23), (2100, [1.0, 2.0]), (None, x[0].tolist())]
    table = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>")
    found = nearest.search(table, F.col("vec_id") % 20 == 0, 20).toPandas()
    assert set(found.query_id) == {i for i in range(900) if i % 20 == 0}
    y, hit, total = x.astype(float), 0, 0
    for q, g in found.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21))
        score = y @ y[q]
        assert np.allclose(g.score, score[g.vec_id]) and q not in set(g.vec_id)
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
        best = np.lexsort((np.arange(900), -score.round(12)))
        hit += np.isin([i for i in best if i != q][:20], g.vec_id).sum()
        total += 20
    assert hit / total >= 0.9
    few = nearest.search(table.filter("vec_id < 5"), F.col("vec_id") % 20 == 0, 20).toPandas()
    assert sorted(few.vec_id) == [1, 2, 3, 4]
    assert nearest.search(table.filter("vec_id < 0"), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    words_ = rng.integers(0, 1 << 32, (300, 8), dtype=np.uint32)
    asked = words_[:40] ^ (rng.random((40, 8)) < 0.3).astype(np.uint32) * np.uint32(0xF0F)
    for radius in (0, 5, 40, 111, 130):
        codes = nearest.Codes(np.zeros(1), 1.0, np.zeros((1, 1)), radius, nearest._shares(radius, 8))
        q, v = nearest.retrieve(codes, asked, words_, nearest.index_of(words_))
        apart = np.bitwise_count(asked[:, None] ^ words_[None]).sum(2, dtype=int)
        assert set(zip(q.tolist(), v.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(apart <= radius))))


def test_blocks_and_main_text():
    model, features = html_extract.train_on_layouts(160), html_extract.Features()
    page = ("<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><!-- <p>no</p> --><div class='ad'>Buy now.</div>"
            "<article><h1>Head &amp; tail</h1><p>One <b>bold</b>ly\n  two<br>three.<p>Four &copy five, and six more words in a line.</article>"
            "<section class='comments'><p>I liked it.</p></section><form><label>Mail</label></form><footer>&copy; x</footer>")
    assert html_extract.main_text(model, features, page) == "Head & tail One boldly two three. Four © five, and six more words in a line."
    for odd in (None, "", "plain", "<", "<p", "<p title='", "<!--", "<script>never closed", "&am", "<div>" * 3000 + "deep" + "</div>" * 10):
        html_extract.main_text(model, features, odd)
    right = total = 0
    for text, main in html_layouts.labelled_pages(80, seed=77):
        blocks = html_extract.blocks_of(text)
        scores = [float(model.weight[features.block(b, i, len(blocks))].sum()) for i, b in enumerate(blocks)]
        right += sum(bool(label) == (b.text in main) for b, label in zip(blocks, model.viterbi(scores), strict=True))
        total += len(blocks)
    assert right / total > 0.97


def test_unclosed_embedded_elements_keep_the_page():
    texts = lambda page: [b.text for b in html_extract.blocks_of(page)]
    for tag in ("select", "template", "svg", "math"):
        assert texts(f"<article><p>One</p><div><{tag}><g>hidden</div><p>Two</p></article><p>Three</p>") == ["One", "Two", "Three"]
    for tag in ("video", "audio", "canvas", "object"):
        assert texts(f"<article><p>One</p><{tag} src=x><p>Two</p></article><p>Three</p>") == ["One", "Two", "Three"]
        assert texts(f"<div><{tag}><p>hidden</div><p>Two</p><{tag}>x</{tag}><p>Three</p>") == ["Two", "Three"]
    assert texts("<p>One<object><p>hidden</p>more</object>Two<svg><title/><path/></svg><p>Three") == ["One", "Two", "Three"]


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(2)
    for _ in range(20):
        model = html_extract.Field(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
        scores = rng.normal(size=7).tolist()
        value = lambda y: model.first[y[0]] + sum(s for s, k in zip(scores, y) if k) + sum(model.step[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max((tuple(n >> i & 1 for i in range(7)) for n in range(128)), key=value)
        assert tuple(model.viterbi(scores)) == best


def test_extract_rows(spark):
    rows = [(1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t"), (None, None, None, "t"), (2, "u", "", "t")]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).toPandas()
    assert len(out) == 4 and out.columns.tolist() == ["page_id", "url", "text", "n_chars"] and (out.n_chars == out.text.str.len()).all()
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shards_even_and_whole(docs, no_docs):
    out = shards.shard_documents(docs, 7).toPandas()
    counts = out.groupby("shard").size()
    assert len(out) == len(documents()) and counts.max() - counts.min() <= 1 and len(counts) == 7
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    expected = Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in documents())
    assert Counter(zip(out["size"], out["text_crc32"])) == expected and set(out["law"]) == {"rows"} and out["grown_shard"].isna().all()
    assert shards.shard_documents(no_docs, 7).count() == 0


def test_shards_cut_few_groups(spark):
    rows = [(i, f"text {i % 300}") for i in range(900)]
    out = shards.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 10).toPandas()
    out["group"] = out.doc_id % 300
    assert (out.groupby("group").shard.nunique() > 1).sum() < 60  # hashing alone would cut 297 of 300


def test_suffix_rules_and_addresses(spark):
    hosts = ["a.b.com.mx", "com.mx", "x.shop.ck", "q.x.shop.ck", "www.ck", "m.www.ck", "n.co.uk:80", "10.0.0.1:8080", "[::1]", "", "one", "A.B", "deep.a.b.c.d"]
    rules = spark.createDataFrame([(r,) for r in ("com.mx", "mx", "*.ck", "!www.ck", "B.C.D", "d", None, "d")], "suffix string")
    table = spark.createDataFrame([(h,) for h in hosts], "host string")
    listed = url_reputation.listed_suffixes(table, rules)
    got = {r[0]: (r[1], r[2]) for r in listed.select("host", *url_reputation.suffix_and_domain(F.col("host"), F.col("listed"))).collect()}
    assert got == {
        "a.b.com.mx": ("com.mx", "b.com.mx"), "com.mx": ("com.mx", "com.mx"), "x.shop.ck": ("shop.ck", "x.shop.ck"), "q.x.shop.ck": ("shop.ck", "x.shop.ck"),
        "www.ck": ("ck", "www.ck"), "m.www.ck": ("ck", "www.ck"), "n.co.uk:80": ("co.uk", "n.co.uk"), "10.0.0.1:8080": ("(address)", "10.0.0.1"),
        "[::1]": ("(address)", "[::1]"), "": ("", ""), "one": ("one", "one"), "A.B": ("B", "A.B"), "deep.a.b.c.d": ("b.c.d", "a.b.c.d")}
    plain = {r[0]: (r[1], r[2]) for r in table.select("host", *url_reputation.suffix_and_domain(F.col("host"))).collect()}
    assert plain["a.b.com.mx"] == ("mx", "com.mx") and plain["10.0.0.1:8080"] == ("(address)", "10.0.0.1") and plain["n.co.uk:80"] == ("co.uk", "n.co.uk")
    # Hosts of one site below a listed suffix borrow from each other; without the rules they borrow from all of com.mx.
    urls = [(i, f"http://h{i % 9}.bad.com.mx/") for i in range(90)] + [(100 + i, f"http://h{i}.s{i}.com.mx/") for i in range(60)] + [(500, "http://new.bad.com.mx/")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(90)] + [(100 + i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    verdict = lambda r: url_reputation.filter_urls(pages, labels, [], suffix_rules=r).where("page_id = 500").first()["verdict"]
    assert verdict(rules) == "block"
    assert url_reputation.filter_urls(pages, labels, [], suffix_rules=rules.limit(0)).count() == len(urls)


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/")]


def test_url_filter(spark):
    urls = [(1, "http://A.example.org/es/1?q#f"), (2, "https://x.org/es/"), (3, "no scheme"), (4, None), (5, "http://good.com?x"), (6, "http://bad.com/de/1#t"),
            (7, "http://ÄB.com/fr/x"), (None, "http://notexample.org:8080/es/2"), (8, "ftp://u@h.co.uk/p://q"), (8, "ftp://u@h.co.uk/p://q")]
    urls += [(1000 + i, "http://bad.com/p") for i in range(60)] + [(2000 + i, "http://good.com/p") for i in range(60)]
    labels = [(1000 + i, 0, 0) for i in range(50)] + [(2000 + i, 1, None) for i in range(50)] + [(1000, 1, 0), (None, 0, 1)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    out = url_reputation.filter_urls(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), RULES).toPandas()
    assert len(out) == len(urls)
    row = {r.page_id: r for r in out.itertuples() if r.page_id == r.page_id}
    assert (row[1].host, row[1].path, row[1].rule, row[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (row[2].rule, row[2].verdict) == ("org/", "allow")
    assert (row[3].host, row[3].path, row[4].host, row[4].path) == ("", "", "", "")
    assert (row[5].host, row[5].path, row[5].verdict) == ("good.com", "", "allow")
    assert (row[6].verdict, row[6].host_labelled, row[6].host_bad) == ("block", 50, 50)
    assert (row[7].host, row[7].rule, row[7].verdict) == ("Äb.com", "com/fr/", "allow")
    assert (row[8].host, row[8].path) == ("u@h.co.uk", "/p://q")
    none = url_reputation.filter_urls(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int"), RULES)
    assert none.filter("rule IS NULL").select("verdict").distinct().collect()[0][0] == "allow"
    assert url_reputation.filter_urls(pages.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), RULES).count() == 0


def test_poisson_counts_follow_the_rates(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "x" * (1 + i % 4), 9, "c") for i in range(6000)] + [(None, None, "null source", 9, "c"), (7000, "empty", None, 9, "c")]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string, copy int, order_key string")
    rates = {r.source: r.rate for r in mixing.source_rates(table).collect()}
    assert rates["empty"] == 0.0
    out = mixing.replicate(table, mixing.source_rates(table))
    assert out.columns == [*table.columns, "_copy", "copies", "_order_key"]
    got = out.toPandas()
    share = got.text.str.len().groupby(got.source.fillna("")).sum()
    assert abs(share["hot"] / share.drop("").mean() - 1) < 0.15
    first = got.drop_duplicates("doc_id").set_index("doc_id")
    for i in list(first.index[:200]):
        u = int(hashlib.md5(f"0:{'null' if i != i else int(i)}".encode()).hexdigest()[:13], 16) / (1 << 52)
        rate, k, below = rates[first.source[i] or ""], 0, 0.0
        while (below := below + math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))) <= u:
            k += 1
        assert first["copies"][i] == k
    assert mixing.replicate(table.limit(0), mixing.source_rates(table.limit(0))).count() == 0
    weights = spark.createDataFrame([("hot", 1.0), ("s1", None), ("s2", -3.0), ("other", 5.0)], "source string, weight double")
    assert {r.source for r in mixing.replicate(table, mixing.source_rates(table, weights)).select("source").distinct().collect()} == {"hot"}


def test_mixture_query_moves_whole_texts(spark):
    """The text is among the columns of the shuffle that orders the copies, and its check follows that shuffle."""
    plan = catalog.QUERIES["op7_poisson_mix"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "RepartitionByExpression":
        plan = plan.children().head()
    names = plan.output().mkString(",")
    assert re.search(r"\btext#", names) and "order_key" in names


def test_languages_are_learned(spark):
    rng = random.Random(8)
    stems = {"aa": ["the", "and", "ing"], "bb": ["ung", "sch", "der"], "cc": ["eau", "oix", "que"], "dd": ["ción", "ños", "las"]}
    rows = [(i, " ".join("".join(rng.choices(stems[g], k=2)) for _ in range(rng.randint(4, 40))), g, "x") for i, g in ((i, rng.choice(list(stems))) for i in range(600))]
    rows += [(9001, None, "aa", "x"), (9002, "", "aa", "x"), (9003, "12 !?", "bb", "x"), (None, "theand", None, "x"), (9004, "the and " * 30000, None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = language_id.identify(table).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    pred = out.set_index("doc_id").lang_pred
    assert [pred[i] for i in (9001, 9002, 9003)] == ["und"] * 3 and pred[9004] == "aa"
    held = out[out.held_out & (out.doc_id < 9000)]
    truth = {i: g for i, _, g, _ in rows}
    assert (held.lang_pred == held.doc_id.map(truth)).mean() > 0.98
    assert all(r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 3 == 1) for r in out.dropna(subset=["doc_id"]).itertuples())
    assert language_id.identify(table.limit(0)).count() == 0
    assert set(language_id.identify(table.withColumn("lang", F.lit(None).cast("string"))).toPandas().lang_pred) == {"und"}
    assert set(language_id.identify(table.filter("lang = 'aa'")).toPandas().lang_pred) == {"aa", "und"}
    kept = language_id.keep_identified(table)
    assert kept.columns == table.columns and kept.count() == len(rows) - 3


def test_texts_of_no_language_go(spark):
    """Encoded junk goes, every clean row stays; without labels nothing but letterless texts goes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").filter("text IS NOT NULL")
    rng = random.Random(4)
    junk = [(10**9 + i, base64.b64encode(rng.randbytes(600)).decode(), None) for i in range(40)] + [(2 * 10**9, "12 !", None)]
    both = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    kept = {r.doc_id for r in language_id.keep_identified(both).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}
    unlabelled = both.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_identified(unlabelled).count() == both.count() - 1


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 12, 40):
        code = language_id.codewords(k)
        apart = (code[:, None] != code[None]).sum(2)[~np.eye(k, dtype=bool)]
        assert code.shape[0] == k and apart.min() >= max(1, code.shape[1] // 4)


ODD = ["", "  a  b\n\n ", "▁x ▁▁", "\x00é😀日本 <0x0A> <s>\r\n", "a" * 5000, "naïve   ▁ end\t\ttab", " " * 50, "\n"]


def test_segmentations_are_lossless_and_reproducible(spark, docs, no_docs):
    table = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*ODD, None])] + [(None, "x y", "k"), (0, "", "k")], "doc_id long, text string, decoded_ string")
    coded = piece_sampling.encode(table)
    back = piece_sampling.decode(coded).collect()
    assert len(back) == len(ODD) + 3 and all(r.decoded == r.text for r in back)
    again = {(r.doc_id, r.text): r.piece_ids for r in piece_sampling.encode(table.repartition(5)).collect()}
    assert again == {(r.doc_id, r.text): r.piece_ids for r in back}
    assert {tuple(r.piece_ids) for seed in range(5) for r in piece_sampling.encode(table.filter("doc_id = 5"), seed=seed).collect()}.__len__() > 1
    facts = piece_sampling.digests(docs).toPandas()
    assert facts.lossless.all() and sorted(facts.n_chars) == sorted(len(t or "") for _, t, *_ in documents())
    assert piece_sampling.encode(no_docs).count() == 0 == piece_sampling.digests(no_docs).count()


def test_sampled_segmentations_follow_the_lattice():
    with open(piece_sampling.MODEL, "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    pieces = piece_sampling.Pieces(model)
    rows = 30_000
    for word in (" thing", "eaué", "日x"):
        shown, chance = word.replace(" ", "▁"), {}

        def walk(at, made, log, word=word, shown=shown, chance=chance):
            if at == len(word):
                chance[made] = math.exp(log)
                return
            single = False
            for end in range(at + 1, len(word) + 1):
                if (i := ids.get(shown[at:end])) is not None:
                    walk(end, (*made, i), log + pieces.weight[i])
                    single |= end == at + 1
            if not single:
                own = tuple(pieces.byte_id[b] for b in word[at].encode())
                walk(at + 1, made + own, log + sum(pieces.weight[list(own)]))

        walk(0, (), 0.0)
        whole = sum(chance.values())
        drawn = Counter(tuple(x.tolist()) for x in piece_sampling.sample(piece_sampling.Words(pieces), [word] * rows, [piece_sampling.key_seed(i, 1) for i in range(rows)]))
        assert drawn.keys() <= chance.keys()
        assert all(abs(drawn[k] / rows - p / whole) < 0.02 for k, p in chance.items())


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://h/{i}\r\nX: y", f"<p>é {i % 7}</p>\r\n\r\n", "e") for i in range(40)] + [(50, None, None, "e"), (51, "u", "", "e"), (None, "u", "only null id", "e"),
             (52, "u", "long " * 300_000, "e"), (53, "a", "same id", "e"), (53, "b", "same id", "e"), (53, "b", "other", "e")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, digest_ok string")
    out = warc.archive_round_trip(spark, table, f"file://{tmp_path}/w").collect()
    assert len(out) == len(pages) and all(r.digest_ok for r in out)
    first = {}
    for i, _, h, _ in pages:
        first[h or ""] = max(first.get(h or "", -1), -1 if i is None else i)
    digest = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): h for h in first}
    for r in out:
        h = digest[r.payload_digest]
        alone = r.page_id in (None, first[h])
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(h.encode()), "response" if alone else "revisit", None if alone else first[h])
    one = out[0]
    with open(one.archive.removeprefix("file://"), "rb") as f:  # any record stands alone at its place
        f.seek(one.offset)
        assert gzip.decompress(f.read(one.length)).startswith(b"WARC/1.1\r\n")
    assert warc.archive_round_trip(spark, table.limit(0)).count() == 0


def test_selected_records_only(spark, tmp_path):
    table = spark.createDataFrame([(i, "u", f"page {i}") for i in range(30)], "page_id long, url string, html string")
    index = warc.write_archives(table, f"file://{tmp_path}/v")
    some = warc.read_records(index.filter("page_id % 10 = 3")).collect()
    assert sorted(r.page_id for r in some) == [3, 13, 23]


def test_pipeline_stages(spark, tmp_path):
    rows = [(i, t, la, s, n) for i, t, la, s, n, *_ in documents()]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], folder)
        out.write.parquet(f"{folder}/{name}")
        steps.append(spark.read.parquet(f"{folder}/{name}"))
        assert name == "pieces" or out.columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_copies", "mixing", "pieces"]
    lettered = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    assert steps[1].count() == len(lettered)
    assert Counter(bare(r.text) for r in steps[2].collect()) == Counter({bare(r[1]) for r in lettered})
    ids, _, _ = near_classes([tuple(r) for r in steps[2].collect()])
    assert {r.doc_id for r in steps[3].collect()} - {None} == {i for i, k in ids.items() if i is not None and i == k}
    assert {r.doc_id for r in steps[4].collect()} <= {r.doc_id for r in steps[3].collect()}
    assert steps[5].count() == steps[4].count() and "piece_ids" in steps[5].columns


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_match_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, folder)
    cursor = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))
