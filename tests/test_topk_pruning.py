"""Top-k by block bounds and dictionary passes: the same rows as scoring every pair, with fewer pairs scored."""

import random

import pytest
from pyspark.sql import functions as F

from corpusspark.functions import fixed_values as V
from corpusspark.operators import scoring
from corpusspark.operators.search_strings import contained, found_in

FLAGS = ", ".join(f"{c} boolean" for c in scoring.FLAG_COLUMNS)


def words(rng, vocabulary, n):
    """Frequent words are drawn much more often than rare ones."""
    return " ".join(vocabulary[min(int(rng.paretovariate(0.7)), len(vocabulary)) - 1] for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i:x}" for i in range(900)] + ["示例", "风险能力", "mod_a"]
    rng.shuffle(vocabulary)
    folders = ["entities/code/features/", "entities/code/modules/", "sources/", "entities/data-dictionary/", "concepts/"]
    entries = [(root, i, words(rng, vocabulary, 3) if i % 9 else "", words(rng, vocabulary, 12) if i % 7 else None, f"{rng.choice(folders)}{rng.choice('AB')}/page-{i % 180}.md")
               for root in ("r1", "r2") for i in range(200)]
    queries = []
    for q in range(12):
        text = words(rng, vocabulary, rng.randint(1, 8)) if q else ""
        tokens = list(dict.fromkeys(text.split())) if q != 1 else None
        for root in ("r1", "r2"):
            queries.append((f"q{q}", root, rng.choice([None, 0, 3, 5]), tokens, text, *[rng.random() < 0.4 for _ in scoring.FLAG_COLUMNS]))
    aliases = [("r1", "mod_a", "MOD_A"), ("r1", vocabulary[0], "X"), ("r2", vocabulary[1], "Y")]
    return (
        spark.createDataFrame(entries, "root_id string, entry_pos long, title string, summary string, path string"),
        spark.createDataFrame(queries, f"query_id string, root_id string, candidate_limit int, tokens array<string>, lowered_query string, {FLAGS}"),
        spark.createDataFrame(aliases, "root_id string, alias_key string, module string"),
    )


def brute(corpus):
    """Every pair scored in plain Python, except for the prior, which is the operator's own."""
    entries, targets, aliases = corpus
    named = {(r.root_id, r.alias_key) for r in aliases.collect()}
    classified = scoring.classified_entries(entries)
    pairs = classified.join(targets, "root_id").select("query_id", "root_id", "entry_pos", "path", "l_title", "l_summary", "l_path", "tokens", "lowered_query",
                                                        "candidate_limit", scoring.prior_score().alias("prior")).collect()
    scored = {}
    for p in pairs:
        title, summary, path, points = p.l_title or "", p.l_summary or "", p.l_path or "", p.prior
        for t in p.tokens or []:
            points += V.W_TOKEN_TITLE * (t in title) + V.W_TOKEN_SUMMARY * (t in summary)
            points += (t in path) * (V.W_MODULE_TOKEN_PATH if (p.root_id, t) in named else V.W_TOKEN_PATH)
        if p.lowered_query:
            points += V.W_QUERY_IN_TITLE if p.lowered_query in title else V.W_QUERY_IN_SUMMARY if p.lowered_query in summary else 0
        if points > 0:
            scored.setdefault((p.query_id, p.root_id, p.candidate_limit), []).append((-points * 4, p.path, p.entry_pos))
    return {(q, root, pos, entry, -points) for (q, root, limit), rows in scored.items()
            for pos, (points, _, entry) in enumerate(sorted(rows)[: limit or 4], 1)}


@pytest.mark.parametrize("block, few", [(4, 0), (16, 0), (7, 10**9)])
def test_top_candidates_equal_brute_force(corpus, block, few):
    top = scoring.top_candidates(*corpus, default_limit=4, block=block, few=few)
    assert {(r.query_id, r.root_id, r.pos, r.entry_pos, r.score20) for r in top.collect()} == brute(corpus)


def test_bounds_leave_blocks_unread(corpus):
    entries, targets, aliases = corpus
    needles, asked = scoring.query_terms(targets)
    terms = scoring.entry_terms(scoring.classified_entries(entries), needles, aliases)
    wanted = targets.drop("tokens").withColumn("k", F.lit(2)).join(asked, "query_id", "left")
    read = scoring.pruned_scores(terms, wanted, 4).count()
    every = terms.join(wanted, "root_id").select(scoring.score20().alias("s")).where("s > 0").count()
    assert read < 0.7 * every


def test_dictionary_pieces_and_repeated_rows(spark, monkeypatch):
    """A dictionary too large to be broadcast is cut into pieces; repeated texts stay repeated."""
    from corpusspark.operators import search_strings

    monkeypatch.setattr(search_strings, "PIECE_ROWS", 3)
    monkeypatch.setattr(search_strings, "CHUNK_BYTES", 300)
    needles = [("a", "ab"), ("a", "b"), ("b", "ab"), ("b", "x y"), ("a", "数据"), ("b", "数"), ("a", "abab"), ("c", "q")]
    texts = [("a", 1, "abab 数据"), ("a", 1, "abab 数据"), ("b", 2, "x y ab"), ("c", 3, None), ("c", 4, ""), ("d", 5, "ab"), ("a", 6, "b" * 2000 + "ab")]
    n = spark.createDataFrame(needles, "root string, needle string")
    t = spark.createDataFrame(texts, "root string, id int, body string")
    expected = sorted((r, i, x) for r, i, b in texts for root, x in needles if r == root and x in (b or ""))
    for rows in (100, 0):
        got = contained(n, t, "body", ["root"], broadcast_rows=rows).select("root", "id", "needle").collect()
        assert sorted(map(tuple, got)) == expected
        arrays = found_in(n, t, ["body"], same=["root"], broadcast_rows=rows)
        assert arrays.count() == len(texts)
    assert contained(n.limit(0), t, "body", ["root"]).count() == contained(n, t.limit(0), "body", ["root"]).count() == 0


def test_cells_keep_the_best_of_every_query_only(corpus, monkeypatch):
    """What leaves a cell is bounded by queries x limit, not by pairs; scores are those of the joined pairs."""
    entries, targets, aliases = corpus
    monkeypatch.setattr(scoring, "QUERIES", 5)
    needles, asked = scoring.query_terms(targets)
    terms = scoring.entry_terms(scoring.classified_entries(entries), needles, aliases)
    wanted = targets.drop("tokens").withColumn("k", F.lit(3)).join(asked, "query_id", "left")
    got = scoring.pruned_scores(terms, wanted, 1000).collect()
    assert 0 < len(got) <= 3 * wanted.count()
    every = {(r.query_id, r.root_id, r.entry_pos): r.s for r in terms.join(wanted, "root_id").select("query_id", "root_id", "entry_pos", scoring.score20().alias("s")).collect()}
    assert all(every[r.query_id, r.root_id, r.entry_pos] == r.score20 for r in got)


def test_hits_carry_no_summaries(corpus, spark):
    """A candidate row holds the topic terms found in its entry, not the entry's text."""
    entries = spark.createDataFrame([("r", 1, "Export 数据权限", "long summary text", "a.md"), ("r", 2, "b", "EXPORT of c", "c.md"), ("r", 3, None, None, "d.md")],
                                    "root_id string, entry_pos long, title string, summary string, path string")
    ranked = spark.createDataFrame([(q, "r", e, e, 4) for q in ("code", "plain") for e in (1, 2, 3)], "query_id string, root_id string, entry_pos long, pos int, score20 int")
    targets = spark.createDataFrame([("code", "r", True, False, "focused", ["export", "数据权限", "d.md"]), ("plain", "r", False, False, "focused", ["export"])],
                                    "query_id string, root_id string, wants_code_knowledge boolean, wants_code_navigation boolean, mode string, code_topic_terms array<string>")
    rows = scoring.narrow_hits(ranked, entries, targets)
    assert "summary" not in rows.columns
    got = {(r.query_id, r.entry_pos): r.topic_found for r in rows.collect()}
    assert got == {("code", 1): ["export", "数据权限"], ("code", 2): ["export"], ("code", 3): ["d.md"], ("plain", 1): [], ("plain", 2): [], ("plain", 3): []}
