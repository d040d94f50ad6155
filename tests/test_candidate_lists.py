"""Long query logs as lists of numbers give the candidates, primaries and pages that rows give, and leave little on disk."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusspark.functions import fixed_values as V
from corpusspark.operators import candidate_lists, scoring, search_strings
from corpusspark.operators.pair_scores import packed, unpacked
from corpusspark.plans.retrieval import ListedRetrieval, Retrieval
from corpusspark.session import SHUFFLES_END, cut_lineage, scratch

ENTRY = "root_id string, entry_pos long, title string, path string, summary string"
PAGE = "root_id string, repo_path string, title string, page_type string, body string"


@pytest.fixture(scope="module")
def job(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["EN", "FR", "数据权限", "导出"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    folders = ["entities/code/features/", "entities/code/modules/", "sources/", "entities/data-dictionary/", "concepts/", "queries/"]
    entries, pages = [], []
    for root in ("r1", "r2"):
        for i in range(60):
            path = f"{folders[i % 6]}{rng.choice(['EN', 'FR'])}/{'repository-map-' if i % 12 == 1 else 'p'}{i % 50}.md"
            entries.append((root, i, text(3) if i % 9 else None, path if i % 7 else f"wiki/{path}", text(12) if i % 8 else None))
            pages.append((root, path if path.startswith("wiki/") else f"wiki/{path}", f"page {i}", "entity", f"[[p{(i + 1) % 50}]] [x](p{(i + 6) % 60}.md) [[unlisted]] [[none]]"))
        entries += entries[-3:-1]
        pages.append((root, "wiki/unlisted.md", "not in the index", "entity", "end"))
    queries = [(f"q{i}", text(rng.randint(1, 6)) + rng.choice(["", " 代码 数据权限", " 代码地图", " EN 有哪些能力", " 原文"]), rng.choice(["r1", "r2", None])) for i in range(30)]
    log = spark.createDataFrame([*queries, queries[0]], "query_id string, query string, named_root string").select(
        "*", F.lit("focused").alias("mode"), F.lit(0).alias("candidate_limit"), F.lit(0).alias("evidence_budget"), F.lit(False).alias("include_source"),
        F.lit(False).alias("include_cross_module"), *[F.lit(None).cast("string").alias(c) for c in ("plan_operator", "plan_scope", "plan_subject")])
    roots = spark.createDataFrame([("r1", True, 1, False), ("r2", True, 2, True)], "root_id string, enabled boolean, priority int, is_code_root boolean")
    parts = (roots, spark.createDataFrame(entries, ENTRY), log, spark.createDataFrame(pages, PAGE))
    return Retrieval(*parts, candidate_limit=9), ListedRetrieval(*parts, candidate_limit=9)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).distinct().collect())


def test_lists_give_the_primaries_of_rows(job):
    for columns in (["query_id", "root_id", "path", "score20", "rule_no"], ["query_id", "root_id", "path", "primary_pos"]):
        expected = rows(job[0].primaries.where("query_id <> 'q0'"), *columns)
        assert expected and rows(job[1].primaries.where("query_id <> 'q0'"), *columns) == expected
    assert len({r[0] for r in rows(job[0].primaries, "rule_no")}) > 1


def test_lists_give_the_merged_candidates_of_rows(job):
    expected = rows(job[0].merged, "query_id", "root_id", "pos", "path")
    assert rows(job[1].merged, "query_id", "root_id", "pos", "path") == expected
    named = job[1].merged.where("title is not null").withColumnRenamed("title", "place").join(job[1].titles.where("title is not null"), "place")
    assert rows(named, "query_id", "root_id", "path", "title") == [r for r in rows(job[0].merged, "query_id", "root_id", "path", "title") if r[3] is not None]
    assert any(r[3] == "wiki/unlisted.md" for r in expected)


def test_lists_cut_by_entries_are_whole_again(job, monkeypatch):
    lists, facts = job[1].listed
    targets, columns = candidate_lists.carried(job[1].targets)
    ranked, numbers = scoring.ranked_lists(job[1].index, targets, job[1].aliases, columns, 9, block=16, few=0)
    ranked = cut_lineage(ranked)
    again = candidate_lists.candidate_lists(ranked, facts, entries_of_cell=7, queries_of_cell=5)
    assert rows(again, "query_id", "root_id", "pos", "path_no", "score", "flags") == rows(lists, "query_id", "root_id", "pos", "path_no", "score", "flags")


def test_scores_and_numbers_share_a_long():
    scores, numbers = np.array([5, 1, 2**30]), np.array([1, 2**32 - 1, 7])
    both = packed(scores, numbers)
    assert [x.tolist() for x in unpacked(both)] == [scores.tolist(), numbers.tolist()]
    assert np.argsort(both).tolist() == [2, 0, 1]


def test_shared_values_of_lists():
    facts, queries = pa.chunked_array([[["a", "b"], [], None, ["c"]]]), pa.chunked_array([[["b", "x"], None, ["c", "a"]]])
    owner, row = np.array([0, 0, 1, 2, 2, 2]), np.array([0, 3, 0, 3, 0, 1])
    assert candidate_lists.shared(owner, row, facts, queries).tolist() == [True, False, False, True, True, False]


def test_long_strings_are_found_by_their_heads():
    head = "h" * search_strings.HEAD
    strings = search_strings.Strings([(head, 1), (head + "ab", 2), (head + "ac", 3), ("ab", 4), ("x" * 3000, 5)])
    assert strings.found(f"..{head}ac") == [1, 3]
    assert strings.found(f"{head[1:]} ab") == [4]
    assert strings.found("y" + "x" * 3000) == [5]
    nodes = strings.automaton.get_stats()["nodes_count"] + strings.heads.get_stats()["nodes_count"] if len(strings.automaton) else strings.heads.get_stats()["nodes_count"]
    assert nodes < 4 * search_strings.HEAD


def test_stages_on_the_way_are_removed(spark):
    with scratch(spark) as keep:
        aside = cut_lineage(spark.range(3))
        with scratch(spark) as pass_on:
            inner = cut_lineage(spark.range(4))
            passed = pass_on(cut_lineage(inner))
        assert passed.count() == 4 and not os.path.exists(inner._stage_folder.removeprefix("file:"))
        result = keep(cut_lineage(aside.union(passed)))
    assert result.count() == 7
    assert [os.path.exists(x._stage_folder.removeprefix("file:")) for x in (aside, passed, result)] == [False, False, True]


def test_shuffle_files_end_with_the_write(spark):
    before = spark.conf.get(SHUFFLES_END, None)
    stage = cut_lineage(spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(4, "k"))
    assert stage.count() == 1000 and spark.conf.get(SHUFFLES_END, None) == before


def test_candidates_of_rules_hold_no_texts(job):
    assert set(job[1].listed[0].columns) == {"query_id", "root_id", *candidate_lists.LISTS}
    assert V.CANDIDATE_LIMIT and dict(job[1].matched.dtypes)["path_nos"] == "array<int>"
