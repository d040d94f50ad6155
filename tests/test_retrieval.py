"""Retrieval and evidence on small corpora, and invariants on the given tables."""

import pytest
from pyspark.sql import functions as F

from corpusspark.operators import extract, quality
from corpusspark.plans import catalog
from corpusspark.plans.retrieval import Retrieval
from corpusspark.sources import scan

SF = "/root/testdata/sf0.001"
PAGE = "---\ntitle: {t}\ntype: entity\ncreated: 2024-01-01\nupdated: 2024-01-01\nsources: []\n---\n{b}\n"


def corpus(spark, root, files, index):
    rows = [(root, p, PAGE.format(t=p.rsplit("/", 1)[-1][:-3], b=b)) for p, b in files.items()] + [(root, "index.md", "# index\n" + "\n".join(index))]
    pages = spark.createDataFrame(rows, "root_id string, path string, text string")
    return extract.parse_pages(pages), scan.parse_index(scan.index_lines(pages))


def log(spark, *queries, root=None, **given):
    rows = [(f"q{i}", q, root, given.get("mode", "focused"), given.get("limit", 20), given.get("budget", 8), False, False, given.get("operator"), given.get("scope"), given.get("scope"))
            for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "query_id string, query string, named_root string, mode string, candidate_limit int, evidence_budget int, include_source boolean, include_cross_module boolean, plan_operator string, plan_scope string, plan_subject string")


def roots_of(spark, *rows):
    return scan.with_code_roots(spark.createDataFrame(list(rows), "root_id string, name string, path string, enabled boolean, mode string, priority int"))


APP_FILES = {
    "entities/product/modules/APPSET.md": "APPSET apps\n\n- [one](../features/APPSET/one.md)\n- [two](../features/APPSET/two.md)",
    "entities/product/features/APPSET/one.md": "first app", "entities/product/features/APPSET/two.md": "second app",
    "entities/product/features/APPSET/three.md": "third app",
}
APP_INDEX = ["- [APPSET 应用集合](entities/product/modules/APPSET.md) - APPSET 的应用", "- [one](entities/product/features/APPSET/one.md) - APPSET 应用一",
             "- [two](entities/product/features/APPSET/two.md) - APPSET 应用二", "- [three](entities/product/features/APPSET/three.md) — APPSET 应用三",
             "- [web](https://example.com) - no entry"]


def test_collection_has_owner_and_members(spark):
    pages, entries = corpus(spark, "kb", APP_FILES, APP_INDEX)
    assert entries.count() == 4
    r = Retrieval(roots_of(spark, ("kb", "kb", "/kb", True, "read_only", 1), ("off", "off", "/off", False, "read_only", 9)), entries, log(spark, "APPSET有几个应用"), pages)
    assert [t["root_id"] for t in r.targets.collect()] == ["kb"]
    assert r.targets.first()["operator"] == "COUNT_COLLECTION" and r.targets.first()["scope"] == "APPSET"
    evidence = r.evidence.orderBy("evidence_pos").collect()
    assert evidence[0]["path"] == "wiki/entities/product/modules/APPSET.md" and evidence[0]["selection_reason"] == "collection_owner_page"
    proof = r.coverage.first()
    assert proof["complete"] and len(proof["member_paths"]) == 3
    bundle = quality.evidence_pages(r.evidence, pages)
    gaps = quality.bundle_gaps(bundle, r.expansion, r.targets).unionByName(quality.sufficiency_gaps(r.targets, bundle, r.coverage))
    assert quality.confidence(r.targets, bundle, gaps, ["query_id"]).first()["confidence"] == "high"


def test_provided_plan_and_single_member(spark):
    pages, entries = corpus(spark, "kb", APP_FILES, APP_INDEX)
    roots = roots_of(spark, ("kb", "kb", "/kb", True, "read_only", 1))
    r = Retrieval(roots, entries, log(spark, "应用集合数量", operator="COUNT_COLLECTION", scope="APPSET"), pages)
    assert r.targets.first()["planner"] == "provided" and r.evidence.orderBy("evidence_pos").first()["page_role"] == "module"
    lone, few = corpus(spark, "kb", {"entities/product/features/APPSET/one.md": "x"}, ["- [one](entities/product/features/APPSET/one.md) - APPSET 应用"])
    s = Retrieval(roots, few, log(spark, "APPSET有几个应用"), lone)
    bundle = quality.evidence_pages(s.evidence, lone)
    codes = {g["code"] for g in quality.sufficiency_gaps(s.targets, bundle, s.coverage).collect()}
    assert {"collection_owner_missing", "single_member_page_insufficient_for_count"} <= codes


def test_only_the_index_is_searched_and_links_are_followed(spark):
    files = {"concepts/flow.md": "see [[helper-agent]] and [[gone]] and [c](../entities/helper-agent.md#x)", "entities/helper-agent.md": "secretword"}
    pages, entries = corpus(spark, "kb", files, ["- [Agentic Workflow](concepts/flow.md) - how agents work"])
    r = Retrieval(roots_of(spark, ("kb", "kb", "/kb", True, "read_only", 1)), entries, log(spark, "Agentic Workflow", "secretword", "?!"), pages)
    assert {(t["query_id"], t["path"]) for t in r.top.collect()} == {("q0", "concepts/flow.md")}
    assert r.top.first()["score20"] == (60 + 2 * 25) * 4
    links = {(e["target"], e["dst"]) for e in r.expansion.collect()}
    assert links == {("helper-agent", "wiki/entities/helper-agent.md"), ("gone", None), ("../entities/helper-agent.md", "wiki/entities/helper-agent.md")}
    linked = r.candidates.where("source <> 'index.md'").first()
    assert linked["path"] == "wiki/entities/helper-agent.md" and linked["score20"] == 330


def test_module_without_pages_falls_back_to_the_map(spark):
    files = {"entities/code/modules/repository-map.md": "map", "entities/code/features/AAA/f.md": "feature", "sources/x.md": "src"}
    index = ["- [map](entities/code/modules/repository-map.md) - 仓库地图", "- [f](entities/code/features/AAA/f.md) - AAA 导出能力", "- [BBB only here](sources/x.md) - BBB"]
    pages, entries = corpus(spark, "kb", files, index)
    r = Retrieval(roots_of(spark, ("kb", "kb", "/kb", True, "read_only", 1)), entries, log(spark, "BBB 导出 实现 审计"), pages)
    assert r.targets.first()["modules"] == ["BBB"]
    assert [(p["rule_no"], p["path"]) for p in r.primaries.collect()] == [(4, "wiki/entities/code/modules/repository-map.md")]


def test_invariants_on_the_tables(spark):
    r = catalog.retrieval(spark, SF)
    keys = ["query_id", "root_id", "path"]
    assert r.evidence.groupBy(*keys).count().where("count > 1").isEmpty()
    assert r.evidence.join(r.candidates, keys, "left_anti").isEmpty()
    budget = F.when(F.col("evidence_budget") > 0, F.col("evidence_budget")).when(F.col("mode") == "exhaustive", 30).otherwise(8)
    sizes = r.evidence.groupBy("query_id", "root_id").agg(F.count("*").alias("n")).join(r.targets, ["query_id", "root_id"])
    assert sizes.where(F.col("n") > budget).isEmpty()
    both = r.omitted.join(r.evidence, keys, "left_semi").count()
    assert both == 0 and r.candidates.where("source = 'index.md'").count() == r.omitted.count() + r.candidates.where("source = 'index.md'").join(r.evidence, keys, "left_semi").count()


@pytest.mark.parametrize("body,codes", [
    ("## Source Snapshot\nx\n## Outline\n- a\n## Summary\nshort\n", {"source_summary_too_thin"}),
    ("plain", set()),
])
def test_lint_of_source_pages(spark, body, codes):
    from corpusspark.operators import lint

    pages, _ = corpus(spark, "kb", {"sources/s.md": body}, [])
    got = {i["code"] for i in lint.page_issues(lint.page_facts(pages)).collect()}
    assert got == codes


def test_lint_ladder_of_code_features(spark):
    from corpusspark.functions.fixed_values import CODE_FEATURE_REQUIRED_HEADINGS as H
    from corpusspark.operators import lint

    def codes(body, sources="[]", files=()):
        text = PAGE.format(t="f", b=body).replace("sources: []", f"sources: {sources}")
        rows = spark.createDataFrame([("kb", "entities/code/features/f.md", text)], "root_id string, path string, text string")
        facts = lint.page_facts(extract.parse_pages(rows))
        present = spark.createDataFrame([("kb", f) for f in files] or [("kb", "none")], "root_id string, path string")
        return {i["code"] for i in lint.page_issues(facts).unionByName(lint.missing_summaries(facts, present)).collect()}

    assert codes("thin") == {"code_feature_required_section_missing", "code_feature_code_locator_missing", "code_feature_source_trace_missing"}
    assert "code_feature_section_not_substantive" in codes("\n".join(f"## {h}\n- 待补充" for h in H))
    full = "\n".join(f"## {h}\n- src/main/ExampleService.java 负责这里的处理流程" for h in H)
    trace = "[wiki/sources/code/team-runs/r1.md]"
    assert codes(full, trace) == {"code_feature_source_summary_missing"}
    assert codes(full, trace, ["wiki/sources/code/team-runs/r1.md"]) == set()
