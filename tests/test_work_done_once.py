"""Work that grows with texts or queries is done once: index lines, pages of bundles, words of queries, row relevance."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from corpusspark.operators import closure, query_features, reconcile, repos, scoring, selection
from corpusspark.plans.catalog import Quality, Reconciliation
from corpusspark.sources import scan


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_index_line_is_built_once(spark):
    lines = spark.createDataFrame([("r", 1, "- [A](a.md) — one"), ("r", 2, "- [W](https://x) — web"), ("r", 3, "text"), ("r", 4, None)], "root_id string, entry_pos long, line string")
    found = scan.parse_index(lines.withColumn("line", F.translate("line", "#", "")))
    assert [tuple(r) for r in found.collect()] == [("r", 1, "A", "a.md", "one")]
    assert optimized(found).count("translate(") == 1


def test_bundles_read_their_pages_from_a_written_table(spark):
    evidence = spark.createDataFrame([("q1", "r", "wiki/a.md"), ("q2", "r", "wiki/a.md"), ("q2", "r", "wiki/gone.md")], "query_id string, root_id string, path string")
    pages = spark.createDataFrame([("r", "wiki/a.md", "text", ["s"], "A", "concept"), ("r", "wiki/b.md", "other", [], "B", "concept")],
                                  "root_id string, repo_path string, text string, sources array<string>, title string, page_type string")
    bundle = Quality(SimpleNamespace(evidence=evidence), pages, None).bundle
    assert {(r.query_id, r.path): r.content for r in bundle.collect()} == {("q1", "wiki/a.md"): "text", ("q2", "wiki/a.md"): "text", ("q2", "wiki/gone.md"): None}
    assert bundle.inputFiles()


def test_words_of_queries_meet_the_aliases_of_searched_roots_only(spark):
    targets = spark.createDataFrame([("q", "r1", ["en", "x"], "en x")], "query_id string, root_id string, tokens array<string>, lowered_query string")
    aliases = spark.createDataFrame([("r1", "en", "EN", (1, 0)), ("r2", "en", "En", (2, 0))],
                                    "root_id string, alias_key string, module string, alias_rank struct<entry_pos: long, value_pos: int>")
    assert [tuple(r) for r in query_features.query_modules(targets, aliases).collect()] == [("q", "r1", ["EN"])]


def test_words_of_pages_are_not_shuffled_before_they_meet_the_aliases(spark):
    pages = spark.createDataFrame([("r", "a/en.md", "En b", "b-c EN _ -- 9")], "root_id string, path string, title string, summary string")
    aliases = spark.createDataFrame([("r", k, k.upper(), (i, 0)) for i, k in enumerate(("b", "en", "b-c", "c"))],
                                    "root_id string, alias_key string, module string, alias_rank struct<entry_pos: long, value_pos: int>")
    found = scoring.page_modules(pages, aliases)
    assert found.collect()[0].page_modules == ["EN", "B", "B-C"]
    assert not any("Aggregate" in line and "alias_key" in line.split("],")[0] for line in optimized(found).splitlines())


def test_relevance_is_dealt_by_number(spark):
    bundle = spark.createDataFrame([("q", "r", "wiki/m.md", "text")], "query_id string, root_id string, path string, content string")
    asks = spark.createDataFrame([("q", ["导出权限", "web"], ["en"])], "query_id string, terms array<string>, ask_modules array<string>")
    rows = spark.createDataFrame([("r", "wiki/m.md", 0, "EN", "导出权限", "", "EN 导出权限 web"), ("r", "wiki/m.md", 1, None, "x", "", "nothing")],
                                 "page_root string, page_path string, row_index int, product_module string, capability string, judgement string, row_values string")
    found = repos.code_map_matches(bundle, rows, asks, ["query_id"])
    assert [(r.row_index, r.relevance) for r in found.collect()] == [(0, 14 + 7 + 3)]
    assert "RepartitionByExpression" in optimized(found)


def test_handoffs_build_no_pages_and_parse_tables_once(spark):
    text = "\n".join(["# Knowledge Manager 维护请求", "", "| 分片 | 主题 | 来源批次 |", "| --- | --- | --- |", "| h/1.md | topic | B1 |", "",
                      "| 分片 | Source summary | 候选正式代码页 | 知识层级 |", "| --- | --- | --- | --- |", "| h/1.md | wiki/s.md | wiki/a.md, wiki/b.md | code_map |"])
    documents = spark.createDataFrame([("r1", "r", None, text, "task")], "request_id string, root_id string, source_path string, text string, task string")
    files = spark.createDataFrame([], "root_id string, path string, text string")
    pages = spark.range(1).select(F.raise_error(F.lit("read")).alias("root_id"), *[F.lit("").alias(c) for c in ("repo_path", "title", "page_type", "body")])
    r = Reconciliation(documents, files, None, None, pages)
    assert [tuple(x) for x in r.strings.orderBy("query_no").select("query_no", "query").collect()][:2] == [(1, "topic"), (2, "wiki/a.md")]
    assert [x.material for x in reconcile.materials(r.handoffs, r.shards, r.outputs).collect()] == ["h/1.md"]
    for kept in (r.tables, r.shards, r.outputs):
        assert kept.inputFiles()
    assert "MapInArrow" not in optimized(reconcile.handoff_outputs(documents, r.handoffs, r.tables))


def test_titles_are_kept_for_the_own_query_of_a_request_only(spark):
    r = Reconciliation(None, None, None, None, None)
    r.__dict__["run"] = SimpleNamespace(merged=spark.createDataFrame(
        [("r1#0", 1, "a.md", "A"), ("r1#2", 1, "b.md", "B")], "query_id string, pos int, path string, title string"))
    assert {tuple(x) for x in r.found.select("request_id", "query_no", "pos", "path").collect()} == {("r1", 0, 1, "a.md"), ("r1", 2, 1, "b.md")}
    assert "title" not in r.found.columns
    assert [tuple(x) for x in r.titled.collect()] == [("r1", 0, 1, "a.md", "A")]


def test_merged_candidates_are_shuffled_once(spark):
    schema = "query_id string, root_id string, path string, pos int, title string"
    index = spark.createDataFrame([("q", "r", "b", 1, "B"), ("q", "r", "a", 2, "A"), ("q2", "r", "a", 1, "A")], schema)
    linked = spark.createDataFrame([("q", "r", "a", 1, "linked"), ("q", "r", "c", 2, "C"), ("q", None, "c", 3, "C")], schema)
    merged = selection.merge_candidates(index, linked)
    assert {tuple(x) for x in merged.collect()} == {
        ("q", "r", "b", 1, "B"), ("q", "r", "a", 2, "A"), ("q", "r", "c", 3, "C"), ("q2", "r", "a", 1, "A"), ("q", None, "c", 1, "C")}
    assert merged._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1
    assert optimized(merged).count("RepartitionByExpression") == 1


def test_an_import_is_looked_up_once_for_all_extensions(spark):
    facts = spark.createDataFrame([("w/src/a.vue", ["./b", "@/c", "./none", "./d.js"]), ("w/src/b.vue", []), ("w/src/b.ts", []), ("w/src/c/index.js", []), ("w/src/d.js", []),
                                   ("w/x.vue", ["@/b"])], "path string, imports array<string>")
    refs = closure.import_refs(facts)
    assert {(r.src, r.dst, r.symbol) for r in refs.collect()} == {
        ("w/src/a.vue", "w/src/b.ts", "./b"), ("w/src/a.vue", "w/src/c/index.js", "@/c"), ("w/src/a.vue", "w/src/d.js", "./d.js"), ("w/x.vue", "w/src/b.ts", "@/b")}
    assert not any("Generate posexplode" in line and "try_no" in line for line in optimized(refs).splitlines())
