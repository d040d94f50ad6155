"""Rules on nested findings, repository scope of a closure, and collections beyond the candidate limit."""

from pyspark.sql import functions as F

from corpusspark.operators import closure, findings, selection
from corpusspark.sources import scan

LINE = ('{"finding_id":"F1","batch_id":"B1","kind":"k","title":"标题","current_state":"现状","knowledge_level":"code_map",'
        '"repairs":[{"rationale":"fix it","confidence":0.5}],"notes":["plain",{"reason":"nested"},["no field"],"中文"],'
        '"evidence_refs":["x"],"coverage_claims":[{"item":"x","status":"covered","evidence_refs":["x"]}],'
        '"blocking_gaps":[],"non_blocking_gaps":[],"exploration_hints":[],"confidence":%s}')


def parsed(spark, confidence):
    return findings.flatten_findings(scan.parse_findings(spark.createDataFrame([(LINE % confidence,)], "line string")))


def test_language_rule_at_any_depth(spark):
    found = {r["item"] for r in findings.language_issues(parsed(spark, "0.9")).collect()}
    assert found == {"repairs[0].rationale", "notes[0]", "notes[1].reason"}


def test_confidence_is_the_top_level_number(spark):
    def wrong(c):
        return "invalid_confidence" in {r["code"] for r in findings.field_issues(parsed(spark, c)).collect()}

    assert [wrong(c) for c in ("0.9", "1", "7", '"0.9"', "null", "[0.5]", "1e-1")] == [False, False, True, True, True, True, False]


def test_references_stay_in_the_batch_repositories(spark):
    batches = spark.createDataFrame([("one", ["repos/a"], ["repos/a/x.js:1"], []), ("both", ["a", "b"], ["repos/a/x.js"], []), ("guess", [], ["repos/c/y.js"], [])],
                                    "batch_id string, repo_ids array<string>, paths array<string>, entrypoints array<string>")
    repos = spark.createDataFrame([("a", "repos/a"), ("b", "repos/b")], "name string, path string")
    scope = closure.batch_repositories(batches, closure.seed_files(batches), repos)
    assert {(r["batch_id"], r["repo_path"]) for r in scope.collect()} == {("one", "repos/a"), ("both", "repos/a"), ("both", "repos/b"), ("guess", "repos/c")}
    paths = spark.createDataFrame([("repos/a/x.js",), ("repos/b/S.java",)], "path string")
    step = spark.createDataFrame([(b, "repos/a/x.js", "repos/b/S.java", k) for b in ("one", "both") for k in ("java_type_reference", "js_relative_import")],
                                 "batch_id string, src string, dst string, kind string")
    kept = {(r["batch_id"], r["kind"]) for r in closure.in_scope(step, closure.file_owners(paths, repos), scope).collect()}
    assert kept == {("one", "js_relative_import"), ("both", "java_type_reference"), ("both", "js_relative_import")}


def test_collection_of_a_hundred_members_is_complete(spark):
    targets = spark.createDataFrame([("q", "r", True, "LIST_COLLECTION", "EN", "EN")], "query_id string, root_id string, is_collection boolean, operator string, scope string, subject string")
    pages = [("r", f"entities/product/features/EN/p{i:03d}.md", ["EN"]) for i in range(100)] + [("r", "entities/product/modules/EN/m.md", ["EN"])]
    index = spark.createDataFrame(pages, "root_id string, path string, page_modules array<string>")
    merged = index.limit(3).select(F.lit("q").alias("query_id"), "root_id", F.concat(F.lit("wiki/"), "path").alias("path"), "page_modules", F.lit("feature").alias("page_role"), F.lit(40).alias("score20"))
    proof = selection.coverage_proof(merged, merged.limit(1).select("query_id", "root_id", "path"), targets, index).first()
    assert len(proof["member_paths"]) == 100 and len(proof["owner_pages"]) == 1 and proof["complete"] and len(proof["evidence_member_paths"]) == 1
