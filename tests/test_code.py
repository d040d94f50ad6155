"""Repository inventory, references, closure, findings and rollup on small fixtures."""

from pyspark.sql import functions as F

from corpusspark.operators import closure, findings, inventory, reconcile, rollup, tables
from corpusspark.sources import scan

BASE = "repos/repo-a/"
FILES = {
    "app.py": "from framework import app\n\n@app.route('/items')\ndef list_items():\n    return []\n",
    "src/api/sampleApi.js": "export function listItems() {\n  return request.post('/sample/items/list')\n}\n",
    "src/views/Feature.vue": "import Helper from '@/components/Helper.vue'\nthis.$api.sample.listItems()\n",
    "src/views/List.vue": "not a type", "src/components/Helper.vue": "helper",
    "src/http/modules/sample.js": "import request from '../request'\nexport const listItems = () => {\n  return request({ url: '/sample/items/list' })\n}\n",
    "java/SampleController.java": "import java.util.List;\nimport example.Database;\n@RequestMapping(\"sample\")\npublic class SampleController {\n  private final SampleService service;\n  @PostMapping(value=\"/items/list\")\n  public List<String> list() { String ignored = \"UnrelatedService\"; }\n}\n",
    "java/Database.java": "public class Database {}\n", "java/DatabaseBackupServiceImpl.java": "public class DatabaseBackupServiceImpl {}\n",
    "java/UnrelatedServiceImpl.java": "public class UnrelatedServiceImpl {}\n", "java/SampleService.java": "public interface SampleService {}\n",
    "java/SampleServiceImpl.java": "public class SampleServiceImpl implements SampleService {}\n", "config.json": "{}",
}


def files(spark):
    return spark.createDataFrame([("repo-a", "repos/repo-a", BASE + p, t) for p, t in FILES.items()], "repo_id string, repo_path string, path string, content string")


def test_inventory(spark):
    entry = inventory.entrypoints(files(spark)).orderBy("entry_no").first()
    assert (entry["path"], entry["line"], entry["symbol"]) == (BASE + "app.py", 3, "")
    summary = inventory.language_summary(files(spark)).first()
    assert summary["tracked_files"] == 13 and summary["language_summary"]["java"] == 6 and summary["language_summary"]["other"] == 3


def closed(spark, *seeds):
    batches = spark.createDataFrame([("B1", [BASE + s + ":1" for s in seeds], [], ["repo-a"])], "batch_id string, paths array<string>, entrypoints array<string>, repo_ids array<string>")
    index = closure.build_index(files(spark))
    c = closure.closure(index, closure.seed_files(batches))
    return {r["path"].removeprefix(BASE) for r in c.nodes.collect()}, {r["kind"] for r in c.edges.collect()}, c


def test_closure_from_api(spark):
    reached, kinds, c = closed(spark, "src/api/sampleApi.js")
    assert {"java/SampleController.java", "java/SampleService.java", "java/SampleServiceImpl.java", "java/Database.java"} <= reached
    assert not reached & {"src/views/List.vue", "java/DatabaseBackupServiceImpl.java", "java/UnrelatedServiceImpl.java"}
    assert {"http_endpoint_to_controller", "java_interface_or_contract_implementation"} <= kinds
    rows = closure.evidence_rows(c, files(spark), spark.createDataFrame([("repos/repo-a",)], "path string")).orderBy("evidence_id").collect()
    assert rows[0]["evidence_id"] == "E-B1-001" and rows[0]["last"] == 3 and rows[0]["repo_id"] == "repos/repo-a"


def test_closure_from_view(spark):
    reached, kinds, _ = closed(spark, "src/views/Feature.vue")
    assert {"src/components/Helper.vue", "src/http/modules/sample.js", "java/SampleController.java"} <= reached
    assert {"js_alias_import", "frontend_api_module_call"} <= kinds


def test_findings_and_references(spark):
    ranges = spark.createDataFrame([("B1", "E-B1-001", "a.py", 1, 10)], "batch_id string, evidence_id string, path string, first long, last long")
    line = ('{"finding_id":"F1","batch_id":"B1","kind":"k","title":"标题","current_state":"现状","knowledge_level":"feature_implementation","confidence":0.9,'
            '"evidence_refs":["E-B1-001","a.py:1-3","b.py:1-2","a.py:9-11"],"coverage_claims":[{"item":"x","status":"covered","evidence_refs":["E-B1-001"]}],'
            '"blocking_gaps":[],"non_blocking_gaps":[],"exploration_hints":[]}')
    f = findings.flatten_findings(scan.parse_findings(spark.createDataFrame([(line,)], "line string")))
    assert {r["item"] for r in findings.evidence_ref_issues(f, ranges).collect()} == {"b.py:1-2", "a.py:9-11"}
    assert findings.field_issues(f).isEmpty()
    codes = {r["code"] for r in findings.finding_issues(f, ranges).collect()}
    assert codes == {"invalid_evidence_ref", "coverage_claim_item_not_in_contract", "coverage_contract_items_missing", "knowledge_object_candidates_missing"}


def test_rollup_targets(spark):
    rows = [("B001-topic", "F1", 1, "code_map", ["wiki/entities/code/x.md", "elsewhere.md"]), ("B001-topic", "F2", 2, "code_map", [])]
    f = spark.createDataFrame(rows, "batch string, finding_id string, pos long, knowledge_level string, knowledge_object_candidates array<string>")
    got = {(r["kind"], r["page_no"], r["page"]) for r in rollup.target_pages(f).collect()}
    assert got == {("candidate", 1, "wiki/entities/code/modules/x.md"), ("primary", 1, "wiki/entities/code/modules/x.md"), ("primary", 2, "wiki/entities/code/modules/topic.md")}


def test_tables(spark):
    text = "| a | b |\n|---|---|\n| 1 | 2 |\n| short |\n| 3 | 4 |\n\n| c | d |\n--- | ---\n| 5 | 6 |\ntext\n| no | header |\n"
    got = tables.table_rows(spark.createDataFrame([(1, text)], "id int, text string"), ["id"], "text").orderBy("row_index").collect()
    assert [(r["headers"], r["cells"]) for r in got] == [(["a", "b"], ["1", "2"]), (["a", "b"], ["3", "4"]), (["c", "d"], ["5", "6"])]


def test_manifest_and_artifacts(spark):
    text = '{"schema_version":"t.handoff_manifest.v1","run_id":"r9","shards":[{"path":"s1","candidate_wiki_pages":["a","b"],"primary_wiki_pages":["a"]}]}'
    m = spark.createDataFrame([("r", text)], "request_id string, t string").select("request_id", F.from_json("t", reconcile.MANIFEST_SCHEMA).alias("m"))
    row = reconcile.manifest_rows(m).first()
    assert row["alternate_pages"] == ["b"] and row["shard"] == "s1"
    paths = spark.createDataFrame([("handoff/x",), ("无",), ("wiki/y",), ("z",)], "v string").select(reconcile.artifact_path(F.col("v"), F.lit("r9"))).collect()
    assert [p[0] for p in paths] == ["state/code-runs/r9/handoff/x", "", "wiki/y", "z"]


def test_handoff_routes(spark):
    manifest = '{"schema_version":"t.handoff_manifest.v1","run_id":"%s","knowledge_id":"%s","handoff_quality":"quality.json","shards":[null,{"path":"s","candidate_wiki_pages":["a","","b"],"primary_wiki_pages":["a"]}]}'
    text = "# Knowledge Manager 维护请求\n- knowledge_id: k\n- run_id: r1\n- manifest: {}\n"
    rows = [
        ("beside", "x", "a/b/request.md", text.format("manifest.json")), ("above", "x", "a/b/c/request.md", text.format("m2.json")),
        ("root", "x", "q/request.md", text.format("top.json")), ("climbs", "x", "a/b/c/request.md", text.format("../manifest.json")),
        ("inline", "x", None, text.format("top.json")), ("broken", "x", "a/request.md", text.format("broken.json")),
        ("other root", "y", "a/b/request.md", text.format("manifest.json")), ("absolute", "x", "a/request.md", text.format("/top.json")),
        ("itself", "x", "z/manifest.json", manifest % ("r9", "")), ("nothing", "x", None, "no marker"), ("null", "x", None, None),
    ]
    documents = spark.createDataFrame(rows, "request_id string, root_id string, source_path string, text string")
    files = spark.createDataFrame([
        ("x", "a/b/manifest.json", manifest % ("r2", "m")), ("x", "a/b/m2.json", manifest % ("", "")), ("x", "top.json", manifest % ("r4", "")),
        ("x", "manifest.json", manifest % ("far", "")), ("x", "a/broken.json", "{"), ("x", "broken.json", manifest % ("never", "")),
        ("x", "a/b/quality.json", '{"schema_version":"t.handoff_quality.v1","passed":true,"issues":["i"]}'), ("x", "quality.json", "{}"),
    ], "root_id string, path string, text string")
    found = reconcile.handoffs(documents, files)
    got = {r["request_id"]: r for r in found.collect()}
    assert {k: (r["route"], r["manifest_path"], r["run_id"]) for k, r in got.items() if r["detected"]} == {
        "beside": ("manifest", "a/b/manifest.json", "r2"), "above": ("manifest", "a/b/m2.json", "r1"), "root": ("manifest", "top.json", "r4"),
        "climbs": ("manifest", "a/b/manifest.json", "r2"), "inline": ("request", "top.json", "r1"), "broken": ("request", "broken.json", "r1"),
        "other root": ("request", "manifest.json", "r1"), "absolute": ("request", "/top.json", "r1"), "itself": ("manifest", "z/manifest.json", "r9")}
    assert not got["nothing"]["detected"] and not got["null"]["detected"]
    assert (got["beside"]["quality_status"], got["beside"]["quality_passed"], got["beside"]["quality_issues"]) == ("detected", True, 1)
    assert (got["root"]["quality_status"], got["root"]["quality_path"]) == ("unreadable", "quality.json")
    assert got["beside"]["knowledge_id"] == "m" and got["above"]["knowledge_id"] == "k" and got["itself"]["manager_request_path"] == ""
    shard = reconcile.handoff_outputs(documents, found).where("request_id = 'beside'").collect()
    assert [(r["candidate_pages"], r["alternate_pages"]) for r in shard] == [(["a", "b"], ["b"])]
    assert {r["material"] for r in reconcile.materials(found, reconcile.handoff_shards(documents, found), reconcile.handoff_outputs(documents, found)).where("request_id = 'beside'").collect()} == {
        "a/b/request.md", "a/b/manifest.json", "a/b/quality.json", "s"}


def test_consulted_and_matched(spark):
    found = spark.createDataFrame([("r", 1, 1, "b"), ("r", 0, 2, "a"), ("r", 0, 1, "c")], "request_id string, query_no int, pos int, path string")
    read = spark.createDataFrame([("r", 0, 0, "index"), ("r", 1, 0, "index"), ("r", 1, 1, "b")], "request_id string, query_no int, pos int, path string")
    rows = reconcile.consulted_and_matched(found, read).orderBy("kind", "page_no").collect()
    assert [(r["kind"], r["path"]) for r in rows] == [("consulted", p) for p in ("index", "b", "c", "a")] + [("matched", p) for p in ("c", "a", "b")]
