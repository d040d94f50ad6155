"""Sources, sinks and streams on files of a temporary folder."""

import random

from corpusspark import adapters
from corpusspark.sources import scan, sinks
from corpusspark.streaming import jobs
from pyspark.sql import types as T


def test_pages_index_and_listing(spark, tmp_path):
    wiki = tmp_path / "kb" / "wiki" / "a b"
    wiki.mkdir(parents=True)
    (wiki / "页.md").write_text("---\ntitle: T\n---\nbody", encoding="utf-8")
    (tmp_path / "kb" / "wiki" / "index.md").write_text("# i\n- [T](a b/页.md) — sum\n- [w](#x) - no\n", encoding="utf-8")
    pages = scan.read_root_files(spark, "kb", str(tmp_path / "kb"))
    assert {r["path"] for r in pages.collect()} == {"a b/页.md", "index.md"}
    entry = scan.parse_index(scan.index_lines(pages)).collect()
    assert [(e["entry_pos"], e["title"], e["path"], e["summary"]) for e in entry] == [(1, "T", "a b/页.md", "sum")]
    assert {r["path"] for r in scan.list_files(spark, "kb", str(tmp_path / "kb")).collect()} == {"wiki/a b/页.md", "wiki/index.md"}


def test_repositories(spark, tmp_path):
    text = '[submodule "a"]\n\tpath = repos/a\n\turl = https://x/a.git\n[other]\n\tpath = no\n[submodule "b"]\n\tpath = repos/sub/b\n'
    lines = spark.createDataFrame([("w", i, v) for i, v in enumerate(text.split("\n"))], "workspace_id string, line_no int, line string")
    repos = scan.parse_submodules(lines)
    assert {(r["name"], r["path"], r["url"]) for r in repos.collect()} == {("a", "repos/a", "https://x/a.git"), ("b", "repos/sub/b", "")}
    assert [r["name"] for r in scan.filter_repositories(repos, "b").collect()] == ["b"]
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("x")
    (tmp_path / "m.py").write_text("y")
    assert [r["path"] for r in scan.read_repository(spark, "a", "repos/a", str(tmp_path)).collect()] == ["repos/a/m.py"]


def test_json_artifacts_and_findings(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"snapshot_id": "s1"}')
    (tmp_path / "bad.json").write_text('{"snapshot_id": ')
    schema = T.StructType([T.StructField("snapshot_id", T.StringType())])
    assert [r[0] for r in scan.read_json_artifacts(spark, str(tmp_path), schema).collect()] == ["s1"]
    (tmp_path / "f.jsonl").write_text('{"finding_id": "F1"}\n\n{"finding_id": "F2"}\n')
    assert scan.read_findings(spark, str(tmp_path / "f.jsonl")).count() == 2


def test_registered_names_equal_one_by_one(spark):
    rng = random.Random(3)
    names = ["a.md", "a-2.md", "b.txt", "c", "a-3.md"]
    incoming = [("w", i, rng.choice(names), False) for i in range(30)] + [("w", 99, "kept.md", True), ("ro", 1, "a.md", False)]
    existing = [("w", "raw/imports/a-3.md"), ("w", "raw/imports/b.txt"), ("w", "raw/imports/b-5.txt")]
    roots = spark.createDataFrame([("w", True, "read_write"), ("ro", True, "read_only")], "root_id string, enabled boolean, mode string")
    got = sinks.register_sources(spark.createDataFrame(incoming, "root_id string, arrival int, name string, in_raw boolean"),
                                 spark.createDataFrame(existing, "root_id string, path string"), roots).collect()
    paths = [r["raw_path"] for r in got]
    assert len(paths) == 31 and len(set(paths)) == 31 and not set(paths) & {p for _, p in existing}
    assert [r["raw_path"] for r in got if not r["copied"]] == ["raw/kept.md"]
    assert sorted(p for p in paths if p.endswith(".txt"))[:2] == ["raw/imports/b-2.txt", "raw/imports/b-3.txt"]


def test_streams(spark, tmp_path):
    events = adapters.read(spark, "/root/testdata/sf0.001", "events")
    stream = lambda: jobs.stream_ledger(spark, "/root/testdata/sf0.001", events.schema, str(tmp_path / "l"), str(tmp_path / "c"), "events.parquet")
    stream().awaitTermination()
    stream().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "l")).count() == events.count()
    inbox = tmp_path / "in"
    inbox.mkdir()
    schema = T.StructType([T.StructField(n, t) for n, t in (("root_id", T.StringType()), ("arrival", T.LongType()), ("name", T.StringType()), ("in_raw", T.BooleanType()))])
    roots = spark.createDataFrame([("w", True, "read_write")], "root_id string, enabled boolean, mode string")
    for i in range(2):
        (inbox / f"{i}.json").write_text('{"root_id":"w","arrival":%d,"name":"a.md","in_raw":false}\n' % i)
        jobs.stream_sources(spark, str(inbox), schema, roots, str(tmp_path / "reg"), str(tmp_path / "rc")).awaitTermination()
    assert sorted(r["raw_path"] for r in spark.read.parquet(str(tmp_path / "reg")).collect()) == ["raw/imports/a-2.md", "raw/imports/a.md"]


def test_snapshot_is_replaced(spark, tmp_path):
    target = str(tmp_path / "latest")
    sinks.write_latest_snapshot(spark.createDataFrame([("r", "c1")], "repo_id string, commit string"), target)
    sinks.write_latest_snapshot(spark.read.parquet(target).selectExpr("repo_id", "'c2' as commit"), target)
    assert spark.read.parquet(target).first()["commit"] == "c2"
    sinks.write_payload(spark.range(2), str(tmp_path / "runs"), "r1", "hits")
    assert spark.read.json(str(tmp_path / "runs" / "hits")).where("run_id = 'r1'").count() == 2
