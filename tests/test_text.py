"""Text functions: tokens, topic terms, aliases, operators, anchors, sections, references."""

import pytest
from pyspark.sql import functions as F

from corpusspark.functions import terms
from corpusspark.functions.text import canonical_path, file_stem, lines_of
from corpusspark.operators import extract, query_features, scoring


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "v string").select(expression(F.col("v")).alias("r")).first()["r"]


def test_tokens_have_ordered_grams(spark):
    assert one(spark, "Foo-1 数据权限 foo-1", terms.tokens) == ["foo-1", "数据权限", "数据权", "据权限", "数据", "据权", "权限"]


def test_topic_terms(spark):
    assert one(spark, "AlphaCore 配置 PRD 如何补齐实现边界", terms.topic_terms) == ["alphacore"]
    assert one(spark, "sample_token 后端是否已在当前 repos 闭合", terms.code_topic_terms) == ["sample_token"]
    assert one(spark, "数据权限策略", terms.topic_terms) == ["数据权限策略", "数据权限", "策略", "权限"]


@pytest.mark.parametrize("text,expected", [("example gamma capability", False), ("AM capability", True), ("x-am_y", True), ("éam", True)])
def test_alias_needs_boundaries(spark, text, expected):
    assert ("am" in one(spark, text, lambda v: terms.boundary_keys(F.lower(v)))) is expected


@pytest.mark.parametrize("text,operator", [
    ("示例流程列表筛选", "LOCATE_IMPLEMENTATION"), ("示例报表导出列表字段", "LOCATE_IMPLEMENTATION"), ("示例模块有哪些功能", "LIST_COLLECTION"),
    ("示例通知中心支持哪些事件类型", "LIST_ENTITY_ATTRIBUTE"), ("示例通知中心接入了哪些类型的事件", "LIST_ENTITY_ATTRIBUTE"),
])
def test_operator_of_code_queries(spark, text, operator):
    assert one(spark, text, lambda v: query_features.infer_operator(v, F.lit(True))) == operator


def test_anchors_drop_internal_paths(spark):
    text = "wiki/sources/code/a-runs/run/H1.md repos/sample/backend/pom.xml /sample/frontend/src/http/modules/ /api/ /service /sample/items/list `SampleController`"
    found = {(a["kind"], a["value"]) for a in one(spark, text, extract.anchor_values)}
    assert ("endpoint", "/sample/items/list") in found and ("symbol", "SampleController") in found
    values = {v for k, v in found if k == "endpoint"}
    assert not values & {"/api", "/service", "/sample/backend/pom.xml", "/sample/frontend/src/http/modules", "/sources/code/a-runs/run/H1.md"}


def test_front_matter_last_key_wins(spark):
    text = "---\ntitle: 'A'\nx: 1\nx: 2: 3\nsources: [\"a b\", 'c']\n---\nbody --- x"
    row = spark.createDataFrame([("r", "p/q.md", text)], "root_id string, path string, text string")
    page = extract.parse_pages(row).first()
    assert page["title"] == "A" and page["meta"]["x"] == "2: 3" and page["sources"] == ["a b", "c"] and page["body"] == "body --- x"
    bare = extract.parse_pages(spark.createDataFrame([("r", "p/q.v1.md", "no front matter")], row.schema)).first()
    assert bare["title"] == "q.v1" and bare["page_type"] == "unknown" and bare["sources"] is None


def test_sections_keep_last_body(spark):
    got = one(spark, "x\n## A\none\n## B\ntwo\n## A \nthree\n", extract.sections)
    assert [(s["heading"], s["body"]) for s in got] == [("A", "three"), ("B", "two")]


@pytest.mark.parametrize("ref,expected", [("a/b.py:1-3", ("a/b.py", 1, 3)), ("a:b:2-2", ("a:b", 2, 2)), ("a:3-1", None), ("a:0-1", None), ("a", None), ("a:x-1", None)])
def test_file_reference(spark, ref, expected):
    got = one(spark, ref, extract.file_reference)
    assert (tuple(got) if got else None) == expected


def test_paths(spark):
    assert one(spark, "wiki/a/../b/./c.md", canonical_path) == "wiki/b/c.md"
    assert one(spark, "a/../../b", canonical_path) == "../b"
    assert one(spark, "x/.gitignore", file_stem) == ".gitignore"
    assert one(spark, "", lines_of) == [] and one(spark, "a\r\nb\n", lines_of) == ["a", "b"]


def test_roles(spark):
    roles = {"wiki/sources/a.md": "source", "entities/code/features/a.md": "feature", "concepts/features.md": "concept", "other/x.md": "unknown"}
    for path, role in roles.items():
        assert one(spark, path, scoring.page_role) == role


def test_english_lines_skip_code_fences(spark):
    text = "This line has far more than five words\n```\nThis line has far more than five words\n```\n中文 Label: this has more than five english words\n| this is a table row with words |\n短"
    got = extract.english_lines(spark.createDataFrame([(1, text)], "id int, text string"), ["id"], "text").collect()
    assert sorted(r["line"] for r in got) == [1, 5]
