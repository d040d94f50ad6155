"""The folder source, tables folded out of texts, JSON of any depth."""

import json
import random

import pytest

from corpusspark.operators import findings, tables
from corpusspark.sources import folders


@pytest.fixture
def roots(tmp_path):
    for root in ("a", "b"):
        for path in ("index.md", "wiki/x.md", "wiki/deep/er/y.md", "wiki/z.txt", "node_modules/no.md", "wiki/node_modules/no.md", "wiki/ü b.md"):
            f = tmp_path / root / path
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_text(f"{root} {path}\nsecond ä", encoding="utf-8")
    (tmp_path / "a" / "empty.md").write_text("")
    return {r: f"file:{tmp_path}/{r}" for r in ("a", "b", "missing")}


def test_folders_are_scanned(spark, roots, tmp_path):
    got = {(r.id, r.path): (r.length, r.content) for r in folders.read_folders(spark, roots, "*.md", partition_bytes=40).collect()}
    names = ["index.md", "wiki/x.md", "wiki/deep/er/y.md", "wiki/ü b.md"]
    expected = {(r, p): f"{r} {p}\nsecond ä" for r in ("a", "b") for p in names} | {("a", "empty.md"): ""}
    assert got == {k: (len(v.encode()), v) for k, v in expected.items()}
    assert folders.read_folders(spark, {"missing": roots["missing"]}).count() == 0


def test_partitions_follow_bytes_and_filters(roots, monkeypatch):
    reader = folders.FolderReader({"folders": json.dumps(roots), "glob": "*.md", "exclude": '["node_modules"]', "partition_bytes": "40"})
    assert len(reader.partitions()) >= 4
    opened = []
    monkeypatch.setattr(folders, "listed", lambda f, *rest, run=folders.listed: opened.append(f) or run(f, *rest))
    rest = list(reader.pushFilters([folders.EqualTo(("id",), "b"), folders.EqualTo(("path",), "x")]))
    pieces = [p for part in reader.partitions() for p in part.pieces]
    assert opened == [roots["b"]] and {p.id for p in pieces} == {"b"} and len(rest) == 1


@pytest.mark.parametrize("size", [1, 3, 7, 64, 10**6])
def test_lines_of_byte_ranges(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(folders, "CHUNK", 5)
    rng = random.Random(size)
    text = "".join("".join(rng.choice("ab é\r") for _ in range(rng.randint(0, 6))) + "\n" for _ in range(40)) + rng.choice(["", "last"])
    (tmp_path / "index.md").write_bytes(text.encode())
    expected, at = [], 0
    for line in text.encode().split(b"\n"):
        expected.append((at, line.decode().removesuffix("\r")))
        at += len(line) + 1
    if text.endswith("\n"):
        expected.pop()
    reader = folders.FolderReader({"folders": json.dumps({"r": f"file:{tmp_path}"}), "glob": "index.md", "lines": "true", "partition_bytes": str(size)})
    parts = reader.partitions()
    got = [(o, line) for p in parts for _, _, o, line in reader.read(p)]
    assert got == expected and (size > 64 or len(parts) > 2)
    if size == 64:
        rows = folders.read_lines(spark, {"r": f"file:{tmp_path}"}, "index.md", size).collect()
        assert sorted((r.offset, r.line) for r in rows) == expected


def test_tables_in_reading_order(spark):
    texts = {
        1: "| a | b |\n|---|:---:|\n| 1 | 2 |\n| short |\n|x|y|\n\ntext | no\n| c |\n| --- |\n| 3 |",
        2: "| a | b |\n--- | ---\n| 1 | 2 |\n| 3 | 4 |\n",  # a separator without pipes
        3: "| a |\nno separator\n| b |", 4: "---\ntitle: x\n---\n| only | header |\n| --- | --- |", 5: "", 6: None,
        7: "| h | i |\r\n|---|---|\r\n|  | 　z | | p | q |", 8: "|||\n|---|---|---|\n",
        9: "| big | t |\n|---|---|\n" + "| r | s |\n" * 20_000,
    }
    got = tables.table_rows(spark.createDataFrame(list(texts.items()), "id int, body string"), ["id"], "body")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {}
    for r in got.collect():
        rows.setdefault(r.id, []).append((r.row_index, r.table_line, r.headers, r.cells))
    rows = {k: sorted(v, key=lambda x: x[0]) for k, v in rows.items()}
    assert rows[1] == [(1, 0, ["a", "b"], ["1", "2"]), (2, 0, ["a", "b"], ["x", "y"]), (3, 7, ["c"], ["3"])]
    assert rows[2] == [(1, 0, ["a", "b"], ["1", "2"]), (2, 0, ["a", "b"], ["3", "4"])]
    assert rows[7] == [(1, 0, ["h", "i"], ["", "z"]), (2, 0, ["h", "i"], ["p", "q"])]
    assert len(rows[9]) == 20_000 and set(rows) == {1, 2, 7, 9}


def test_texts_for_people_at_any_depth(spark):
    deep = {"title": "bottom"}
    for i in range(30):
        deep = {"x": deep} if i % 2 else [deep]
    lines = [json.dumps({"title": "top", "other": "no", "nested": deep}), "not json", None, "[]", "3"]
    rows = spark.createDataFrame([(str(i), x) for i, x in enumerate(lines)], "finding_id string, line string")
    got = [(r.finding_id, r.value, r.path.count(".") + r.path.count("[")) for r in findings.human_texts(rows, ["finding_id"]).collect()]
    assert sorted(got) == [("0", "bottom", 31), ("0", "top", 0)]
    assert findings.human_texts(rows.limit(0), ["finding_id"]).count() == 0
