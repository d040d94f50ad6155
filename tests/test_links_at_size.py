"""What grew with the texts in link_expansion (F24): pages not chosen, roots not searched, places of modules, short words."""

import itertools

import pytest
from pyspark.sql import functions as F

from corpusspark.operators import links, scoring
from corpusspark.operators.search_strings import FEW_SHORT, Dictionary
from corpusspark.plans.retrieval import Retrieval
from corpusspark.sources import scan

PRIMARIES = "query_id string, root_id string, path string, primary_pos int, score20 long"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bodies_are_built_for_primary_pages_only(spark):
    pages = spark.createDataFrame([("r", "wiki/a.md", "[[b]] [[gone|G]]"), ("r", "wiki/b.md", "[[a]]"), (None, "wiki/a.md", "x")], "root_id string, repo_path string, raw string")
    built = pages.withColumn("body", F.when(F.col("raw") == "[[a]]", F.raise_error(F.lit("not a primary page"))).otherwise(F.col("raw")))
    primaries = spark.createDataFrame([("q1", "r", "wiki/a.md", 1, 8), ("q2", "r", "wiki/a.md", 1, 4), ("q2", "r", "wiki/none.md", 2, 4)], PRIMARIES)
    found = links.expand_relationships(primaries, built.drop("raw"))
    assert {(r.query_id, r.link_no, r.target, r.label, r.dst, r.status) for r in found.collect()} == {
        (q, *rest) for q in ("q1", "q2") for rest in ((1, "b", "b", "wiki/b.md", "resolved"), (2, "gone", "G", None, "broken"))}
    # Targets are looked up in the rows that were written, so no text is read for them again.
    assert "raise_error" not in optimized(found).lower()


def test_only_searched_roots_are_indexed(spark):
    roots = spark.createDataFrame([("on", True, 1, False), ("off", False, 2, False)], "root_id string, enabled boolean, priority int, is_code_root boolean")
    entries = spark.createDataFrame([(r, i, f"T{i}", f"p/EN{i}.md", "S") for r in ("on", "off", None) for i in (1, 2)],
                                    "root_id string, entry_pos long, title string, path string, summary string")
    run = Retrieval(roots, entries, None)
    assert {(r.root_id, r.entry_pos) for r in run.index.collect()} == {("on", 1), ("on", 2)}
    assert {r.root_id for r in run.aliases.collect()} == {"on"}


def test_modules_of_a_page_are_brought_together_once(spark):
    pages = spark.createDataFrame([("r", "x/b.md", "C", "b a"), ("r", "x/b.md", "A", "d"), ("r", "y", "", "none")], "root_id string, path string, title string, summary string")
    aliases = spark.createDataFrame([("r", k, k.upper(), (9 - i, i)) for i, k in enumerate("abcd")],
                                    "root_id string, alias_key string, module string, alias_rank struct<entry_pos: long, value_pos: int>")
    found = scoring.page_modules(pages, aliases)
    assert [tuple(r) for r in found.collect()] == [("r", "x/b.md", ["B", "C", "A", "D"])]
    assert optimized(found).count("Aggregate [") == 1


LINES = ["- [A](a.md) — one", "  -  [A b](a.md)-two  words ", "- [A](a.md) — ends\r", "- [A](a.md) — ends\r\n", "- [A](a.md) — a b", "- [A](a.md) —\n x", "- [A](a.md) —\n x\ny",
         "- [A](a.md) — a\x85", "- [A](a.md) —", "- [A](a.md)", "- [](a.md) — x", "- [A]() — x", "- [W](https://x) — w", "- [W](#x) — w", "x - [A](a.md) — no", "- [数 é](ü/😀.md) — 😀 — - x", "", None]


def test_heads_of_index_lines_give_what_the_whole_lines_give(spark):
    lines = spark.createDataFrame([("r", i, line) for i, line in enumerate(LINES)], "root_id string, entry_pos long, line string")
    whole = [F.regexp_extract("line", "(?U)" + scan.INDEX_LINE, n) for n in (1, 2, 3)]
    plain = lines.select("root_id", "entry_pos", *[scan.strip(c).alias(n) for c, n in zip(whole, ("title", "path", "summary"))]).where(
        (whole[1] != "") & ~whole[1].rlike("^(https?://|#)"))
    expected = {tuple(r) for r in plain.collect()}
    assert len(expected) == 8 and {tuple(r) for r in scan.parse_index(lines).collect()} == expected


@pytest.mark.parametrize("more", [0, FEW_SHORT])
def test_short_strings_are_found_few_or_many(more):
    needles = ["a", "ab", "abc", "数", "数据", "数据权", "zz"] + [chr(0x3400 + i) for i in range(more)]
    rows = [("k", n, i) for i, n in enumerate(needles)] + [("only", "ab", 7)]
    dictionary = Dictionary(rows)
    assert len(dictionary.strings["k",].short) == (0 if more else 6 - 1)
    for text in ["".join(t) for t in itertools.product("abcz", repeat=3)] + ["数据权限", "㐁a", "x", ""]:
        assert dictionary.found(("k",), text) == [i for i, n in enumerate(needles) if n in text]
        assert dictionary.found(("only",), text) == ([7] if "ab" in text else [])
    assert dictionary.found(("none",), "ab") == dictionary.found(("k",), None) == []
