"""Prefix intervals, as-of references and published tables against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from corpusspark.functions.numbering import running
from corpusspark.operators import findings, inventory, repos
from corpusspark.sources import publish


def test_prefix_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ab/é") for _ in range(rng.randint(0, 6))) for _ in range(150)] + ["repos/" + "x" * 900, "repos/" + "x" * 901, "𝒳y", "𝒳"]
    p, v = words[:90] + words[-4:], words[60:]
    got = repos.prefix_pairs(spark.createDataFrame([(x,) for x in p] + [(None,)], "prefix string"), spark.createDataFrame([(x,) for x in v] + [(None,)], "value string"))
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in set(p) - {""} for b in set(v) - {""} if b.startswith(a))


def test_paths_to_repos_among_many(spark):
    """A hundred thousand repositories: only the pairs of the result are written."""
    many = spark.range(100_000).select(F.lit("r").alias("root_id"), F.concat(F.lit("org/team-"), F.col("id").cast("string")).alias("repo_id"),
                                       F.concat(F.lit("repos/org/team-"), F.col("id").cast("string")).alias("path"))
    paths = spark.createDataFrame([("repos/org/team-77777/src/a.py",), ("org/team-123/x",), ("repos/org/team-9999",), ("/",), ("nothing",)], "value string")
    got = {(r.value, r.repo_id) for r in repos.paths_to_repos(paths, many).collect()}
    expected = {(v, f"org/team-{n}") for v, whole in (("repos/org/team-77777/src/a.py", "77777"), ("org/team-123/x", "123")) for n in (whole[:k] for k in range(1, len(whole) + 1))}
    expected |= {("repos/org/team-9999", f"org/team-{n}") for n in ("9", "99", "999", "9999", *[f"9999{d}" for d in range(10)])}
    assert got == expected


def test_references_inside_ranges(spark):
    rng = random.Random(4)
    ranges = [("b", f"E{i}", rng.choice(["a.py", "c\\d.py"]), s, s + rng.randint(-2, 12)) for i, s in enumerate(rng.randint(0, 60) for _ in range(25))]
    refs = [("b", f"{p}:{s}-{s + n}") for p in ("a.py", "c/d.py", "x.py") for s in range(1, 70, 3) for n in (0, 4, 9)] + [("b", "E3"), ("c", "E3"), ("c", "a.py:1-2"), ("b", "junk")]
    got = findings.valid_refs(spark.createDataFrame(refs * 2, "batch_id string, ref string"),
                              spark.createDataFrame(ranges, "batch_id string, evidence_id string, path string, first long, last long"))
    known = [(p.replace("\\", "/"), f, la) for _, _, p, f, la in ranges if 1 <= f <= la]

    def valid(b, ref):
        if b != "b" or ref == "junk":
            return False
        if ref.startswith("E"):
            return True
        path, s, e = ref.split(":")[0], *map(int, ref.split(":")[1].split("-"))
        return any(p == path and f <= s and e <= la for p, f, la in known)

    assert sorted(map(tuple, got.collect())) == sorted((b, r) for b, r in set(refs) if valid(b, r))


@pytest.mark.parametrize("groups", [["g"], []])
def test_running_values_span_partitions(spark, groups):
    rows = [(("hot" if i % 3 else f"k{i % 5}"), (i * 7919) % 3001, i % 11 if i % 4 else None) for i in range(3000)] + [(None, 1, 5), (None, 2, 3)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    for total, fold in ((F.sum, lambda a, b: a + b), (F.max, max)):
        state, expected = {}, set()
        for g, o, v in sorted(rows, key=lambda r: (r[1], r[0] or "")):
            key = g if groups else 0
            if v is not None:
                state[key] = fold(state[key], v) if key in state else v
            expected.add((g, o, state.get(key, 0 if total is F.sum else None)))
        order = ["o"] if groups else ["o", "g"]
        got = running(df, groups, order, "v", "so_far", total)
        assert {(r.g, r.o, r.so_far) for r in got.collect()} == {(g, o, x) for g, o, x in expected}


def test_modules_of_a_hot_repository(spark):
    files = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "other").otherwise("hot").alias("repo_id"), (F.col("id") % 4).alias("m"), "id").select(
        "repo_id", F.concat(F.lit("repos/"), "repo_id").alias("repo_path"),
        F.concat(F.lit("repos/"), "repo_id", F.lit("/src/m"), F.col("m").cast("string"), F.lit("/f"), F.col("id").cast("string"), F.lit(".py")).alias("path"))
    rows = inventory.candidate_modules(files).collect()
    assert {(r.repo_id, r.module_no, r.module) for r in rows} == {(r, i + 1, f"src/m{i}") for r in ("hot", "other") for i in range(4)}
    for repo, module in {(r.repo_id, r.module) for r in rows}:
        mine = sorted((r.file_no, r.path) for r in rows if (r.repo_id, r.module) == (repo, module))
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [p for _, p in mine] == sorted(p for _, p in mine)
    assert inventory.candidate_modules(files, modules=2, per_module=3).count() == 12


def test_readers_see_whole_tables(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert publish.published(spark, folder) is None
    one, two = spark.range(3), spark.range(5)
    publish.write_version(one, folder)  # a writer that ends before it names its version
    assert publish.published(spark, folder) is None
    assert publish.publish(one, folder) == 1
    version = publish.write_version(two, folder)
    assert publish.published(spark, folder).count() == 3  # written, not yet named
    again = publish.published(spark, folder)
    assert publish.publish(again.withColumn("id", F.col("id") + 10), folder) == 2  # reads the table it replaces
    assert publish.name_version(spark, folder, version, two.schema) == 3  # the other writer's number was taken meanwhile
    assert publish.published(spark, folder).count() == 5 and again.count() == 3
    (tmp_path / "t" / "manifests" / "zzz.part").write_text("{")  # left over by a crash between write and rename
    assert publish.publish(two.limit(0), folder) == 4 and publish.published(spark, folder).count() == 0
    parted = spark.createDataFrame([("a", 1), ("b", 2)], "batch_id string, n int")
    publish.publish(parted, folder, ["batch_id"])
    assert sorted(map(tuple, publish.published(spark, folder).collect())) == [("a", 1), ("b", 2)]
