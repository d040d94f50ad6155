"""Hash trees of folders: equal to plain comparison, descending only where something differs, kept up by changes."""

from pyspark.sql import functions as F

from corpusspark.operators import hash_tree, inventory

SCHEMA = "repo_id string, path string, content string"


def versions(spark):
    before = [("r", f"a{i % 5}/b{i % 3}/f{i}", f"text {i}") for i in range(120)] + [("r", "top", "x"), ("same", "a/b", "y"), ("gone", "p/q/r", "z"), ("r", "deep/" * 30 + "f", "d")]
    after = [(r, p, c + "!" if p in ("a1/b1/f1", "top") else c) for r, p, c in before if r != "gone" and p != "a2/b2/f2"]
    after += [("r", "a1/new/f", "n"), ("r", "a3", "a file named like a folder"), ("born", "s", None), (None, "s", "s"), ("r", None, "s"), ("same", "a/b", "y")]
    return spark.createDataFrame(before, SCHEMA), spark.createDataFrame(after, SCHEMA)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_descent_finds_what_a_full_comparison_finds(spark):
    before, after = versions(spark)
    old, new = hash_tree.file_hashes(before), hash_tree.file_hashes(after)
    folders = hash_tree.differing_folders(hash_tree.tree(old), hash_tree.tree(new))
    changes = hash_tree.file_changes(old, new, folders)
    full = inventory.changed_files(before.fillna(""), after.where("repo_id is not null and path is not null").distinct().fillna(""))
    assert rows(changes.withColumn("change", hash_tree.change_kind()), "repo_id", "path", "change") == rows(full, "repo_id", "path", "change")
    # Neither the deep chain nor the untouched folders were met.
    assert rows(folders, "repo_id", "folder") == sorted([
        ("r", ""), ("r", "a1"), ("r", "a1/b1"), ("r", "a1/new"), ("r", "a2"), ("r", "a2/b2"), ("gone", ""), ("gone", "p"), ("gone", "p/q"), ("born", "")])
    assert rows(folders.where("own_differs"), "repo_id", "folder") == sorted([
        ("r", ""), ("r", "a1/b1"), ("r", "a1/new"), ("r", "a2/b2"), ("gone", "p/q"), ("born", "")])
    updated = hash_tree.updated_tree(hash_tree.tree(old), changes)
    columns = [*hash_tree.KEY, "n_files", *hash_tree.SUMS]
    assert rows(updated, *columns) == rows(hash_tree.tree(new), *columns)


def test_equal_and_empty_trees(spark):
    before, _ = versions(spark)
    old = hash_tree.file_hashes(before)
    again = hash_tree.file_hashes(before.unionAll(before).withColumn("extra", F.lit(1)))
    assert hash_tree.differing_folders(hash_tree.tree(old), hash_tree.tree(again)).isEmpty()
    none = old.limit(0)
    assert hash_tree.tree(none).isEmpty()
    folders = hash_tree.differing_folders(hash_tree.tree(none), hash_tree.tree(none))
    assert folders.isEmpty() and hash_tree.file_changes(none, none, folders).isEmpty()


def test_moved_and_missing_contents_differ(spark):
    def commit(*files):
        return hash_tree.commits(hash_tree.tree(hash_tree.file_hashes(spark.createDataFrame([("r", *f) for f in files], SCHEMA)))).first()["commit"]

    states = [commit(("a", "x"), ("b", "y")), commit(("a", "y"), ("b", "x")), commit(("a", "x"), ("c/b", "y")), commit(("a", "x"), ("b", None)), commit(("a", "x"), ("b", ""))]
    assert len(set(states)) == 5 and all(len(s) == hash_tree.LANES * hash_tree.DIGITS for s in states)
