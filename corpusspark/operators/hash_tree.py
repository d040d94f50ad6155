"""Hash trees over the folders of repositories: snapshots that compare by descending only where something differs.

A file is (repo_id, path, sha); the hash of a folder is the exclusive or of the hashes of (path, sha) of all files below it.
That sum does not depend on order, so it is aggregated before the shuffle, a folder of any size is many tasks, and a change of
files changes the tree by the hashes of these files alone.  A node has two sums: ``hash`` over all files below it and ``own``
over those directly in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parent_path
from ..session import cut_lineage, new_folder

LANES = 4
DIGITS = 15  # hexadecimal digits of a lane: it fits a long
KEY = ["repo_id", "folder"]
SUMS = [f"{kind}{i}" for kind in ("hash", "own") for i in range(LANES)]


def file_hashes(files: DataFrame) -> DataFrame:
    """(repo_id, path, content) -> (repo_id, path, sha).

    A missing content has the hash ``''``, unlike an empty one.  Rows without a repository or a path are no files.  Of rows
    that repeat a path the largest hash counts.
    """
    sha = F.coalesce(F.sha2("content", 256), F.lit(""))
    return files.where("repo_id is not null and path is not null").groupBy("repo_id", "path").agg(F.max(sha).alias("sha"))


def _lanes(hex_digest: Column) -> list[Column]:
    return [F.conv(F.substring(hex_digest, 1 + DIGITS * i, DIGITS), 16, 10).cast("long") for i in range(LANES)]


def _summed(rows: DataFrame, files: Column | str = "n_files") -> DataFrame:
    sums = [F.coalesce(F.bit_xor(c), F.lit(0).cast("long")).alias(c) for c in SUMS]
    return rows.groupBy(*KEY).agg(F.sum(files).cast("long").alias("n_files"), *sums)


def _nodes(signed: DataFrame) -> DataFrame:
    """(repo_id, path, sha, sign) -> contributions of these files to all folders above them."""
    lanes = _lanes(F.sha2(F.concat_ws("\n", "path", "sha"), 256))
    direct = signed.groupBy("repo_id", parent_path(F.col("path")).alias("at")).agg(
        F.sum("sign").alias("n_files"), *[F.bit_xor(lane).alias(f"hash{i}") for i, lane in enumerate(lanes)])
    parts = F.split("at", "/")
    depth = F.when(F.col("at") == "", 0).otherwise(F.size(parts))
    above = F.transform(F.sequence(F.lit(0), depth), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    spread = direct.withColumn("folder", F.explode(above))
    own = [F.when(F.col("folder") == F.col("at"), F.col(f"hash{i}")).alias(f"own{i}") for i in range(LANES)]
    return _summed(spread.select("*", *own))


def tree(hashes: DataFrame) -> DataFrame:
    """(repo_id, path, sha), unique by path -> a node per folder: repo_id, folder ('' is the root), n_files, hash0.., own0..

    Files are summed by their folder first; only folders are copied to the folders above them.
    """
    return _nodes(hashes.select("repo_id", "path", "sha", F.lit(1).alias("sign")))


def updated_tree(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """The tree after ``changes`` (repo_id, path, before, after: hashes, null where there is no file); no other file is read."""
    gone = changes.where("before is not null").select("repo_id", "path", F.col("before").alias("sha"), F.lit(-1).alias("sign"))
    come = changes.where("after is not null").select("repo_id", "path", F.col("after").alias("sha"), F.lit(1).alias("sign"))
    delta = _nodes(gone.unionByName(come))
    return _summed(nodes.select(*KEY, "n_files", *SUMS).unionByName(delta)).where("n_files > 0")


def digest(kind: str = "hash") -> Column:
    """The lanes of a node as one text."""
    return F.concat_ws("", *[F.lpad(F.lower(F.hex(f"{kind}{i}")), DIGITS, "0") for i in range(LANES)])


def commits(nodes: DataFrame) -> DataFrame:
    """(repo_id, commit): the root's hash of every repository stands for its state."""
    return nodes.where("folder = ''").select("repo_id", digest().alias("commit"))


def _by_level(nodes: DataFrame) -> DataFrame:
    """The tree as a table with a folder per level, so that a level is read without the others."""
    folder = new_folder(nodes.sparkSession, "tree")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    above = F.when(F.col("folder") != "", parent_path(F.col("folder")))
    rows = nodes.select(*KEY, above.alias("above"), digest().alias("hash"), digest("own").alias("own"), depth.alias("depth"))
    rows.write.partitionBy("depth").parquet(folder)
    return nodes.sparkSession.read.schema(rows.schema).parquet(folder)


def differing_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo_id, folder, depth, own_differs) of the folders whose hashes differ, found from the roots downwards.

    A level meets only the nodes below folders that differ on the level above; the loop ends at the deepest difference.
    """
    old, new = _by_level(before), _by_level(after)
    levels: list[DataFrame] = []
    nothing = F.lit("0" * LANES * DIGITS)
    while True:
        sides = [t.where(F.col("depth") == len(levels)) for t in (old, new)]
        if levels:
            above = levels[-1].select("repo_id", F.col("folder").alias("above"))
            sides = [t.join(above, ["repo_id", "above"], "left_semi") for t in sides]
        b, a = [t.select(*KEY, F.col("hash").alias(f"{n}_hash"), F.col("own").alias(f"{n}_own")) for t, n in zip(sides, "ba")]
        met = b.join(a, KEY, "full_outer").where(~F.col("b_hash").eqNullSafe(F.col("a_hash")))
        found = cut_lineage(met.select(*KEY, F.lit(len(levels)).alias("depth"), (F.coalesce("b_own", nothing) != F.coalesce("a_own", nothing)).alias("own_differs")))
        levels.append(found)
        if found.isEmpty():
            break
    result = levels[0]
    for level in levels[1:-1]:
        result = result.unionByName(level)
    return result


def file_changes(before: DataFrame, after: DataFrame, folders: DataFrame) -> DataFrame:
    """(repo_id, path, before, after): files (repo_id, path, sha) that differ in the folders found; others are not joined."""
    wanted = folders.where("own_differs").select("repo_id", "folder")

    def inside(hashes: DataFrame, name: str) -> DataFrame:
        placed = hashes.select("repo_id", "path", F.col("sha").alias(name), parent_path(F.col("path")).alias("folder"))
        return placed.join(wanted, KEY, "left_semi").drop("folder")

    return inside(before, "before").join(inside(after, "after"), ["repo_id", "path"], "full_outer").where(
        ~F.col("before").eqNullSafe(F.col("after"))).select("repo_id", "path", "before", "after")


def change_kind() -> Column:
    return F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("modified")
