"""Sources: Markdown pages, index lines, registries, file listings, JSON artifacts, repository files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions.text import any_of, contains_any, let, slashes, strip

INDEX_HEAD = r"^\s*-\s*\[([^\]]+)\]\(([^)]+)\)\s*[—-]\s*"
INDEX_LINE = INDEX_HEAD + "(.*)$"
#: Characters that a dot of a pattern does not match.
LINE_BREAKS = ("\n", "\r", "\x85", "\u2028", "\u2029")

FINDING_SCHEMA = T.StructType([
    T.StructField("finding_id", T.StringType()), T.StructField("batch_id", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("current_state", T.StringType()), T.StructField("knowledge_level", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("evidence_refs", T.ArrayType(T.StringType())),
    T.StructField("coverage_claims", T.ArrayType(T.StructType([
        T.StructField("item", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("evidence_refs", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("blocking_gaps", T.ArrayType(T.StringType())),
    T.StructField("non_blocking_gaps", T.ArrayType(T.StringType())),
    T.StructField("exploration_hints", T.ArrayType(T.StringType())),
    T.StructField("design_implications", T.ArrayType(T.StringType())),
    T.StructField("knowledge_object_candidates", T.ArrayType(T.StringType())),
    T.StructField("coding_context", T.MapType(T.StringType(), T.ArrayType(T.StructType([
        T.StructField("summary", T.StringType()), T.StructField("evidence_refs", T.ArrayType(T.StringType())),
    ])))),
])


def _below(folder: str, column: Column) -> Column:
    """Path of a scanned file below ``folder``; the folder may be given with or without a scheme."""
    bare = folder.split("://", 1)[-1] if "://" in folder else folder.removeprefix("file:")
    start = "/" + bare.strip("/") + "/"
    decoded = F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B")))
    return F.substring(decoded, F.locate(start, decoded) + len(start), F.char_length(decoded))


def read_root_files(spark: SparkSession, root_id: str, folder: str) -> DataFrame:
    """Every Markdown page below ``<folder>/wiki`` as (root_id, path, text)."""
    pages = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")
        .text(f"{folder}/wiki", wholetext=True)
    )
    return pages.select(
        F.lit(root_id).alias("root_id"), _below(f"{folder}/wiki", F.col("_metadata.file_path")).alias("path"),
        F.col("value").alias("text"),
    )


def index_lines(pages: DataFrame) -> DataFrame:
    """Lines of the ``index.md`` page of every root, numbered from 0."""
    index = pages.where("path = 'index.md'")
    return index.select("root_id", F.posexplode(F.split("text", "\n")).alias("entry_pos", "line")).withColumn(
        "entry_pos", F.col("entry_pos").cast("long")
    )


def parse_index(lines: DataFrame) -> DataFrame:
    """``- [title](path) — summary`` lines; links to the web and to anchors are no entries."""

    def parsed(line: Column) -> Column:
        part = lambda text, n: F.regexp_extract(text, "(?U)" + INDEX_LINE, n)

        def of_head(head: Column) -> Column:
            rest = F.substring(line, F.char_length(head) + 1, F.char_length(line))
            # The summary is all that follows the head, unless a line break stands in it: then the whole line must match.
            return let(rest, lambda rest: F.when(contains_any(rest, LINE_BREAKS), F.struct(
                part(line, 1).alias("title"), part(line, 2).alias("path"), part(line, 3).alias("summary"))).otherwise(F.struct(
                    part(head, 1).alias("title"), part(head, 2).alias("path"), rest.alias("summary"))))

        # Summaries are whole texts, so patterns read them once, and then the head only.
        return let(F.regexp_extract(line, "(?U)" + INDEX_HEAD, 0), of_head)

    # A generator reads the line once; a filter and a projection would each copy its whole expression into the plan.
    # No part 2 is empty, so an empty one says that the line does not match.
    matched = F.filter(F.transform(F.array("line"), parsed), lambda e: (e["path"] != "") & ~e["path"].rlike("^(https?://|#)"))
    return lines.select("root_id", "entry_pos", F.inline(matched)).select(
        "root_id", "entry_pos", *[strip(F.col(c)).alias(c) for c in ("title", "path", "summary")])


def with_code_roots(roots: DataFrame, workspaces: DataFrame | None = None) -> DataFrame:
    """Marks code roots: by id or name, or because a code workspace is configured for them."""
    identity = F.lower(F.concat_ws(" ", "root_id", "name"))
    named = identity.contains("code") | identity.contains("代码")
    if workspaces is None:
        return roots.withColumn("is_code_root", named).withColumn("has_workspace", F.lit(False))
    marked = roots.join(workspaces.select("root_id", F.lit(True).alias("has_workspace")), "root_id", "left")
    return marked.withColumn("has_workspace", F.coalesce("has_workspace", F.lit(False))).withColumn(
        "is_code_root", named | F.col("has_workspace")
    )


def enabled_roots(roots: DataFrame, writable: bool = False) -> DataFrame:
    kept = roots.where("enabled")
    return kept.where("mode = 'read_write'") if writable else kept


def list_files(spark: SparkSession, root_id: str, folder: str) -> DataFrame:
    """Names of all files below a folder; the contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.lit(root_id).alias("root_id"), _below(folder, F.col("path")).alias("path"), "length")


def is_excluded(path: Column) -> Column:
    """A path below one of the excluded directories (not at the very start, as ``**/name/**`` demands)."""
    return any_of(path.contains(f"/{d}/") for d in V.EXCLUDED_DIRECTORIES)


def repository_files(files: DataFrame) -> DataFrame:
    """(repo_id, path, ...) without excluded paths; the order of a repository is the order of ``path``."""
    return files.withColumn("path", slashes(F.col("path"))).where(~is_excluded(F.col("path")))


def read_repository(spark: SparkSession, repo_id: str, repo_path: str, folder: str) -> DataFrame:
    texts = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return repository_files(texts.select(
        F.lit(repo_id).alias("repo_id"), F.lit(repo_path).alias("repo_path"),
        F.concat(F.lit(repo_path + "/"), _below(folder, F.col("_metadata.file_path"))).alias("path"),
        F.col("value").alias("content"),
    ))


def parse_submodules(lines: DataFrame) -> DataFrame:
    """(workspace_id, line_no, line) of submodule files -> repositories (name, path, url).

    The section of a key is the last section line before it: a running count per workspace numbers the
    sections, then the keys of a section are one aggregate.
    """
    from pyspark.sql import Window as W

    line = strip(F.col("line"))
    section = F.regexp_extract(line, r"^\[(.+)\]$", 1)
    order = W.partitionBy("workspace_id").orderBy("line_no")
    marked = lines.select(
        "workspace_id", "line_no", F.when(section != "", section).alias("section"),
        F.lower(strip(F.regexp_extract(line, r"^([^=:#;\[]+?)\s*[=:]\s*(.*)$", 1))).alias("key"),
        strip(F.regexp_extract(line, r"^([^=:#;\[]+?)\s*[=:]\s*(.*)$", 2)).alias("value"),
    ).withColumn("section_no", F.count("section").over(order))
    grouped = marked.groupBy("workspace_id", "section_no").agg(
        F.max("section").alias("section"),
        F.max_by("value", F.when(F.col("key") == "path", F.col("line_no"))).alias("path"),
        F.max_by("value", F.when(F.col("key") == "url", F.col("line_no"))).alias("url"),
    )
    quoted = F.regexp_extract("section", r'"([^"]*)"', 1)
    name = F.when(F.col("section").contains('"'), quoted).otherwise(strip(F.replace("section", F.lit("submodule "), F.lit(""))))
    return grouped.where(F.col("section").startswith("submodule ") & (F.coalesce("path", F.lit("")) != "")).select(
        "workspace_id", name.alias("name"), "path", F.coalesce("url", F.lit("")).alias("url")
    )


def repositories_from_listing(files: DataFrame) -> DataFrame:
    """Without a submodule file every directory below ``repos`` is a repository."""
    name = F.regexp_extract("path", "^repos/([^/]+)/", 1)
    return files.where(name != "").select(
        F.col("root_id").alias("workspace_id"), name.alias("name"), F.concat(F.lit("repos/"), name).alias("path"),
        F.lit("").alias("url"),
    ).distinct()


def filter_repositories(repos: DataFrame, wanted: str | None) -> DataFrame:
    if not wanted:
        return repos
    value = wanted.replace("\\", "/").strip()
    return repos.where((F.col("name") == value) | (F.col("path") == value) | F.col("path").endswith("/" + value))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Finding lines with their file position; blank lines are skipped."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    return parse_findings(lines.select(F.col("value").alias("line")))


def parse_findings(lines: DataFrame) -> DataFrame:
    """JSON lines -> typed columns under ``f``, next to the raw line (which tells absent keys from nulls)."""
    return lines.withColumn("f", F.from_json("line", FINDING_SCHEMA))


def read_json_artifacts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents; a document that cannot be read gives no row."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).json(
        path, multiLine=True, mode="PERMISSIVE"
    )
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def content_descriptor(requests: DataFrame) -> DataFrame:
    """(request_id, content, source_path) -> kind and SHA-256 of the content."""
    provided = F.coalesce("content", F.lit("")) != ""
    kind = F.when(~provided, "none").when(F.col("source_path").isNotNull(), "file").otherwise("inline")
    return requests.select(
        "request_id", provided.alias("provided"), kind.alias("kind"),
        F.when(provided, F.sha2("content", 256)).alias("sha256"),
        F.when(kind == "file", F.array("source_path")).otherwise(F.array().cast("array<string>")).alias("source_paths"),
    )
