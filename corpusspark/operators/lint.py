"""Lint of whole corpora: one row per violation of a page, index or root rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import any_of, canonical_path, file_name, slashes, strings
from . import extract, links
from .quality import CODE_FEATURES, union
from ..session import cut_lineage
from .search_strings import contained

ISSUE = ["root_id", "severity", "code", "path", "detail"]


def _rows(df: DataFrame, code, path: Column | str, detail: Column | str | None = None, severity: str = "minor") -> DataFrame:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select("root_id", F.lit(severity).alias("severity"), as_column(code).alias("code"), as_column(path).alias("path"),
                     (as_column(detail) if detail is not None else F.lit(None).cast("string")).alias("detail"))


def page_facts(pages: DataFrame) -> DataFrame:
    """What lint needs to know of a page, from one scan of the corpus: rule violations, wikilinks, traces.

    The texts stay behind; the narrow rows are written once and every other rule reads those.
    """
    feature = F.col("repo_path").startswith(CODE_FEATURES)
    body = F.col("body")

    def issue(condition: Column, code: Column | str, detail: str | None = None) -> Column:
        return F.when(
            condition,
            F.struct((code if isinstance(code, Column) else F.lit(code)).alias("code"), F.lit(detail).cast("string").alias("detail")),
        )

    def section_issue(heading: str) -> Column:
        present = extract.has_section(body, heading)
        empty = extract.lint_placeholder(extract.section_text(body, heading))
        return F.when(feature & ~present, issue(F.lit(True), "code_feature_required_section_missing", heading)).when(
            feature, issue(empty, "code_feature_section_not_substantive", heading)
        )

    traces = F.filter(F.coalesce("sources", strings([])), extract.is_run_trace)
    rules = [issue(~F.map_contains_key("meta", f), "frontmatter_field_missing", f) for f in V.REQUIRED_FRONT_MATTER]
    rules += [section_issue(h) for h in V.CODE_FEATURE_REQUIRED_HEADINGS]
    rules += [
        issue(extract.is_thin_source(F.col("repo_path"), F.col("declared_type"), body), "source_summary_too_thin"),
        issue(feature & ~extract.lint_code_locator(extract.section_text(body, V.CODE_LOCATION_SECTION)), "code_feature_code_locator_missing"),
        issue(feature & (F.size(traces) == 0), "code_feature_source_trace_missing"),
    ]
    facts = pages.select(
        "root_id", "path", "repo_path", "title", file_name(F.col("repo_path")).isin(V.EXEMPT_PAGE_NAMES).alias("exempt"),
        F.array_compact(F.array(*rules)).alias("issues"), links.wikilink_targets(F.col("text")).alias("wikilinks"),
        F.when(feature, F.transform(traces, extract.normalized_source)).otherwise(strings([])).alias("traces"),
        ((F.col("path") == "schema.md") & F.col("text").contains("Code Knowledge")).alias("code_schema"),
    )
    return cut_lineage(facts)


def page_issues(facts: DataFrame) -> DataFrame:
    found = facts.where("not exempt").select("root_id", "repo_path", F.inline("issues"))
    return _rows(found, F.col("code"), F.col("repo_path"), F.col("detail"))


def missing_summaries(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Code-run summaries that a code feature page names but that do not exist."""
    named = facts.where("not exempt").select("root_id", "repo_path", F.explode("traces").alias("source"))
    full = F.when(F.col("source").startswith("wiki/"), F.col("source")).otherwise(F.concat(F.lit("wiki/"), "source"))
    located = named.withColumn("path", canonical_path(full))
    gone = located.join(files.select("root_id", "path").distinct(), ["root_id", "path"], "left_anti")
    return _rows(gone, "code_feature_source_summary_missing", F.col("repo_path"), F.col("source"))


def wikilink_issues(facts: DataFrame) -> DataFrame:
    return _rows(links.broken_wikilinks(facts), "broken_wikilink", F.col("path"), F.col("target"))


def named_in_index(pages: DataFrame, index_lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(root_id, path) of pages whose path stands anywhere in the index of their root.

    Most paths are the link of an index entry and match by equality; only the rest is searched in the lines.
    """
    paths = pages.select("root_id", "path").distinct()
    linked = paths.join(entries.select("root_id", "path").distinct(), ["root_id", "path"], "left_semi")
    rest = paths.join(linked, ["root_id", "path"], "left_anti")
    needles = rest.select("root_id", F.col("path").alias("needle"))
    lines = index_lines.where("line <> ''").select("root_id", "line")
    inside = contained(needles, lines, "line", ["root_id"]).select("root_id", F.col("needle").alias("path")).distinct()
    return linked.unionByName(rest.join(inside, ["root_id", "path"], "left_semi"))


def index_issues(pages: DataFrame, named: DataFrame) -> DataFrame:
    missing = pages.where("not exempt").select("root_id", "path", "repo_path").join(named, ["root_id", "path"], "left_anti")
    return _rows(missing, "index_entry_missing", F.col("repo_path"))


def _required(roots: DataFrame, files: DataFrame, paths: list[str]) -> DataFrame:
    """Required paths that neither exist as a file nor lead to one."""
    listed = files.select("root_id", F.explode(F.filter(strings(paths), lambda p: (F.col("path") == p) | F.startswith(F.col("path"), F.concat(p, F.lit("/"))))).alias("required")).distinct()
    wanted = roots.select("root_id", F.explode(strings(paths)).alias("required"))
    return wanted.join(listed, ["root_id", "required"], "left_anti")


def root_path_issues(roots: DataFrame, files: DataFrame, paths: list[str] | None = None) -> DataFrame:
    missing = _required(roots, files, paths or V.REQUIRED_LINT_PATHS)
    return _rows(missing, "required_path_missing", F.col("required"), severity="major")


def relation_issues(roots: DataFrame, files: DataFrame) -> DataFrame:
    missing = _required(roots, files, ["relations/" + n for n in V.RELATION_FILES])
    return _rows(missing, "relation_file_missing", F.col("required"))


def structure_issues(roots: DataFrame, files: DataFrame) -> DataFrame:
    """Structure validation of enabled roots: a root without any file is missing as a whole."""
    enabled = roots.where("enabled")
    present = files.select("root_id").distinct()
    gone = enabled.join(present, "root_id", "left_anti")
    there = enabled.join(present, "root_id", "left_semi")
    return union([
        _rows(gone, "knowledge_path_missing", F.col("path"), severity="major"),
        root_path_issues(there, files, V.REQUIRED_ROOT_PATHS),
    ])


def readiness_issues(code_roots: DataFrame, pages: DataFrame, named: DataFrame, entries: DataFrame) -> DataFrame:
    """Rules of code roots: schema page, code pages, their index entries and actionable index summaries."""
    schema = pages.where("code_schema").select("root_id").distinct()
    code = pages.where(
        any_of(F.col("repo_path").startswith(f"wiki/entities/code/{kind}/") for kind in ("features", "modules"))
    ).select("root_id", "path", "repo_path")
    has_code = code.select("root_id").distinct()
    has_hit = code.join(named, ["root_id", "path"], "left_semi").select("root_id").distinct()
    last = entries.groupBy("root_id", slashes(F.col("path")).alias("path")).agg(F.max_by("summary", "entry_pos").alias("summary"))
    vague = (
        code.where(F.col("repo_path").startswith(CODE_FEATURES)).join(code_roots.select("root_id"), "root_id", "left_semi")
        .join(last, ["root_id", "path"]).where(~extract.lint_code_locator(F.col("summary")))
    )
    roots = code_roots.select("root_id")
    return union([
        _rows(roots.join(schema, "root_id", "left_anti"), "code_schema_missing", "wiki/schema.md", severity="major"),
        _rows(roots.join(has_code, "root_id", "left_anti"), "code_knowledge_pages_missing", "wiki/entities/code", severity="major"),
        _rows(roots.join(has_code, "root_id", "left_semi").join(has_hit, "root_id", "left_anti"), "code_knowledge_index_missing",
              "wiki/index.md", severity="major"),
        _rows(vague, "code_feature_index_summary_not_actionable", F.col("repo_path")),
    ])


def lint(roots: DataFrame, pages: DataFrame, index_lines: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """All issues of the enabled roots.  Readiness rules apply to roots with ``has_workspace``."""
    enabled = roots.where("enabled")
    keep = lambda df: df.join(enabled.select("root_id"), "root_id", "left_semi")
    index_lines, entries = keep(index_lines), keep(entries)
    facts = page_facts(keep(pages))
    named = cut_lineage(named_in_index(facts, index_lines, entries))
    return union([
        root_path_issues(enabled, files), page_issues(facts), missing_summaries(facts, files), wikilink_issues(facts),
        index_issues(facts, named), relation_issues(enabled, files),
        readiness_issues(enabled.where("has_workspace"), facts, named, entries),
    ])


def lint_summary(roots: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per root: skipped, passed and the number of issues per severity and code."""
    counts = issues.groupBy("root_id", "code").agg(F.count("*").alias("n"), F.sum((F.col("severity") == "major").cast("long")).alias("major"))
    per_root = counts.groupBy("root_id").agg(
        F.sum("n").alias("n_issues"), F.sum("major").alias("n_major"),
        F.array_sort(F.collect_list(F.concat_ws("=", "code", F.col("n").cast("string")))).alias("codes"),
    )
    joined = roots.select("root_id", "enabled").join(per_root, "root_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "root_id", (~F.col("enabled")).alias("skipped"), F.when(F.col("enabled"), zero("n_issues") == 0).alias("passed"),
        zero("n_issues").alias("n_issues"), zero("n_major").alias("n_major"), F.coalesce("codes", strings([])).alias("codes"),
    )
