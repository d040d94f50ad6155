"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..functions import fixed_values as V
from ..functions.text import joined, strings
from ..operators import (
    candidate_lists, closure, extract, findings, hash_tree, inventory, links, lint, quality, query_features, reconcile, repos, rollup, scoring, selection,
)
from ..session import cut_lineage, data_stamp, ensure_checkpoint_dir, new_folder
from ..sources import scan, sinks
from ..sources.folders import filesystem, read_folders
from ..sources.publish import published
from ..streaming import jobs
from .retrieval import ListedRetrieval, Retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return adapters.table(spark, sf_dir, name)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.parse_pages(model(spark, sf_dir, "page_texts"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.parse_index(model(spark, sf_dir, "index_lines"))


def new_retrieval(spark: SparkSession, sf_dir: str) -> Retrieval:
    return Retrieval(
        roots=model(spark, sf_dir, "roots"), entries=entries(spark, sf_dir), queries=model(spark, sf_dir, "queries"),
        pages=pages(spark, sf_dir),
    )


@lru_cache(maxsize=4)
def _retrieval(application: str, stamp: int, spark: SparkSession, sf_dir: str) -> Retrieval:
    return new_retrieval(spark, sf_dir)


def retrieval(spark: SparkSession, sf_dir: str) -> Retrieval:
    """One retrieval job per session and data set: its written stages serve every query that reads them."""
    return _retrieval(spark.sparkContext.applicationId, data_stamp(spark, sf_dir), spark, sf_dir)


def text_of(*names: str) -> list[Column]:
    """Array columns as text, so that results compare by value in every engine."""
    return [joined(F.col(n)).alias(n) for n in names]


# ---- query features --------------------------------------------------------------------------------
@register
def query_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1-Q5: tokens, topic terms and intent flags of every user turn."""
    flags = query_features.intent_flags(model(spark, sf_dir, "user_queries"))
    return flags.select(
        "query_id", *text_of("tokens", "topic_terms", "code_topic_terms"), "wants_data_dictionary", "wants_source",
        "wants_regulation", "wants_cross_module", "wants_code_navigation", "wants_code_knowledge", "wants_runtime_boundary",
    )


@register
def module_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module aliases of every root."""
    return scoring.module_aliases(entries(spark, sf_dir)).select(
        "root_id", "alias_key", "module", F.col("alias_rank.entry_pos").alias("entry_pos")
    )


@register
def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents, modules, operator and plan of every query in every searched root."""
    return retrieval(spark, sf_dir).targets.select(
        "query_id", "root_id", "operator", "scope", "wants_code_knowledge", *text_of("modules"), "planner",
        "answer_shape", "member_type", *text_of("attribute_terms", "intents"),
    )


# ---- relevance ----------------------------------------------------------------------------------------
@register
def page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role, type and code-page predicates of every index entry."""
    path = F.col("path")
    return entries(spark, sf_dir).select(
        "root_id", F.concat(F.lit("wiki/"), path).alias("path"), scoring.page_role(path).alias("page_role"),
        scoring.page_type(scoring.page_role(path)).alias("type"), scoring.is_code_feature(path).alias("code_feature"),
        scoring.is_code_module(path).alias("code_module"), scoring.is_repository_map(path, F.col("title")).alias("repo_map"),
    )


@register
def score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best index entries of every query in every searched root.

    The model index leaves out 5% of the documents (adapters.py), which no query on it can return.
    """
    return retrieval(spark, sf_dir).hits.select("query_id", "root_id", "pos", "path", "title", "score20")


@register
def hit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of every query in every searched root, with their scores in points."""
    return scoring.index_hits(retrieval(spark, sf_dir).hits).select("query_id", "root_id", "pos", "title", "path", "summary", "score", "source")


@register
def candidate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate columns with modules, signals and fits."""
    return retrieval(spark, sf_dir).index_candidates.select(
        "query_id", "root_id", "pos", "path", "score20", "page_role", "module", *text_of("page_modules", "signals"),
        "intent_fit", "module_fit", "source_policy",
    )


# ---- selection --------------------------------------------------------------------------------------------
@register
def primary_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary pages and the rule that chose them."""
    return retrieval(spark, sf_dir).primaries.select("query_id", "root_id", "primary_pos", "path", "rule_no", "score20")


@register
def links_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5, L1: the edge table of all pages with resolved targets."""
    corpus = pages(spark, sf_dir)
    edges = links.resolve_links(links.extract_links(corpus), corpus)
    return edges.select("root_id", "src", "link_type", "target", "label", F.coalesce("anchor", F.lit("")).alias("anchor"), "dst")


@register
def link_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2, L3: links followed from the primary pages, with broken ones."""
    return retrieval(spark, sf_dir).expansion.select(
        "query_id", "root_id", "link_no", "src", "target", "link_type", "label", "anchor", "dst", "status"
    )


@register
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence under the budget.

    The model index leaves out 5% of the documents (adapters.py), which no query on it can return.
    """
    return retrieval(spark, sf_dir).evidence.select(
        "query_id", "root_id", "evidence_pos", "path", "page_role", "module", "score20", "evidence_role", "selection_reason"
    )


@register
def omitted_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are not evidence, and why."""
    return retrieval(spark, sf_dir).omitted.select("query_id", "root_id", "pos", "path", "score20", "page_role", "module", "reason")


@register
def coverage_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner and member pages of collection queries."""
    return retrieval(spark, sf_dir).coverage.select(
        "query_id", "root_id", "operator", "scope", *text_of("owner_pages", "member_paths", "evidence_member_paths"), "complete"
    )


# ---- evidence quality ---------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Quality:
    """Tables of the evidence check that several queries read."""

    run: Retrieval
    corpus: DataFrame
    files: DataFrame

    @cached_property
    def texts(self) -> DataFrame:
        """The pages of the bundles, read from the corpus once for all rules."""
        return cut_lineage(quality.evidence_texts(self.run.evidence, self.corpus))

    @cached_property
    def bundle(self) -> DataFrame:
        return quality.with_texts(self.run.evidence, self.texts)

    @cached_property
    def context(self) -> DataFrame:
        return cut_lineage(quality.query_context(self.run.targets, self.run.roots))

    @cached_property
    def topics(self) -> DataFrame:
        return cut_lineage(quality.topic_coverage(self.context, self.bundle))

    @cached_property
    def root_gaps(self) -> DataFrame:
        return cut_lineage(quality.bundle_gaps(self.bundle, self.run.expansion, self.run.targets).unionByName(
            quality.sufficiency_gaps(self.run.targets, self.bundle, self.run.coverage)))

    @cached_property
    def code_gaps(self) -> DataFrame:
        return cut_lineage(quality.code_gaps(self.run.targets, self.context, self.bundle, self.topics))

    @cached_property
    def profile_gaps(self) -> DataFrame:
        traces = quality.page_traces(
            self.corpus.join(self.run.evidence.select("root_id", F.col("path").alias("repo_path")).distinct(), ["root_id", "repo_path"], "left_semi"),
            self.files,
        )
        return cut_lineage(quality.profile_gaps(self.context, self.bundle, self.topics, traces))

    @cached_property
    def gaps(self) -> DataFrame:
        return cut_lineage(quality.merged_gaps([self.root_gaps, self.code_gaps, self.profile_gaps]))

    @cached_property
    def plans(self) -> DataFrame:
        """Code plans: query_id, root_id, terms, modules in lower case."""
        return self.run.targets.where("is_code_root and wants_code_knowledge").select(
            "query_id", "root_id", F.col("topic_terms").alias("terms"),
            F.transform("modules", F.lower).alias("ask_modules"), "priority",
        )

    @cached_property
    def asks(self) -> DataFrame:
        """One ask per query over all its code roots."""
        return self.plans.groupBy("query_id").agg(
            F.first("terms").alias("terms"), F.flatten(F.collect_list("ask_modules")).alias("ask_modules")
        )

    @cached_property
    def map_rows(self) -> DataFrame:
        return cut_lineage(repos.code_map_rows(self.bundle.join(self.asks.select("query_id"), "query_id", "left_semi")))

    @cached_property
    def matches(self) -> DataFrame:
        return cut_lineage(repos.code_map_matches(self.bundle, self.map_rows, self.asks, ["query_id"]))


@lru_cache(maxsize=4)
def _quality(application: str, stamp: int, spark: SparkSession, sf_dir: str) -> Quality:
    return Quality(retrieval(spark, sf_dir), pages(spark, sf_dir), model(spark, sf_dir, "files_present"))


def quality_of(spark: SparkSession, sf_dir: str) -> Quality:
    return _quality(spark.sparkContext.applicationId, data_stamp(spark, sf_dir), spark, sf_dir)


@register
def selection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate, linked pages too, with whether it became evidence."""
    run = retrieval(spark, sf_dir)
    return selection.selection_status(run.candidates, run.evidence).select("query_id", "root_id", "path", "source", "page_role", "score20", "selection_status")


@register
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: what the bundle of a query cites, in the order of its evidence."""
    return quality.citations(quality_of(spark, sf_dir).bundle)


@register
def evidence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gap of every query, each once."""
    return quality_of(spark, sf_dir).gaps.select(
        "query_id", "root_id", "code", "severity", "operator", "profile", "section", "path", "target", *text_of("modules", "topic_terms"), "reason"
    )


@register
def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are the terms of a query in its code feature pages?"""
    return quality_of(spark, sf_dir).topics


@register
def root_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence per query and root."""
    q = quality_of(spark, sf_dir)
    gaps = quality.root_gaps(q.root_gaps, q.code_gaps, q.run.targets)
    return quality.confidence(q.run.targets, q.bundle, gaps, ["query_id", "root_id"])


@register
def query_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence, profiles, review reasons and status per query."""
    q = quality_of(spark, sf_dir)
    result = quality.review(q.context, q.gaps, quality.confidence(q.run.targets, q.bundle, q.gaps, ["query_id"]), q.run.targets)
    return result.select("query_id", "confidence", "n_evidence", "n_gaps", *text_of("profiles", "answer_blocks", "reason_codes"),
                         "must_use_only", "required_before_final", "status")


@register
def review_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and omitted candidates per query in review order, across roots."""
    r = retrieval(spark, sf_dir)
    scope = lambda df, kind: quality.review_scope(df.select("query_id", "root_id", "pos", "path", "score20"), r.targets).withColumn("kind", F.lit(kind))
    return scope(r.candidates, "candidate").unionByName(scope(r.omitted, "omitted")).select(
        "query_id", "kind", "review_pos", "root_id", "path", "score20")


@register
def source_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does every front-matter source of every page exist?"""
    return quality.source_statuses(pages(spark, sf_dir), model(spark, sf_dir, "files_present"))


# ---- code maps and repositories -----------------------------------------------------------------------------------
@register
def code_map_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best code-map rows per code query."""
    return quality_of(spark, sf_dir).matches.select(
        "query_id", "match_no", "page_root", "page_path", "row_index", "relevance", "product_module", "repo_text"
    )


def _repo_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_of(spark, sf_dir)
    return repos.repo_targets(q.plans.drop("priority"), q.bundle, q.map_rows, model(spark, sf_dir, "root_repos"))


@register
def repo_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2-H5: best repositories per code query and root."""
    return _repo_targets(spark, sf_dir)


@register
def code_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code anchors per code query."""
    q = quality_of(spark, sf_dir)
    bundle = q.bundle.join(q.asks.select("query_id"), "query_id", "left_semi")
    return repos.code_anchors(bundle, q.matches, q.run.targets)


@register
def explorations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7, Q12: exploration row per code query, with expanded search terms."""
    q = quality_of(spark, sf_dir)
    bundle = q.bundle.join(q.asks.select("query_id"), "query_id", "left_semi")
    rows = repos.explorations(q.context, q.plans, q.matches, repos.code_anchors(bundle, q.matches, q.run.targets), _repo_targets(spark, sf_dir))
    return rows.withColumn("search_terms", query_features.expanded_terms(F.col("query_terms"))).select(
        "query_id", "enabled", *text_of("query_terms", "modules", "search_terms"), "n_repos", "n_matches", "n_anchors", "repo_target_status", "must_execute_before_final")


# ---- page extraction and lint -----------------------------------------------------------------------------------------
@register
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter, title, type, summary and sections of every page."""
    return pages(spark, sf_dir).select(
        "root_id", "repo_path", "title", "page_type", "summary", F.array_join(F.array_sort(F.map_keys("meta")), "|").alias("keys"),
        F.coalesce(joined(F.col("sources")), F.lit("-")).alias("sources"),
        F.array_join(F.transform(extract.sections(F.col("body")), lambda s: F.concat_ws("=", s["heading"], F.char_length(s["body"]).cast("string"))), "|").alias("sections"),
    )


@register
def page_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locator, placeholder, attribute and thinness tests of every page."""
    body, section = F.col("body"), extract.section_text(F.col("body"), V.CODE_LOCATION_SECTION)
    return pages(spark, sf_dir).select(
        "root_id", "repo_path", F.char_length(section).alias("section_chars"), extract.lint_code_locator(section).alias("lint_locator"),
        extract.profile_code_locator(extract.normalized_section(section)).alias("profile_locator"), extract.lint_placeholder(section).alias("lint_placeholder"),
        extract.profile_placeholder(body).alias("profile_placeholder"), extract.attribute_values_present(body).alias("attribute_values"),
        extract.is_thin_source(F.col("repo_path"), F.col("declared_type"), body).alias("thin_source"),
    )


@register
def index_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index lines of every root."""
    return entries(spark, sf_dir)


def _lint_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    marked = scan.with_code_roots(model(spark, sf_dir, "roots").drop("is_code_root")).withColumn("has_workspace", F.col("is_code_root"))
    return marked, pages(spark, sf_dir), model(spark, sf_dir, "index_lines"), entries(spark, sf_dir), model(spark, sf_dir, "files_present")


@register
def lint_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every issue of the enabled roots."""
    return lint.lint(*_lint_inputs(spark, sf_dir))


@register
def lint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result per root."""
    inputs = _lint_inputs(spark, sf_dir)
    return lint.lint_summary(inputs[0], lint.lint(*inputs)).select("root_id", "skipped", "passed", "n_issues", "n_major", *text_of("codes"))


@register
def structure_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required paths of the enabled roots."""
    return lint.structure_issues(model(spark, sf_dir, "roots"), model(spark, sf_dir, "files_present"))


@register
def english_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, outside code fences, that read as English sentences."""
    documents = adapters.read(spark, sf_dir, "documents").select("doc_id", "text")
    return extract.english_lines(documents, ["doc_id"], "text")


# ---- repository inventory ---------------------------------------------------------------------------------------------
def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.repository_files(model(spark, sf_dir, "repo_files"))


@register
def language_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per language of every repository."""
    s = inventory.language_summary(repo_files(spark, sf_dir))
    pairs = F.transform(F.map_entries("language_summary"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return s.select("repo_id", "tracked_files", joined(F.array_sort(pairs)).alias("languages"))


@register
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: dependency and configuration files of every repository."""
    return inventory.listed_files(repo_files(spark, sf_dir)).select("repo_id", "kind", "file_no", "path")


@register
def entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entrypoints with their enclosing symbol."""
    return inventory.entrypoints(repo_files(spark, sf_dir)).select("repo_id", "entry_no", "path", "line", "symbol")


@register
def candidate_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate modules of every repository."""
    return inventory.candidate_modules(repo_files(spark, sf_dir))


@register
def repository_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot rows of all repositories, published as the latest snapshot and read back; one without files stays."""
    files = model(spark, sf_dir, "repo_files")
    repositories = files.select("repo_id", F.col("repo_path").alias("path"), *[F.lit(None).cast("string").alias(c) for c in ("branch", "commit", "remote")]).distinct()
    folder = new_folder(spark, "snapshots")
    rows = inventory.snapshot(repositories, repo_files(spark, sf_dir), "current")
    sinks.publish_snapshot(rows.limit(0), folder)
    sinks.publish_snapshot(rows, folder)
    pairs = F.transform(F.map_entries("language_summary"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return published(spark, folder).select("snapshot_id", "repo_id", "path", "tracked_files", joined(F.array_sort(pairs)).alias("languages"))


@register
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: repositories whose commit changed since the previous snapshot."""
    s = model(spark, sf_dir, "snapshots")
    previous = s.where("previous_commit is not null").select("path", F.col("previous_commit").alias("commit"))
    return inventory.snapshot_diff(previous, s.select("repo_id", "path", F.col("current_commit").alias("commit")))


@register
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that differ between two versions."""
    v = model(spark, sf_dir, "file_versions")
    return inventory.changed_files(v.where("version = 'previous'"), v.where("version = 'current'"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """File hashes of the previous and the current version, in folders of two levels."""
    number = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    v = model(spark, sf_dir, "file_versions").withColumn("path", F.concat(F.lit("a"), (number % 7).cast("string"), F.lit("/b"), (number % 11).cast("string"), F.lit("/"), "path"))
    return tuple(cut_lineage(hash_tree.file_hashes(v.where(F.col("version") == name))) for name in ("previous", "current"))


def _tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    return hash_tree.file_changes(before, after, hash_tree.differing_folders(hash_tree.tree(before), hash_tree.tree(after)))


@register
def snapshot_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash tree over the folders of every repository."""
    return hash_tree.tree(_versions(spark, sf_dir)[1]).select(*hash_tree.KEY, "n_files", hash_tree.digest().alias("hash"), hash_tree.digest("own").alias("own"))


@register
def snapshot_tree_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The previous hash tree brought to the current version by the changed files alone."""
    before, after = _versions(spark, sf_dir)
    found = hash_tree.updated_tree(cut_lineage(hash_tree.tree(before)), _tree_changes(before, after))
    return found.select(*hash_tree.KEY, "n_files", hash_tree.digest().alias("hash"), hash_tree.digest("own").alias("own"))


@register
def snapshot_tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files, found by descending the hash trees of two versions."""
    return _tree_changes(*_versions(spark, sf_dir)).select("repo_id", "path", hash_tree.change_kind().alias("change"))


@register
def snapshot_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot rows with the roots of the hash trees as commits, published one after the other and compared."""
    folder = new_folder(spark, "snapshots")
    both = []
    for name, hashes in zip(("previous", "current"), _versions(spark, sf_dir)):
        roots = hash_tree.commits(hash_tree.tree(hashes))
        repositories = roots.select("repo_id", F.concat(F.lit("repos/"), "repo_id").alias("path"), "commit", *[F.lit(None).cast("string").alias(c) for c in ("branch", "remote")])
        sinks.publish_snapshot(inventory.snapshot(repositories, hashes, name), folder)
        both.append(published(spark, folder))
    return inventory.snapshot_diff(*both)


# ---- references and closure ----------------------------------------------------------------------------------------------
@register
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of all source files."""
    return closure.reference_edges(closure.build_index(model(spark, sf_dir, "code_files"))).select("src", "dst", "kind", "symbol")


def code_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir, "code_batches").select(
        "batch_id", F.array("seed").alias("paths"), F.array("other").alias("entrypoints"), F.array(F.lit("repos/web")).alias("repo_ids"))


@lru_cache(maxsize=4)
def _closure(application: str, stamp: int, spark: SparkSession, sf_dir: str) -> closure.Closure:
    files, batches = model(spark, sf_dir, "code_files"), code_batches(spark, sf_dir)
    repos, seeds = code_repositories(files), closure.seed_files(batches)
    return closure.closure(closure.build_index(files), seeds, scope=closure.batch_repositories(batches, seeds, repos), repos=repos)


def code_repositories(files: DataFrame) -> DataFrame:
    return files.select(F.substring_index("repo_id", "/", -1).alias("name"), F.col("repo_id").alias("path")).distinct()


def closure_of(spark: SparkSession, sf_dir: str) -> closure.Closure:
    return _closure(spark.sparkContext.applicationId, data_stamp(spark, sf_dir), spark, sf_dir)


@register
def closure_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files each batch reaches, with their level."""
    return closure_of(spark, sf_dir).nodes.select("batch_id", "path", "level")


@register
def closure_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of an earlier state of the files, brought up to date by the table of changed files.

    In the earlier state every 7th file (by checksum of its path) was empty, every 11th did not exist and every 13th had
    a twin that is gone by now.
    """
    files, batches = model(spark, sf_dir, "code_files"), code_batches(spark, sf_dir)
    code = F.crc32(F.col("path").cast("binary"))
    twins = files.where(code % 13 == 2).withColumn("path", F.concat("path", F.lit(".old.vue")))
    earlier = files.where(code % 11 != 3).withColumn("content", F.when(code % 7 == 1, F.lit("")).otherwise(F.col("content"))).unionByName(twins)
    repos, seeds = code_repositories(files), closure.seed_files(batches)
    scope = closure.batch_repositories(batches, seeds, repos)
    index = closure.build_index(earlier)
    before = closure.closure(index, seeds, scope=scope, repos=repos)
    fresh = closure.refreshed_index(index, inventory.changed_files(earlier, files), files)
    return closure.updated_closure(before, fresh, seeds, scope=scope, repos=repos).nodes.select("batch_id", "path", "level")


@register
def closure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: statistics of every batch's closure."""
    return closure.closure_stats(closure_of(spark, sf_dir)).select(
        "batch_id", "file_count", "levels", "reference_count", *text_of("followed_reference_kinds"), "expansion_policy", "stopped_reason")


@register
def closure_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows of every batch."""
    files = model(spark, sf_dir, "code_files")
    return closure.evidence_rows(closure_of(spark, sf_dir), files, code_repositories(files))


# ---- findings ----------------------------------------------------------------------------------------------------------------
def findings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.flatten_findings(scan.parse_findings(model(spark, sf_dir, "findings_json")))


@register
def finding_field_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field rules of every finding."""
    return findings.field_issues(findings_table(spark, sf_dir))


@register
def ref_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence references outside the evidence."""
    return findings.evidence_ref_issues(findings_table(spark, sf_dir), model(spark, sf_dir, "evidence_ranges"))


@register
def claim_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coverage claims against the contract."""
    return findings.claim_issues(findings_table(spark, sf_dir), model(spark, sf_dir, "evidence_ranges"))


@register
def layer_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claims that all share one set of references."""
    return findings.specificity_issues(findings_table(spark, sf_dir))


@register
def target_and_context_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target pages, coding context and language of findings."""
    f = findings_table(spark, sf_dir)
    return findings.target_page_issues(f).unionByName(
        findings.coding_context_issues(f, model(spark, sf_dir, "evidence_ranges"))).unionByName(findings.language_issues(f))


@register
def bundle_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: evidence of every batch against statistics that some batches report wrongly."""
    f = findings_table(spark, sf_dir)
    files = model(spark, sf_dir, "evidence_ranges")
    n = model(spark, sf_dir, "plan_batches")
    stats = n.where("n % 5 <> 3").select(
        "batch_id", F.when(F.col("n") % 4 == 1, "limited").otherwise(V.CLOSURE_POLICY).alias("expansion_policy"),
        F.when(F.col("n") % 6 == 2, "budget").otherwise(V.CLOSURE_STOPPED).alias("stopped_reason"),
        F.when(F.col("n") % 7 == 0, F.col("n_docs") + 1).otherwise(F.col("n_docs")).alias("file_count"),
        F.when(F.col("n") % 8 == 0, F.col("n_docs") + 2).otherwise(F.col("n_docs")).alias("reference_count"),
    )
    return findings.bundle_issues(f, stats, files, files)


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned batches with fields that are absent or wrong by rule."""
    b = model(spark, sf_dir, "plan_batches")
    level = F.element_at(strings([*V.KNOWLEDGE_LEVELS, "odd"]), (F.col("n") % 4 + 1).cast("int"))
    layers, claims = strings(V.CONTRACT_ITEMS["feature_implementation"]), strings(V.CONTRACT_ITEMS["coding_playbook"])
    cut = lambda a: F.when(F.col("n") % 3 == 0, F.concat(F.slice(a, 1, 4), strings(["extra"]))).when(F.col("n") % 3 == 1, a)
    return b.select(
        "batch_id", F.when(F.col("n") % 7 != 2, F.col("slug")).alias("slug"), F.array("batch_id").alias("repo_ids"),
        F.when(F.col("n") % 5 != 1, F.array(F.lit("docs/a.txt"))).alias("paths"), F.when(F.col("n") % 10 == 1, F.array(F.lit("x.py:3"))).alias("entrypoints"),
        F.array(F.lit("page")).alias("expected_outputs"), level.alias("knowledge_level"), cut(layers).alias("required_layers"), cut(claims).alias("required_claims"),
        F.when(F.col("n") % 2 == 0, F.array(F.lit("rule"))).alias("blocking_gap_rules"), F.when(F.col("n") % 9 == 0, F.lit("8")).alias("legacy_budget"),
        F.when(F.col("n") % 2 == 0, F.lit("计划")).otherwise(F.lit("plan")).alias("title"),
    )


@register
def plan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rules of planned batches."""
    return findings.plan_issues(planned(spark, sf_dir))


def verified_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verifier output: most findings of most batches, and unknown ids in some."""
    f = model(spark, sf_dir, "findings_json")
    known = f.where("finding_pos % 20 not in (5, 6) and finding_pos % 4 <> 0").select("batch_id", "finding_id")
    unknown = f.where("finding_pos % 20 = 7").select("batch_id", F.concat("finding_id", F.lit("-x")).alias("finding_id"))
    return known.unionByName(unknown)


@register
def batch_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """does a batch's verifier output hold?"""
    return findings.accept(findings_table(spark, sf_dir), verified_ids(spark, sf_dir))


# ---- rollup ---------------------------------------------------------------------------------------------------------------------
def batch_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified findings of all batches, numbered by document."""
    kept = findings.verified_findings(findings_table(spark, sf_dir), verified_ids(spark, sf_dir))
    return kept.withColumn("batch", F.concat_ws("-", F.lit("B1"), "batch_id")).withColumn("pos", F.substring("finding_id", 3, 20).cast("long"))


@register
def published_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified findings without blocking gaps, published by batch and read back."""
    kept = findings.verified_findings(findings_table(spark, sf_dir), verified_ids(spark, sf_dir))
    folder = new_folder(spark, "findings")
    sinks.publish_findings(kept.select("batch_id", "finding_id", "knowledge_level", "evidence_refs"), folder)
    return published(spark, folder).select("batch_id", "finding_id", "knowledge_level", F.size("evidence_refs").alias("n_refs"))


@register
def batch_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: planned against verified batches."""
    plan = model(spark, sf_dir, "plan_batches").where("n % 6 <> 4").select(F.concat_ws("-", F.lit("B1"), "batch_id").alias("batch"))
    found = batch_findings(spark, sf_dir).groupBy("batch").agg(F.count("*").alias("n_findings"))
    empty = model(spark, sf_dir, "plan_batches").where("n % 20 = 5").select(F.concat_ws("-", F.lit("B1"), "batch_id").alias("batch"), F.lit(0).cast("long").alias("n_findings"))
    return rollup.batch_completion(plan, found.unionByName(empty))


@register
def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: topic, size and levels of every batch."""
    return rollup.batch_rollup(batch_findings(spark, sf_dir)).select("batch", "topic", "findings", *text_of("knowledge_levels"))


@register
def target_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate and primary pages of every batch."""
    return rollup.target_pages(batch_findings(spark, sf_dir))


@register
def target_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptor rules of every batch's targets."""
    b = model(spark, sf_dir, "plan_batches")
    name = F.concat_ws("-", F.lit("B1"), "batch_id")
    at = lambda folder: F.concat(F.lit(folder), name)
    rows = b.select(
        name.alias("batch"), at("shards/").alias("path"), F.when(F.col("n") % 6 != 1, F.lit("topic")).otherwise(F.lit(" ")).alias("topic"), name.alias("source_batch"),
        at("verified/").alias("verified_findings"), at("analysis/").alias("analysis"), at("evidence/").alias("evidence"),
        F.when(F.col("n") % 4 != 2, F.lit("wiki/sources/code/team-runs/r/x.md")).otherwise(F.lit("elsewhere.md")).alias("source_summary_path"), F.lit("b.md").alias("source_summary_blueprint"),
    )
    artifacts = rows.select(F.explode(F.array("path", "verified_findings", "analysis", "evidence")).alias("path")).where(~F.col("path").rlike("(analysis/.*7|evidence/.*3)$"))
    targets = rollup.target_pages(batch_findings(spark, sf_dir))
    blueprints = targets.where("kind = 'primary' and page_no <> 3").select("batch", F.col("page").alias("path"))
    return rollup.target_descriptor_issues(rows, targets, artifacts, blueprints)


@register
def duplicate_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose normalised body an earlier document of the source has."""
    d = adapters.read(spark, sf_dir, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "text")
    return rollup.duplicate_bodies(d, ["source"])


@register
def acceptance_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that may not be published."""
    f = findings_table(spark, sf_dir).withColumnRenamed("batch_id", "batch")
    return rollup.acceptance_issues(f)


@register
def section_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every section of every primary page."""
    f = batch_findings(spark, sf_dir)
    return rollup.section_values(f, rollup.target_pages(f))


# ---- reconciliation ------------------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Reconciliation:
    """Change requests -> search strings -> retrieval in the root of each request."""

    documents: DataFrame
    files: DataFrame
    roots: DataFrame
    entries: DataFrame
    pages: DataFrame

    @cached_property
    def handoffs(self) -> DataFrame:
        return cut_lineage(reconcile.handoffs(self.documents, self.files))

    @cached_property
    def tables(self) -> DataFrame:
        """The table rows of the request documents that are in force; shards, summaries and outputs read them."""
        return cut_lineage(reconcile.request_tables(self.documents, self.handoffs))

    @cached_property
    def shards(self) -> DataFrame:
        return cut_lineage(reconcile.handoff_shards(self.documents, self.handoffs, self.tables))

    @cached_property
    def outputs(self) -> DataFrame:
        return cut_lineage(reconcile.handoff_outputs(self.documents, self.handoffs, self.tables))

    @cached_property
    def strings(self) -> DataFrame:
        return cut_lineage(reconcile.search_strings(self.shards, self.outputs))

    @cached_property
    def run(self) -> ListedRetrieval:
        """Retrieval for the task of every request (query_no 0) and for the search strings of its handoff."""
        asked = self.documents.select("request_id", "root_id", F.lit(0).alias("query_no"), F.coalesce("task", F.lit("")).alias("query")).unionByName(
            self.strings.join(self.documents.select("request_id", "root_id"), "request_id").select("request_id", "root_id", "query_no", "query"))
        log = asked.select(
            F.concat_ws("#", "request_id", F.col("query_no").cast("string")).alias("query_id"), "query", F.col("root_id").alias("named_root"),
            F.lit("focused").alias("mode"), F.lit(0).alias("candidate_limit"), F.lit(0).alias("evidence_budget"), F.lit(False).alias("include_source"),
            F.lit(False).alias("include_cross_module"), *[F.lit(None).cast("string").alias(c) for c in ("plan_operator", "plan_scope", "plan_subject")],
        )
        # The retrieval of a request runs without the code preference of a named root.
        return ListedRetrieval(self.roots.withColumn("is_code_root", F.lit(False)), self.entries, log, self.pages)

    @cached_property
    def found(self) -> DataFrame:
        """(request_id, query_no, pos, path): candidates of each query, from the index and by links of primary pages.  A plan: who
        needs the own queries only makes rows of these."""
        return self.run.merged.select(*request_query(), "pos", "path")

    @cached_property
    def titled(self) -> DataFrame:
        """``found`` with titles, which are whole lines, of the requests' own queries: no rule asks for the others' titles."""
        return self.run.merged.select(*request_query(), "pos", "path", "title").where("query_no = 0")

    @cached_property
    def matched(self) -> DataFrame:
        """``found`` as lists of path numbers: request_id, query_no, pos (of the first path), paths."""
        return self.run.matched.select(*request_query(), F.lit(1).alias("pos"), F.col("path_nos").alias("paths"))

    @cached_property
    def title_names(self) -> DataFrame:
        """(title, title_id): the different titles and topics, which are whole lines, as numbers."""
        names = self.run.titles.select("title").unionByName(self.shards.select(F.col("topic").alias("title")))
        return cut_lineage(names.where("title <> ''").distinct().withColumn("title_id", F.monotonically_increasing_id()))

    @cached_property
    def consulted(self) -> DataFrame:
        """(request_id, query_no, pos, path): the index page of the root, then the primary pages that exist."""
        index = self.run.targets.join(self.run.index.select("root_id").distinct(), "root_id", "left_semi").select(
            *request_query(), F.lit(0).alias("pos"), F.lit(candidate_lists.INDEX_PAGE).alias("path"))
        there = self.pages.select("root_id", F.col("repo_path").alias("path")).distinct()
        read = self.run.primaries.join(there, ["root_id", "path"], "left_semi").select(*request_query(), F.col("primary_pos").alias("pos"), "path")
        return cut_lineage(index.unionByName(read))


def request_query() -> list[Column]:
    parts = F.split("query_id", "#")
    return [parts[0].alias("request_id"), parts[1].cast("int").alias("query_no")]


@lru_cache(maxsize=4)
def _reconciliation(application: str, stamp: int, spark: SparkSession, sf_dir: str) -> Reconciliation:
    return Reconciliation(
        model(spark, sf_dir, "change_requests"), model(spark, sf_dir, "handoff_files"), model(spark, sf_dir, "roots"), entries(spark, sf_dir),
        pages(spark, sf_dir),
    )


def reconciliation(spark: SparkSession, sf_dir: str) -> Reconciliation:
    return _reconciliation(spark.sparkContext.applicationId, data_stamp(spark, sf_dir), spark, sf_dir)


@register
def request_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash and fields of every change request."""
    docs = model(spark, sf_dir, "change_requests")
    described = scan.content_descriptor(docs.select("request_id", F.col("text").alias("content"), F.lit(None).cast("string").alias("source_path")))
    return described.drop("source_paths").join(reconcile.requests(docs), "request_id")


@register
def request_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output pages of every change request."""
    return reconcile.request_outputs(model(spark, sf_dir, "change_requests")).select(
        "request_id", "row_index", "shard", "source_summary", *text_of("candidate_pages", "primary_pages", "alternate_pages", "knowledge_levels", "page_blueprints"))


@register
def reconcile_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, Q11: search strings of every change request."""
    return reconciliation(spark, sf_dir).strings


@register
def reconcile_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M3: paths every change request may touch."""
    r = reconciliation(spark, sf_dir)
    return reconcile.path_candidates(r.found, r.outputs, r.handoffs.where("detected"))


@register
def reconcile_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: title candidates of every change request."""
    r = reconciliation(spark, sf_dir)
    places = r.run.titles.join(r.title_names, "title").select("place", "title_id")
    own = r.titled.withColumnRenamed("title", "place").join(places, "place").withColumnRenamed("title_id", "title")
    topics = r.shards.select("request_id", "row_index", F.col("topic").alias("title")).join(r.title_names, "title").withColumn("topic", F.col("title_id"))
    return reconcile.title_candidates(own, topics).withColumnRenamed("title", "title_id").join(r.title_names, "title_id").select("request_id", "title_no", "title")


@register
def reconcile_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: matched and consulted pages over all queries of every change request."""
    r = reconciliation(spark, sf_dir)
    paths = r.run.path_numbers
    consulted = r.consulted.join(paths, "path").select("request_id", "query_no", "pos", F.array("path_no").alias("paths"))
    numbered = reconcile.pages_of_requests(r.matched, consulted).withColumnRenamed("path", "path_no")
    return numbered.join(paths, "path_no").select("request_id", "kind", "page_no", "path")


@register
def reconcile_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: confidence of the reconciliation."""
    r = reconciliation(spark, sf_dir)
    matched = r.matched.repartition("request_id").select("request_id", F.explode("paths").alias("path"))
    return reconcile.reconciliation_confidence(r.documents, matched)


@register
def handoff_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change request with its manifest, or without one, and the quality report of the handoff."""
    return reconciliation(spark, sf_dir).handoffs.drop("m", "source_path")


@register
def handoff_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of every detected handoff."""
    return reconciliation(spark, sf_dir).shards.select(*[c for c in reconcile.SHARD if c != "page_blueprints"], *text_of("page_blueprints"))


@register
def handoff_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output pages of every detected handoff; alternates are the candidates that are not primary."""
    lists = ("candidate_pages", "primary_pages", "alternate_pages", "knowledge_levels", "page_blueprints")
    return reconciliation(spark, sf_dir).outputs.select(*[c for c in reconcile.OUTPUT if c not in lists], *text_of(*lists))


@register
def maintenance_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: material list of every change request."""
    r = reconciliation(spark, sf_dir)
    return reconcile.materials(r.handoffs, r.shards, r.outputs)


# ---- sinks and streams ---------------------------------------------------------------------------------------------------------------------
def _file_writer(folder: str):
    """(root_id, path, html) -> a text file per row below ``folder``, written by the task that holds the row."""

    def write(batches):
        fs, base = filesystem(folder)
        for batch in batches:
            for root, path, html in zip(*[batch.column(c).to_pylist() for c in ("root_id", "path", "html")]):
                name = f"{base}/{root}/{path}"
                fs.create_dir(name.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(name) as out:
                    out.write((html or "").encode())
            yield batch.select(["path"])

    return write


@register
def scanned_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as files of five roots and scanned back; folders of dependencies are not opened."""
    number = F.col("page_id").cast("string")
    p = adapters.read(spark, sf_dir, "pages").select(
        F.concat(F.lit("h"), (F.col("page_id") % 5).cast("string")).alias("root_id"),
        F.concat(F.lit("wiki/d"), (F.col("page_id") % 3).cast("string"), F.when(F.col("page_id") % 23 == 7, "/node_modules").otherwise(""), F.lit("/p"), number, F.lit(".md")).alias("path"), "html")
    folder = new_folder(spark, "files")
    p.mapInArrow(_file_writer(folder), "path string").count()
    found = read_folders(spark, {f"h{i}": f"{folder}/h{i}" for i in range(5)}, "*.md")
    return found.select(F.col("id").alias("root_id"), "path", "length", F.sha2("content", 256).alias("sha256"))


@register
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows, appended by a file stream over the event table."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/ledger-{uuid4().hex}"
    schema = adapters.read(spark, sf_dir, "events").schema
    jobs.stream_ledger(spark, sf_dir, schema, f"{folder}/rows", f"{folder}/progress", "events.parquet").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("run_id", "kind", "artifact", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@register
def source_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw names of incoming sources (pages), free of collisions in writable roots."""
    p = adapters.read(spark, sf_dir, "pages")
    name = F.concat(F.element_at(F.split(F.regexp_replace("url", r"[?#].*$", ""), "/"), -1), F.lit(".html"))
    incoming = p.select(F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("root_id"), F.col("page_id").alias("arrival"), name.alias("name"), (F.col("page_id") % 9 == 0).alias("in_raw"))
    existing = p.where("page_id % 3 = 0").select(
        F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("root_id"),
        F.concat(F.lit("raw/imports/"), F.regexp_replace(name, r"\.html$", ""), F.when(F.col("page_id") % 2 == 0, F.lit("-3")).otherwise(F.lit("")), F.lit(".html")).alias("path"))
    return sinks.register_sources(incoming, existing, model(spark, sf_dir, "roots"))


def forget_stages() -> None:
    """Drop the stages kept for this session, so that the next query computes its own."""
    for kept in (_retrieval, _quality, _closure, _reconciliation):
        kept.cache_clear()
