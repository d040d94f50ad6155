"""Evidence retrieval for a query log: from the index to the evidence set of every query and root."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import candidate_lists, links, query_features, scoring, selection
from ..session import cut_lineage, scratch


@dataclass(frozen=True)
class Retrieval:
    """One retrieval job.  Each property is a table; tables that several others need are written once.

    roots: root_id, enabled, priority, is_code_root          entries: root_id, entry_pos, title, path, summary
    pages: parsed pages (root_id, repo_path, title, page_type, summary, body)         queries: the query log
    """

    roots: DataFrame
    entries: DataFrame
    queries: DataFrame
    pages: DataFrame | None = None
    candidate_limit: int = V.CANDIDATE_LIMIT
    link_limit: int = V.LINK_LIMIT

    @cached_property
    def index(self) -> DataFrame:
        """The index entries as a narrow table: aliases, scoring and the final lookup all read it.

        Roots that are not enabled are searched by no query.  The filter goes below the columns parsed from the lines, and the
        roots are written, so that the planner broadcasts a short list of them and the lines stay where they are.
        """
        searched = cut_lineage(query_features.enabled_roots(self.roots).select("root_id"))
        return cut_lineage(self.entries.where(F.col("root_id").isin(searched)))

    @cached_property
    def aliases(self) -> DataFrame:
        return cut_lineage(scoring.module_aliases(self.index))

    @cached_property
    def targets(self) -> DataFrame:
        aliases = self.aliases
        with scratch(self.queries.sparkSession) as keep:
            # Few short rows cost much work each, so they are dealt by number, not by their bytes, and read by several plans.
            parts = int(self.queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            flagged = cut_lineage(query_features.intent_flags(self.queries.repartition(parts, "query_id")))
            fan_out = query_features.query_targets(flagged, self.roots)
            planned = query_features.semantic_plan(query_features.with_modules(fan_out, aliases))
            return keep(cut_lineage(query_features.intents(planned)))

    @cached_property
    def ranked(self) -> DataFrame:
        index, targets, aliases = self.index, self.targets, self.aliases
        with scratch(self.queries.sparkSession) as keep:
            return keep(cut_lineage(scoring.ranked_entries(index, targets, aliases, self.candidate_limit)))

    @cached_property
    def hits(self) -> DataFrame:
        """The ranked entries with all their columns; summaries are whole texts."""
        return scoring.with_entries(self.ranked, self.index)

    @cached_property
    def top(self) -> DataFrame:
        return cut_lineage(scoring.narrow_hits(self.ranked, self.index, self.targets))

    @cached_property
    def index_candidates(self) -> DataFrame:
        return cut_lineage(scoring.candidate_columns(self.top, self.targets, self.aliases, self.index))

    @cached_property
    def primaries(self) -> DataFrame:
        # No other column is read after the rules, so none goes through their windows and sorts without need.
        return cut_lineage(selection.select_primaries(self.index_candidates, self.targets).select(
            "query_id", "root_id", "path", "score20", "rule_no", "primary_pos"))

    @cached_property
    def expansion(self) -> DataFrame:
        return cut_lineage(links.expand_relationships(self.primaries, self.pages, self.link_limit))

    @cached_property
    def merged(self) -> DataFrame:
        """The candidates as a plan: who needs few of their columns merges and writes only these."""
        linked = selection.linked_candidates(self.expansion, self.pages, self.aliases)
        return selection.merge_candidates(self.index_candidates, linked)

    @cached_property
    def candidates(self) -> DataFrame:
        return cut_lineage(self.merged)

    @cached_property
    def evidence(self) -> DataFrame:
        return cut_lineage(selection.select_evidence(self.candidates, self.primaries, self.expansion, self.targets))

    @cached_property
    def omitted(self) -> DataFrame:
        return selection.omitted_candidates(self.candidates, self.evidence, self.targets)

    @cached_property
    def coverage(self) -> DataFrame:
        # Only modules that a collection query asks for are looked for, in the roots where it asks.
        asked = self.targets.where("is_collection and scope <> ''").select("root_id", F.col("scope").alias("module")).distinct()
        listed = self.index.select("root_id", "path", "title", "summary").join(asked.select("root_id").distinct(), "root_id", "left_semi")
        modules = scoring.page_modules(listed, self.aliases.join(asked, ["root_id", "module"], "left_semi"))
        return cut_lineage(selection.coverage_proof(self.candidates, self.evidence, self.targets, modules))


@dataclass(frozen=True)
class ListedRetrieval(Retrieval):
    """A retrieval for a log as long as the corpus: candidates are lists of numbers, see :mod:`candidate_lists`."""

    @cached_property
    def path_numbers(self) -> DataFrame:
        index = self.index
        with scratch(self.queries.sparkSession) as keep:
            return keep(cut_lineage(candidate_lists.path_numbers(index, self.pages)))

    @cached_property
    def listed(self) -> tuple[DataFrame, DataFrame]:
        """The candidates of each query and root from the index, and the facts of the entries."""
        index, aliases, paths = self.index, self.aliases, self.path_numbers
        targets, columns = candidate_lists.carried(self.targets)
        with scratch(self.queries.sparkSession) as keep:
            with scratch(self.queries.sparkSession) as pass_on:
                ranked, numbers = scoring.ranked_lists(index, targets, aliases, columns, self.candidate_limit)
                ranked, numbers = pass_on(cut_lineage(ranked)), pass_on(cut_lineage(numbers))
            facts = keep(cut_lineage(candidate_lists.entry_facts(index, numbers, aliases, paths, targets)))
            return keep(cut_lineage(candidate_lists.candidate_lists(ranked, facts))), facts

    @cached_property
    def primaries(self) -> DataFrame:
        c = candidate_lists.with_rules(self.listed[0], self.targets)
        chosen = selection.primaries_of(c, ["query_id", "root_id", "path", "score20"])
        return cut_lineage(chosen.withColumnRenamed("path", "path_no").join(self.path_numbers, "path_no").select(
            "query_id", "root_id", "path", "score20", "rule_no", "primary_pos"))

    @cached_property
    def matched(self) -> DataFrame:
        """The candidates of each query and root with those that links lead to: (query_id, root_id, path_nos, keys)."""
        linked = candidate_lists.linked_lists(self.expansion, self.path_numbers)
        return cut_lineage(candidate_lists.merged_lists(self.listed[0], linked))

    @cached_property
    def merged(self) -> DataFrame:
        """:attr:`matched` as rows; ``title`` names the place of the title, see :attr:`titles`."""
        at = F.inline(F.arrays_zip(F.sequence(F.lit(1), F.size("path_nos")), "path_nos", "keys")).alias("pos", "path_no", "key")
        rows = self.matched.where(F.size("path_nos") > 0).select("query_id", "root_id", at)
        linked = F.concat_ws("\n", "root_id", "path")
        return rows.join(self.path_numbers, "path_no").withColumn("title", F.when(F.col("key") < 0, linked).otherwise(F.col("key").cast("string")))

    @cached_property
    def titles(self) -> DataFrame:
        """(place, title): the titles of all candidates; a linked page has that of its text."""
        dst = self.expansion.where("dst is not null").select("root_id", F.col("dst").alias("repo_path")).distinct()
        pages = links.pages_named(self.pages, dst).groupBy("root_id", "repo_path").agg(F.first("title").alias("title"))
        entries = self.listed[1].select(F.col("key").cast("string").alias("place"), "title")
        return entries.unionByName(pages.select(F.concat_ws("\n", "root_id", "repo_path").alias("place"), "title"))
