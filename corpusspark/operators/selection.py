"""Candidates -> primary pages -> evidence under a budget, for all queries and roots at once.

Every "first rule that yields rows wins" of the selection is a flag column computed by windows over
(query_id, root_id), so there is one shuffle and no branching per query.  A window group holds the
candidates of one query in one root, which the candidate limit bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import drop_prefix, strings
from .links import pages_named
from .scoring import is_code_feature, is_code_module, is_repository_map, page_modules, page_role, repo_path

GROUP = ["query_id", "root_id"]

QUERY_COLUMNS = [
    "query_id", "root_id", "mode", "include_source", "include_cross_module", "evidence_budget", "modules",
    "wants_source", "wants_data_dictionary", "wants_regulation", "wants_cross_module", "wants_code_navigation",
    "wants_code_knowledge", "code_topic_terms", "operator", "scope", "is_collection", "is_attribute",
]


def by_group():
    return W.partitionBy(*GROUP)


def some(condition: Column) -> Column:
    """True for the whole group when any of its rows satisfies the condition."""
    return F.coalesce(F.max(condition).over(by_group()), F.lit(False))


def with_query(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds the query columns and the tests on a candidate that all rules share."""
    c = candidates.join(targets.select(*QUERY_COLUMNS), GROUP)
    return (
        c.withColumn("m_query", F.arrays_overlap("page_modules", "modules"))
        .withColumn("m_scope", (F.col("scope") != "") & F.array_contains("page_modules", F.col("scope")))
        .withColumn("code_feature", (F.col("page_role") == "feature") & is_code_feature(F.col("path")))
        .withColumn("code_module", (F.col("page_role") == "module") & is_code_module(F.col("path")))
        .withColumn("repo_map", F.col("code_module") & is_repository_map(F.col("path"), F.col("title")))
        .withColumn(
            "covers_topic",
            (F.size("code_topic_terms") == 0) | F.arrays_overlap("topic_found", "code_topic_terms"),
        )
        .withColumn("rank_role", role_rank())
        # Rules that follow a window read these numbers, so the lists stay behind when rows are shuffled.
        .withColumns({"n_modules": F.size("modules"), "n_page_modules": F.size("page_modules"), "n_topics": F.size("code_topic_terms")})
    )


def role_rank() -> Column:
    """Role priority times two, so that the half step between roles stays an integer."""
    role = F.col("page_role")
    priority = F.lit(V.ROLE_PRIORITY_OTHER)
    for name, value in V.ROLE_PRIORITY.items():
        priority = F.when(role == name, value).otherwise(priority)
    return (
        F.when(F.col("code_feature") & F.col("wants_code_knowledge"), -1)
        .when(F.col("code_module") & F.col("wants_code_navigation"), -2)
        .when((role == "data_dictionary") & F.col("wants_data_dictionary"), -2)
        .when((role == "source") & F.col("wants_source"), -2)
        .otherwise(priority * 2)
    )


def _module_gate() -> Column:
    """True when a single requested module excludes the candidate."""
    lenient = F.col("include_cross_module") | F.col("wants_cross_module") | (F.col("mode") == "exhaustive")
    return (F.col("n_modules") == 1) & (F.col("n_page_modules") > 0) & ~F.col("m_query") & ~lenient


def _regulation_blocked() -> Column:
    return (F.col("page_role") == "regulation_requirement") & ~(F.col("wants_regulation") | (F.col("mode") == "exhaustive"))


def primary_allowed() -> Column:
    source = (F.col("page_role") == "source") & ~(F.col("include_source") | F.col("wants_source"))
    return ~source & ~_regulation_blocked() & ~_module_gate()


def evidence_allowed() -> Column:
    source = (F.col("page_role") == "source") & ~(
        F.col("include_source") | F.col("wants_source") | (F.col("mode") == "exhaustive")
    )
    return ~source & ~_regulation_blocked() & ~_module_gate()


def attribute_owners(c: DataFrame, base: Column, name: str) -> DataFrame:
    """Marks the owner candidates of an attribute query within the rows where ``base`` holds."""
    page = base & F.col("page_role").isin("feature", "concept", "query")
    c = c.withColumn("_ent", page).withColumn("_mod", page & ((F.col("n_modules") == 0) | F.col("m_query")))
    c = c.withColumn("_own", F.when(some(F.col("_mod")), F.col("_mod")).otherwise(F.col("_ent")))
    c = c.withColumn("_feat", F.col("_own") & F.col("code_feature") & F.col("wants_code_knowledge"))
    return c.withColumn(name, F.when(some(F.col("_feat")), F.col("_feat")).otherwise(F.col("_own"))).drop(
        "_ent", "_mod", "_own", "_feat"
    )


def fallback_maps(c: DataFrame, name: str) -> DataFrame:
    """Marks repository maps, or else all code module pages."""
    return c.withColumn(name, F.when(some(F.col("repo_map")), F.col("repo_map")).otherwise(F.col("code_module")))


def select_primaries(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Primary pages per query and root with ``primary_pos``.

    Returning rules, tried in order: attribute owner, scope-less collection, focused code query without
    topic, module without pages, collection owner.  Narrowing rules shrink the pool only if they leave rows.
    """
    return primaries_of(with_query(candidates, targets), candidates.columns)


def primaries_of(c: DataFrame, columns: list[str]) -> DataFrame:
    """The rules of :func:`select_primaries` on candidates that have the tests of :func:`with_query`; they read no list."""
    code, navigation = F.col("wants_code_knowledge"), F.col("wants_code_navigation")
    focused = F.col("mode") == "focused"
    c = c.withColumn("allowed", primary_allowed())
    c = c.withColumn("attr_base", F.col("allowed") | ~some(F.col("allowed")))
    c = attribute_owners(c, F.col("attr_base"), "attr_owner")
    c = fallback_maps(c, "map_page")

    nav_pool = F.col("allowed") & F.col("code_module")
    c = c.withColumn("pool1", F.when(navigation & some(nav_pool), nav_pool).otherwise(F.col("allowed")))
    topicless = focused & code & ~navigation & (F.col("n_topics") == 0)
    c = c.withColumn("topicless_map", topicless & F.col("pool1") & F.col("code_module"))

    gated = (F.col("n_modules") == 1) & ~F.col("include_cross_module") & ~F.col("wants_cross_module")
    c = c.withColumn("same_module", F.col("pool1") & F.col("m_query"))
    c = c.withColumn("has_same", some(F.col("same_module")))
    c = c.withColumn("pool2", F.when(gated & F.col("has_same"), F.col("same_module")).otherwise(F.col("pool1")))
    c = c.withColumn("owner", F.col("pool2") & (F.col("page_role") == "module") & F.col("m_scope"))

    topical = focused & code & ~navigation
    c = c.withColumn("on_topic", topical & F.col("pool2") & F.col("code_feature") & F.col("covers_topic"))
    topic_paths = F.collect_set(F.when(F.col("on_topic"), F.col("path"))).over(by_group())
    c = c.withColumn("topic_paths", topic_paths)
    c = c.withColumn(
        "pool3",
        F.col("pool2") & ((F.size("topic_paths") == 0) | ~F.col("code_feature") | F.array_contains("topic_paths", F.col("path"))),
    )
    c = c.withColumn("pool4", F.col("pool3") | ~some(F.col("pool3")))

    # One tag per returning rule; the lowest tag present in the group decides.
    tagged = F.array_compact(
        F.array(
            F.when(F.col("is_attribute") & F.col("attr_owner"), F.lit(1)),
            F.when(F.col("is_collection") & (F.col("scope") == "") & code & F.col("map_page"), F.lit(2)),
            F.when(F.col("topicless_map"), F.lit(3)),
            F.when(gated & ~F.col("has_same") & code & F.col("map_page"), F.lit(4)),
            F.when(F.col("is_collection") & F.col("owner"), F.lit(5)),
            F.when(F.col("pool4"), F.lit(6)),
        )
    )
    c = c.withColumn("tags", tagged).withColumn("rule_no", F.min(F.array_min("tags")).over(by_group()))
    c = c.where(F.array_contains("tags", F.col("rule_no")))

    seed = F.when(focused, 1).when(F.col("mode") == "exhaustive", 5).otherwise(3)
    seed = F.when(F.col("rule_no").isin(1, 6), seed).otherwise(1)
    owner_rule = F.col("rule_no") == 5
    order = by_group().orderBy(F.when(~owner_rule, F.col("rank_role")), F.desc("score20"), "path", "pos")
    c = c.withColumn("rn", F.row_number().over(order)).withColumn("seeded", F.col("rn") <= seed)

    # Complementary feature pages of a focused code query.
    expandable = topical & (F.col("rule_no") == 6)
    top_score = F.first(F.when(F.col("code_feature"), F.col("score20")), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    seed_path = F.first("path").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    c = c.withColumn("top_feature", top_score).withColumn("seed_path", seed_path)
    extra = (
        expandable & ~F.col("seeded") & F.col("code_feature") & F.col("covers_topic") & (F.col("path") != F.col("seed_path"))
        & (F.col("top_feature") > 0)
        & (F.col("top_feature") - F.col("score20") <= V.FOCUSED_FEATURE_GAP_20THS)
        & (F.col("score20") * 100 >= F.col("top_feature") * V.FOCUSED_FEATURE_RATIO_PERCENT)
    )
    c = c.withColumn("extra", extra)
    c = c.withColumn("extra_no", F.sum(F.col("extra").cast("int")).over(order))
    chosen = c.where(F.col("seeded") | (F.col("extra") & (F.col("extra_no") <= V.FOCUSED_FEATURE_LIMIT - 1)))
    return chosen.select(
        *columns, "rule_no", F.row_number().over(order).alias("primary_pos"),
    )


def linked_candidates(expansion: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Candidate rows for the resolved links: three quarters of the source page's score."""
    resolved = expansion.where("dst is not null")
    wanted = resolved.select("root_id", F.col("dst").alias("repo_path")).distinct()
    found = pages_named(pages, wanted).select(
        "root_id", F.col("repo_path").alias("dst"), "title", "page_type"
    )
    modules = page_modules(wanted.select("root_id", F.col("repo_path").alias("path")), aliases, texts=False).select(
        "root_id", F.col("path").alias("dst"), "page_modules"
    )
    role = page_role(F.col("dst"))
    c = resolved.join(found, ["root_id", "dst"]).join(modules, ["root_id", "dst"], "left")
    return c.select(
        "query_id", "root_id", F.col("link_no").alias("pos"), F.col("dst").alias("path"), "title",
        F.col("page_type").alias("type"), role.alias("page_role"),
        F.coalesce(F.try_element_at("page_modules", F.lit(1)), F.lit("")).alias("module"),
        F.coalesce("page_modules", strings([])).alias("page_modules"), strings([]).alias("topic_found"),
        (F.col("src_score20") * 3 / 4).cast("long").alias("score20"),
        F.array(F.lit("explicit_link_from_primary_evidence"), F.concat(F.lit("role:"), role)).alias("signals"),
        F.lit("linked").alias("intent_fit"), F.lit("linked").alias("module_fit"),
        F.when(role == "source", "linked_provenance").otherwise("normal").alias("source_policy"),
        F.concat_ws(":", "link_type", "src").alias("source"),
    )


def merge_candidates(index_candidates: DataFrame, linked: DataFrame) -> DataFrame:
    """Index candidates, then linked ones; the first row of a path wins; ``pos`` is renumbered."""
    both = index_candidates.withColumn("step", F.lit(0)).unionByName(linked.withColumn("step", F.lit(1)))
    first = W.partitionBy(*GROUP, "path").orderBy("step", "pos")
    # Rows of a path lie in the partition of their query and root, so both windows share one shuffle.
    kept = both.repartition(*GROUP).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    renumbered = F.row_number().over(by_group().orderBy("step", "pos"))
    return kept.withColumn("pos", renumbered).drop("step")


def select_evidence(merged: DataFrame, primaries: DataFrame, expansion: DataFrame, targets: DataFrame) -> DataFrame:
    """Evidence rows with evidence_pos, evidence_role and selection_reason.

    The greedy filling of the budget is a cut: stages in order, first row of a path, first ``budget`` rows.
    """
    columns = ["query_id", "root_id", "path", "stage", "stage_pos", "evidence_role", "selection_reason"]
    c = with_query(merged, targets)
    c = fallback_maps(c, "map_page")
    prime = primaries.select(*GROUP, "path", F.col("primary_pos")).dropDuplicates([*GROUP, "path"])
    c = c.join(prime, [*GROUP, "path"], "left")
    links = expansion.where("dst is not null").groupBy(*GROUP, F.col("dst").alias("path")).agg(F.min("link_no").alias("first_link"))
    c = c.join(links, [*GROUP, "path"], "left")
    plain = ~F.col("is_collection") & ~F.col("is_attribute")

    # Attribute queries: the owner among the primaries, or else among all candidates.
    is_primary = F.col("primary_pos").isNotNull()
    c = attribute_owners(c, is_primary, "own_primary")
    c = attribute_owners(c, F.lit(True), "own_any")
    c = c.withColumn("attr_owner", F.col("is_attribute") & F.when(some(F.col("own_primary")), F.col("own_primary")).otherwise(F.col("own_any")))
    rank = F.struct(F.col("rank_role"), -F.col("score20"), F.col("path"))
    c = c.withColumn("first_owner", F.min(F.when(F.col("attr_owner"), rank)).over(by_group()) == rank)

    owner = F.col("is_collection") & (F.col("page_role") == "module") & F.col("m_scope")
    c = c.withColumn("coll_owner", owner).withColumn("has_owner", some(owner))
    member = F.col("is_collection") & (F.col("page_role") == "feature") & F.col("m_scope")
    by_score = F.row_number().over(by_group().orderBy(F.desc("score20"), "path"))
    c = c.withColumn("score_pos", by_score)

    additional = F.col("mode").isin("balanced", "exhaustive") & evidence_allowed()
    in_stages = is_primary | F.col("first_link").isNotNull() | additional
    map_pos = F.when(F.col("map_page") & F.col("wants_code_knowledge"), F.col("pos"))
    # Plain queries take the first map page that no earlier stage holds; attribute queries the first one.
    c = c.withColumn("free_map", F.min(F.when(~in_stages, map_pos)).over(by_group())).withColumn("any_map", F.min(map_pos).over(by_group()))

    link_role = F.when((F.col("page_role") == "source") & ~F.col("wants_source"), "provenance").otherwise("supporting")

    def stage(number: int, condition: Column, position: Column, role, reason) -> Column:
        return F.when(
            condition,
            F.struct(
                F.lit(number).alias("stage"), position.cast("long").alias("stage_pos"),
                (role if isinstance(role, Column) else F.lit(role)).alias("evidence_role"),
                (reason if isinstance(reason, Column) else F.lit(reason)).alias("selection_reason"),
            ),
        )

    map_reason, link_reason = "code_map_fallback_for_exploration", "explicit_link_from_primary_evidence"
    stages = F.array_compact(
        F.array(
            stage(0, F.col("is_collection") & F.col("coll_owner"), F.col("score_pos"), "primary", "collection_owner_page"),
            stage(0, F.col("is_collection") & ~F.col("has_owner") & is_primary, F.col("primary_pos"), "primary",
                  F.when(F.col("page_role") == "module", "collection_owner_page").otherwise("top_relevant_primary_page")),
            stage(1, member, F.col("score_pos"), "supporting", "collection_member_evidence"),
            stage(0, F.col("is_attribute") & F.coalesce("first_owner", F.lit(False)) & F.col("attr_owner"), F.lit(0), "primary",
                  "entity_attribute_owner_page"),
            stage(0, plain & is_primary, F.col("primary_pos"), "primary", "top_relevant_primary_page"),
            stage(1, ~F.col("is_collection") & F.col("first_link").isNotNull(), F.col("first_link"), link_role, link_reason),
            stage(2, plain & additional, F.col("pos"), "supporting", "additional_ranked_candidate"),
            stage(3, plain & (F.col("pos") == F.col("free_map")), F.lit(0), "supporting", map_reason),
            stage(3, F.col("is_attribute") & (F.col("pos") == F.col("any_map")), F.lit(0), "supporting", map_reason),
        )
    )
    best = F.array_min(stages)
    picked = c.withColumn("s", best).where("s is not null")
    budget = F.when(F.coalesce("evidence_budget", F.lit(0)) > 0, F.col("evidence_budget")).otherwise(
        F.when(F.col("mode") == "exhaustive", V.EXHAUSTIVE_EVIDENCE_BUDGET).otherwise(V.EVIDENCE_BUDGET)
    )
    order = by_group().orderBy("s.stage", "s.stage_pos")
    return (
        picked.withColumn("evidence_pos", F.row_number().over(order))
        .where(F.col("evidence_pos") <= budget)
        .select(
            *GROUP, "evidence_pos", "path", "title", "type", "page_role", "module", "score20",
            F.col("s.evidence_role").alias("evidence_role"), F.col("s.selection_reason").alias("selection_reason"),
        )
    )


def selection_status(merged: DataFrame, evidence: DataFrame) -> DataFrame:
    chosen = evidence.select(*GROUP, "path", F.lit("selected").alias("selection_status"))
    return merged.join(chosen, [*GROUP, "path"], "left").withColumn(
        "selection_status", F.coalesce("selection_status", F.lit("omitted"))
    )


def omitted_candidates(merged: DataFrame, evidence: DataFrame, targets: DataFrame) -> DataFrame:
    """Index candidates that are not evidence, with the reason."""
    rest = merged.where("source = 'index.md'").join(evidence.select(*GROUP, "path"), [*GROUP, "path"], "left_anti")
    c = rest.join(
        targets.select(*GROUP, "modules", "mode", "wants_cross_module", "wants_source", "wants_regulation", "wants_data_dictionary"),
        GROUP,
    )
    overlap = F.arrays_overlap("page_modules", "modules")
    role = F.col("page_role")
    reason = (
        F.when((F.size("modules") == 1) & (F.size("page_modules") > 0) & ~overlap & ~F.col("wants_cross_module"), "module_mismatch")
        .when((role == "source") & ~F.col("wants_source"), "source_page_not_requested")
        .when((role == "regulation_requirement") & ~F.col("wants_regulation"), "regulation_intent_not_requested")
        .when((role == "data_dictionary") & ~F.col("wants_data_dictionary"), "data_dictionary_not_requested")
        .when(F.col("mode") == "focused", "not_selected_for_focused_evidence")
        .otherwise("evidence_budget_or_lower_rank")
    )
    return c.select(*GROUP, "pos", "path", "title", "score20", "page_role", "module", "signals", reason.alias("reason"))


def coverage_proof(merged: DataFrame, evidence: DataFrame, targets: DataFrame, index_modules: DataFrame) -> DataFrame:
    """Owner and member pages of every collection query, and which members are evidence.

    Owners and members come from the whole index (``index_modules``: root_id, path, page_modules) and the candidates,
    so that the candidate limit hides none; pages that are no candidates stand last, with score 0.
    """
    plans = targets.where("is_collection").select(*GROUP, "operator", "scope", "subject")
    c = merged.join(plans, GROUP).where((F.col("scope") != "") & F.array_contains("page_modules", F.col("scope")))
    listed = index_modules.select("root_id", "path", F.explode("page_modules").alias("scope")).where("scope <> ''").join(plans, ["root_id", "scope"]).select(
        *GROUP, "operator", "scope", "subject", repo_path(F.col("path")).alias("path"), page_role(F.col("path")).alias("page_role"), F.lit(0).cast("long").alias("score20"))
    names = [*GROUP, "operator", "scope", "subject", "path", "page_role"]
    c = c.select(*names, F.col("score20").cast("long").alias("score20")).unionByName(listed).groupBy(*names).agg(F.max("score20").alias("score20"))
    c = c.where(F.col("page_role").isin("module", "feature")).join(
        evidence.select(*GROUP, "path", F.lit(True).alias("in_evidence")), [*GROUP, "path"], "left"
    )
    item = F.struct((-F.col("score20")).alias("o"), "path")

    def paths(condition: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(condition, item))), lambda x: x["path"])

    is_member = F.col("page_role") == "feature"
    proof = c.groupBy(*GROUP).agg(
        paths(F.col("page_role") == "module").alias("owner_pages"), paths(is_member).alias("member_paths"),
        paths(is_member & F.col("in_evidence")).alias("evidence_member_paths"),
    )
    full = plans.join(proof, GROUP, "left")
    for name in ("owner_pages", "member_paths", "evidence_member_paths"):
        full = full.withColumn(name, F.coalesce(name, strings([])))
    return full.withColumn("complete", (F.size("owner_pages") > 0) & (F.size("member_paths") > 0))
