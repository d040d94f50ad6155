"""Query log -> feature columns: tokens, intents, modules, operator and semantic plan.

``queries``: query_id, query, named_root, mode, candidate_limit, evidence_budget, include_source,
include_cross_module and the optional plan columns plan_operator, plan_scope, plan_subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.sizing import lookup_join
from ..functions.terms import boundary_keys, code_topic_terms, tokens, topic_terms
from ..functions.text import any_of, contains_any, drop_suffix, strings, strip


def intent_flags(queries: DataFrame) -> DataFrame:
    """Tokens, topic terms and the intent flags; they depend on the text alone."""
    lowered = F.lower("query")
    q = queries.withColumn("tokens", tokens(F.col("query")))
    navigation = contains_any(lowered, V.CODE_NAVIGATION_HINTS)
    return q.select(
        "*",
        lowered.alias("lowered_query"),
        contains_any(lowered, V.DATA_DICTIONARY_HINTS).alias("wants_data_dictionary"),
        (contains_any(lowered, V.SOURCE_HINTS) | F.arrays_overlap("tokens", strings(V.SOURCE_TOKEN_HINTS))).alias("wants_source"),
        contains_any(lowered, V.REGULATION_HINTS).alias("wants_regulation"),
        contains_any(lowered, V.CROSS_MODULE_HINTS).alias("wants_cross_module"),
        navigation.alias("wants_code_navigation"),
        (navigation | contains_any(lowered, V.CODE_KNOWLEDGE_HINTS)).alias("wants_code_knowledge"),
        contains_any(lowered, V.RUNTIME_BOUNDARY_QUERY_HINTS).alias("wants_runtime_boundary"),
        topic_terms(F.col("query")).alias("topic_terms"),
        code_topic_terms(F.col("query")).alias("code_topic_terms"),
    )


def intents(df: DataFrame) -> DataFrame:
    named = [
        ("wants_data_dictionary", "data_dictionary_query"), ("wants_source", "source_query"),
        ("wants_regulation", "regulation_query"), ("wants_cross_module", "cross_module_query"),
        ("wants_code_navigation", "code_navigation_query"),
    ]
    values = [F.lit("feature_query")] + [F.when(F.col(flag), F.lit(name)) for flag, name in named]
    return df.withColumn("intents", F.array_compact(F.array(*values)))


def enabled_roots(roots: DataFrame) -> DataFrame:
    """The roots that queries can search."""
    return roots.where("enabled").select("root_id", "priority", "is_code_root")


def query_targets(flagged: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per query and searched root: the named root, or every enabled root.

    The registry is joined by a scope key ('*' for all roots) and is broadcast only when counting it
    shows that it fits; beyond that the queries of a scope are spread over salts.
    """
    enabled = enabled_roots(roots)
    scopes = enabled.withColumn("scope", F.col("root_id")).unionByName(enabled.withColumn("scope", F.lit("*")))
    q = flagged.withColumn("scope", F.coalesce("named_root", F.lit("*")))
    joined = lookup_join(q, scopes, ["scope"], spread=["query_id"]).drop("scope")
    forced = F.col("named_root").isNotNull() & F.col("is_code_root")
    return joined.withColumn("wants_code_knowledge", F.col("wants_code_knowledge") | forced)


def query_modules(targets: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, root_id, modules): tokens that are aliases first, then aliases standing in the text."""
    per_query = targets.select("query_id", "tokens", "lowered_query").dropDuplicates(["query_id"])
    from_tokens = per_query.select("query_id", F.posexplode("tokens").alias("pos", "key")).select(
        "query_id", F.lower("key").alias("alias_key"), F.lit(0).alias("step"), F.col("pos").cast("long").alias("pos")
    )
    from_text = per_query.select(
        "query_id", F.explode(boundary_keys(F.col("lowered_query"))).alias("alias_key"),
        F.lit(1).alias("step"), F.lit(0).cast("long").alias("pos"),
    )
    # Keys meet only the aliases of the roots that their query searches.
    searched = targets.select("query_id", "root_id").distinct()
    keys = from_tokens.unionByName(from_text).join(searched, "query_id")
    matched = lookup_join(keys, aliases.select("root_id", "alias_key", "module", "alias_rank"), ["root_id", "alias_key"], spread=["query_id"])
    ranked = matched.groupBy("query_id", "root_id", "module").agg(
        F.min(F.struct("step", F.when(F.col("step") == 0, F.struct(F.col("pos").alias("a"), F.lit(0).alias("b")))
                       .otherwise(F.struct(F.col("alias_rank.entry_pos").cast("long").alias("a"), F.col("alias_rank.value_pos").alias("b"))))).alias("rank")
    )
    return ranked.groupBy("query_id", "root_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "module"))), lambda x: x["module"]).alias("modules")
    )


def with_modules(targets: DataFrame, aliases: DataFrame) -> DataFrame:
    found = query_modules(targets, aliases)
    return targets.join(found, ["query_id", "root_id"], "left").withColumn(
        "modules", F.coalesce("modules", strings([]))
    )


def is_attribute_list_query(query: Column) -> Column:
    lowered = F.lower(query)
    return (
        contains_any(lowered, V.LIST_HINTS)
        & ~contains_any(lowered, V.IMPLEMENTATION_OVERRIDE_HINTS)
        & contains_any(lowered, [h.lower() for h in V.ENTITY_ATTRIBUTE_HINTS])
        & ~contains_any(lowered, V.APPLICATION_HINTS + V.CAPABILITY_HINTS)
    )


def infer_operator(query: Column, wants_code: Column) -> Column:
    lowered = F.lower(query)
    attribute = is_attribute_list_query(query)
    return (
        F.when(wants_code & contains_any(query, V.LOCATE_PHRASES), "LOCATE_IMPLEMENTATION")
        .when(wants_code & contains_any(query, V.DESCRIBE_PHRASES), "DESCRIBE_ENTITY")
        .when(wants_code & attribute, "LIST_ENTITY_ATTRIBUTE")
        .when(wants_code & contains_any(query, V.CODE_IMPLEMENTATION_ACTION_HINTS), "LOCATE_IMPLEMENTATION")
        .when(contains_any(lowered, V.COUNT_HINTS), "COUNT_COLLECTION")
        .when(attribute, "LIST_ENTITY_ATTRIBUTE")
        .when(contains_any(lowered, V.LIST_HINTS), "LIST_COLLECTION")
        .otherwise("DESCRIBE_ENTITY")
    )


def answer_shape(operator: Column) -> Column:
    return (
        F.when(operator == "COUNT_COLLECTION", "count")
        .when(operator.isin("LIST_COLLECTION", "LIST_ENTITY_ATTRIBUTE"), "list")
        .when(operator == "COMPARE_ENTITIES", "comparison")
        .when(operator == "TRACE_FLOW", "trace")
        .when(operator == "LOCATE_IMPLEMENTATION", "implementation_location")
        .otherwise("descriptive")
    )


def member_type(query: Column) -> Column:
    lowered = F.lower(query)
    return (
        F.when(contains_any(lowered, V.APPLICATION_HINTS), "application")
        .when(contains_any(lowered, V.CAPABILITY_HINTS), "capability")
        .otherwise("member")
    )


def attribute_terms(query: Column) -> Column:
    """Attribute hints of the query, longest first, then by code point; the first one is the name."""
    ordered = sorted(V.ENTITY_ATTRIBUTE_HINTS, key=lambda h: (-len(h), h))
    return F.filter(strings(ordered), lambda h: F.lower(query).contains(F.lower(h)))


def semantic_plan(targets: DataFrame) -> DataFrame:
    """Plan columns per query and root; a provided operator wins over the inferred one."""
    inferred = infer_operator(F.col("query"), F.col("wants_code_knowledge"))
    provided = F.col("plan_operator").isNotNull()
    subject = F.when(provided, F.col("plan_subject")).when(F.size("modules") == 1, F.col("modules")[0])
    collection = F.col("operator").isin("LIST_COLLECTION", "COUNT_COLLECTION")
    attribute = F.col("operator") == "LIST_ENTITY_ATTRIBUTE"
    return (
        targets.withColumn("operator", F.coalesce("plan_operator", inferred))
        .withColumn("planner", F.when(provided, "provided").otherwise("deterministic_protocol_fallback"))
        .withColumn("answer_shape", answer_shape(F.col("operator")))
        .withColumn("subject", subject)
        .withColumn(
            "scope",
            F.when(provided, F.coalesce(F.nullif("plan_scope", F.lit("")), "plan_subject", F.lit("")))
            .when(collection, F.coalesce("subject", F.lit("")))
            .otherwise(F.coalesce("subject", F.lit(""))),
        )
        .withColumn("member_type", F.when(collection & ~provided, member_type(F.col("query"))))
        .withColumn(
            "attribute_terms",
            F.when(attribute & ~provided, attribute_terms(F.col("query"))).otherwise(strings([])),
        )
        .withColumn("is_collection", collection)
        .withColumn("is_attribute", attribute)
        .withColumn(
            "required_evidence",
            F.when(provided, strings([]))
            .when(collection, strings(["collection_owner_page", "complete_member_list_or_coverage_proof"]))
            .when(attribute, strings(["entity_owner_page", "attribute_values_or_topic_coverage"]))
            .otherwise(strings([])),
        )
        .withColumn(
            "sufficiency_rules",
            F.when(provided, strings([]))
            .when(collection, strings(["must_have_collection_boundary", "must_have_member_set",
                                       "must_not_answer_count_from_single_member_page"]))
            .when(attribute, strings(["must_have_entity_owner_page", "must_cover_attribute_topic",
                                      "must_have_attribute_values"]))
            .otherwise(strings([])),
        )
    )


def answer_profiles(df: DataFrame, query: str = "query", code_scope: str = "code_scope",
                    navigation: str = "wants_code_navigation", collection: str = "is_collection") -> DataFrame:
    """Which answer profiles a query activates and which answer blocks they require (one row per query)."""
    lowered = F.lower(query)
    scope = F.col(code_scope)
    coding_hint = contains_any(lowered, V.CODING_PROFILE_HINTS)
    coding = ~F.col(navigation) & (coding_hint | (scope & contains_any(lowered, V.CODING_PROFILE_CODE_SCOPE_HINTS)))
    design = ~F.col(navigation) & (
        contains_any(lowered, V.DESIGN_PROFILE_HINTS)
        | (scope & contains_any(lowered, V.DESIGN_PROFILE_CODE_SCOPE_HINTS))
        | (coding_hint & lowered.contains("设计"))
    )
    none = strings([])
    sections = {p: strings(s) for p, s in V.PROFILE_SECTIONS.items()}
    blocks = F.array_distinct(
        F.concat(
            strings(V.BASE_ANSWER_SECTIONS),
            F.when(coding, sections["agentic_coding"]).otherwise(none),
            F.when(design, sections["prd_design_from_code"]).otherwise(none),
            F.when(scope, strings([V.EXPLORATION_PLAN_BLOCK])).otherwise(none),
            F.when(scope & (coding | design), strings([V.VERIFICATION_RESULT_BLOCK])).otherwise(none),
        )
    )
    sources = (
        F.when(scope & (coding | design), "evidence_pages_coverage_proof_and_executed_code_exploration")
        .when(F.col(collection), "evidence_pages_and_coverage_proof")
        .otherwise("evidence_pages")
    )
    return (
        df.withColumn("profile_coding", coding)
        .withColumn("profile_design", design)
        .withColumn("must_use_only", sources)
        .withColumn("answer_blocks", blocks)
    )


def page_path_query(path: Column) -> Column:
    """Search text made from a page path."""
    cut = F.regexp_replace(drop_suffix(F.replace(path, F.lit("\\"), F.lit("/")), ".md"), "^wiki/entities/code/features/", "")
    cut = F.regexp_replace(cut, "^wiki/entities/code/modules/", "")
    return strip(F.regexp_replace(cut, "[-_/]+", " "))


def expanded_terms(terms: Column) -> Column:
    """Each term followed by its search aliases; ordered distinct."""
    table = F.create_map(*[x for k, v in V.CODE_SEARCH_ALIASES.items() for x in (F.lit(k), strings(v))])
    return F.array_distinct(
        F.flatten(F.transform(terms, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), strings([])))))
    )
