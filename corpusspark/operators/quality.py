"""Evidence quality: bundles, gaps, sufficiency, topic coverage, confidence and review decisions.

A gap row has one fixed schema (GAP_COLUMNS); ``root_id`` is null for gaps of the query as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.sizing import at_most
from ..functions.terms import is_strong_topic_term
from ..functions.text import any_of, canonical_path, contains_any, let, strings
from . import extract
from .query_features import answer_profiles

GROUP = ["query_id", "root_id"]
CODE_FEATURES = "wiki/entities/code/features/"
GAP_COLUMNS = {
    "query_id": "string", "root_id": "string", "stage": "int", "gap_no": "int", "code": "string", "severity": "string",
    "operator": "string", "profile": "string", "section": "string", "path": "string", "target": "string",
    "modules": "array<string>", "topic_terms": "array<string>", "reason": "string",
}


def gap_rows(df: DataFrame, **values) -> DataFrame:
    """Rows with the gap schema; columns that are not given are null."""
    return df.select(*[
        (values[name] if isinstance(values.get(name), Column) else F.lit(values.get(name)) if values.get(name) is not None else F.lit(None))
        .cast(kind).alias(name)
        for name, kind in GAP_COLUMNS.items()
    ])


def union(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# ---- source existence ---------------------------------------------------------------------------------
def source_statuses(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(root_id, repo_path, source, exists) for every front-matter source of every page."""
    normalized = extract.normalized_source(F.col("item"))
    located = F.when(normalized.startswith("wiki/"), normalized).when(
        normalized.startswith("sources/"), F.concat(F.lit("wiki/"), normalized)
    )
    listed = pages.select("root_id", "repo_path", F.explode(F.array_distinct("sources")).alias("item")).select(
        "root_id", "repo_path", normalized.alias("source"), canonical_path(located).alias("located")
    )
    present = files.select("root_id", F.col("path").alias("located"), F.lit(True).alias("found")).distinct()
    joined = listed.join(present, ["root_id", "located"], "left")
    return joined.select("root_id", "repo_path", "source", F.coalesce("found", F.lit(False)).alias("exists"))


def page_traces(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(root_id, repo_path, has_trace, trace_exists): does a page name a code-run summary, and does one exist."""
    s = source_statuses(pages, files).where(extract.is_run_trace(F.col("source")))
    return s.groupBy("root_id", "repo_path").agg(
        F.lit(True).alias("has_trace"), F.max("exists").alias("trace_exists")
    )


# ---- bundles ----------------------------------------------------------------------------------------------
def evidence_texts(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages that some query has as evidence."""
    wanted = evidence.select("root_id", F.col("path").alias("repo_path")).distinct()
    return pages.join(wanted, ["root_id", "repo_path"], "left_semi").select(
        "root_id", F.col("repo_path").alias("path"), F.col("text").alias("content"), "sources",
        F.col("title").alias("page_title"), "page_type",
    )


def with_texts(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    return evidence.join(texts, ["root_id", "path"], "left")


def evidence_pages(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """Evidence with page contents; ``content`` is null when the planned page is missing."""
    return with_texts(evidence, evidence_texts(evidence, pages))


def citations(bundle: DataFrame) -> DataFrame:
    found = bundle.where("content is not null")
    return found.select("query_id", "root_id", "evidence_pos", F.concat_ws(":", "root_id", "path").alias("citation"))


def bundle_gaps(bundle: DataFrame, expansion: DataFrame, targets: DataFrame) -> DataFrame:
    missing = bundle.where(F.col("content").isNull())
    outside = ~F.col("path").startswith("wiki/")
    root = {"query_id": F.col("query_id"), "root_id": F.col("root_id"), "stage": 0}
    with_pages = bundle.where("content is not null").select(*GROUP).distinct()
    return union([
        gap_rows(missing, **root, gap_no=F.col("evidence_pos"), path=F.col("path"),
                 code=F.when(outside, "forbidden_non_wiki_path").otherwise("planned_page_missing")),
        gap_rows(expansion.where("dst is null"), **root, gap_no=F.col("link_no") + 1000, code="broken_wikilink",
                 path=F.col("src"), target=F.col("target")),
        gap_rows(targets.select(*GROUP).join(with_pages, GROUP, "left_anti"), **root, gap_no=2000,
                 code="no_evidence_pages", path="wiki/index.md"),
    ])


# ---- sufficiency --------------------------------------------------------------------------------------------
def sufficiency_gaps(targets: DataFrame, bundle: DataFrame, coverage: DataFrame) -> DataFrame:
    found = bundle.where("content is not null")
    shape = found.groupBy(*GROUP).agg(
        F.count("*").alias("n_pages"), F.max("page_role").alias("only_role"), F.max("path").alias("only_path")
    )
    c = coverage.join(shape, GROUP, "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
    owners, members = F.size("owner_pages") > 0, F.size("member_paths") > 0
    single = (F.col("operator") == "COUNT_COLLECTION") & (F.col("n_pages") == 1) & (F.col("only_role") == "feature")

    def mark(number: int, condition: Column, code: str, path: Column | None = None) -> Column:
        return F.when(condition, F.struct(F.lit(number).alias("gap_no"), F.lit(code).alias("code"),
                                          (path if path is not None else F.lit(None).cast("string")).alias("path")))

    collection = c.select(
        *GROUP, "operator",
        F.inline(F.array_compact(F.array(
            mark(3000, F.col("subject").isNull(), "subject_unresolved"),
            mark(3001, ~owners, "collection_owner_missing"),
            mark(3002, ~members, "collection_members_missing"),
            mark(3003, single, "single_member_page_insufficient_for_count", F.col("only_path")),
            mark(3004, members & ~F.col("complete"), "collection_coverage_incomplete"),
        ))),
    )
    owner_page = (F.col("evidence_role") == "primary") & F.col("page_role").isin("feature", "concept", "query", "unknown")
    terms = targets.where("is_attribute").select(*GROUP, "operator", "attribute_terms")
    owned = found.where(owner_page).join(terms.drop("operator"), GROUP).groupBy(*GROUP).agg(
        F.max(
            (F.size("attribute_terms") == 0) | let(F.lower("content"), lambda whole: F.exists("attribute_terms", lambda t: whole.contains(F.lower(t))))
        ).alias("on_topic"),
        F.max(extract.attribute_values_present(F.col("content"))).alias("has_values"),
    )
    a = terms.join(owned, GROUP, "left")
    attribute = a.select(
        *GROUP, "operator",
        F.inline(F.array_compact(F.array(
            mark(3000, F.col("on_topic").isNull(), "entity_owner_missing"),
            mark(3001, ~F.col("on_topic"), "attribute_topic_missing"),
            mark(3002, ~F.col("has_values"), "attribute_values_missing"),
        ))),
    )
    both = collection.unionByName(attribute)
    return gap_rows(both, query_id=F.col("query_id"), root_id=F.col("root_id"), stage=0, gap_no=F.col("gap_no"),
                    code=F.col("code"), severity="major", operator=F.col("operator"), path=F.col("path"))


# ---- query-level context ---------------------------------------------------------------------------------------
def query_context(targets: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per query: code scope, navigation, profiles and answer blocks."""
    code_plan = F.col("is_code_root") & F.col("wants_code_knowledge")
    grouped = targets.join(roots.select("root_id"), "root_id").groupBy("query_id").agg(
        F.first("query").alias("query"), F.first("topic_terms").alias("topic_terms"),
        F.max(code_plan).alias("code_scope"), F.max("wants_code_navigation").alias("wants_code_navigation"),
        F.max("is_collection").alias("is_collection"), F.max("wants_code_knowledge").alias("any_code_query"),
    )
    return answer_profiles(grouped).withColumn(
        "profiles",
        F.array_compact(F.array(F.when(F.col("profile_coding"), F.lit("agentic_coding")),
                                F.when(F.col("profile_design"), F.lit("prd_design_from_code")))),
    )


def topic_coverage(context: DataFrame, bundle: DataFrame) -> DataFrame:
    """(query_id, n_pages, n_feature_pages, n_terms, n_matched, covered): are the query's terms in its
    code feature pages?  With strong terms one of them must match; then all of up to two terms, or a third."""
    found = bundle.where("content is not null").withColumn("is_feature", F.col("path").startswith(CODE_FEATURES))
    counts = found.groupBy("query_id").agg(
        F.count("*").alias("n_pages"), F.sum(F.col("is_feature").cast("int")).alias("n_feature_pages")
    )
    matched = (
        found.where("is_feature").join(context.select("query_id", "topic_terms"), "query_id")
        .select("query_id", F.explode(let(F.lower("content"), lambda whole: F.filter("topic_terms", lambda t: whole.contains(F.lower(t))))).alias("term"))
        .distinct().groupBy("query_id").agg(
            F.count("*").alias("n_matched"), F.max(is_strong_topic_term(F.col("term"))).alias("strong_matched"))
    )
    n = F.size("topic_terms")
    has_strong = F.exists("topic_terms", lambda t: is_strong_topic_term(t))
    needed = F.when(n <= 2, n).otherwise(F.greatest(F.lit(2), F.floor((n + 2) / 3).cast("int")))
    joined = context.join(counts, "query_id", "left").join(matched, "query_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_pages", "n_feature_pages", "n_matched")}
    return joined.select(
        "query_id", *[v.alias(k) for k, v in zero.items()], n.alias("n_terms"),
        ((n == 0) | ((~has_strong | F.coalesce("strong_matched", F.lit(False))) & (zero["n_matched"] >= needed))).alias("covered"),
    )


def section_verdicts(pages: DataFrame) -> DataFrame:
    """(root_id, path, profile, section) of required sections a code feature page does not fill.

    The first heading that matches one of the section's markers decides.
    """
    parsed = pages.withColumn("_sections", extract.sections(F.col("content")))

    def filled(section: str, markers: list[str]) -> Column:
        def matches(s: Column) -> Column:
            heading = F.lower(strip_heading(s["heading"]))
            return any_of(heading.contains(m.lower()) | F.lit(m.lower()).contains(heading) for m in markers)

        body = extract.normalized_section(F.try_element_at(F.filter("_sections", matches), F.lit(1))["body"])
        if section == V.CODE_LOCATION_SECTION:
            return extract.profile_code_locator(body)
        return let(body, lambda b: (F.char_length(b) >= 12) & ~extract.profile_placeholder(b))

    marks = [
        F.struct(F.lit(profile).alias("profile"), F.lit(section).alias("section"), F.coalesce(filled(section, markers), F.lit(False)).alias("ok"))
        for profile, sections in V.PROFILE_SECTIONS.items() for section, markers in sections.items()
    ]
    return parsed.select("root_id", "path", F.inline(F.array(*marks))).where("not ok").drop("ok")


def strip_heading(heading: Column) -> Column:
    return F.trim(heading)


def profile_gaps(context: DataFrame, bundle: DataFrame, coverage: DataFrame, traces: DataFrame) -> DataFrame:
    """Gaps of the answer profiles of a query, over the evidence of all its roots."""
    c = context.where(F.size("profiles") > 0).join(coverage.drop("n_terms"), "query_id")
    c = c.withColumn("profile", F.explode("profiles"))
    base = {"query_id": F.col("query_id"), "stage": 2, "severity": "major", "profile": F.col("profile")}
    empty = c.where("n_pages = 0")
    no_subject = c.where((F.col("n_pages") > 0) & (F.size("topic_terms") == 0))
    rest = c.where((F.col("n_pages") > 0) & (F.size("topic_terms") > 0))
    found = bundle.where("content is not null")
    features = found.where(F.col("path").startswith(CODE_FEATURES)).select("query_id", "root_id", "path", "content")
    traced = features.drop("content").join(
        traces.select("root_id", F.col("repo_path").alias("path"), "has_trace", "trace_exists"), ["root_id", "path"], "left"
    )
    per_page = rest.select("query_id", "profile").join(traced, "query_id")
    unfilled = section_verdicts(features.select("root_id", "path", "content").dropDuplicates(["root_id", "path"]))
    page_sections = rest.select("query_id", "profile").join(features.select("query_id", "root_id", "path"), "query_id").join(
        unfilled, ["root_id", "path", "profile"]
    )
    # Without a feature page the markers may stand anywhere in the evidence.
    markers = [(p, s, m) for p, secs in V.PROFILE_SECTIONS.items() for s, m in secs.items()]
    named = found.join(rest.where("n_feature_pages = 0").select("query_id").distinct(), "query_id", "left_semi").groupBy("query_id").agg(
        F.array(*[
            F.struct(F.lit(p).alias("profile"), F.lit(s).alias("section"), F.max(contains_any(F.col("content"), m)).alias("ok"))
            for p, s, m in markers
        ]).alias("marks")
    )
    unnamed = rest.where("n_feature_pages = 0").select("query_id", "profile").join(
        named.select("query_id", F.inline("marks")).where("not ok"), ["query_id", "profile"]
    )
    return union([
        gap_rows(empty, **base, gap_no=0, code="profile_no_evidence_pages"),
        gap_rows(no_subject, **base, gap_no=1, code="profile_query_subject_missing",
                 reason="code_or_prd_query_has_no_specific_business_topic"),
        gap_rows(rest.where("n_feature_pages = 0"), **base, gap_no=2, code="profile_code_feature_evidence_missing"),
        gap_rows(rest.where("n_feature_pages > 0 and not covered"), **base, gap_no=3, code="profile_query_topic_not_covered",
                 topic_terms=F.col("topic_terms"),
                 reason="selected_code_feature_page_does_not_cover_query_specific_topic"),
        gap_rows(per_page.where("not coalesce(has_trace, false)"), **base, gap_no=4, path=F.col("path"),
                 code="profile_code_feature_source_trace_missing"),
        gap_rows(per_page.where("has_trace and not trace_exists"), **base, gap_no=5, path=F.col("path"),
                 code="profile_code_feature_source_summary_missing"),
        gap_rows(page_sections, **base, gap_no=6, path=F.col("path"), section=F.col("section"),
                 code="profile_required_section_missing", reason="code_feature_page_section_missing_or_not_actionable"),
        gap_rows(unnamed, **base, gap_no=7, section=F.col("section"), code="profile_required_section_missing"),
    ])


def code_gaps(targets: DataFrame, context: DataFrame, bundle: DataFrame, coverage: DataFrame) -> DataFrame:
    """Gaps of code queries: topic or module not covered by the chosen code feature pages.

    ``root_id`` of a module gap names the code root that asked for the module.
    """
    plans = targets.where("is_code_root and wants_code_knowledge").select(*GROUP, "modules", "wants_code_navigation")
    navigating = plans.where("wants_code_navigation").select("query_id").distinct()
    plans = plans.join(navigating, "query_id", "left_anti")
    queries = plans.select("query_id").distinct()
    topic = context.select("query_id", "topic_terms").join(queries, "query_id").join(coverage, "query_id").where(
        "n_feature_pages > 0 and n_terms > 0 and not covered"
    )
    chosen = bundle.where("content is not null").where(F.col("path").startswith(CODE_FEATURES)).select(
        "query_id", F.col("module").alias("asked")
    ).distinct()
    asked = plans.select(*GROUP, "modules", F.explode("modules").alias("asked"))
    covered = asked.join(chosen, ["query_id", "asked"], "left_semi").select(*GROUP).distinct()
    module = plans.where(F.size("modules") > 0).join(covered, GROUP, "left_anti")
    base = {"query_id": F.col("query_id"), "stage": 1, "severity": "major"}
    return union([
        gap_rows(topic, **base, gap_no=0, code="query_topic_not_covered", topic_terms=F.col("topic_terms"),
                 reason="selected_code_feature_pages_do_not_cover_query_topic"),
        gap_rows(module, **base, gap_no=1, root_id=F.col("root_id"), code="query_module_not_covered", modules=F.col("modules"),
                 reason="query_requested_module_but_selected_code_feature_pages_do_not_match_module"),
    ])


def merged_gaps(frames: list[DataFrame]) -> DataFrame:
    """All gaps of the queries, each once; a missing profile subject replaces the unresolved plan subject."""
    gaps = union(frames).dropDuplicates(list(GAP_COLUMNS))
    subject = gaps.where("code = 'profile_query_subject_missing'").select("query_id").distinct()
    unresolved = gaps.where("code = 'subject_unresolved'").join(subject, "query_id", "left_anti")
    return gaps.where("code <> 'subject_unresolved'").unionByName(unresolved.select(*gaps.columns))


LOWERING = V.PROFILE_GAP_CODES + V.SEMANTIC_GAP_CODES


def confidence(targets: DataFrame, bundle: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """low / high / medium per query (``keys = [query_id]``) or per query and root."""
    pages = bundle.where("content is not null").groupBy(*keys).agg(
        F.count("*").alias("n_evidence"), F.max(F.col("evidence_role") == "primary").alias("has_primary")
    )
    flags = gaps.groupBy(*keys).agg(F.count("*").alias("n_gaps"), F.max(F.col("code").isin(LOWERING)).alias("lowering"))
    joined = targets.select(*keys).distinct().join(pages, keys, "left").join(flags, keys, "left")
    return joined.select(
        *keys, F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"),
        F.when(F.col("n_evidence").isNull() | F.coalesce("lowering", F.lit(False)), "low")
        .when(F.col("has_primary") & F.col("n_gaps").isNull(), "high").otherwise("medium").alias("confidence"),
    )


def root_gaps(gaps_of_roots: DataFrame, gaps_of_code: DataFrame, targets: DataFrame) -> DataFrame:
    """Gaps per query and root: the root's own and, for code roots, the query's code gaps."""
    plans = targets.where("is_code_root and wants_code_knowledge").select(*GROUP)
    shared = gaps_of_code.drop("root_id").join(plans, "query_id").select(*GAP_COLUMNS)
    return gaps_of_roots.unionByName(shared).dropDuplicates(list(GAP_COLUMNS))


# ---- review -----------------------------------------------------------------------------------------------------
def review(context: DataFrame, gaps: DataFrame, quality: DataFrame, targets: DataFrame) -> DataFrame:
    """Reason codes in the order they arise, whether review must come first, and the status of the query."""
    order = targets.select(*GROUP, "priority")
    ranked = gaps.where(F.col("code").isin(V.REVIEW_GAP_CODES)).join(order, GROUP, "left")
    firsts = ranked.groupBy("query_id", "code").agg(
        F.min(F.struct("stage", F.when(F.col("stage") == 0, -F.coalesce("priority", F.lit(0))).otherwise(0).alias("p"), "gap_no")).alias("o")
    )
    codes = firsts.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "code"))), lambda x: x["code"]).alias("codes"),
        F.max(F.col("code").isin(V.SEMANTIC_GAP_CODES)).alias("semantic"),
    )
    c = context.join(quality, "query_id").join(codes, "query_id", "left")
    none = strings([])
    reasons = F.array_distinct(F.concat(
        F.when(F.col("confidence") == "low", strings(["low_confidence"])).otherwise(none),
        F.when(F.col("n_evidence") == 0, strings(["no_evidence_pages"])).otherwise(none),
        F.coalesce("codes", none),
        F.when(F.col("any_code_query"), strings(["code_knowledge_query"])).otherwise(none),
    ))
    profiled = F.size("profiles") > 0
    required = (F.size("reason_codes") > 0) & (F.col("confidence") == "low") & (profiled | F.coalesce("semantic", F.lit(False)))
    status = (
        F.when(F.col("code_scope") & profiled, "requires_code_exploration")
        .when(F.col("required_before_final"), "requires_semantic_review").otherwise("ready_for_answer")
    )
    return (
        c.withColumn("reason_codes", reasons).withColumn("required_before_final", required).withColumn("status", status)
        .select("query_id", "confidence", "n_evidence", "n_gaps", "profiles", "must_use_only", "answer_blocks", "reason_codes",
                "required_before_final", "status")
    )


def review_scope(candidates: DataFrame, targets: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows per query in review order: roots by priority, then by position; ``limit`` keeps the first."""
    order = W.partitionBy("query_id").orderBy(F.desc("priority"), "root_id", "pos")
    ranked = candidates.join(targets.select(*GROUP, "priority"), GROUP).withColumn("review_pos", F.row_number().over(order))
    return at_most(ranked, "review_pos", limit).drop("priority")
