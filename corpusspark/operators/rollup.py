"""Batches of verified findings -> completion, rollup rows, target pages, section values, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.numbering import numbered
from ..functions.sizing import lookup_join
from ..functions.text import slashes, strings, strip
from .quality import union

SECTION_FIELDS = {
    "现有实现": "current_state", "代码定位": "evidence_refs", "实现链": "coverage_claims", "复用边界": "reuse_points",
    "改动点": "change_points", "暂不应改动": "do_not_change_without_extra_exploration", "数据/权限/运行约束": "data_contracts",
    "测试/验证路径": "verification_entrypoints", "PRD 设计影响": "design_implications", "缺口与继续探索": "non_blocking_gaps",
}


def batch_completion(planned: DataFrame, verified: DataFrame) -> DataFrame:
    """(batch, state): planned batches without verified findings, and verified ones nobody planned.

    ``planned``: batch; ``verified``: batch, n_findings (0 = an empty result exists).
    """
    p = planned.select("batch", F.lit(True).alias("planned")).distinct()
    v = verified.groupBy("batch").agg(F.sum("n_findings").alias("n_findings"))
    state = (
        F.when(F.col("planned").isNull(), "orphan_verified").when(F.col("n_findings").isNull(), "verified_findings_missing")
        .when(F.col("n_findings") == 0, "verified_findings_empty").otherwise("complete")
    )
    return p.join(v, "batch", "full_outer").select("batch", state.alias("state"))


def normalized_target(path: Column, level: Column) -> Column:
    p = strip(slashes(path))
    prefix = "wiki/entities/code/"
    rest = F.ltrim(F.substring(p, F.lit(len(prefix) + 1), F.char_length(p)), F.lit("/"))
    bucket = F.when(level == "code_map", "modules/").otherwise("features/")
    return F.when(~p.startswith(prefix), F.lit("")).when(p.rlike("^wiki/entities/code/(features|modules)/"), p).otherwise(
        F.concat(F.lit(prefix), bucket, rest)
    )


def fallback_target(batch: Column, level: Column) -> Column:
    slug = F.lower(F.trim(F.regexp_replace(F.regexp_replace(batch, r"^B\d+-", ""), "[^A-Za-z0-9_-]+", "-"), F.lit("-")))
    slug = F.when(slug == "", "code-knowledge").otherwise(slug)
    bucket = F.when(level == "code_map", "modules/").otherwise("features/")
    return F.concat(F.lit("wiki/entities/code/"), bucket, slug, F.lit(".md"))


def _levels(findings: DataFrame) -> DataFrame:
    """Preferred level per batch: code map only when every finding is one."""
    return findings.groupBy("batch").agg(
        F.when(F.min(F.col("knowledge_level") == "code_map"), "code_map").otherwise("feature_implementation").alias("preferred")
    )


def target_pages(findings: DataFrame) -> DataFrame:
    """(batch, kind, page_no, page): candidate pages and primary pages in finding order, each page once.

    ``findings``: batch, pos, knowledge_level, knowledge_object_candidates.
    """
    f = findings.select("batch", "pos", F.coalesce("knowledge_level", F.lit("")).alias("level"),
                        F.coalesce("knowledge_object_candidates", strings([])).alias("raw"))
    pages = F.filter(F.transform("raw", lambda r: normalized_target(r, F.col("level"))), lambda p: p != "")
    f = f.withColumn("pages", pages)
    listed = f.select("batch", "pos", F.posexplode("pages").alias("i", "page"))
    lone = _levels(findings).join(listed.select("batch").distinct(), "batch", "left_anti").select(
        "batch", F.lit(0).cast("long").alias("pos"), F.lit(0).alias("i"), fallback_target(F.col("batch"), F.col("preferred")).alias("page")
    )
    candidates = listed.withColumn("pos", F.col("pos").cast("long")).unionByName(lone).withColumn("kind", F.lit("candidate"))
    primary = f.select(
        "batch", F.col("pos").cast("long").alias("pos"), F.lit(0).alias("i"),
        F.when(F.size("pages") > 0, F.try_element_at("pages", F.lit(1))).otherwise(fallback_target(F.col("batch"), F.col("level"))).alias("page"),
        F.lit("primary").alias("kind"),
    )
    firsts = candidates.unionByName(primary).groupBy("batch", "kind", "page").agg(F.min(F.struct("pos", "i")).alias("o"))
    return numbered(firsts, ["batch", "kind"], "o", "page_no").select("batch", "kind", F.col("page_no").cast("int").alias("page_no"), "page")


def batch_rollup(findings: DataFrame) -> DataFrame:
    """One row per batch: topic of its first finding, number of findings, levels.  Aggregates only."""
    return findings.groupBy("batch").agg(
        F.min_by(F.coalesce("title", F.col("batch")), "pos").alias("topic"), F.count("*").alias("findings"),
        F.array_sort(F.collect_set(F.when(F.col("knowledge_level") != "", F.col("knowledge_level")))).alias("knowledge_levels"),
    )


def acceptance_issues(findings: DataFrame) -> DataFrame:
    """Findings that may not be published."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    rules = F.array_compact(F.array(
        F.when(n("blocking_gaps") > 0, F.lit("blueprint_includes_blocking_gap_finding")),
        F.when(n("evidence_refs") <= 0, F.lit("verified_finding_evidence_refs_missing")),
        F.when(n("coverage_claims") <= 0, F.lit("verified_finding_coverage_claims_missing")),
        F.when((F.col("knowledge_level") == "coding_playbook") & F.col("coding_context").isNull(), F.lit("coding_playbook_context_missing")),
    ))
    return findings.select("batch", "finding_id", F.explode(rules).alias("code"))


def target_descriptor_issues(rollup: DataFrame, targets: DataFrame, artifacts: DataFrame, blueprints: DataFrame) -> DataFrame:
    """Descriptors of batch targets: empty fields, paths, page lists, missing artifacts.

    ``rollup``: batch and the text columns TARGET_FIELDS; ``artifacts``: path; ``blueprints``: batch, path.
    """
    missing = [F.when(strip(F.coalesce(c, F.lit(""))) == "", F.lit(c)) for c in V.TARGET_FIELDS]
    fields = rollup.select("batch", F.explode(F.array_compact(F.array(*missing))).alias("item")).withColumn("code", F.lit("shard_field_missing"))
    bad_path = rollup.where(~F.coalesce(F.col("source_summary_path").rlike("^wiki/sources/code/[^/]+-runs/"), F.lit(False))).select(
        "batch", F.col("source_summary_path").alias("item"), F.lit("source_summary_path_invalid").alias("code")
    )
    named = rollup.select("batch", F.explode(F.array("path", "verified_findings", "analysis", "evidence")).alias("item")).where("item <> ''")
    gone = named.join(artifacts.select(F.col("path").alias("item")).distinct(), "item", "left_anti").withColumn("code", F.lit("shard_artifact_missing"))
    pages = targets.where("kind = 'candidate'")
    no_pages = rollup.select("batch").join(pages.select("batch"), "batch", "left_anti").select("batch", F.lit(None).cast("string").alias("item"), F.lit("candidate_pages_missing").alias("code"))
    bad_pages = pages.where(~(F.col("page").startswith("wiki/entities/code/") & F.col("page").endswith(".md"))).select(
        "batch", F.col("page").alias("item"), F.lit("candidate_page_invalid").alias("code")
    )
    counts = rollup.select("batch").join(blueprints.groupBy("batch").agg(F.count("*").alias("n_blueprints")), "batch", "left").join(
        targets.where("kind = 'primary'").groupBy("batch").agg(F.count("*").alias("n_primary")), "batch", "left"
    ).na.fill(0, ["n_blueprints", "n_primary"])
    code = F.when(F.col("n_blueprints") == 0, "page_blueprints_missing").when(F.col("n_primary") == 0, "primary_pages_missing").when(
        F.col("n_blueprints") != F.col("n_primary"), "page_blueprints_not_limited_to_primary_pages"
    )
    sized = counts.withColumn("code", code).where("code is not null").select(
        "batch", F.concat_ws("/", F.col("n_blueprints").cast("string"), F.col("n_primary").cast("string")).alias("item"), "code"
    )
    return union([df.select("batch", "code", "item") for df in (fields, bad_path, gone, no_pages, bad_pages, sized)])


def normalized_body(text: Column) -> Column:
    """Text without the lines that only name the page, every line trimmed."""
    lines = F.filter(
        F.split(text, "\r\n|\r|\n"), lambda v: ~v.rlike("^# .*正式页落页蓝图：") & ~v.startswith("- candidate_wiki_page:")
    )
    return strip(F.array_join(F.transform(lines, strip), "\n"))


def duplicate_bodies(documents: DataFrame, group: list[str]) -> DataFrame:
    """(group, path, duplicate_of): documents whose normalised body another one of the group has first.

    Only hashes are shuffled, and the first path of a body is an aggregate with a partial step, so a body
    that a third of all documents share stays cheap; the copies of a hot body are spread when joined.
    """
    hashed = documents.select(*group, "path", F.sha2(normalized_body(F.col("text")), 256).alias("h"))
    firsts = hashed.groupBy(*group, "h").agg(F.min("path").alias("duplicate_of"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = lookup_join(hashed, firsts, [*group, "h"], spread=["path"])
    return copies.where("path <> duplicate_of").select(*group, "path", "duplicate_of")


def section_values(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """(batch, page, section, finding_pos, value_no, value): what belongs into each section of a target page.

    Sections without a value keep one row with a null value, where a fallback text goes.
    """

    def item(section: str, values: Column) -> Column:
        return F.transform(values, lambda v, i: F.struct(F.lit(section).alias("section"), i.alias("value_no"), v.alias("value")))

    def with_refs(value: Column, refs: Column) -> Column:
        return F.when(F.coalesce(F.size(refs), F.lit(0)) > 0, F.concat(value, F.lit(" | "), F.array_join(refs, ", "))).otherwise(value)

    def context(field: str) -> Column:
        entries = F.try_element_at("coding_context", F.lit(field))
        values = F.transform(entries, lambda e: with_refs(strip(F.coalesce(e["summary"], F.lit(""))), e["evidence_refs"]))
        return F.coalesce(F.filter(values, lambda v: ~F.startswith(v, F.lit(" | ")) & (v != "")), strings([]))

    def plain(column: str) -> Column:
        return F.filter(F.transform(F.coalesce(F.col(column), strings([])), strip), lambda v: v != "")

    claims = F.transform(
        "coverage_claims", lambda c: with_refs(F.concat_ws(" = ", c["item"], c["status"]), c["evidence_refs"])
    )
    values = []
    for section, field in SECTION_FIELDS.items():
        if field == "current_state":
            values.append(item(section, F.filter(F.array(strip(F.coalesce(field, F.lit("")))), lambda v: v != "")))
        elif field == "coverage_claims":
            values.append(item(section, F.coalesce(claims, strings([]))))
        elif field in V.CODING_CONTEXT_FIELDS:
            values.append(item(section, context(field)))
        elif field == "non_blocking_gaps":
            values.append(item(section, F.concat(plain("non_blocking_gaps"), plain("exploration_hints"))))
        else:
            values.append(item(section, plain(field)))
    filled = findings.select("batch", "finding_id", F.col("pos").alias("finding_pos"), F.inline(F.concat(*values)))
    pages = targets.where("kind = 'primary'").select("batch", "page")
    wanted = pages.withColumn("section", F.explode(strings(list(SECTION_FIELDS))))
    return wanted.join(filled, ["batch", "section"], "left").select("batch", "page", "section", "finding_id", "finding_pos", "value_no", "value")
