"""Verification of plans and findings: every rule is a set of issue rows over exploded columns.

Issues: batch_id, finding_id, code, item (what the code is about), idx.  ``line`` is the raw JSON of a
finding; it tells absent keys from empty values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.numbering import running
from ..functions.text import has_cjk, slashes, strings, strip
from ..session import new_folder
from .extract import file_reference
from .quality import union

LEVELS_WITH_TARGETS = ["feature_implementation", "coding_playbook"]


def issues(df: DataFrame, code, item=None, idx=None) -> DataFrame:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        "batch_id", "finding_id", as_column(code).alias("code"), as_column(item).cast("string").alias("item"),
        as_column(idx).cast("int").alias("idx"),
    )


def flatten_findings(parsed: DataFrame) -> DataFrame:
    """(batch_id, line, f STRUCT) -> typed finding columns with the raw keys."""
    return parsed.select(
        F.coalesce("f.batch_id", F.lit("")).alias("batch_id"), F.coalesce("f.finding_id", F.lit("")).alias("finding_id"),
        "line", F.coalesce(F.json_object_keys("line"), strings([])).alias("keys"),
        *[F.col(f"f.{c}").alias(c) for c in (
            "kind", "title", "current_state", "confidence", "evidence_refs", "coverage_claims", "blocking_gaps",
            "non_blocking_gaps", "exploration_hints", "design_implications", "knowledge_object_candidates", "coding_context")],
        F.coalesce("f.knowledge_level", F.lit("")).alias("knowledge_level"),
        F.get_json_object("line", "$.confidence").alias("raw_confidence"),
    )


def valid_refs(refs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct (batch_id, ref) that name an evidence id or lie inside a known range of their batch.

    Ids match by equality.  File references are an as-of join: along a file, ranges stand at their first line and
    references at theirs; (s, e) lies inside a range exactly when the largest last line of the ranges that begin at s or
    before reaches e.  That is one pass over each (batch, path), and a file with many ranges spans many tasks.
    """
    distinct = refs.select("batch_id", "ref").distinct()
    by_id = distinct.join(ranges.select("batch_id", F.col("evidence_id").alias("ref")).distinct(), ["batch_id", "ref"], "left_semi")
    parsed = distinct.withColumn("p", file_reference(F.col("ref"))).where("p is not null").select(
        "batch_id", F.col("p.path").alias("path"), F.col("p.first").cast("long").alias("at"), F.lit(1).alias("kind"),
        F.lit(None).cast("long").alias("reach"), "ref", F.col("p.last").cast("long").alias("e"))
    known = ranges.where("first >= 1 and last >= first").select(
        "batch_id", slashes(F.col("path")).alias("path"), F.col("first").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("last").cast("long").alias("reach"))
    along = parsed.unionByName(known, allowMissingColumns=True)
    covered = running(along, ["batch_id", "path"], ["at", "kind"], "reach", "covered", F.max)
    inside = covered.where("kind = 1 and e <= covered")
    return by_id.unionByName(inside.select("batch_id", "ref")).distinct()


def requirements() -> Column:
    """Contract items of ``knowledge_level``."""
    value = strings([])
    for level, items in V.CONTRACT_ITEMS.items():
        value = F.when(F.col("knowledge_level") == level, strings(items)).otherwise(value)
    return value


def field_issues(findings: DataFrame) -> DataFrame:
    """Required fields, level, confidence, list types and the legacy field: one pass over the rows."""

    def mark(condition: Column, code: str, item=None) -> Column:
        return F.when(condition, F.struct(F.lit(code).alias("code"), (item if isinstance(item, Column) else F.lit(item)).cast("string").alias("item")))

    has = lambda k: F.array_contains("keys", k)
    raw = lambda k: F.get_json_object("line", f"$.{k}")
    given = F.try_variant_get(F.try_parse_json("line"), "$.confidence", "variant")
    number = F.when(F.schema_of_variant(given).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(given, "$", "double"))
    marks = [mark(~has(k), "finding_field_missing", k) for k in V.FINDING_FIELDS]
    marks += [
        mark((F.col("knowledge_level") != "") & ~F.col("knowledge_level").isin(V.KNOWLEDGE_LEVELS), "invalid_knowledge_level", F.col("knowledge_level")),
        mark(has("gaps"), "legacy_gaps_field"),
        mark(number.isNull() | ~number.between(0, 1), "invalid_confidence"),
        mark(F.coalesce(F.size("coverage_claims"), F.lit(0)) <= 0, "coverage_claims_missing"),
    ]
    marks += [
        mark(has(k) & ~F.coalesce(raw(k).startswith("["), F.lit(False)), "finding_field_not_list", k)
        for k in ("blocking_gaps", "non_blocking_gaps", "exploration_hints")
    ]
    found = findings.select("batch_id", "finding_id", F.inline(F.array_compact(F.array(*marks))))
    return issues(found, F.col("code"), F.col("item"))


def evidence_ref_issues(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    refs = findings.select("batch_id", "finding_id", F.explode("evidence_refs").alias("ref"))
    bad = refs.join(valid_refs(refs, ranges), ["batch_id", "ref"], "left_anti")
    return issues(bad, "invalid_evidence_ref", F.col("ref"))


def claim_rows(findings: DataFrame) -> DataFrame:
    """One row per coverage claim, with the contract of the finding's level."""
    c = findings.withColumn("contract", requirements())
    return c.select(
        "batch_id", "finding_id", "knowledge_level", "contract", F.posexplode("coverage_claims").alias("idx", "claim")
    ).select(
        "batch_id", "finding_id", "knowledge_level", "contract", "idx", F.coalesce("claim.item", F.lit("")).alias("item"),
        F.coalesce("claim.status", F.lit("")).alias("status"), F.col("claim.evidence_refs").alias("refs"),
        F.col("claim").isNull().alias("broken"),
    )


def claim_issues(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Contract of the coverage claims: items, statuses, references, completeness, blocking gaps."""
    claims = claim_rows(findings)
    sound = claims.where("not broken")
    outside = (F.col("item") != "") & (F.size("contract") > 0) & ~F.array_contains("contract", F.col("item"))
    covered = sound.where("status = 'covered'")
    refs = covered.select("batch_id", "finding_id", "item", F.explode("refs").alias("ref"))
    bad_refs = refs.join(valid_refs(refs, ranges), ["batch_id", "ref"], "left_anti")
    # What a finding claims is combined inside the row: no shuffle for the completeness rule.
    named = F.filter(
        F.transform(F.coalesce("coverage_claims", F.array().cast(findings.schema["coverage_claims"].dataType)), lambda c: F.coalesce(c["item"], F.lit(""))),
        lambda i: i != "",
    )
    f = findings.withColumn("contract", requirements()).withColumn("absent", F.array_sort(F.array_except("contract", named)))
    incomplete = f.where(F.col("knowledge_level").isin(LEVELS_WITH_TARGETS) & (F.size("coverage_claims") > 0) & (F.size("absent") > 0))
    blocked = f.where(
        F.exists("coverage_claims", lambda c: c["status"] == "blocking_gap") & (F.coalesce(F.size("blocking_gaps"), F.lit(0)) <= 0)
    )
    return union([
        issues(claims.where("broken"), "coverage_claim_invalid", idx=F.col("idx")),
        issues(sound.where("item = ''"), "coverage_claim_item_missing", idx=F.col("idx")),
        issues(sound.where(outside), "coverage_claim_item_not_in_contract", F.col("item")),
        issues(sound.where(~F.col("status").isin(V.CLAIM_STATUSES)), "coverage_claim_status_invalid", F.concat_ws("=", "item", "status")),
        issues(covered.where(F.coalesce(F.size("refs"), F.lit(0)) <= 0), "coverage_claim_evidence_missing", F.col("item")),
        issues(bad_refs, "invalid_coverage_claim_evidence_ref", F.concat_ws("=", "item", "ref")),
        issues(incomplete, "coverage_contract_items_missing", F.array_join("absent", "|")),
        issues(blocked, "blocking_coverage_without_blocking_gap"),
    ])


def specificity_issues(findings: DataFrame) -> DataFrame:
    """Feature findings whose three or more covered claims all share one set of references."""
    covered = F.filter("coverage_claims", lambda c: (c["status"] == "covered") & (F.coalesce(F.size(c["evidence_refs"]), F.lit(0)) > 0))
    sets = F.array_distinct(F.transform("covered", lambda c: F.array_join(F.array_sort(c["evidence_refs"]), "\n")))
    f = findings.where("knowledge_level = 'feature_implementation'").withColumn("covered", covered)
    same = f.where((F.size("covered") >= 3) & (F.size(sets) == 1))
    return issues(same, "coverage_claims_not_layer_specific", F.array_join(F.transform("covered", lambda c: c["item"]), "|"))


def target_page_issues(findings: DataFrame) -> DataFrame:
    f = findings.where(F.col("knowledge_level").isin(LEVELS_WITH_TARGETS))
    missing = f.where(F.coalesce(F.size("knowledge_object_candidates"), F.lit(0)) <= 0)
    each = f.select("batch_id", "finding_id", F.posexplode("knowledge_object_candidates").alias("idx", "raw"))
    text = strip(slashes(F.col("raw")))
    full = F.when(text.startswith("entities/code/features/"), F.concat(F.lit("wiki/"), text)).otherwise(text)
    bad = (text != "") & ~(full.startswith("wiki/entities/code/features/") & full.endswith(".md"))
    return union([
        issues(missing, "knowledge_object_candidates_missing"),
        issues(each.where(text == ""), "knowledge_object_candidate_empty", idx=F.col("idx")),
        issues(each.where(bad), "knowledge_object_candidate_invalid", F.col("raw")),
    ])


def coding_context_issues(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    f = findings.where("knowledge_level = 'coding_playbook'")
    present = f.where("coding_context is not null")
    fields = present.select("batch_id", "finding_id", "coding_context", F.explode(strings(V.CODING_CONTEXT_FIELDS)).alias("field")).withColumn(
        "entries", F.try_element_at("coding_context", F.col("field"))
    )
    each = fields.select("batch_id", "finding_id", "field", F.posexplode("entries").alias("idx", "e"))
    sound = each.where("e is not null").select(
        "batch_id", "finding_id", "field", "idx", strip(F.coalesce("e.summary", F.lit(""))).alias("summary"), F.col("e.evidence_refs").alias("refs")
    )
    refs = sound.select("batch_id", "finding_id", "field", F.explode("refs").alias("ref"))
    bad_refs = refs.join(valid_refs(refs, ranges), ["batch_id", "ref"], "left_anti")
    return union([
        issues(f.where("coding_context is null"), "coding_context_missing"),
        issues(fields.where(F.coalesce(F.size("entries"), F.lit(0)) <= 0), "coding_context_field_missing", F.col("field")),
        issues(each.where("e is null"), "coding_context_item_invalid", F.col("field"), F.col("idx")),
        issues(sound.where("summary = ''"), "coding_context_summary_missing", F.col("field"), F.col("idx")),
        issues(sound.where((F.col("summary") != "") & ~has_cjk(F.col("summary"))), "human_text_not_chinese",
               F.concat(F.lit("coding_context."), F.col("field"), F.lit(".summary")), F.col("idx")),
        issues(sound.where(F.coalesce(F.size("refs"), F.lit(0)) <= 0), "coding_context_evidence_missing", F.col("field"), F.col("idx")),
        issues(bad_refs, "invalid_coding_context_evidence_ref", F.concat_ws("=", "field", "ref")),
    ])


def human_texts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, value): every text of the JSON column ``line`` that is the value of a field for people, or an element
    of such a field's list, at any depth.

    A loop over the levels: a turn opens the objects and lists of the turn before and appends what they hold to a table.
    Each turn's plan is the same, whatever the depth, and only "is anything left to open" reaches the driver.
    """
    spark = rows.sparkSession
    names, kept = ", ".join(f"'{n}'" for n in V.HUMAN_TEXT_FIELDS), ", ".join(keys)
    folder, turn = new_folder(spark, "texts"), 0
    level = rows.select(*keys, F.lit("").alias("path"), F.try_parse_json("line").alias("v"), F.lit(False).alias("human")).where(
        "v IS NOT NULL AND schema_of_variant(v) RLIKE '^(ARRAY|OBJECT)'")
    schema = level.schema
    while True:
        spark.sql(f"""
            SELECT {kept}, CASE WHEN e.key IS NULL THEN path || '[' || e.pos || ']' WHEN path = '' THEN e.key ELSE path || '.' || e.key END AS path,
                   e.value AS v, CASE WHEN e.key IS NULL THEN human AND NOT startswith(schema_of_variant(e.value), 'ARRAY') ELSE e.key IN ({names}) END AS human
            FROM {{level}} w, LATERAL variant_explode(w.v) e""", level=level).write.parquet(f"{folder}/turn={turn}")
        opened = spark.read.schema(schema).parquet(f"{folder}/turn={turn}")
        level = opened.where("schema_of_variant(v) RLIKE '^(ARRAY|OBJECT)'")
        if level.isEmpty():
            break
        turn += 1
    every = spark.read.schema(schema).parquet(folder)
    return every.where("human AND schema_of_variant(v) = 'STRING'").select(*keys, "path", F.try_variant_get("v", "$", "string").alias("value"))


def language_issues(findings: DataFrame) -> DataFrame:
    """Texts for people without a Chinese character, one row per text with its place in the finding."""
    texts = human_texts(findings.select("batch_id", "finding_id", "line"), ["batch_id", "finding_id"])
    return issues(texts.where((strip(F.col("value")) != "") & ~has_cjk(F.col("value"))), "human_text_not_chinese", F.col("path"))


def finding_issues(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """All rules of a finding."""
    return union([
        field_issues(findings), evidence_ref_issues(findings, ranges), claim_issues(findings, ranges), specificity_issues(findings),
        target_page_issues(findings), coding_context_issues(findings, ranges), language_issues(findings),
    ])


def bundle_issues(findings: DataFrame, stats: DataFrame, files: DataFrame, references: DataFrame) -> DataFrame:
    """Evidence bundle of a batch against its closure statistics.

    ``stats``: batch_id, expansion_policy, stopped_reason, file_count, reference_count.
    """
    batches = findings.groupBy("batch_id").agg(F.max(F.col("knowledge_level").isin(LEVELS_WITH_TARGETS)).alias("needs_closure"))
    n_files = files.groupBy("batch_id").agg(F.count("*").alias("n_files"))
    n_refs = references.groupBy("batch_id").agg(F.count("*").alias("n_refs"))
    b = batches.join(n_files, "batch_id", "left").join(n_refs, "batch_id", "left").join(
        stats.withColumn("has_stats", F.lit(True)), "batch_id", "left"
    )
    b = b.withColumn("finding_id", F.lit("")).na.fill(0, ["n_files", "n_refs"])
    closed = b.where("needs_closure and has_stats")
    return union([
        issues(b.where("n_files = 0"), "evidence_files_missing"),
        issues(b.where("n_files = 0"), "evidence_snippets_missing"),
        issues(b.where("needs_closure and has_stats is null"), "evidence_closure_missing"),
        issues(closed.where(~F.col("expansion_policy").eqNullSafe(F.lit(V.CLOSURE_POLICY))), "evidence_closure_policy_invalid", F.col("expansion_policy")),
        issues(closed.where(~F.col("stopped_reason").eqNullSafe(F.lit(V.CLOSURE_STOPPED))), "evidence_closure_not_exhausted", F.col("stopped_reason")),
        issues(closed.where(~F.col("file_count").eqNullSafe(F.col("n_files"))), "evidence_closure_file_count_mismatch", F.col("file_count")),
        issues(closed.where(~F.col("reference_count").eqNullSafe(F.col("n_refs"))), "evidence_closure_reference_count_mismatch", F.col("reference_count")),
    ])


def plan_issues(batches: DataFrame) -> DataFrame:
    """Rules of planned batches.  Columns that a plan leaves out are null."""
    b = batches.withColumn("finding_id", F.lit("")).withColumn("contract", requirements())
    absent = [F.when(F.col(c).isNull(), F.lit(c)) for c in V.BATCH_FIELDS]
    missing = b.select("batch_id", "finding_id", F.explode(F.array_compact(F.array(*absent))).alias("field"))
    level = F.coalesce("knowledge_level", F.lit(""))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    contracted = b.where(level.isin(LEVELS_WITH_TARGETS)).withColumn(
        "field", F.when(level == "coding_playbook", "required_claims").otherwise("required_layers")
    ).withColumn("items", F.when(level == "coding_playbook", F.col("required_claims")).otherwise(F.col("required_layers")))
    given = contracted.where(n("items") > 0)
    invalid = F.array_sort(F.array_except("items", "contract"))
    rest = F.array_sort(F.array_except("contract", "items"))
    return union([
        issues(missing, "batch_field_missing", F.col("field")),
        issues(b.where("legacy_budget is not null"), "legacy_evidence_budget"),
        issues(b.where((level != "") & ~level.isin(V.KNOWLEDGE_LEVELS)), "invalid_knowledge_level", F.col("knowledge_level")),
        issues(b.where((n("paths") <= 0) & (n("entrypoints") <= 0)), "batch_has_no_code_seed"),
        issues(contracted.where(n("items") <= 0), F.concat(F.col("field"), F.lit("_missing"))),
        issues(given.where(F.size(invalid) > 0), F.concat(F.col("field"), F.lit("_not_in_contract")), F.array_join(invalid, "|")),
        issues(given.where(F.size(rest) > 0), F.concat(F.col("field"), F.lit("_incomplete")), F.array_join(rest, "|")),
        issues(contracted.where(n("blocking_gap_rules") <= 0), "blocking_gap_rules_missing"),
        issues(b.where((strip(F.coalesce("title", F.lit(""))) != "") & ~has_cjk(F.coalesce("title", F.lit("")))), "human_text_not_chinese", "title"),
    ])




def accept(findings: DataFrame, verified: DataFrame) -> DataFrame:
    """(batch_id, passed, error, n_accepted): a batch passes when its verified ids are known and unblocked."""
    v = verified.select("batch_id", "finding_id").distinct()
    known = v.join(findings.select("batch_id", "finding_id").distinct(), ["batch_id", "finding_id"], "left_semi")
    blocked = findings.where(F.coalesce(F.size("blocking_gaps"), F.lit(0)) > 0).join(v, ["batch_id", "finding_id"], "left_semi")
    count = lambda df, name: df.groupBy("batch_id").agg(F.count("*").alias(name))
    b = findings.select("batch_id").distinct()
    for part in (count(v, "n_verified"), count(known, "n_known"), count(blocked, "n_blocked")):
        b = b.join(part, "batch_id", "left")
    b = b.na.fill(0, ["n_verified", "n_known", "n_blocked"])
    error = (
        F.when(F.col("n_verified") == 0, "verified_finding_ids_missing").when(F.col("n_known") != F.col("n_verified"), "verified_finding_ids_unknown")
        .when(F.col("n_blocked") > 0, "blocking_gaps").otherwise("")
    )
    return b.select("batch_id", (error == "").alias("passed"), error.alias("error"), "n_verified")


def verified_findings(findings: DataFrame, verified: DataFrame) -> DataFrame:
    """Findings to publish: verified and without blocking gaps."""
    free = findings.where(F.coalesce(F.size("blocking_gaps"), F.lit(0)) <= 0)
    return free.join(verified.select("batch_id", "finding_id").distinct(), ["batch_id", "finding_id"], "left_semi")
