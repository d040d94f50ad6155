"""Comparison query of every registered query that has one."""

from __future__ import annotations

from . import findings as f
from . import pages as p
from . import quality as q
from . import retrieval as r

ORACLES: dict[str, str] = {
    "query_text_features": r.USER_FEATURES,
    "module_aliases": r.MODULE_ALIASES,
    "query_plans": r.QUERY_PLANS,
    "page_roles": r.PAGE_ROLES,
    "score_topk": r.SCORE_TOPK,
    "hit_list": r.HITS,
    "candidate_columns": r.CANDIDATES,
    "primary_pages": r.PRIMARIES,
    "links_extract": r.LINKS_EXTRACT,
    "link_expansion": r.EXPANSION,
    "evidence_budget": r.EVIDENCE,
    "selection_status": r.STATUS,
    "omitted_reasons": r.OMITTED,
    "coverage_proof": r.COVERAGE,
    "page_extract": p.PAGE_EXTRACT,
    "page_predicates": p.PAGE_PREDICATES,
    "index_parse": p.INDEX_PARSE,
    "source_statuses": p.SOURCE_STATUSES,
    "lint_issues": p.LINT_ISSUES,
    "lint_summary": p.LINT_SUMMARY,
    "structure_issues": p.STRUCTURE,
    "english_lines": p.ENGLISH,
    "language_summary": p.LANGUAGES,
    "listed_files": p.LISTED,
    "entrypoints": p.ENTRYPOINTS,
    "candidate_modules": p.MODULES,
    "repository_snapshot": p.SNAPSHOT,
    "snapshot_diff": p.DIFF,
    "changed_files": p.CHANGED,
    "snapshot_tree": p.TREE,
    "snapshot_tree_update": p.TREE,
    "snapshot_tree_changes": p.TREE_CHANGES,
    "snapshot_repositories": p.ROOTS,
    "reference_edges": p.EDGES,
    "closure_reach": p.CLOSURE,
    "closure_update": p.CLOSURE,
    "closure_stats": p.CLOSURE_STATS,
    "scanned_folders": p.SCANNED,
    "finding_field_issues": f.FIELD_ISSUES,
    "ref_range_check": f.REF_CHECK,
    "claim_contract": f.CLAIMS,
    "layer_specific": f.LAYERS,
    "target_and_context_issues": f.TARGET_CONTEXT,
    "bundle_consistency": f.BUNDLE,
    "plan_issues": f.PLAN,
    "batch_acceptance": f.ACCEPT,
    "published_findings": f.PUBLISHED,
    "batch_completion": f.COMPLETION,
    "batch_rollup": f.ROLLUP,
    "target_pages": f.TARGETS,
    "target_descriptors": f.DESCRIPTORS,
    "section_values": f.SECTION_VALUES,
    "duplicate_bodies": f.DUPLICATES,
    "acceptance_issues": f.ACCEPTANCE,
    "request_descriptors": f.REQUESTS,
    "request_outputs": f.OUTPUTS,
    "reconcile_queries": f.STRINGS,
    "maintenance_materials": f.MATERIALS,
    "run_ledger": f.LEDGER,
    "source_registration": f.REGISTERED,
    "citations": q.CITATIONS,
    "evidence_gaps": q.GAPS,
    "topic_coverage": q.TOPICS,
    "root_confidence": q.ROOT_CONFIDENCE,
    "query_review": q.REVIEW,
    "review_scope": q.SCOPE,
    "code_map_matches": q.MATCHES,
    "repo_targets": q.TARGETS,
    "reconcile_candidates": q.RECONCILE,
    "reconcile_titles": q.TITLES,
    "reconcile_pages": q.RECONCILED_PAGES,
    "handoff_descriptors": f.HANDOFFS,
    "handoff_shards": f.SHARDS,
    "handoff_outputs": f.OUTS,
    "reconcile_confidence": q.CONFIDENCE,
}
