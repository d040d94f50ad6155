"""Evidence quality, code maps, repository targets, reconciliation by retrieval."""

from __future__ import annotations

from corpusspark.functions import fixed_values as V

from . import findings as _findings  # noqa: F401  (request tables)
from . import pages as _pages  # noqa: F401  (page tables)
from . import retrieval as _retrieval  # noqa: F401  (retrieval tables)
from .pages import locator
from .sql import CJK_RUN, CTES, arr, cte, has_any, lit, query

CODE_FEATURES = "wiki/entities/code/features/"
GAP = "query_id, root_id, code, severity, operator, profile, section, path, target, modules, topic_terms, reason"


def gap(source: str, code: str, root="root_id", severity="'major'", operator="null", profile="null", section="null", path="null", target="null",
        modules="null", topic_terms="null", reason="null") -> str:
    text = lambda v: f"cast({v} as varchar)"
    return (f"select query_id, {text(root)} as root_id, {code} as code, {text(severity)} as severity, {text(operator)} as operator, {text(profile)} as profile, {text(section)} as section, "
            f"{text(path)} as path, {text(target)} as target, {text(modules)} as modules, {text(topic_terms)} as topic_terms, {text(reason)} as reason from {source}")


cte("x_bundle", "select e.*, p.text as content, p.ipath from x_evidence e join x_pages p on p.root_id = e.root_id and p.repo_path = e.path")
CITATIONS = query("select query_id, root_id, evidence_pos, root_id || ':' || path as citation from x_bundle where content is not null")
cte("x_shape", "select query_id, root_id, count(*) as n, max(page_role) as role, max(path) as path from x_bundle group by all")
cte("x_cov2", "select c.*, coalesce(s.n, 0) as n, s.role, s.path as spath from x_coverage c left join x_shape s on s.query_id = c.query_id and s.root_id = c.root_id")
cte("x_attr", f"""
select t.query_id, t.root_id, t.operator, bool_or(len(t.terms) = 0 or len(list_filter(t.terms, lambda w: contains(lower(b.content), lower(w)))) > 0) as on_topic,
  bool_or(regexp_matches(b.content, '`[A-Za-z][A-Za-z0-9_./:-]{{2,}}`') or regexp_matches(b.content, '(?m)^\\s*[-*]\\s+\\S+') or regexp_matches(b.content, '(?m)^\\s*\\d+\\.\\s+\\S+') or regexp_matches(b.content, '(?m)^\\|.+\\|$')) as has_values
from (select *, list_filter({arr(sorted(V.ENTITY_ATTRIBUTE_HINTS, key=lambda h: (-len(h), h)))}, lambda h: contains(lower(query), lower(h))) as terms from x_targets where is_attribute) t
left join x_bundle b on b.query_id = t.query_id and b.root_id = t.root_id and b.evidence_role = 'primary' and b.page_role in ('feature', 'concept', 'query', 'unknown')
group by all""")
cte("x_root_gaps", " union ".join([
    gap("x_expand where dst is null", "'broken_wikilink'", severity="null", path="src", target="target"),
    gap("(select t.query_id, t.root_id from x_targets t left join x_bundle b on b.query_id = t.query_id and b.root_id = t.root_id where b.path is null) n", "'no_evidence_pages'", severity="null", path="'wiki/index.md'"),
    gap("x_cov2 where subject is null", "'subject_unresolved'", operator="operator"),
    gap("x_cov2 where len(owner_pages) = 0", "'collection_owner_missing'", operator="operator"),
    gap("x_cov2 where len(member_paths) = 0", "'collection_members_missing'", operator="operator"),
    gap("x_cov2 where operator = 'COUNT_COLLECTION' and n = 1 and role = 'feature'", "'single_member_page_insufficient_for_count'", operator="operator", path="spath"),
    gap("x_cov2 where len(member_paths) > 0 and len(owner_pages) = 0", "'collection_coverage_incomplete'", operator="operator"),
    gap("x_attr where on_topic is null", "'entity_owner_missing'", operator="operator"),
    gap("x_attr where not on_topic", "'attribute_topic_missing'", operator="operator"),
    gap("x_attr where not has_values", "'attribute_values_missing'", operator="operator"),
]))
LQ = "lower(query)"
CODING = f"(not nav and ({has_any(LQ, V.CODING_PROFILE_HINTS)} or (scope and {has_any(LQ, V.CODING_PROFILE_CODE_SCOPE_HINTS)})))"
DESIGN = f"(not nav and ({has_any(LQ, V.DESIGN_PROFILE_HINTS)} or (scope and {has_any(LQ, V.DESIGN_PROFILE_CODE_SCOPE_HINTS)}) or ({has_any(LQ, V.CODING_PROFILE_HINTS)} and contains({LQ}, '设计'))))"
cte("x_qctx", f"""
select *, {CODING} as coding, {DESIGN} as design,
  list_filter([case when {CODING} then 'agentic_coding' end, case when {DESIGN} then 'prd_design_from_code' end], lambda x: x is not null) as profiles
from (select t.query_id, any_value(t.query) as query, any_value(t.topic_terms) as topic_terms, bool_or(r.is_code_root and t.wants_code_knowledge) as scope, bool_or(t.wants_code_navigation) as nav,
  bool_or(t.is_collection) as is_collection, bool_or(t.wants_code_knowledge) as any_code from x_targets t join m_roots r on r.root_id = t.root_id group by t.query_id) q""")
STRONG = f"(w in ({', '.join(lit(c) for c in V.CJK_TOPIC_COMPOUNDS)}) or (regexp_full_match(w, '{CJK_RUN}') and length(w) >= 4))"
cte("x_fpages", f"select distinct query_id, root_id, path, content, module, evidence_pos from x_bundle where starts_with(path, '{CODE_FEATURES}')")
cte("x_topics", f"""
select query_id, n_pages, n_feature_pages, n_terms, n_matched, n_terms = 0 or ((n_strong = 0 or strong_hit > 0) and n_matched >= case when n_terms <= 2 then n_terms else greatest(2, (n_terms + 2) // 3) end) as covered
from (select q.query_id, (select count(*) from x_bundle b where b.query_id = q.query_id) as n_pages, (select count(*) from x_fpages f where f.query_id = q.query_id) as n_feature_pages,
  len(topic_terms) as n_terms, coalesce(m.n, 0) as n_matched, len(list_filter(topic_terms, lambda w: {STRONG})) as n_strong, coalesce(m.strong_hit, 0) as strong_hit
  from x_qctx q left join (select query_id, count(*) as n, count(*) filter ({STRONG}) as strong_hit from (
     select distinct q.query_id, w from (select query_id, unnest(topic_terms) as w from x_qctx) q join x_fpages f on f.query_id = q.query_id and contains(lower(f.content), lower(w))) d group by query_id) m on m.query_id = q.query_id) z""")
TOPICS = query("select query_id, n_pages, n_feature_pages, cast(n_terms as int) as n_terms, n_matched, covered from x_topics")
cte("x_plans", "select t.* from x_targets t join m_roots r on r.root_id = t.root_id and r.is_code_root where t.wants_code_knowledge")
cte("x_plans2", "select * from x_plans where query_id not in (select query_id from x_plans where wants_code_navigation)")
TERMS12 = "array_to_string(topic_terms, '|')"
cte("x_code_gaps", " union ".join([
    gap("(select q.* from x_qctx q join x_topics c using (query_id) where q.query_id in (select query_id from x_plans2) and c.n_feature_pages > 0 and c.n_terms > 0 and not c.covered) t", "'query_topic_not_covered'", root="null",
        topic_terms=TERMS12, reason="'selected_code_feature_pages_do_not_cover_query_topic'"),
    gap("x_plans2 p where len(modules) > 0 and not exists (select 1 from x_fpages f where f.query_id = p.query_id and list_contains(p.modules, f.module))", "'query_module_not_covered'",
        modules="array_to_string(modules, '|')", reason="'query_requested_module_but_selected_code_feature_pages_do_not_match_module'"),
]))
cte("x_active", "select q.query_id, q.topic_terms, unnest(q.profiles) as profile, c.n_pages, c.n_feature_pages, c.covered from x_qctx q join x_topics c using (query_id)")
cte("x_rest", "select * from x_active where n_pages > 0 and len(topic_terms) > 0")
cte("x_trace", f"""
select f.query_id, f.root_id, f.path, m.k % 4 = 0 as has_trace, p.path is not null as trace_exists from x_fpages f join x_fm m on m.root_id = f.root_id and m.repo_path = f.path
left join m_files_present p on p.root_id = f.root_id and m.k % 4 = 0 and p.path = m.sources[1]""")


def heading_match(markers) -> str:
    return "(" + " or ".join(f"contains(lower(s.h), {lit(m.lower())}) or contains({lit(m.lower())}, lower(s.h))" for m in markers) + ")"


cte("x_secs", """
select root_id, path, no, trim(h[4:]) as h, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  trim(split_part(split_part(content, h || chr(10), 2), chr(10) || '## ', 1), chr(10) || ' '), '`([^`]+)`', '\\1', 'g'), '\\[[^\\]]+\\]\\([^)]+\\)', '', 'g'), '(?m)^\\s*[-*]\\s*', '', 'g'), '\\s+', ' ', 'g')) as b
from (select root_id, path, content, generate_subscripts(l, 1) as no, unnest(l) as h from (select distinct root_id, path, content, regexp_extract_all(content, '(?m)^## [^\\n]*') as l from x_fpages) x) y""")
FILLED = []
for _profile, _sections in V.PROFILE_SECTIONS.items():
    for _section, _markers in _sections.items():
        ok = locator("s.b", "/[A-Za-z0-9_$:{}./-]+") if _section == V.CODE_LOCATION_SECTION else f"(length(s.b) >= 12 and not {has_any('s.b', V.PROFILE_PLACEHOLDERS)})"
        FILLED.append(f"select root_id, path, '{_profile}' as profile, {lit(_section)} as section, arg_min({ok}, s.no) as ok from x_secs s where {heading_match(_markers)} group by root_id, path")
cte("x_filled", " union all ".join(FILLED))
SECTION_LIST = " union all ".join(f"select '{p}' as profile, {lit(s)} as section, {arr(m)} as markers" for p, secs in V.PROFILE_SECTIONS.items() for s, m in secs.items())
cte("x_section_list", SECTION_LIST)
cte("x_profile_gaps", " union ".join([
    gap("x_active where n_pages = 0", "'profile_no_evidence_pages'", root="null", profile="profile"),
    gap("x_active where n_pages > 0 and len(topic_terms) = 0", "'profile_query_subject_missing'", root="null", profile="profile", reason="'code_or_prd_query_has_no_specific_business_topic'"),
    gap("x_rest where n_feature_pages = 0", "'profile_code_feature_evidence_missing'", root="null", profile="profile"),
    gap("x_rest where n_feature_pages > 0 and not covered", "'profile_query_topic_not_covered'", root="null", profile="profile", topic_terms=TERMS12, reason="'selected_code_feature_page_does_not_cover_query_specific_topic'"),
    gap("(select r.query_id, r.profile, t.path from x_rest r join x_trace t using (query_id) where not t.has_trace) t", "'profile_code_feature_source_trace_missing'", root="null", profile="profile", path="path"),
    gap("(select r.query_id, r.profile, t.path from x_rest r join x_trace t using (query_id) where t.has_trace and not t.trace_exists) t", "'profile_code_feature_source_summary_missing'", root="null", profile="profile", path="path"),
    gap("(select r.query_id, r.profile, f.path, s.section from x_rest r join x_fpages f using (query_id) join x_section_list s on s.profile = r.profile left join x_filled x on x.root_id = f.root_id and x.path = f.path and x.profile = r.profile and x.section = s.section where not coalesce(x.ok, false)) t",
        "'profile_required_section_missing'", root="null", profile="profile", path="path", section="section", reason="'code_feature_page_section_missing_or_not_actionable'"),
    gap("(select r.query_id, r.profile, s.section from x_rest r join x_section_list s on s.profile = r.profile where r.n_feature_pages = 0 and not exists (select 1 from x_bundle b where b.query_id = r.query_id and len(list_filter(s.markers, lambda m: contains(b.content, m))) > 0)) t",
        "'profile_required_section_missing'", root="null", profile="profile", section="section"),
]))
cte("x_gaps", """
select * from (select * from x_root_gaps union select * from x_code_gaps union select * from x_profile_gaps) g
where code <> 'subject_unresolved' or query_id not in (select query_id from x_profile_gaps where code = 'profile_query_subject_missing')""")
GAPS = query(f"select {GAP} from x_gaps")
LOW = ", ".join(lit(c) for c in V.PROFILE_GAP_CODES + V.SEMANTIC_GAP_CODES)
cte("x_rgaps", f"""
select {GAP} from x_root_gaps union select p.query_id, p.root_id, g.code, g.severity, g.operator, g.profile, g.section, g.path, g.target, g.modules, g.topic_terms, g.reason from x_code_gaps g join x_plans p on p.query_id = g.query_id""")


def confidence(keys: str, gaps: str) -> str:
    on = lambda a: " and ".join(f"{a}.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    return f"""select t.*, coalesce(b.n, 0) as n_evidence, coalesce(g.n, 0) as n_gaps, case when b.n is null or coalesce(g.low, false) then 'low' when b.prim and g.n is null then 'high' else 'medium' end as confidence
from (select distinct {keys} from x_targets) t left join (select {keys}, count(*) as n, bool_or(evidence_role = 'primary') as prim from x_bundle group by {keys}) b on {on('b')}
left join (select {keys}, count(*) as n, bool_or(code in ({LOW})) as low from {gaps} group by {keys}) g on {on('g')}"""


ROOT_CONFIDENCE = query(confidence("query_id, root_id", "x_rgaps"))
cte("x_conf", confidence("query_id", "x_gaps"))
REVIEW_CODES = ", ".join(lit(c) for c in V.REVIEW_GAP_CODES)
ORDER = "case code " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(["no_evidence_pages", "subject_unresolved", "entity_owner_missing", "collection_owner_missing", "attribute_topic_missing", "collection_members_missing", "attribute_values_missing", "single_member_page_insufficient_for_count", "collection_coverage_incomplete"])) + " else 99 end"
cte("x_reasons", f"""
select query_id, list(code order by o) as codes, bool_or(code in ({', '.join(lit(c) for c in V.SEMANTIC_GAP_CODES)})) as semantic from (
  select query_id, code, min(o) as o from (
    select g.query_id, g.code, (0, -r.priority, {ORDER}) as o from x_gaps g join m_roots r on r.root_id = g.root_id where g.code in ({REVIEW_CODES}) and g.code <> 'query_module_not_covered'
    union all select query_id, code, (1, 0, case when code = 'query_topic_not_covered' then 0 else 1 end) from x_code_gaps
    union all select query_id, code, (2, 0, case code when 'profile_no_evidence_pages' then 0 when 'profile_query_subject_missing' then 1 when 'profile_code_feature_evidence_missing' then 2 else 3 end) from x_profile_gaps where code in ({REVIEW_CODES})) u group by query_id, code) v group by query_id""")
NONE = "cast([] as varchar[])"
cte("x_review", f"""
select q.*, c.confidence, c.n_evidence, c.n_gaps, r.semantic,
  (case when c.confidence = 'low' then ['low_confidence'] else {NONE} end) || (case when c.n_evidence = 0 then ['no_evidence_pages'] else {NONE} end)
  || list_filter(coalesce(r.codes, {NONE}), lambda x: not (x = 'no_evidence_pages' and c.n_evidence = 0)) || (case when any_code then ['code_knowledge_query'] else {NONE} end) as reasons
from x_qctx q join x_conf c using (query_id) left join x_reasons r using (query_id)""")
cte("x_review2", "select *, len(reasons) > 0 and confidence = 'low' and (len(profiles) > 0 or coalesce(semantic, false)) as required_before_final from x_review")
BLOCKS = f"""{arr(V.BASE_ANSWER_SECTIONS)} || (case when coding then {arr(V.PROFILE_SECTIONS['agentic_coding'])} else {NONE} end) || (case when design then {arr(V.PROFILE_SECTIONS['prd_design_from_code'])} else {NONE} end)
  || (case when scope then [{lit(V.EXPLORATION_PLAN_BLOCK)}] else {NONE} end) || (case when scope and len(profiles) > 0 then [{lit(V.VERIFICATION_RESULT_BLOCK)}] else {NONE} end)"""
REVIEW = query(f"""
select query_id, confidence, n_evidence, n_gaps, array_to_string(profiles, '|') as profiles, array_to_string(list_filter(blocks, lambda v, i: list_position(blocks, v) = i), '|') as answer_blocks, array_to_string(reasons, '|') as reason_codes,
  case when scope and len(profiles) > 0 then 'evidence_pages_coverage_proof_and_executed_code_exploration' when is_collection then 'evidence_pages_and_coverage_proof' else 'evidence_pages' end as must_use_only, required_before_final,
  case when scope and len(profiles) > 0 then 'requires_code_exploration' when required_before_final then 'requires_semantic_review' else 'ready_for_answer' end as status
from (select *, {BLOCKS} as blocks from x_review2) b""")
SCOPE = query("""
select query_id, kind, cast(review_pos as int) as review_pos, root_id, path, cast(score20 as bigint) as score20 from (
  select c.*, row_number() over (partition by c.query_id, kind order by r.priority desc, c.root_id, c.pos) as review_pos from (
    select query_id, root_id, pos, path, score20, 'candidate' as kind from x_merged union all select query_id, root_id, pos, path, score20, 'omitted' from x_omitted) c join m_roots r on r.root_id = c.root_id) d""")

# ---- code maps: the table rows are known from the pages they were written into ---------------------------------------------------------
cte("x_map_rows", r"""
select root_id as page_root, repo_path as page_path, i as row_index, pm as product_module, cap as capability, rt as repo_text, pm || ' ' || cap || ' ' || rt || ' ' || en as row_values, pth
from (select root_id, repo_path, 1 as i, up as pm, trim('数据权限 ' || translate(split_part(base, chr(10), 1), '|`', '')) as cap, lower(up) || '-team-' || (k % 13) as rt, 'src/App' || doc_id || 'Service.java' as en, 'src/App' || doc_id || 'Service.java' as pth
      from (select m.*, d.text as base from x_fm m join documents d using (doc_id)) z where k % 10 = 1
      union all select root_id, repo_path, 2, 'other', '导出', 'web', '`repos/' || lower(up) || '-team-' || ((k + 2) % 13) || '/src/b.java`', 'repos/' || lower(up) || '-team-' || ((k + 2) % 13) || '/src/b.java' from x_fm where k % 10 = 1) r""")
STRONG4 = f"(regexp_full_match(w, '{CJK_RUN}') and length(w) >= 4)"


def matches(asks: str, keys: str) -> str:
    part = ", ".join("a." + k.strip() for k in keys.split(","))
    return f"""
select * from (select *, row_number() over (partition by {keys} order by relevance desc, page_path, row_index, page_root) as match_no from (
  select {part}, m.*, mp + tp as relevance from (
    select a.*, m.*, list_sum(list_transform(ask_modules, lambda x: case when contains(lower(product_module), x) then 14 when contains(lower(capability), x) then 8 else 0 end)) as mp0,
      list_filter(list_transform(terms, lambda w: lower(w)), lambda w: w <> '' and not list_contains(ask_modules, w)) as used
    from {asks} a join x_bundle b on b.query_id = a.query_id join x_map_rows m on m.page_root = b.root_id and m.page_path = b.path) a0,
    lateral (select coalesce(mp0, 0) as mp, list_filter(used, lambda w: contains(lower(row_values), w) or (w = '数据权限' and (contains(lower(row_values), '访问管控') or contains(lower(row_values), '访问控制')))) as hit) h,
    lateral (select coalesce(list_sum(list_transform(hit, lambda w: case when length(w) >= 6 then 12 when length(w) >= 4 then 7 else 3 end)), 0) as tp) t,
    lateral (select a0.page_root, a0.page_path, a0.row_index, a0.product_module, a0.repo_text, a0.row_values, a0.pth) m, lateral (select {', '.join('a0.' + k.strip() for k in keys.split(','))}) a
  where tp > 0 and not (len(list_filter(used, lambda w: {STRONG4})) > 0 and len(list_filter(hit, lambda w: {STRONG4})) = 0 and len(hit) < 2)) s) r"""


cte("x_asks", "select query_id, any_value(topic_terms) as terms, flatten(list(list_transform(modules, lambda m: lower(m)))) as ask_modules from x_plans group by query_id")
cte("x_matches", matches("x_asks", "query_id"))
MATCHES = query("select query_id, cast(match_no as int) as match_no, page_root, page_path, cast(row_index as int) as row_index, cast(relevance as int) as relevance, product_module, repo_text from x_matches")
cte("x_pasks", "select query_id, root_id, topic_terms as terms, list_transform(modules, lambda m: lower(m)) as ask_modules from x_plans")
cte("x_pmatches", matches("x_pasks", "query_id, root_id"))
cte("x_page_paths", r"""
select query_id, path, rtrim(p, '.,;:') as p from (select b.query_id, b.root_id, b.path, unnest(regexp_extract_all(b.content, '[\w./-]+[.](?:java|kt|js|jsx|ts|tsx|vue|py|go|xml|yml|yaml|json|sql)\b')) as p from x_fpages b) u""")
BELONGS = "(starts_with({v}, r.path) or starts_with({v}, replace(r.path, 'repos/', '')) or starts_with(r.path, {v}))"
cte("x_repo_scores", f"""
select a.query_id, a.root_id, r.repo_id, len(a.ask_modules) = 0 and len(a.terms) = 0 as bare,
  coalesce((select max(30 + m.relevance) from x_pmatches m where m.query_id = a.query_id and m.root_id = a.root_id and (contains(lower(m.row_values), lower(r.repo_id)) or {BELONGS.format(v='m.pth')})), 0) as map_score,
  6 * (select count(*) from x_page_paths p where p.query_id = a.query_id and {BELONGS.format(v='p.p')}) as path_score,
  coalesce(list_sum(list_transform(a.ask_modules, lambda m: case when contains(lower(r.repo_id || ' ' || r.path || ' ' || r.remote), m) then 10 else 0 end)), 0)
    + coalesce(list_sum(list_transform(a.terms, lambda w: case when contains(lower(r.repo_id || ' ' || r.path || ' ' || r.remote), lower(w)) then 2 else 0 end)), 0) as word_score
from x_pasks a join (select root_id, repo_id, path, max(remote) as remote from m_root_repos group by all) r on r.root_id = a.root_id""")
TARGETS = query("""
select query_id, root_id, cast(target_no as int) as target_no, repo_id, cast(score as bigint) as score, case when score <= 0 then 'code_snapshot_fallback' when map_score > 0 then 'evidence_code_map_match' when word_score > 0 then 'module_or_term_match' when path_score > 0 then 'evidence_code_path_match' else 'code_snapshot_fallback' end as selection_reason
from (select *, row_number() over (partition by query_id, root_id order by score desc, repo_id) as target_no, max(score) over (partition by query_id, root_id) as best from (
  select *, case when map_score + path_score + word_score > 0 then map_score + path_score + word_score when bare then 1 else 0 end as score from x_repo_scores) s) t where (best <= 0 or score > 0)""")

# ---- reconciliation: the same retrieval over the search strings of the requests --------------------------------------------------------------
LOG = """
select request_id || '#' || query_no as query_id, query, root_id as named_root, 'focused' as mode, 0 as candidate_limit, 0 as evidence_budget, false as include_source, false as include_cross_module,
  cast(null as varchar) as plan_operator, cast(null as varchar) as plan_scope, cast(null as varchar) as plan_subject
from (select request_id, query_no, query, root_id from x_strings union all select request_id, 0, coalesce(task, ''), root_id from x_eff) s"""
OVERRIDE = {"m_queries": LOG, "m_roots": CTES["m_roots"].replace("n % 5 = 4 as is_code_root", "false as is_code_root")}
cte("x_found", "select split_part(query_id, '#', 1) as request_id, cast(split_part(query_id, '#', 2) as int) as query_no, pos, path, title from x_merged")
cte("x_consulted", """
select split_part(query_id, '#', 1) as request_id, cast(split_part(query_id, '#', 2) as int) as query_no, 0 as pos, 'wiki/index.md' as path from x_targets where root_id in (select root_id from m_index_entries)
union all select split_part(p.query_id, '#', 1), cast(split_part(p.query_id, '#', 2) as int), p.primary_pos, p.path from x_primaries p where (p.root_id, p.path) in (select (root_id, repo_path) from x_pages)""")
RECONCILE = query("""
select request_id, cast(row_number() over (partition by request_id order by o) as int) as path_no, path from (select request_id, path, min(o) as o from (
  select request_id, path, (0, 0, cast(pos as bigint)) as o from x_found where query_no = 0
  union all select request_id, unnest(pages || [summary]), (1, 0, cast(generate_subscripts(pages || [summary], 1) as bigint)) from x_eff where detected
  union all select request_id, unnest(['wiki/entities/code/features/**', 'wiki/entities/code/modules/**', 'wiki/sources/code/*-runs/**']), (2, 0, cast(unnest([1, 2, 3]) as bigint)) from x_eff where detected) u group by request_id, path) g""", OVERRIDE)
TITLES = query("""
select request_id, cast(row_number() over (partition by request_id order by o) as int) as title_no, title from (select request_id, title, min(o) as o from (
  select request_id, title, (0, 0, cast(pos as bigint)) as o from x_found where query_no = 0
  union all select request_id, unnest(topics), (1, 0, cast(generate_subscripts(topics, 1) as bigint)) from x_eff where detected) u where title <> '' group by request_id, title) g""", OVERRIDE)
RECONCILED_PAGES = query("""
select request_id, kind, cast(row_number() over (partition by request_id, kind order by o) as int) as page_no, path from (select request_id, kind, path, min(o) as o from (
  select request_id, 'matched' as kind, path, (0, query_no, pos) as o from x_found
  union all select request_id, 'consulted', path, (0, query_no, pos) from x_consulted
  union all select request_id, 'consulted', path, (1, query_no, pos) from x_found) u group by all) g""", OVERRIDE)
CONFIDENCE = query("""
select r.request_id, coalesce(f.n, 0) as n_matched, case when f.n > 0 then 0.6::double else 0.35::double end as confidence from x_eff r left join (select request_id, count(distinct path) as n from x_found group by request_id) f using (request_id)""", OVERRIDE)
