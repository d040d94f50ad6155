"""Query features, relevance, selection."""

from __future__ import annotations

from corpusspark.functions import fixed_values as V
from corpusspark.functions.terms import CODE_STOPWORD_PATTERN, longest_first

from .sql import CJK_RUN, arr, cte, grams, has_any, keep_order, lit, query

# ---- tokens and terms ----------------------------------------------------------------------------------
IS_CJK = f"regexp_full_match(run, '{CJK_RUN}')"


def tokens_of(source: str) -> str:
    return f"""
select query_id, {keep_order('raw_tokens')} as tokens from (
  select query_id, flatten(list_transform(regexp_extract_all(query, '[a-zA-Z0-9_-]+|{CJK_RUN}'), lambda run:
    case when {IS_CJK} then [run] || {grams('run', 4)} || {grams('run', 3)} || {grams('run', 2)} else [lower(run)] end)) as raw_tokens
  from {source}) t"""


def topic_terms_of(source: str) -> str:
    stops = arr(longest_first(V.CJK_TOPIC_STOPWORDS))
    compounds, aliases = arr(longest_first(V.CJK_TOPIC_COMPOUNDS)), arr(V.CODE_SEARCH_ALIASES)
    alias_hits = f"list_filter({aliases}, lambda al: al <> part and contains(part, al))"
    known = f"({keep_order('known0')})"
    return f"""
select query_id, {keep_order('all_terms')} as topic_terms from (
  select query_id, flatten(list(terms order by run_no, part_no)) as all_terms from (
    select query_id, run_no, part_no,
      case when part is null then ascii_terms
           when length(part) <= 4 then [part] || aliases0
           else (case when length(part) <= 8 then [part] else [] end)
                || (case when len(known0) > 0 then {known} else {grams('part', 4)} || {grams('part', 3)} end) end as terms
    from (select query_id, run_no, part_no, part, ascii_terms, {alias_hits} as aliases0,
                 list_filter({compounds}, lambda co: contains(part, co)) || {alias_hits} as known0
          from (select query_id, run_no, 0 as part_no, cast(null as varchar) as part,
                       case when lower(run) not in ({', '.join(lit(w) for w in V.ALNUM_TOPIC_STOPWORDS)}) and length(run) >= 2 then [lower(run)] else [] end as ascii_terms
                from {source}_runs where not {IS_CJK}
                union all
                select query_id, run_no, generate_subscripts(parts, 1), unnest(parts), []
                from (select query_id, run_no, list_filter(regexp_split_to_array(trim(list_reduce({stops}, lambda acc, st: replace(acc, st, ' '), run)), ' +'), lambda pp: length(pp) >= 2) as parts
                      from {source}_runs where {IS_CJK}) c) p) k) g
  group by query_id) o"""


def code_terms_of(source: str) -> str:
    variant = " || ".join(
        ["[part]"] + [f"(case when length(part) > {n} then {grams('part', n)} else [] end)" for n in (4, 3, 2)]
    )
    return f"""
select query_id, {keep_order('all_terms')} as code_topic_terms from (
  select query_id, flatten(list(terms order by run_no)) as all_terms from (
    select query_id, run_no,
      case when {IS_CJK} then flatten(list_transform(list_filter(string_split(regexp_replace(run, {lit(CODE_STOPWORD_PATTERN)}, ' ', 'g'), ' '), lambda pp: length(pp) >= 2), lambda part: {variant}))
           when lower(run) in ({', '.join(lit(w) for w in V.CODE_TOPIC_STOPWORDS_ALNUM)}) or length(run) < 3 then []
           else [lower(run)] end as terms
    from {source}_runs) t group by query_id) o"""


for _src in ("m_queries", "m_user_queries"):
    cte(f"{_src}_runs", f"""
select query_id, generate_subscripts(runs, 1) as run_no, unnest(runs) as run
from (select query_id, regexp_extract_all(query, '[A-Za-z][A-Za-z0-9_-]*|{CJK_RUN}') as runs from {_src}) r""")
    cte(f"{_src}_tokens", tokens_of(_src))
    cte(f"{_src}_topics", topic_terms_of(_src))
    cte(f"{_src}_codeterms", code_terms_of(_src))
    lq = "lower(query)"
    nav = has_any(lq, V.CODE_NAVIGATION_HINTS)
    cte(f"{_src}_flags", f"""
select q.query_id, q.query, lower(q.query) as lowered_query, t.tokens,
  coalesce(tt.topic_terms, []) as topic_terms, coalesce(ct.code_topic_terms, []) as code_topic_terms,
  {has_any(lq, V.DATA_DICTIONARY_HINTS)} as wants_data_dictionary,
  {has_any(lq, V.SOURCE_HINTS)} or list_has_any(t.tokens, {arr(V.SOURCE_TOKEN_HINTS)}) as wants_source,
  {has_any(lq, V.REGULATION_HINTS)} as wants_regulation,
  {has_any(lq, V.CROSS_MODULE_HINTS)} as wants_cross_module,
  {nav} as wants_code_navigation,
  {nav} or {has_any(lq, V.CODE_KNOWLEDGE_HINTS)} as wants_code0,
  {has_any(lq, V.RUNTIME_BOUNDARY_QUERY_HINTS)} as wants_runtime_boundary
from {_src} q join {_src}_tokens t using (query_id) left join {_src}_topics tt using (query_id) left join {_src}_codeterms ct using (query_id)""")

USER_FEATURES = query("""
select query_id, array_to_string(tokens, '|') as tokens, array_to_string(topic_terms, '|') as topic_terms,
  array_to_string(code_topic_terms, '|') as code_topic_terms, wants_data_dictionary, wants_source, wants_regulation,
  wants_cross_module, wants_code_navigation, wants_code0 as wants_code_knowledge, wants_runtime_boundary
from m_user_queries_flags""")

# ---- module aliases ------------------------------------------------------------------------------------------
NON_SEGMENT = ", ".join(lit(v) for v in V.NON_MODULE_TOKENS + V.NON_MODULE_SEGMENTS)
NON_TOKEN = ", ".join(lit(v) for v in V.NON_MODULE_TOKENS)
cte("x_alias_values", f"""
select root_id, entry_pos, s as step, i as pos, v as value from (
  select root_id, entry_pos, 0 as s, generate_subscripts(p, 1) as i, unnest(p) as v
  from (select root_id, entry_pos, list_transform(string_split(path, '/'), lambda x: regexp_replace(x, '[.]md$', '')) as p from m_index_entries) a
  union all
  select root_id, entry_pos, 1, generate_subscripts(p, 1), unnest(p)
  from (select root_id, entry_pos, regexp_extract_all(title, '[A-Za-z0-9_-]+') as p from m_index_entries) b
  union all
  select root_id, entry_pos, 2, generate_subscripts(p, 1), unnest(p)
  from (select root_id, entry_pos, regexp_extract_all(summary, '[A-Za-z0-9_-]+') as p from m_index_entries) c) u
where (s = 0 and regexp_full_match(v, '[A-Za-z][A-Za-z0-9_-]{{1,15}}') and lower(v) not in ({NON_SEGMENT}) and (v = upper(v) or not contains(v, '-')))
   or (s > 0 and regexp_full_match(v, '[A-Z][A-Z0-9_-]{{1,11}}') and lower(v) not in ({NON_TOKEN}))""")
cte("x_aliases", """
select root_id, lower(value) as alias_key, arg_min(value, (entry_pos, step, pos)) as module,
  min(entry_pos) as entry_pos, min((entry_pos, step, pos)) as rank
from x_alias_values group by root_id, lower(value)""")

MODULE_ALIASES = query("select root_id, alias_key, module, entry_pos from x_aliases")

# ---- targets, modules, plan --------------------------------------------------------------------------------------
cte("x_targets0", """
select q.*, f.* exclude (query_id, query), r.root_id, r.priority,
  f.wants_code0 or (q.named_root is not null and r.is_code_root) as wants_code_knowledge
from m_queries q join m_queries_flags f on q.query_id = f.query_id
join m_roots r on r.enabled and (q.named_root is null or q.named_root = r.root_id)""")
cte("x_query_modules", """
select query_id, root_id, list(module order by rank) as modules from (
  select t.query_id, t.root_id, a.module, min(case when list_position(t.tokens, a.alias_key) > 0
      then (0, cast(list_position(t.tokens, a.alias_key) as bigint), 0, 0) else (1, a.rank[1], cast(a.rank[2] as int), cast(a.rank[3] as int)) end) as rank
  from x_targets0 t join x_aliases a on a.root_id = t.root_id
   and (list_contains(t.tokens, a.alias_key) or regexp_matches(t.lowered_query, '(^|[^a-z0-9])' || a.alias_key || '([^a-z0-9]|$)'))
  group by t.query_id, t.root_id, a.module) g
group by query_id, root_id""")
LQ = "lower(query)"
ATTRIBUTE = (
    f"({has_any(LQ, V.LIST_HINTS)} and not {has_any(LQ, V.IMPLEMENTATION_OVERRIDE_HINTS)} "
    f"and {has_any(LQ, [h.lower() for h in V.ENTITY_ATTRIBUTE_HINTS])} and not {has_any(LQ, V.APPLICATION_HINTS + V.CAPABILITY_HINTS)})"
)
cte("x_targets1", f"""
select t.*, coalesce(m.modules, []) as modules,
  coalesce(plan_operator, case
    when wants_code_knowledge and {has_any('query', V.LOCATE_PHRASES)} then 'LOCATE_IMPLEMENTATION'
    when wants_code_knowledge and {has_any('query', V.DESCRIBE_PHRASES)} then 'DESCRIBE_ENTITY'
    when wants_code_knowledge and {ATTRIBUTE} then 'LIST_ENTITY_ATTRIBUTE'
    when wants_code_knowledge and {has_any('query', V.CODE_IMPLEMENTATION_ACTION_HINTS)} then 'LOCATE_IMPLEMENTATION'
    when {has_any(LQ, V.COUNT_HINTS)} then 'COUNT_COLLECTION'
    when {ATTRIBUTE} then 'LIST_ENTITY_ATTRIBUTE'
    when {has_any(LQ, V.LIST_HINTS)} then 'LIST_COLLECTION' else 'DESCRIBE_ENTITY' end) as operator
from x_targets0 t left join x_query_modules m on m.query_id = t.query_id and m.root_id = t.root_id""")
cte("x_targets", f"""
select *, operator in ('LIST_COLLECTION', 'COUNT_COLLECTION') as is_collection, operator = 'LIST_ENTITY_ATTRIBUTE' as is_attribute,
  case when plan_operator is not null then plan_subject when len(modules) = 1 then modules[1] end as subject,
  coalesce(case when plan_operator is not null then plan_subject when len(modules) = 1 then modules[1] end, '') as scope,
  case when evidence_budget > 0 then evidence_budget when mode = 'exhaustive' then 30 else 8 end as budget
from x_targets1""")
QUERY_PLANS = query(f"""
select query_id, root_id, operator, scope, wants_code_knowledge, array_to_string(modules, '|') as modules,
  case when plan_operator is not null then 'provided' else 'deterministic_protocol_fallback' end as planner,
  case operator when 'COUNT_COLLECTION' then 'count' when 'LIST_COLLECTION' then 'list' when 'LIST_ENTITY_ATTRIBUTE' then 'list'
    when 'LOCATE_IMPLEMENTATION' then 'implementation_location' else 'descriptive' end as answer_shape,
  case when is_collection and plan_operator is null then case when {has_any(LQ, V.APPLICATION_HINTS)} then 'application'
    when {has_any(LQ, V.CAPABILITY_HINTS)} then 'capability' else 'member' end end as member_type,
  array_to_string(case when is_attribute and plan_operator is null then list_filter({arr(sorted(V.ENTITY_ATTRIBUTE_HINTS, key=lambda h: (-len(h), h)))}, lambda h: contains({LQ}, lower(h))) else [] end, '|') as attribute_terms,
  'feature_query' || case when wants_data_dictionary then '|data_dictionary_query' else '' end || case when wants_source then '|source_query' else '' end
    || case when wants_regulation then '|regulation_query' else '' end || case when wants_cross_module then '|cross_module_query' else '' end
    || case when wants_code_navigation then '|code_navigation_query' else '' end as intents
from x_targets""")

# ---- scores by brute force --------------------------------------------------------------------------------------------
BOUNDARY = has_any("lower(title) || ' ' || lower(summary) || ' ' || lower(path)", V.RUNTIME_BOUNDARY_PAGE_HINTS)
cte("x_entry_class", f"""
select *, lower(title) as lt, lower(summary) as ls, lower(path) as lp, contains(lower(path), 'features/') as c1, contains(lower(path), '/modules/') as c2,
  starts_with(lower(path), 'entities/code/features/') as cf, starts_with(lower(path), 'entities/code/modules/') as cm,
  {BOUNDARY} as cb, starts_with(lower(path), 'sources/') as cs, contains(lower(path), 'data-dictionary') as cd
from m_index_entries""")
cte("x_token_points", f"""
select t.query_id, t.root_id, e.entry_pos,
  sum(case when contains(e.lt, tok) then {V.W_TOKEN_TITLE} else 0 end + case when contains(e.ls, tok) then {V.W_TOKEN_SUMMARY} else 0 end
      + case when contains(e.lp, tok) then case when a.alias_key is not null then {V.W_MODULE_TOKEN_PATH} else {V.W_TOKEN_PATH} end else 0 end) as points
from (select query_id, root_id, unnest(tokens) as tok from x_targets) t join x_entry_class e on e.root_id = t.root_id
left join x_aliases a on a.root_id = t.root_id and a.alias_key = tok
where contains(e.lt || chr(10) || e.ls || chr(10) || e.lp, tok)
group by t.query_id, t.root_id, e.entry_pos""")
cte("x_scored", f"""
select t.query_id, t.root_id, e.entry_pos, e.path, e.title, e.summary, t.candidate_limit, 4 * (coalesce(p.points, 0)
  + case when t.lowered_query <> '' and contains(e.lt, t.lowered_query) then {V.W_QUERY_IN_TITLE} when t.lowered_query <> '' and contains(e.ls, t.lowered_query) then {V.W_QUERY_IN_SUMMARY} else 0 end
  + case when c1 then {V.W_FEATURES_PATH} else 0 end + case when c2 then {V.W_MODULES_PATH} else 0 end
  + case when wants_code_knowledge then
      case when wants_code_navigation and cm then {V.W_NAVIGATION_MODULE} when wants_code_navigation and cf then {V.W_NAVIGATION_FEATURE} when cf then {V.W_CODE_FEATURE} when cm then {V.W_CODE_MODULE} else 0 end
      + case when wants_runtime_boundary and cf and cb then {V.W_RUNTIME_BOUNDARY} else 0 end
    when cf then {V.W_PLAIN_CODE_FEATURE} when cm then {V.W_PLAIN_CODE_MODULE} else 0 end
  + case when cs and not wants_source then {V.W_UNREQUESTED_SOURCE} else 0 end + case when cd and not wants_data_dictionary then {V.W_UNREQUESTED_DICTIONARY} else 0 end) as score20
from x_targets t join x_entry_class e on e.root_id = t.root_id
left join x_token_points p on p.query_id = t.query_id and p.root_id = t.root_id and p.entry_pos = e.entry_pos""")
cte("x_top", """
select * from (select *, row_number() over (partition by query_id, root_id order by score20 desc, path, entry_pos) as pos from x_scored where score20 > 0) r
where pos <= case when candidate_limit > 0 then candidate_limit else 80 end""")
HITS = query("select query_id, root_id, pos, title, path, summary, score20 / 20.0::double as score, 'wiki/index.md' as source from x_top")
SCORE_TOPK = query("select query_id, root_id, pos, path, title, cast(score20 as bigint) as score20 from x_top")

# ---- candidates -----------------------------------------------------------------------------------------------------------
def role_of(path: str) -> str:
    return f"""case when starts_with({path}, 'sources/') then 'source' when contains({path}, '/data-dictionary/') then 'data_dictionary'
  when contains({path}, '/regulation/requirements/') then 'regulation_requirement' when contains({path}, '/solution/') then 'solution'
  when contains({path}, '/features/') then 'feature' when contains({path}, '/modules/') then 'module' when starts_with({path}, 'concepts/') then 'concept'
  when starts_with({path}, 'queries/') then 'query' else 'unknown' end"""


PAGE_ROLES = query(f"""
select root_id, 'wiki/' || path as path, {role_of('path')} as page_role,
  case {role_of('path')} when 'source' then 'source' when 'concept' then 'concept' when 'query' then 'query' else 'entity' end as type,
  starts_with(path, 'entities/code/features/') as code_feature, starts_with(path, 'entities/code/modules/') as code_module,
  starts_with(path, 'entities/code/modules/') and {has_any("lower(path) || ' ' || lower(title)", V.REPOSITORY_MAP_HINTS)} as repo_map
from m_index_entries""")

cte("x_page_modules", """
select root_id, path, list(module order by rank) as page_modules from (
  select e.root_id, e.path, a.module, min(case
      when list_contains(list_transform(string_split(e.path, '/'), lambda s: lower(regexp_replace(s, '[.]md$', ''))), a.alias_key)
        then (0, cast(list_position(list_transform(string_split(e.path, '/'), lambda s: lower(regexp_replace(s, '[.]md$', ''))), a.alias_key) as bigint), 0, 0)
      when e.texts and regexp_matches(e.lt, '(^|[^a-z0-9])' || a.alias_key || '([^a-z0-9]|$)') then (1, a.rank[1], cast(a.rank[2] as int), cast(a.rank[3] as int))
      when e.texts and regexp_matches(e.ls, '(^|[^a-z0-9])' || a.alias_key || '([^a-z0-9]|$)') then (2, a.rank[1], cast(a.rank[2] as int), cast(a.rank[3] as int)) end) as rank
  from (select root_id, path, lt, ls, true as texts from x_entry_class) e join x_aliases a on a.root_id = e.root_id
  where contains('/' || lower(e.path) || '/', a.alias_key) or contains(e.lt, a.alias_key) or contains(e.ls, a.alias_key)
  group by e.root_id, e.path, a.module) g
where rank is not null group by root_id, path""")
cte("x_cand", f"""
select c.query_id, c.root_id, c.pos, 'wiki/' || c.path as path, c.path as ipath, c.title, c.summary as index_summary, c.score20, coalesce(m.page_modules, []) as page_modules,
  {role_of('c.path')} as page_role, 'index.md' as source
from x_top c left join x_page_modules m on m.root_id = c.root_id and m.path = c.path""")
CANDIDATES = query("""
select c.query_id, c.root_id, c.pos, c.path, cast(c.score20 as bigint) as score20, page_role, coalesce(page_modules[1], '') as module, array_to_string(page_modules, '|') as page_modules,
  array_to_string(list_filter([
    case when len(t.modules) > 0 and list_has_any(page_modules, t.modules) then 'module_match' end,
    case when len(t.modules) > 0 and len(page_modules) > 0 and not list_has_any(page_modules, t.modules) then 'module_mismatch' end,
    'role:' || page_role,
    case when t.wants_code_navigation and starts_with(ipath, 'entities/code/modules/') then 'code_map_preferred' end,
    case when t.wants_code_knowledge and not t.wants_code_navigation and starts_with(ipath, 'entities/code/features/') then 'code_feature_preferred' end], lambda x: x is not null), '|') as signals,
  case when page_role = 'module' and t.wants_code_navigation then 'navigation_primary'
    when page_role = 'source' then case when t.wants_source then 'requested' else 'provenance_only' end
    when page_role = 'data_dictionary' then case when t.wants_data_dictionary then 'requested' else 'supporting' end
    when page_role = 'regulation_requirement' then case when t.wants_regulation then 'requested' else 'out_of_intent' end else 'primary' end as intent_fit,
  case when len(t.modules) = 0 then 'not_requested' when len(page_modules) = 0 then 'neutral' when list_has_any(page_modules, t.modules) then 'same_module' else 'module_mismatch' end as module_fit,
  case when page_role <> 'source' then 'normal' when t.wants_source then 'requested' else 'provenance_only' end as source_policy
from x_cand c join x_targets t on t.query_id = c.query_id and t.root_id = c.root_id""")

# ---- primaries: each rule as its own select, the first non-empty one wins ----------------------------------------------------
cte("x_ctx", f"""
select c.*, t.mode, t.include_source, t.include_cross_module, t.modules, t.wants_source, t.wants_data_dictionary, t.wants_regulation, t.wants_cross_module,
  t.wants_code_navigation as nav, t.wants_code_knowledge as code, t.code_topic_terms as terms, t.scope, t.is_collection, t.is_attribute, t.budget,
  list_has_any(c.page_modules, t.modules) as mq, t.scope <> '' and list_contains(c.page_modules, t.scope) as ms,
  page_role = 'feature' and starts_with(ipath, 'entities/code/features/') as cfeat, page_role = 'module' and starts_with(ipath, 'entities/code/modules/') as cmod,
  page_role = 'module' and starts_with(lower(ipath), 'entities/code/modules/') and {has_any("lower(path) || ' ' || lower(title)", V.REPOSITORY_MAP_HINTS)} as rmap,
  len(t.code_topic_terms) = 0 or len(list_filter(t.code_topic_terms, lambda w: contains(lower(title || ' ' || index_summary || ' ' || path), w))) > 0 as topic,
  case when page_role = 'feature' and starts_with(ipath, 'entities/code/features/') and t.wants_code_knowledge then -1
    when page_role = 'module' and starts_with(ipath, 'entities/code/modules/') and t.wants_code_navigation then -2
    when page_role = 'data_dictionary' and t.wants_data_dictionary then -2 when page_role = 'source' and t.wants_source then -2
    when page_role = 'feature' then 0 when page_role = 'module' then 2 when page_role = 'data_dictionary' then 4 when page_role = 'concept' then 6
    when page_role = 'solution' then 8 when page_role = 'regulation_requirement' then 10 when page_role = 'source' then 12 else 14 end as rr
from x_cand c join x_targets t on t.query_id = c.query_id and t.root_id = c.root_id""")
GATE = "(len(modules) = 1 and len(page_modules) > 0 and not mq and not (include_cross_module or wants_cross_module or mode = 'exhaustive'))"
REGULATED = "(page_role = 'regulation_requirement' and not (wants_regulation or mode = 'exhaustive'))"
cte("x_allowed", f"""
select *, not (page_role = 'source' and not (include_source or wants_source)) and not {REGULATED} and not {GATE} as allowed from x_ctx""")
G = "partition by query_id, root_id"
cte("x_p1", f"""
select *, allowed or not bool_or(allowed) over ({G}) as attr_base,
  case when bool_or(rmap) over ({G}) then rmap else cmod end as map_page,
  case when nav and bool_or(allowed and cmod) over ({G}) then allowed and cmod else allowed end as pool1,
  len(modules) = 1 and not include_cross_module and not wants_cross_module as gated
from x_allowed""")
cte("x_p2", f"""
select *, attr_base and page_role in ('feature', 'concept', 'query') as ent,
  attr_base and page_role in ('feature', 'concept', 'query') and (len(modules) = 0 or mq) as entm,
  bool_or(pool1 and mq) over ({G}) as has_same,
  case when gated and bool_or(pool1 and mq) over ({G}) then pool1 and mq else pool1 end as pool2,
  mode = 'focused' and code and not nav as topical
from x_p1""")
cte("x_p3", f"""
select *, case when bool_or(entm) over ({G}) then entm else ent end as own0,
  list(case when topical and pool2 and cfeat and topic then path end) filter (topical and pool2 and cfeat and topic) over ({G}) as topic_paths
from x_p2""")
cte("x_p4", f"""
select *, case when bool_or(own0 and cfeat and code) over ({G}) then own0 and cfeat and code else own0 end as own,
  pool2 and (coalesce(len(topic_paths), 0) = 0 or not cfeat or list_contains(topic_paths, path)) as pool3
from x_p3""")
cte("x_rules", f"""
select query_id, root_id, path, pos, 1 as rule_no from x_p4 where is_attribute and own
union all select query_id, root_id, path, pos, 2 from x_p4 where is_collection and scope = '' and code and map_page
union all select query_id, root_id, path, pos, 3 from x_p4 where topical and len(terms) = 0 and pool1 and cmod
union all select query_id, root_id, path, pos, 4 from x_p4 where gated and not has_same and code and map_page
union all select query_id, root_id, path, pos, 5 from x_p4 where is_collection and pool2 and page_role = 'module' and ms
union all select query_id, root_id, path, pos, 6 from x_p4 where pool3
union all select query_id, root_id, path, pos, 7 from x_p4""")
cte("x_first_rule", "select query_id, root_id, min(rule_no) as rule_no from x_rules group by query_id, root_id")
cte("x_ranked", f"""
select p.*, least(r.rule_no, 6) as rule_no,
  row_number() over (partition by p.query_id, p.root_id order by case when r.rule_no = 5 then 0 else rr end, score20 desc, p.path, p.pos) as rn
from x_rules r join x_first_rule f using (query_id, root_id, rule_no)
join x_p4 p on p.query_id = r.query_id and p.root_id = r.root_id and p.pos = r.pos""")
cte("x_seeded", f"""
select *, rn <= case when rule_no in (1, 6) then case mode when 'focused' then 1 when 'exhaustive' then 5 else 3 end else 1 end as seeded,
  first_value(case when cfeat then score20 end ignore nulls) over ({G} order by rn rows between unbounded preceding and unbounded following) as top_feature
from x_ranked""")
cte("x_extra", f"""
select *, topical and rule_no = 6 and not seeded and cfeat and topic and top_feature > 0 and top_feature - score20 <= {V.FOCUSED_FEATURE_GAP_20THS}
  and score20 * 100 >= top_feature * {V.FOCUSED_FEATURE_RATIO_PERCENT} as extra from x_seeded""")
cte("x_primaries", f"""
select *, row_number() over ({G} order by rn) as primary_pos from (
  select *, sum(extra::int) over ({G} order by rn) as extra_no from x_extra) e
where seeded or (extra and extra_no <= {V.FOCUSED_FEATURE_LIMIT - 1})""")
PRIMARIES = query("select query_id, root_id, primary_pos, path, rule_no, cast(score20 as bigint) as score20 from x_primaries")

# ---- links ---------------------------------------------------------------------------------------------------------------------
cte("x_pages", """
select root_id, path as ipath, 'wiki/' || path as repo_path, text, substr(text, instr(text, chr(10) || '---' || chr(10)) + 5) as body,
  regexp_extract(text, '\ntitle: "([^\n]*)"', 1) as title,
  case when regexp_matches(text, '^---\n(?:[^\n]*\n)*?type: ') then regexp_extract(text, '\ntype: ([a-z]+)\n', 1) else 'unknown' end as page_type
from m_page_texts""")
cte("x_raw_links", r"""
select root_id, repo_path as src, raw, step * 100000000 + no as link_pos, step from (
  select root_id, repo_path, 0 as step, generate_subscripts(l, 1) as no, unnest(l) as raw
  from (select root_id, repo_path, regexp_extract_all(body, '\[\[[^\]]+\]\]') as l from x_pages) a
  union all
  select root_id, repo_path, 1, generate_subscripts(l, 1), unnest(l)
  from (select root_id, repo_path, regexp_extract_all(body, '\[[^\]]+\]\([^)]+\)') as l from x_pages) b) u""")
cte("x_links0", r"""
select root_id, src, raw, link_pos, case when step = 0 then 'wikilink' else 'markdown' end as link_type,
  case when step = 0 then trim(split_part(raw[3:-3], '|', 1)) else trim(split_part(regexp_extract(raw, '\(([^)]+)\)$', 1), '#', 1)) end as target,
  case when step = 0 then case when contains(raw, '|') then trim(regexp_extract(raw, '\|(.*)\]\]$', 1)) else raw[3:-3] end
       else regexp_extract(raw, '^\[([^\]]+)\]', 1) end as label,
  case when step = 1 then nullif(regexp_extract(raw, '#([^)]*)\)$', 1), '') end as anchor
from x_raw_links""")
cte("x_links", """
select root_id, src, link_type, target, min(link_pos) as link_pos, arg_min(label, link_pos) as label, arg_min(coalesce(anchor, ''), link_pos) as anchor
from x_links0 where link_type = 'wikilink' or (target like '%.md' and not regexp_matches(lower(target), '^(https?://|mailto:|file:)'))
group by root_id, src, link_type, target""")


def resolve(source: str) -> str:
    """Targets beside the page, from the page folder, by name; '..' is removed step by step."""
    return rf"""
select l.*, coalesce(b.repo_path, r.repo_path, n.repo_path) as dst from (
  select *, case when target like '%.md' then target else target || '.md' end as file,
    regexp_replace(src, '/[^/]*$', '') as dir, length(target) - length(replace(target, '../', '')) as ups
  from {source}) l
left join x_pages b on b.root_id = l.root_id and b.repo_path =
  array_to_string(string_split(l.dir, '/')[1:len(string_split(l.dir, '/')) - l.ups // 3], '/') || '/' || replace(l.file, '../', '')
left join x_pages r on r.root_id = l.root_id and l.target like '%.md' and r.repo_path = 'wiki/' || l.file
left join (select root_id, regexp_extract(repo_path, '[^/]+$') as name, min(repo_path) as repo_path from x_pages group by all) n
  on n.root_id = l.root_id and not l.target like '%.md' and n.name = l.file"""


cte("x_resolved_all", resolve("x_links"))
LINKS_EXTRACT = query("select root_id, src, link_type, target, label, anchor, dst from x_resolved_all")
cte("x_expand0", f"""
select * from (select p.query_id, p.root_id, p.path as src, p.score20 as src_score, l.target, l.link_type, l.label, l.anchor,
    row_number() over (partition by p.query_id, p.root_id order by p.primary_pos, l.link_pos) as link_no
  from x_primaries p join (select root_id, src, target, min(link_pos) as link_pos, arg_min(link_type, link_pos) as link_type, arg_min(label, link_pos) as label, arg_min(anchor, link_pos) as anchor
                           from x_links group by root_id, src, target) l on l.root_id = p.root_id and l.src = p.path) e
where link_no <= {V.LINK_LIMIT}""")
cte("x_expand", resolve("x_expand0"))
EXPANSION = query("""
select query_id, root_id, link_no, src, target, link_type, label, anchor, dst, case when dst is null then 'broken' else 'resolved' end as status from x_expand""")

# ---- evidence --------------------------------------------------------------------------------------------------------------------
cte("x_linked_modules", """
select root_id, repo_path, list(module order by p) as page_modules from (
  select x.root_id, x.repo_path, a.module, min(list_position(x.segs, a.alias_key)) as p
  from (select root_id, repo_path, list_transform(string_split(ipath, '/'), lambda s: lower(regexp_replace(s, '[.]md$', ''))) as segs from x_pages) x
  join x_aliases a on a.root_id = x.root_id and list_contains(x.segs, a.alias_key) group by all) g group by all""")
cte("x_merged0", f"""
select query_id, root_id, 0 as step, pos as p, path, ipath, title, index_summary, score20, page_modules, page_role, source,
  case page_role when 'source' then 'source' when 'concept' then 'concept' when 'query' then 'query' else 'entity' end as type from x_cand
union all
select e.query_id, e.root_id, 1, e.link_no, e.dst, g.ipath, g.title, left(trim(regexp_replace(g.body, '\\s+', ' ', 'g')), 240), cast(e.src_score * 3 // 4 as bigint), coalesce(m.page_modules, []),
  {role_of('g.ipath')}, e.link_type || ':' || e.src, g.page_type
from x_expand e join x_pages g on g.root_id = e.root_id and g.repo_path = e.dst left join x_linked_modules m on m.root_id = e.root_id and m.repo_path = e.dst""")
cte("x_merged", """
select * exclude (p, step, dup), row_number() over (partition by query_id, root_id order by step, p) as pos
from (select *, row_number() over (partition by query_id, root_id, path order by step, p) as dup from x_merged0) d where dup = 1""")
cte("x_ectx", f"""
select c.*, t.mode, t.include_source, t.include_cross_module, t.modules, t.wants_source, t.wants_data_dictionary, t.wants_regulation, t.wants_cross_module,
  t.wants_code_navigation as nav, t.wants_code_knowledge as code, t.scope, t.is_collection, t.is_attribute, t.budget, t.operator,
  list_has_any(c.page_modules, t.modules) as mq, t.scope <> '' and list_contains(c.page_modules, t.scope) as ms,
  c.page_role = 'feature' and starts_with(c.ipath, 'entities/code/features/') as cfeat, c.page_role = 'module' and starts_with(c.ipath, 'entities/code/modules/') as cmod,
  c.page_role = 'module' and starts_with(lower(c.ipath), 'entities/code/modules/') and {has_any("lower(c.path) || ' ' || lower(c.title)", V.REPOSITORY_MAP_HINTS)} as rmap,
  p.primary_pos, l.first_link,
  case when c.page_role = 'feature' and starts_with(c.ipath, 'entities/code/features/') and t.wants_code_knowledge then -1
    when c.page_role = 'feature' then 0 when c.page_role = 'concept' then 6 else 14 end as rr
from x_merged c join x_targets t on t.query_id = c.query_id and t.root_id = c.root_id
left join x_primaries p on p.query_id = c.query_id and p.root_id = c.root_id and p.path = c.path
left join (select query_id, root_id, dst as path, min(link_no) as first_link from x_expand where dst is not null group by all) l
  on l.query_id = c.query_id and l.root_id = c.root_id and l.path = c.path""")
cte("x_owner_pool", """
select query_id, root_id, path, rr, score20, src from (
  select *, min(src) over (partition by query_id, root_id) as best from (
    select *, 1 as src from x_ectx where is_attribute and primary_pos is not null and page_role in ('feature', 'concept', 'query')
    union all select *, 2 from x_ectx where is_attribute and page_role in ('feature', 'concept', 'query')) u) v where src = best""")
cte("x_attr_owner", """
select query_id, root_id, arg_min(path, (not pref1, not pref2, rr, -score20, path)) as path from (
  select o.*, (len(e.modules) = 0 or e.mq) as pref1, (e.cfeat and e.code) as pref2
  from x_owner_pool o join x_ectx e using (query_id, root_id, path)) x group by query_id, root_id""")
ADDITIONAL = f"""(mode in ('balanced', 'exhaustive') and not (page_role = 'source' and not (include_source or wants_source or mode = 'exhaustive')) and not {REGULATED} and not {GATE})"""
cte("x_map_pool", f"""
select *, case when bool_or(rmap) over ({G}) then rmap else cmod end as map_page from x_ectx""")
LINK_ROLE = "case when page_role = 'source' and not wants_source then 'provenance' else 'supporting' end"
cte("x_stages", f"""
select query_id, root_id, path, 0 as stage, (-score20, path, 0) as o, 'primary' as evidence_role, 'collection_owner_page' as selection_reason from x_ectx where is_collection and page_role = 'module' and ms
union all select query_id, root_id, path, 0, (0, '', primary_pos), 'primary', case when page_role = 'module' then 'collection_owner_page' else 'top_relevant_primary_page' end
  from (select *, bool_or(page_role = 'module' and ms) over ({G}) as has_owner from x_ectx where is_collection) c where not has_owner and primary_pos is not null
union all select query_id, root_id, path, 1, (-score20, path, 0), 'supporting', 'collection_member_evidence' from x_ectx where is_collection and page_role = 'feature' and ms
union all select query_id, root_id, path, 0, (0, '', 0), 'primary', 'entity_attribute_owner_page' from x_attr_owner
union all select query_id, root_id, path, 0, (0, '', primary_pos), 'primary', 'top_relevant_primary_page' from x_ectx where not is_collection and not is_attribute and primary_pos is not null
union all select query_id, root_id, path, 1, (0, '', first_link), {LINK_ROLE}, 'explicit_link_from_primary_evidence' from x_ectx where not is_collection and first_link is not null
union all select query_id, root_id, path, 2, (0, '', pos), 'supporting', 'additional_ranked_candidate' from x_ectx where not is_collection and not is_attribute and {ADDITIONAL}
union all select query_id, root_id, arg_min(path, pos), 3, (0, '', 0), 'supporting', 'code_map_fallback_for_exploration' from x_map_pool
  where map_page and code and not is_collection and (is_attribute or (primary_pos is null and first_link is null and not {ADDITIONAL})) group by query_id, root_id""")
cte("x_evidence", f"""
select d.query_id, d.root_id, row_number() over (partition by d.query_id, d.root_id order by stage, o) as evidence_pos, d.path, e.title, e.type, e.page_role,
  coalesce(e.page_modules[1], '') as module, e.score20, d.evidence_role, d.selection_reason, e.budget
from (select *, row_number() over (partition by query_id, root_id, path order by stage, o) as dup from x_stages) d
join x_ectx e using (query_id, root_id, path) where d.dup = 1
qualify evidence_pos <= e.budget""")
EVIDENCE = query("""
select query_id, root_id, evidence_pos, path, page_role, module, cast(score20 as bigint) as score20, evidence_role, selection_reason from x_evidence""")
STATUS = query("""
select c.query_id, c.root_id, c.path, c.source, c.page_role, cast(c.score20 as bigint) as score20, case when e.path is null then 'omitted' else 'selected' end as selection_status
from x_merged c left join x_evidence e on e.query_id = c.query_id and e.root_id = c.root_id and e.path = c.path""")
cte("x_omitted", """
select c.query_id, c.root_id, c.pos, c.path, c.title, c.score20, c.page_role, coalesce(c.page_modules[1], '') as module,
  case when len(modules) = 1 and len(page_modules) > 0 and not mq and not wants_cross_module then 'module_mismatch'
    when c.page_role = 'source' and not wants_source then 'source_page_not_requested'
    when c.page_role = 'regulation_requirement' and not wants_regulation then 'regulation_intent_not_requested'
    when c.page_role = 'data_dictionary' and not wants_data_dictionary then 'data_dictionary_not_requested'
    when mode = 'focused' then 'not_selected_for_focused_evidence' else 'evidence_budget_or_lower_rank' end as reason
from x_ectx c left join x_evidence e on e.query_id = c.query_id and e.root_id = c.root_id and e.path = c.path
where c.source = 'index.md' and e.path is null""")
OMITTED = query("select query_id, root_id, pos, path, cast(score20 as bigint) as score20, page_role, module, reason from x_omitted")
cte("x_coverage", f"""
select t.query_id, t.root_id, t.operator, t.scope, t.subject,
  coalesce(list(c.path order by c.score20 desc, c.path) filter (c.page_role = 'module'), []) as owner_pages,
  coalesce(list(c.path order by c.score20 desc, c.path) filter (c.page_role = 'feature'), []) as member_paths,
  coalesce(list(c.path order by c.score20 desc, c.path) filter (c.page_role = 'feature' and e.path is not null), []) as evidence_member_paths
from x_targets t left join (
  select query_id, root_id, path, page_role, max(score20) as score20 from (
    select query_id, root_id, path, page_role, score20 from x_ectx where ms and page_role in ('module', 'feature')
    union all
    select t.query_id, t.root_id, 'wiki/' || m.path, {role_of('m.path')} as page_role, 0 from x_targets t join x_page_modules m on m.root_id = t.root_id and t.scope <> '' and list_contains(m.page_modules, t.scope)) u
  where page_role in ('module', 'feature') group by all) c on c.query_id = t.query_id and c.root_id = t.root_id
left join x_evidence e on e.query_id = c.query_id and e.root_id = c.root_id and e.path = c.path
where t.is_collection group by all""")
COVERAGE = query("""
select query_id, root_id, operator, scope, array_to_string(owner_pages, '|') as owner_pages, array_to_string(member_paths, '|') as member_paths,
  array_to_string(evidence_member_paths, '|') as evidence_member_paths, len(owner_pages) > 0 and len(member_paths) > 0 as complete from x_coverage""")
