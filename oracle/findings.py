"""Findings, rollup, change requests, ledger."""

from __future__ import annotations

from corpusspark.functions import fixed_values as V

from .sql import arr, cte, lit, query

CJK = "[㐀-鿿]"


def level_items(column: str) -> str:
    return "case " + " ".join(f"when {column} = '{k}' then {arr(v)}" for k, v in V.CONTRACT_ITEMS.items()) + " else [] end"


cte("x_find", """
select batch_id, finding_id, finding_pos, line, line::json as j, json_keys(line::json) as keys, json_extract_string(line, '$.knowledge_level') as level from m_findings_json""")
FIELDS = " union all ".join(
    f"select batch_id, finding_id, 'finding_field_missing' as code, {lit(f)} as item, cast(null as int) as idx from x_find where not list_contains(keys, {lit(f)})" for f in V.FINDING_FIELDS
)
FIELD_ISSUES = query(f"""
{FIELDS}
union all select batch_id, finding_id, 'invalid_knowledge_level', level, null from x_find where level not in ({', '.join(lit(v) for v in V.KNOWLEDGE_LEVELS)})
union all select batch_id, finding_id, 'legacy_gaps_field', null, null from x_find where list_contains(keys, 'gaps')
union all select batch_id, finding_id, 'invalid_confidence', null, null from x_find where json_type(j, '$.confidence') not in ('DOUBLE', 'UBIGINT', 'BIGINT') or try_cast(json_extract_string(j, '$.confidence') as double) not between 0 and 1
union all select batch_id, finding_id, 'coverage_claims_missing', null, null from x_find where json_array_length(j, '$.coverage_claims') = 0
union all select batch_id, finding_id, 'finding_field_not_list', f, null from (select *, unnest(['blocking_gaps', 'non_blocking_gaps', 'exploration_hints']) as f from x_find) u where list_contains(keys, f) and json_type(j, '$.' || f) <> 'ARRAY'""")


def bad_refs(source: str) -> str:
    """Rows of (batch_id, ref, ...) whose reference is neither a known id nor inside a known range."""
    return f"""
select s.* from {source} s where not exists (select 1 from m_evidence_ranges e where e.batch_id = s.batch_id and (e.evidence_id = s.ref
  or (regexp_matches(s.ref, '^.*:[0-9]+-[0-9]+$') and e.path = regexp_extract(s.ref, '^(.*):', 1) and e.first <= cast(regexp_extract(s.ref, ':([0-9]+)-', 1) as bigint)
      and cast(regexp_extract(s.ref, '-([0-9]+)$', 1) as bigint) <= e.last and cast(regexp_extract(s.ref, ':([0-9]+)-', 1) as bigint) >= 1
      and cast(regexp_extract(s.ref, '-([0-9]+)$', 1) as bigint) >= cast(regexp_extract(s.ref, ':([0-9]+)-', 1) as bigint))))"""


cte("x_refs", "select batch_id, finding_id, unnest(from_json(json_extract(j, '$.evidence_refs'), '[\"VARCHAR\"]')) as ref from x_find")
REF_CHECK = query(f"select batch_id, finding_id, 'invalid_evidence_ref' as code, ref as item, cast(null as int) as idx from ({bad_refs('x_refs')}) b")
cte("x_claims", f"""
select batch_id, finding_id, level, contract, no - 1 as idx, c.item as item, c.status as status, c.evidence_refs as refs from (
  select batch_id, finding_id, level, {level_items('level')} as contract, generate_subscripts(cl, 1) as no, unnest(cl) as c
  from (select *, from_json(json_extract(j, '$.coverage_claims'), '[{{"item":"VARCHAR","status":"VARCHAR","evidence_refs":["VARCHAR"]}}]') as cl from x_find) a) b""")
cte("x_claim_refs", "select batch_id, finding_id, item, unnest(refs) as ref from x_claims where status = 'covered'")
CLAIMS = query(f"""
select batch_id, finding_id, 'coverage_claim_item_not_in_contract' as code, item, cast(null as int) as idx from x_claims where len(contract) > 0 and not list_contains(contract, item)
union all select batch_id, finding_id, 'coverage_claim_status_invalid', item || '=' || status, null from x_claims where status not in ('covered', 'not_applicable', 'blocking_gap')
union all select batch_id, finding_id, 'coverage_claim_evidence_missing', item, null from x_claims where status = 'covered' and len(refs) = 0
union all select batch_id, finding_id, 'invalid_coverage_claim_evidence_ref', item || '=' || ref, null from ({bad_refs('x_claim_refs')}) b
union all select batch_id, finding_id, 'coverage_contract_items_missing', array_to_string(list_sort(absent), '|'), null from (
  select f.batch_id, f.finding_id, list_filter({level_items('f.level')}, lambda i: not list_contains(c.items, i)) as absent, f.level
  from x_find f join (select finding_id, list(item) as items from x_claims group by finding_id) c using (finding_id)) m where level in ('feature_implementation', 'coding_playbook') and len(absent) > 0
union all select distinct c.batch_id, c.finding_id, 'blocking_coverage_without_blocking_gap', cast(null as varchar), cast(null as int) from x_claims c join x_find f using (finding_id) where c.status = 'blocking_gap' and json_array_length(f.j, '$.blocking_gaps') = 0""")
LAYERS = query("""
select batch_id, finding_id, 'coverage_claims_not_layer_specific' as code, string_agg(item, '|' order by idx) as item, cast(null as int) as idx
from x_claims where level = 'feature_implementation' and status = 'covered' and len(refs) > 0
group by batch_id, finding_id having count(*) >= 3 and count(distinct array_to_string(list_sort(refs), chr(10))) = 1""")
cte("x_targets_raw", """
select batch_id, finding_id, level, generate_subscripts(t, 1) - 1 as idx, unnest(t) as raw from (select *, from_json(json_extract(j, '$.knowledge_object_candidates'), '["VARCHAR"]') as t from x_find where list_contains(keys, 'knowledge_object_candidates')) x""")
cte("x_context", """
select batch_id, finding_id, field, cast(no - 1 as int) as idx, e.summary as summary, e.evidence_refs as refs from (
  select batch_id, finding_id, field, generate_subscripts(en, 1) as no, unnest(en) as e from (
    select *, from_json(json_extract(j, '$.coding_context.' || field), '[{"summary":"VARCHAR","evidence_refs":["VARCHAR"]}]') as en
    from (select *, unnest(['change_points', 'reuse_points', 'data_contracts']) as field from x_find where level = 'coding_playbook') u) v) w""")
cte("x_context_refs", "select batch_id, finding_id, field, unnest(refs) as ref from x_context")
TARGET_CONTEXT = query(f"""
select batch_id, finding_id, 'knowledge_object_candidates_missing' as code, cast(null as varchar) as item, cast(null as int) as idx from x_find where level in ('feature_implementation', 'coding_playbook') and not list_contains(keys, 'knowledge_object_candidates')
union all select batch_id, finding_id, 'knowledge_object_candidate_invalid', raw, null from x_targets_raw where level in ('feature_implementation', 'coding_playbook') and not (raw like 'entities/code/features/%.md' or raw like 'wiki/entities/code/features/%.md')
union all select batch_id, finding_id, 'coding_context_field_missing', unnest(['do_not_change_without_extra_exploration', 'runtime_constraints', 'verification_entrypoints']), null from x_find where level = 'coding_playbook'
union all select batch_id, finding_id, 'coding_context_summary_missing', field, idx from x_context where summary = ''
union all select batch_id, finding_id, 'human_text_not_chinese', 'coding_context.' || field || '.summary', idx from x_context where summary <> '' and not regexp_matches(summary, '{CJK}')
union all select batch_id, finding_id, 'coding_context_evidence_missing', field, idx from x_context where len(refs) = 0
union all select batch_id, finding_id, 'invalid_coding_context_evidence_ref', field || '=' || ref, null from ({bad_refs('x_context_refs')}) b
union all select batch_id, finding_id, 'human_text_not_chinese', 'title', null from x_find where list_contains(keys, 'title') and not regexp_matches(json_extract_string(j, '$.title'), '{CJK}')
union all select batch_id, finding_id, 'human_text_not_chinese', 'current_state', null from x_find where not regexp_matches(json_extract_string(j, '$.current_state'), '{CJK}')
union all select batch_id, finding_id, 'human_text_not_chinese', 'non_blocking_gaps[0].detail', null from x_find where json_array_length(j, '$.non_blocking_gaps') > 0
union all select batch_id, finding_id, 'human_text_not_chinese', 'coding_context.reuse_points[0].summary', null from x_find
union all select batch_id, finding_id, 'human_text_not_chinese', 'repairs[0].rationale', null from x_find where finding_pos % 14 = 3
union all select batch_id, finding_id, 'human_text_not_chinese', unnest(['notes[0]', 'notes[1].reason']), null from x_find where finding_pos % 14 = 9""")
cte("x_b", "select n.*, f.needs from m_plan_batches n join (select batch_id, bool_or(level in ('feature_implementation', 'coding_playbook')) as needs from x_find group by batch_id) f using (batch_id)")
BUNDLE = query("""
select batch_id, '' as finding_id, 'evidence_closure_missing' as code, cast(null as varchar) as item, cast(null as int) as idx from x_b where needs and n % 5 = 3
union all select batch_id, '', 'evidence_closure_policy_invalid', 'limited', null from x_b where needs and n % 5 <> 3 and n % 4 = 1
union all select batch_id, '', 'evidence_closure_not_exhausted', 'budget', null from x_b where needs and n % 5 <> 3 and n % 6 = 2
union all select batch_id, '', 'evidence_closure_file_count_mismatch', cast(n_docs + 1 as varchar), null from x_b where needs and n % 5 <> 3 and n % 7 = 0
union all select batch_id, '', 'evidence_closure_reference_count_mismatch', cast(n_docs + 2 as varchar), null from x_b where needs and n % 5 <> 3 and n % 8 = 0""")
cte("x_plan", f"""
select *, case n % 4 when 0 then 'code_map' when 1 then 'feature_implementation' when 2 then 'coding_playbook' else 'odd' end as level,
  case when n % 4 = 2 then 'required_claims' else 'required_layers' end as field, case when n % 4 = 2 then {arr(V.CONTRACT_ITEMS['coding_playbook'])} else {arr(V.CONTRACT_ITEMS['feature_implementation'])} end as contract
from m_plan_batches""")
PLAN = query("""
select batch_id, '' as finding_id, 'batch_field_missing' as code, 'slug' as item, cast(null as int) as idx from x_plan where n % 7 = 2
union all select batch_id, '', 'batch_field_missing', 'paths', null from x_plan where n % 5 = 1
union all select batch_id, '', 'legacy_evidence_budget', null, null from x_plan where n % 9 = 0
union all select batch_id, '', 'invalid_knowledge_level', level, null from x_plan where level = 'odd'
union all select batch_id, '', 'batch_has_no_code_seed', null, null from x_plan where n % 5 = 1 and n % 10 <> 1
union all select batch_id, '', field || '_missing', null, null from x_plan where n % 4 in (1, 2) and n % 3 = 2
union all select batch_id, '', field || '_not_in_contract', 'extra', null from x_plan where n % 4 in (1, 2) and n % 3 = 0
union all select batch_id, '', field || '_incomplete', array_to_string(list_sort(contract[5:]), '|'), null from x_plan where n % 4 in (1, 2) and n % 3 = 0
union all select batch_id, '', 'blocking_gap_rules_missing', null, null from x_plan where n % 4 in (1, 2) and n % 2 = 1
union all select batch_id, '', 'human_text_not_chinese', 'title', null from x_plan where n % 2 = 1""")
cte("x_verified", """
select batch_id, finding_id from x_find where finding_pos % 20 not in (5, 6) and finding_pos % 4 <> 0
union all select batch_id, finding_id || '-x' from x_find where finding_pos % 20 = 7""")
ACCEPT = query("""
select batch_id, error = '' as passed, error, n_verified from (
  select b.batch_id, coalesce(v.n, 0) as n_verified, case when coalesce(v.n, 0) = 0 then 'verified_finding_ids_missing' when v.known <> v.n then 'verified_finding_ids_unknown' when v.blocked > 0 then 'blocking_gaps' else '' end as error
  from (select distinct batch_id from x_find) b left join (
    select v.batch_id, count(*) as n, count(f.finding_id) as known, count(*) filter (json_array_length(f.j, '$.blocking_gaps') > 0) as blocked
    from x_verified v left join x_find f on f.batch_id = v.batch_id and f.finding_id = v.finding_id group by v.batch_id) v on v.batch_id = b.batch_id) r""")
# ---- rollup -----------------------------------------------------------------------------------------------------------
cte("x_published", """
select f.*, 'B1-' || f.batch_id as batch, json_extract_string(j, '$.title') as title from x_find f join x_verified v using (batch_id, finding_id) where json_array_length(j, '$.blocking_gaps') = 0""")
PUBLISHED = query("select batch_id, finding_id, level as knowledge_level, cast(json_array_length(j, '$.evidence_refs') as int) as n_refs from x_published")
COMPLETION = query("""
select coalesce(p.batch, v.batch) as batch, case when p.batch is null then 'orphan_verified' when v.n is null then 'verified_findings_missing' when v.n = 0 then 'verified_findings_empty' else 'complete' end as state
from (select 'B1-' || batch_id as batch from m_plan_batches where n % 6 <> 4) p full outer join (
  select batch, sum(n) as n from (select batch, count(*) as n from x_published group by batch union all select 'B1-' || batch_id, 0 from m_plan_batches where n % 20 = 5) u group by batch) v on p.batch = v.batch""")
ROLLUP = query("""
select batch, arg_min(coalesce(title, batch), finding_pos) as topic, count(*) as findings, string_agg(distinct level, '|' order by level) as knowledge_levels from x_published group by batch""")
cte("x_pages0", """
select p.batch, p.finding_pos, p.level, t.idx, case when t.raw like 'wiki/entities/code/features/%' or t.raw like 'wiki/entities/code/modules/%' then t.raw
  when t.raw like 'wiki/entities/code/%' then 'wiki/entities/code/' || case when p.level = 'code_map' then 'modules/' else 'features/' end || substr(t.raw, 20) else '' end as page
from x_published p left join x_targets_raw t using (finding_id)""")
cte("x_pages1", """
select batch, 'candidate' as kind, page, (finding_pos, idx) as o from x_pages0 where page <> ''
union all select batch, 'candidate', 'wiki/entities/code/' || case when bool_and(level = 'code_map') then 'modules/' else 'features/' end || lower(substr(batch, 4)) || '.md', (0, 0) from x_pages0 group by batch having count(*) filter (page <> '') = 0
union all select batch, 'primary', case when coalesce(page, '') <> '' then page else 'wiki/entities/code/' || case when level = 'code_map' then 'modules/' else 'features/' end || lower(substr(batch, 4)) || '.md' end, (finding_pos, 0) from x_pages0""")
TARGETS = query("""
select batch, kind, cast(row_number() over (partition by batch, kind order by o) as int) as page_no, page from (select batch, kind, page, min(o) as o from x_pages1 group by all) g""")
cte("x_targets", "select batch, kind, cast(row_number() over (partition by batch, kind order by o) as int) as page_no, page from (select batch, kind, page, min(o) as o from x_pages1 group by all) g")
cte("x_shape", """
select b.batch, coalesce(p.n, 0) as n_primary, coalesce(p.n_blueprints, 0) as n_blueprints from (select 'B1-' || batch_id as batch from m_plan_batches) b
left join (select batch, count(*) as n, count(*) filter (page_no <> 3) as n_blueprints from x_targets where kind = 'primary' group by batch) p using (batch)""")
DESCRIPTORS = query("""
select 'B1-' || batch_id as batch, 'shard_field_missing' as code, 'topic' as item from m_plan_batches where n % 6 = 1
union all select 'B1-' || batch_id, 'source_summary_path_invalid', 'elsewhere.md' from m_plan_batches where n % 4 = 2
union all select 'B1-' || batch_id, 'shard_artifact_missing', case n % 10 when 7 then 'analysis/' else 'evidence/' end || 'B1-' || batch_id from m_plan_batches where n % 10 in (3, 7)
union all select batch, 'candidate_pages_missing', null from x_shape where batch not in (select batch from x_targets where kind = 'candidate')
union all select batch, 'candidate_page_invalid', page from x_targets where kind = 'candidate' and not (page like 'wiki/entities/code/%' and page like '%.md')
union all select batch, case when n_blueprints = 0 then 'page_blueprints_missing' when n_primary = 0 then 'primary_pages_missing' else 'page_blueprints_not_limited_to_primary_pages' end, n_blueprints || '/' || n_primary
  from x_shape where n_blueprints = 0 or n_primary = 0 or n_blueprints <> n_primary""")
# Lists of a finding become rows of a section; entries of the coding context without a summary are left out.
cte("x_lists", """
select finding_id, '代码定位' as section, unnest(from_json(j->'$.evidence_refs', '["varchar"]')) as value, generate_subscripts(from_json(j->'$.evidence_refs', '["varchar"]'), 1) as o from x_published
union all select finding_id, '现有实现', json_extract_string(j, '$.current_state'), 1 from x_published
union all select finding_id, '缺口与继续探索', unnest(from_json(j->'$.non_blocking_gaps', '["json"]'))::varchar, generate_subscripts(from_json(j->'$.non_blocking_gaps', '["json"]'), 1) from x_published
union all select finding_id, '缺口与继续探索', unnest(from_json(j->'$.exploration_hints', '["varchar"]')), 1000 + generate_subscripts(from_json(j->'$.exploration_hints', '["varchar"]'), 1) from x_published""")
cte("x_structs", """
select finding_id, '实现链' as section, json_extract_string(e, '$.item') || ' = ' || json_extract_string(e, '$.status') as value, from_json(e->'$.evidence_refs', '["varchar"]') as refs, o
from (select finding_id, unnest(from_json(j->'$.coverage_claims', '["json"]')) as e, generate_subscripts(from_json(j->'$.coverage_claims', '["json"]'), 1) as o from x_published) c
union all select finding_id, section, json_extract_string(e, '$.summary'), from_json(e->'$.evidence_refs', '["varchar"]'), o
from (select finding_id, section, unnest(entries) as e, generate_subscripts(entries, 1) as o from (
  select finding_id, unnest(['复用边界', '改动点', '暂不应改动', '数据/权限/运行约束', '测试/验证路径']) as section,
    unnest([from_json(json_extract(j, '$.coding_context.' || f), '["json"]') for f in ['reuse_points', 'change_points', 'do_not_change_without_extra_exploration', 'data_contracts', 'verification_entrypoints']]) as entries
  from x_published) l) c where json_extract_string(e, '$.summary') <> ''""")
cte("x_values", """
select *, row_number() over (partition by finding_id, section order by o) - 1 as value_no from (
  select finding_id, section, trim(case when value like '"%' then value::json->>'$' else value end) as value, o from x_lists where value <> ''
  union all select finding_id, section, case when len(refs) > 0 then value || ' | ' || array_to_string(refs, ', ') else value end, o from x_structs) v""")
SECTION_VALUES = query("""
select t.batch, t.page, s.section, v.finding_id, v.finding_pos, cast(v.value_no as int) as value_no, v.value
from x_targets t cross join (select unnest(['现有实现', '代码定位', '实现链', '复用边界', '改动点', '暂不应改动', '数据/权限/运行约束', '测试/验证路径', 'PRD 设计影响', '缺口与继续探索']) as section) s
left join (select p.batch, p.finding_pos, v.* from x_values v join x_published p using (finding_id)) v on v.batch = t.batch and v.section = s.section where t.kind = 'primary'""")
DUPLICATES = query(r"""
select source, path, first_path as duplicate_of from (
  select source, path, min(path) over (partition by source, body) as first_path from (
    select source, lpad(cast(doc_id as varchar), 12, '0') as path, trim(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda v: not regexp_matches(v, '^# .*正式页落页蓝图：') and not starts_with(v, '- candidate_wiki_page:')), lambda v: trim(v)), chr(10)), chr(10) || ' ') as body
    from documents) d) w where path <> first_path""")
ACCEPTANCE = query("""
select batch_id as batch, finding_id, 'blueprint_includes_blocking_gap_finding' as code from x_find where json_array_length(j, '$.blocking_gaps') > 0
union all select batch_id, finding_id, 'verified_finding_coverage_claims_missing' from x_find where json_array_length(j, '$.coverage_claims') = 0""")
# ---- change requests: values from the rows the documents were made of ------------------------------------------------------
cte("x_req", """
select 'r' || d.doc_id as request_id, d.doc_id, d.source as root_id, c.text, l.quality, d.doc_id % 9 <> 4 as detected,
  trim(translate(split_part(d.text, chr(10), 1), '|`', '')) as topic1, trim(translate(replace(d.text, chr(10), ' '), '|`', '')) as topic2,
  case when d.doc_id % 2 = 0 then ['wiki/entities/code/features/data-policy_' || (d.doc_id % 40) || '.md'] else ['wiki/entities/code/modules/map.md', 'wiki/entities/code/features/f' || (d.doc_id % 40) || '.md'] end as pages
from documents d join labels l on d.doc_id = l.doc_id join m_change_requests c on c.doc_id = d.doc_id""")
REQUESTS = query("""
select request_id, true as provided, 'inline' as kind, sha256(text) as sha256, detected, root_id as knowledge_id, 'run-' || (doc_id % 50) as run_id, 'handoff/manifest.json' as manifest_path, '' as language from x_req""")
OUTPUTS = query("""
select request_id, cast((case when quality = 1 then 2 else 1 end) + 2 as int) as row_index, 'handoff/shards/H1.md' as shard, 'wiki/s1.md' as source_summary, array_to_string(pages, '|') as candidate_pages, pages[1] as primary_pages,
  case when doc_id % 2 = 0 then '' else pages[2] end as alternate_pages, case when doc_id % 2 = 0 then 'feature_implementation' else 'code_map' end as knowledge_levels, case when doc_id % 2 = 0 then 'handoff/b1.md|handoff/b2.md' else '' end as page_blueprints from x_req""")
# Effective handoff of a request: its readable manifest, else its tables.
cte("x_eff", """
select x.request_id, x.doc_id, x.root_id, x.detected, mf, x.quality, x.task,
  case when x.doc_id % 3 = 0 then 'state/handoffs/r' || x.doc_id || '/handoff/request.md' end as source_path,
  'state/handoffs/r' || x.doc_id || case when x.doc_id % 2 = 0 then '/handoff/' else '/handoff/handoff/' end as mdir,
  case when mf then 'm-' || (x.doc_id % 50) else 'run-' || (x.doc_id % 50) end as run,
  case when mf then [translate(split_part(d.text, chr(10), 1), '|`"' || chr(9) || chr(13) || chr(92), '')] when x.quality = 1 then [topic1, topic2] else [topic1] end as topics,
  case when mf then ['wiki/entities/code/features/data-policy_' || (x.doc_id % 40) || '.md', 'wiki/entities/code/modules/alt_' || (x.doc_id % 7) || '.md'] else pages end as pages,
  case when mf then 'wiki/s2.md' else 'wiki/s1.md' end as summary
from (select q.*, c.task, q.doc_id % 3 = 0 and q.doc_id % 7 <> 0 and q.doc_id % 5 <> 0 as mf from x_req q join m_change_requests c using (request_id)) x join documents d on d.doc_id = x.doc_id""")
HANDOFFS = query("""
select request_id, root_id, detected, case when mf then 'manifest' else 'request' end as route, coalesce(source_path, '') as request_path, case when mf then source_path else '' end as manager_request_path,
  case when mf then mdir || 'manifest.json' else 'handoff/manifest.json' end as manifest_path, case when not mf then '' when doc_id % 12 = 0 then 'quality.json' else mdir || 'quality.json' end as quality_path,
  case when not mf then null when doc_id % 12 = 0 then 'missing' when doc_id % 9 = 0 then 'unreadable' else 'detected' end as quality_status,
  case when mf and doc_id % 12 <> 0 and doc_id % 9 <> 0 then doc_id % 4 = 2 end as quality_passed, cast(case when mf and doc_id % 12 <> 0 and doc_id % 9 <> 0 and doc_id % 4 <> 2 then 2 else 0 end as int) as quality_issues,
  case when mf and doc_id % 2 = 0 then root_id || '-m' else root_id end as knowledge_id, run as run_id, case when mf then 'zh-CN' else '' end as language from x_eff""")
cte("x_shards", """
select request_id, 0 as row_index, 'handoff/shards/M1.md' as shard, topics[1] as topic, 'B1-m' as source_batch, 'batches/b1/findings.jsonl' as verified_findings, 'batches/b1/analysis.md' as analysis, '' as evidence,
  'wiki/s2.md' as source_summary, 'handoff/source/M1.md' as source_summary_blueprint, 'handoff/m1.md|plan/m2.md' as page_blueprints, run from x_eff where detected and mf
union all select request_id, 1, 'handoff/shards/H1.md', topics[1], 'B1-x', '', '', '', 'wiki/sources/code/team-runs/r' || (doc_id % 3) || '.md', 'handoff/source/H1.md', '', run from x_eff where detected and not mf
union all select request_id, 2, 'handoff/shards/H2.md', topics[2], 'B2-y', '', '', '', '', '', '', run from x_eff where detected and not mf and quality = 1""")
SHARDS = query("select * exclude (run, row_index), cast(row_index as int) as row_index from x_shards")
cte("x_outs", """
select request_id, 0 as row_index, 'handoff/shards/M1.md' as shard, summary as source_summary, 'handoff/source/M1.md' as source_summary_blueprint, array_to_string(pages, '|') as candidate_pages, pages[1] as primary_pages,
  pages[2] as alternate_pages, 'feature_implementation' as knowledge_levels, 'handoff/m1.md|plan/m2.md' as page_blueprints, run from x_eff where detected and mf
union all select request_id, case when quality = 1 then 4 else 3 end, 'handoff/shards/H1.md', summary, 'handoff/source/H1.md', array_to_string(pages, '|'), pages[1], case when doc_id % 2 = 0 then '' else pages[2] end,
  case when doc_id % 2 = 0 then 'feature_implementation' else 'code_map' end, case when doc_id % 2 = 0 then 'handoff/b1.md|handoff/b2.md' else '' end, run from x_eff where detected and not mf""")
OUTS = query("select * exclude (run, row_index), cast(row_index as int) as row_index from x_outs")
cte("x_strings0", r"""
select request_id, root_id, trim(unnest(topics)) as query, (1, generate_subscripts(topics, 1), 0) as o from x_eff where detected
union all select request_id, root_id, unnest(pages), (2, generate_subscripts(pages, 1), 0) from x_eff where detected
union all select request_id, root_id, trim(regexp_replace(regexp_replace(regexp_replace(page, '[.]md$', ''), '^wiki/entities/code/(features|modules)/', ''), '[-_/]+', ' ', 'g')), (2, i, 1)
  from (select request_id, root_id, unnest(pages) as page, generate_subscripts(pages, 1) as i from x_eff where detected) u""")
cte("x_strings", "select request_id, root_id, query, cast(row_number() over (partition by request_id order by o) as int) as query_no from (select request_id, root_id, query, min(o) as o from x_strings0 where query <> '' group by all) g")
STRINGS = query("select request_id, query_no, query from x_strings")
cte("x_materials0", """
select request_id, source_path as v, null as run, (0, 0, 0, 0) as o from x_eff where source_path is not null
union all select request_id, case when mf then mdir || 'manifest.json' else 'handoff/manifest.json' end, run, (1, 0, 0, 0) from x_eff where detected
union all select request_id, source_path, run, (1, 0, 1, 0) from x_eff where detected and source_path is not null
union all select request_id, case when doc_id % 12 = 0 then 'quality.json' else mdir || 'quality.json' end, run, (1, 0, 2, 0) from x_eff where mf
union all select request_id, unnest([shard, verified_findings, analysis, evidence, source_summary_blueprint] || string_split(page_blueprints, '|')), run, (2, row_index, generate_subscripts([shard, verified_findings, analysis, evidence, source_summary_blueprint] || string_split(page_blueprints, '|'), 1), 0) from x_shards
union all select request_id, unnest([source_summary_blueprint] || string_split(page_blueprints, '|')), run, (3, row_index, generate_subscripts([source_summary_blueprint] || string_split(page_blueprints, '|'), 1), 0) from x_outs""")
cte("x_materials", """
select request_id, case when run is not null and regexp_matches(v, '^(handoff|batches|plan|verifier)/') then 'state/code-runs/' || run || '/' || v else v end as material, min(o) as o from x_materials0 where v <> '' group by all""")
MATERIALS = query("select request_id, cast(row_number() over (partition by request_id order by o) as int) as material_no, material from x_materials")
LEDGER = """
select event_type || '-' || strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || event_id as run_id, event_type as kind, 'state/runs/' || event_type || '/' || event_id || '.json' as artifact,
  strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as created_at from events"""

# The i-th free name of a stem is the i-th number that no file has, found by listing numbers.
cte("x_incoming", r"""
select 'src' || (page_id % 20) as root_id, page_id, list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')) as base from pages""")
cte("x_arrivals", """
select root_id, page_id as arrival, base || '.html' as name, page_id % 9 = 0 as in_raw, case when base = '' then '.html' else base end as stem, case when base = '' then '' else '.html' end as suffix
from x_incoming where base is not null and root_id in (select root_id from m_roots where enabled and mode = 'read_write')""")
cte("x_taken_stems", """
select root_id, case when stem = '' then '.html' else stem end as stem, case when stem = '' then '' else '.html' end as suffix
from (select root_id, base || case when page_id % 2 = 0 then '-3' else '' end as stem from x_incoming where page_id % 3 = 0) t""")
cte("x_taken", r"""
select root_id, stem, suffix, 1 as e from x_taken_stems
union select root_id, regexp_replace(stem, '-[0-9]+$', ''), suffix, cast(regexp_extract(stem, '-([1-9][0-9]*)$', 1) as bigint) from x_taken_stems where regexp_matches(stem, '-([2-9]|[1-9][0-9]+)$')""")
cte("x_wanted", "select *, row_number() over (partition by root_id, stem, suffix order by arrival) as i from x_arrivals where not in_raw")
cte("x_numbers", """
select root_id, stem, suffix, e, row_number() over (partition by root_id, stem, suffix order by e) as i from (
  select w.root_id, w.stem, w.suffix, unnest(range(1, w.n + coalesce(t.n, 0) + 1)) as e
  from (select root_id, stem, suffix, count(*) as n from x_wanted group by all) w left join (select root_id, stem, suffix, count(*) as n from x_taken group by all) t using (root_id, stem, suffix)) u
anti join x_taken using (root_id, stem, suffix, e)""")
REGISTERED = query("""
select root_id, arrival, name, in_raw, 'raw/' || name as raw_path, false as copied from x_arrivals where in_raw
union all select root_id, arrival, name, in_raw, 'raw/imports/' || stem || case when e > 1 then '-' || e else '' end || suffix, true from x_wanted join x_numbers using (root_id, stem, suffix, i)""")
