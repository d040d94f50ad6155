"""Page extraction, lint, inventory, references, closure."""

from __future__ import annotations

from corpusspark.functions import fixed_values as V

from .sql import arr, cte, has_any, lit, query

LOCATOR = r"(^|[^\w])[\w./-]*\.(java|kt|js|jsx|ts|tsx|vue|py|go|xml|yml|yaml|json|sql)($|[^\w])"
CLASS = "[A-Z][A-Za-z0-9_]*(Controller|Service|Repository|Mapper|Dao|Client|DTO|Dto|Entity|Config)($|[^A-Za-z0-9_À-ÿ])"


def section(body: str, heading: str) -> str:
    """Text after the first '## heading' up to the next section."""
    tail = f"substr({body}, instr({body}, {lit('## ' + heading)}) + {len(heading) + 3})"
    cut = f"split_part({tail}, chr(10) || '## ', 1)"
    return f"case when contains({body}, {lit('## ' + heading)}) then trim({cut}, chr(10) || ' ') else '' end"


def locator(text: str, endpoint: str = "`/[A-Za-z0-9_$:{}./-]+`") -> str:
    return f"(regexp_matches({text}, {lit(LOCATOR)}) or regexp_matches({text}, {lit(endpoint)}) or regexp_matches({text}, {lit('(^|[^A-Za-z0-9_À-ÿ])' + CLASS)}))"


def placeholder(text: str) -> str:
    stripped = f"regexp_replace({text}, '(?m)^\\s*[-*]\\s*', '', 'g')"
    packed = f"lower(regexp_replace({stripped}, '\\s+', '', 'g'))"
    return f"({packed} = '' or {has_any(packed, [p.lower() for p in V.LINT_PLACEHOLDERS])} or regexp_matches({stripped}, '(?i)(^|[^A-Za-z0-9_/.-])(TODO|TBD)($|[^A-Za-z0-9_/.-])'))"


cte("x_meta", r"""
select root_id, path, k, up, doc_id, text, substr(text, instr(text, chr(10) || '---' || chr(10)) + 5) as body,
  left(text, instr(text, chr(10) || '---' || chr(10))) as front, 'wiki/' || path as repo_path from m_page_texts""")
cte("x_fm", r"""
select *, regexp_extract(front, 'title: "([^\n]*)"', 1) as title, contains(front, chr(10) || 'type: ') as has_type,
  case when contains(front, chr(10) || 'type: ') then regexp_extract(front, '\ntype: ([a-z]+)', 1) else '' end as dtype,
  contains(front, chr(10) || 'created: ') as has_created, contains(front, chr(10) || 'updated: ') as has_updated, contains(front, chr(10) || 'sources: ') as has_sources,
  case k % 4 when 0 then ['wiki/sources/code/team-runs/r' || (k % 3) || '.md', 'raw/a.md'] when 1 then [] when 2 then null else ['raw/b.md'] end as sources
from x_meta""")
PAGE_EXTRACT = query(r"""
select root_id, repo_path, title, case when dtype <> '' then dtype else 'unknown' end as page_type,
  left(trim(regexp_replace(body, '\s+', ' ', 'g')), 240) as summary,
  case when has_created then 'created|' else '' end || case when has_sources then 'sources|' else '' end || 'title' || case when has_type then '|type' else '' end || case when has_updated then '|updated' else '' end as keys,
  coalesce(array_to_string(sources, '|'), '-') as sources,
  coalesce(array_to_string(list_transform(regexp_extract_all(body, '(?m)^## [^\n]*'), lambda h: substr(h, 4) || '=' ||
    length(trim(split_part(split_part(body, h || chr(10), 2), chr(10) || '## ', 1), chr(10) || ' '))), '|'), '') as sections
from x_fm""")
LOCATION = section("body", V.CODE_LOCATION_SECTION)
NORMAL = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({LOCATION}, '`([^`]+)`', '\\1', 'g'), '\\[[^\\]]+\\]\\([^)]+\\)', '', 'g'), '(?m)^\\s*[-*]\\s*', '', 'g'), '\\s+', ' ', 'g'))"
THIN = f"((dtype = 'source' or starts_with(path, 'sources/')) and contains(body, '## Source Snapshot') and contains(body, '## Outline') and length({section('body', 'Summary')}) < 80)"
PAGE_PREDICATES = query(f"""
select root_id, repo_path, cast(length({LOCATION}) as int) as section_chars, {locator(LOCATION)} as lint_locator, {locator(NORMAL, '/[A-Za-z0-9_$:{}./-]+')} as profile_locator,
  {placeholder(LOCATION)} as lint_placeholder, {has_any('body', V.PROFILE_PLACEHOLDERS)} as profile_placeholder,
  regexp_matches(body, '`[A-Za-z][A-Za-z0-9_./:-]{{2,}}`') or regexp_matches(body, '(?m)^\\s*[-*]\\s+\\S+') or regexp_matches(body, '(?m)^\\s*\\d+\\.\\s+\\S+') or regexp_matches(body, '(?m)^\\|.+\\|$') as attribute_values,
  {THIN} as thin_source
from x_fm""")
INDEX_PARSE = query("select root_id, entry_pos, title, path, summary from m_index_entries")
SOURCE_STATUSES = query("""
select s.root_id, s.repo_path, s.source, f.path is not null as exists
from (select distinct root_id, repo_path, unnest(sources) as source from x_fm where sources is not null) s
left join m_files_present f on f.root_id = s.root_id and f.path = case when starts_with(s.source, 'wiki/') then s.source when starts_with(s.source, 'sources/') then 'wiki/' || s.source end""")

# ---- lint ------------------------------------------------------------------------------------------------------
SECTION_ISSUES = " union all ".join(
    f"select root_id, 'minor' as severity, case when contains(body, {lit('## ' + h)}) then 'code_feature_section_not_substantive' else 'code_feature_required_section_missing' end as code, repo_path as path, {lit(h)} as detail "
    f"from x_features where not contains(body, {lit('## ' + h)}) or {placeholder(section('body', h))}"
    for h in V.CODE_FEATURE_REQUIRED_HEADINGS
)
cte("x_enabled_pages", "select p.*, r.is_code_root from x_fm p join m_roots r on r.root_id = p.root_id and r.enabled")
cte("x_features", "select * from x_enabled_pages where starts_with(path, 'entities/code/features/')")
cte("x_index_text", "select root_id, string_agg(line, chr(10)) as index_text from m_index_lines group by root_id")
cte("x_named", "select p.root_id, p.path from x_enabled_pages p join x_index_text i on i.root_id = p.root_id and contains(i.index_text, p.path)")


def required(paths, relation: bool) -> str:
    code, severity = ("relation_file_missing", "minor") if relation else ("required_path_missing", "major")
    return f"""select r.root_id, '{severity}', '{code}', q.p, cast(null as varchar) from m_roots r cross join (select unnest({arr(paths)}) as p) q
where r.enabled and not exists (select 1 from m_files_present f where f.root_id = r.root_id and (f.path = q.p or starts_with(f.path, q.p || '/')))"""


cte("x_lint", f"""
{SECTION_ISSUES}
union all {required(V.REQUIRED_LINT_PATHS, False)}
union all {required(['relations/' + n for n in V.RELATION_FILES], True)}
union all select root_id, 'minor', 'frontmatter_field_missing', repo_path, unnest(list_filter([case when not has_type then 'type' end, case when not has_created then 'created' end, case when not has_updated then 'updated' end, case when not has_sources then 'sources' end], lambda x: x is not null)) from x_enabled_pages
union all select root_id, 'minor', 'source_summary_too_thin', repo_path, null from x_enabled_pages where {THIN}
union all select root_id, 'minor', 'code_feature_code_locator_missing', repo_path, null from x_features where not {locator(LOCATION)}
union all select root_id, 'minor', 'code_feature_source_trace_missing', repo_path, null from x_features where k % 4 <> 0
union all select x.root_id, 'minor', 'code_feature_source_summary_missing', x.repo_path, x.sources[1] from x_features x left join m_files_present f on f.root_id = x.root_id and f.path = x.sources[1] where k % 4 = 0 and f.path is null
union all select l.root_id, 'minor', 'broken_wikilink', l.repo_path, l.target from (select distinct root_id, repo_path, trim(split_part(unnest(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1)), '|', 1)) as target from x_enabled_pages) l
  left join (select distinct root_id, regexp_replace(regexp_extract(path, '[^/]+$'), '[.]md$', '') as stem from x_enabled_pages) s on s.root_id = l.root_id and s.stem = regexp_replace(regexp_extract(l.target, '[^/]*$'), '(.)[.][^.]*$', '\\1')
  left join (select distinct root_id, title from x_enabled_pages) t on t.root_id = l.root_id and t.title = l.target where s.stem is null and t.title is null
union all select p.root_id, 'minor', 'index_entry_missing', p.repo_path, null from x_enabled_pages p left join x_named n on n.root_id = p.root_id and n.path = p.path where n.path is null
union all select root_id, 'major', 'code_schema_missing', 'wiki/schema.md', null from m_roots where enabled and is_code_root
union all select r.root_id, 'major', 'code_knowledge_pages_missing', 'wiki/entities/code', null from m_roots r where enabled and is_code_root and not exists (select 1 from x_enabled_pages p where p.root_id = r.root_id and starts_with(p.path, 'entities/code/'))
union all select r.root_id, 'major', 'code_knowledge_index_missing', 'wiki/index.md', null from m_roots r where enabled and is_code_root and exists (select 1 from x_enabled_pages p where p.root_id = r.root_id and starts_with(p.path, 'entities/code/'))
  and not exists (select 1 from x_named p where p.root_id = r.root_id and starts_with(p.path, 'entities/code/'))
union all select e.root_id, 'minor', 'code_feature_index_summary_not_actionable', 'wiki/' || e.path, null from m_index_entries e join x_features f on f.root_id = e.root_id and f.path = e.path where f.is_code_root and not {locator('e.summary')}""")
LINT_ISSUES = query("select root_id, severity, code, path, detail from x_lint")
LINT_SUMMARY = query("""
select r.root_id, not r.enabled as skipped, case when r.enabled then coalesce(s.n, 0) = 0 end as passed, coalesce(s.n, 0) as n_issues, coalesce(s.major, 0) as n_major, coalesce(s.codes, '') as codes
from m_roots r left join (select root_id, cast(sum(n) as bigint) as n, cast(sum(major) as bigint) as major, string_agg(code || '=' || n, '|' order by code || '=' || n) as codes
  from (select root_id, code, count(*) as n, count(*) filter (severity = 'major') as major from x_lint group by all) c group by root_id) s on s.root_id = r.root_id""")
STRUCTURE = query(f"""
select r.root_id, 'major' as severity, 'required_path_missing' as code, q.p as path, cast(null as varchar) as detail from m_roots r cross join (select unnest({arr(V.REQUIRED_ROOT_PATHS)}) as p) q
where r.enabled and not exists (select 1 from m_files_present f where f.root_id = r.root_id and (f.path = q.p or starts_with(f.path, q.p || '/')))""")
ENGLISH = query(r"""
select doc_id, cast(no as int) as line from (
  select doc_id, no, trim(line) as line, sum(case when starts_with(trim(line), '```') then 1 else 0 end) over (partition by doc_id order by no) % 2 as fenced
  from (select doc_id, generate_subscripts(l, 1) as no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents) s) e) f
where fenced = 0 and not starts_with(line, '```') and line <> '' and not starts_with(line, '|') and not regexp_full_match(line, '[-:| ]+')
  and not regexp_full_match(line, '[-*]\s+[A-Za-z0-9_ -]+:\s*[^。！？；，、]*') and regexp_matches(line, '\s')
  and len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(line, '`[^`]*`', '', 'g'), '\S+=\S+', ' ', 'g'), '([^A-Za-z])', '\1\1', 'g'), '(?:^|[^\wÀ-ÿ/.-])([A-Za-z]{2,})(?:$|[^\wÀ-ÿ/.-])')) >= 5""")

# ---- inventory ----------------------------------------------------------------------------------------------------
cte("x_files", "select *, regexp_extract(path, '[^/]+$') as name from m_repo_files where not contains(path, '/node_modules/') and not contains(path, '/dist/') and not contains(path, '/build/') and not contains(path, '/target/')")
LANG = "case " + " ".join(f"when regexp_matches(lower(name), '.{s.replace('.', '[.]')}$') then '{n}'" for s, n in V.LANGUAGE_BY_SUFFIX.items()) + " else 'other' end"
LANGUAGES = query(f"""
select repo_id, cast(sum(n) as bigint) as tracked_files, string_agg(lang || '=' || n, '|' order by lang || '=' || n) as languages
from (select repo_id, {LANG} as lang, count(*) as n from x_files group by all) c group by repo_id""")
cte("x_listed", f"""
select repo_id, 'dependency' as kind, path from x_files where name in ({', '.join(lit(n) for n in V.DEPENDENCY_FILE_NAMES)}) or name like '%_.csproj'
union all select repo_id, 'config', path from x_files where name in ({', '.join(lit(n) for n in V.CONFIG_FILE_NAMES)}) or starts_with(name, 'config.') or starts_with(name, 'settings.')""")
LISTED = query("select * from (select repo_id, kind, cast(row_number() over (partition by repo_id, kind order by path) as int) as file_no, path from x_listed) x")
SUFFIXES = "(" + " or ".join(f"lower(path) like '%{s}'" for s in V.ENTRYPOINT_SUFFIXES) + ")"
cte("x_lines", f"""
select repo_id, path, generate_subscripts(l, 1) as no, unnest(l) as line from (select repo_id, path, string_split(content, chr(10)) as l from x_files where {SUFFIXES}) s""")
cte("x_entry", f"""
select repo_id, path, no, cast(row_number() over (partition by repo_id order by path) as int) as entry_no
from (select repo_id, path, min(no) as no from x_lines where {has_any('line', V.ENTRYPOINT_PATTERNS)} group by repo_id, path) e""")
cte("x_symbol", f"""
select e.repo_id, e.path, arg_max(trim(l.line), l.no) as line from x_entry e join x_lines l on l.repo_id = e.repo_id and l.path = e.path and l.no between e.no - 18 and e.no
where {has_any('l.line', V.SYMBOL_MARKERS)} group by e.repo_id, e.path""")
MARK = "case " + " ".join(f"when contains(s.line, '{m}') then trim(split_part(split_part(substr(s.line, instr(s.line, '{m}') + {len(m)}), '(', 1), '{{', 1))" for m in V.SYMBOL_MARKERS) + " else '' end"
ENTRYPOINTS = query(f"""
select e.repo_id, e.entry_no, e.path, cast(e.no as int) as line, {MARK} as symbol from x_entry e left join x_symbol s on s.repo_id = e.repo_id and s.path = e.path""")
cte("x_modules", """
select repo_id, path, split_part(inner_path, '/', 1) || '/' || split_part(inner_path, '/', 2) as module
from (select repo_id, path, substr(path, length(repo_path) + 2) as inner_path from x_files) i where contains(inner_path, '/')""")
MODULES = query("""
select repo_id, cast(dense_rank() over (partition by repo_id order by module) as int) as module_no, module,
       cast(row_number() over (partition by repo_id, module order by path) as int) as file_no, path
from (select distinct repo_id, path, module from x_modules) d""")
SNAPSHOT = query(f"""
select 'current' as snapshot_id, r.repo_id, r.path, coalesce(c.tracked_files, 0) as tracked_files, coalesce(c.languages, '') as languages
from (select distinct repo_id, repo_path as path from m_repo_files) r left join (
  select repo_id, cast(sum(n) as bigint) as tracked_files, string_agg(lang || '=' || n, '|' order by lang || '=' || n) as languages
  from (select repo_id, {LANG} as lang, count(*) as n from x_files group by all) c group by repo_id) c on c.repo_id = r.repo_id""")
DIFF = query("select repo_id, path, coalesce(previous_commit, '') as previous_commit, current_commit from m_snapshots where coalesce(previous_commit, '') <> current_commit")
CHANGED = query("""
select coalesce(p.repo_id, c.repo_id) as repo_id, coalesce(p.path, c.path) as path, case when p.path is null then 'added' when c.path is null then 'removed' else 'modified' end as change
from (select * from m_file_versions where version = 'previous') p full outer join (select * from m_file_versions where version = 'current') c on p.repo_id = c.repo_id and p.path = c.path
where p.content is distinct from c.content""")

# ---- hash trees: the folders of a file are its own, the one above and the root ---------------------------------------------------
cte("x_vfiles", """
select version, repo_id, 'a' || (n % 7) || '/b' || (n % 11) || '/' || path as path, 'a' || (n % 7) as f1, 'a' || (n % 7) || '/b' || (n % 11) as f2, coalesce(sha256(content), '') as sha
from (select *, cast(regexp_extract(path, '([0-9]+)', 1) as bigint) as n from m_file_versions) v""")
XORS = ", ".join(f"bit_xor(cast('0x' || substr(h, {1 + 15 * i}, 15) as bigint)) as h{i}, coalesce(bit_xor(cast('0x' || substr(h, {1 + 15 * i}, 15) as bigint)) filter (folder = f2), 0) as o{i}" for i in range(4))


def _hex(kind: str) -> str:
    return " || ".join(f"lpad(lower(to_hex({kind}{i})), 15, '0')" for i in range(4))


cte("x_nodes", f"""
select version, repo_id, folder, count(*) as n_files, {XORS}
from (select *, sha256(path || chr(10) || sha) as h, unnest(['', f1, f2]) as folder from x_vfiles) f group by version, repo_id, folder""")
TREE = query(f"select repo_id, folder, n_files, {_hex('h')} as hash, {_hex('o')} as own from x_nodes where version = 'current'")
TREE_CHANGES = query("""
select coalesce(p.repo_id, c.repo_id) as repo_id, coalesce(p.path, c.path) as path, case when p.path is null then 'added' when c.path is null then 'removed' else 'modified' end as change
from (select * from x_vfiles where version = 'previous') p full outer join (select * from x_vfiles where version = 'current') c on p.repo_id = c.repo_id and p.path = c.path
where p.sha is distinct from c.sha""")
ROOTS = query(f"""
select repo_id, 'repos/' || repo_id as path, coalesce(p.commit, '') as previous_commit, c.commit as current_commit
from (select repo_id, {_hex('h')} as commit from x_nodes where version = 'current' and folder = '') c left join (select repo_id, {_hex('h')} as commit from x_nodes where version = 'previous' and folder = '') p using (repo_id)
where p.commit is distinct from c.commit""")

# ---- references: edges from the rows the files were made of -----------------------------------------------------------------
VIEW, SERVICE, IMPL = "'repos/web/src/views/C' || {0} || '.vue'", "'repos/app/src/main/java/Supplier' || {0} || 'Service.java'", "'repos/app/src/main/java/impl/Supplier' || {0} || 'ServiceImpl.java'"
CONTROLLER, API = "'repos/app/src/main/java/Nation' || {0} || 'Controller.java'", "'repos/web/src/api/n' || {0} || '.js'"
cte("x_edges", f"""
select {VIEW.format('c_custkey')} as src, 'repos/web/src/Base.vue' as dst, 'js_relative_import' as kind, '../Base.vue' as symbol from customer
union all select {VIEW.format('c_custkey')}, 'repos/web/src/util/h' || (c_custkey % 7) || '.js', 'js_alias_import', '@/util/h' || (c_custkey % 7) from customer
union all select {VIEW.format('a.c_custkey')}, {VIEW.format('b.c_custkey')}, 'js_relative_import', './C' || b.c_custkey || '.vue' from customer a join customer b on b.c_custkey = 2 * a.c_custkey
union all select {VIEW.format('a.c_custkey')}, {VIEW.format('b.c_custkey')}, 'js_relative_import', './sub/../C' || b.c_custkey from customer a join customer b on b.c_custkey = 2 * a.c_custkey + 1
union all select {VIEW.format('c_custkey')}, {API.format('c_nationkey')}, 'frontend_api_module_call', 'n' || c_nationkey || '.get' || (c_custkey % 3) from customer where c_custkey % 3 < 2
union all select {API.format('n_nationkey')}, {CONTROLLER.format('n_nationkey')}, 'http_endpoint_to_controller', 'nation' || n_nationkey || '/list' from nation
union all select {API.format('n_nationkey')}, {CONTROLLER.format('n_nationkey')}, 'http_endpoint_to_controller', 'nation' || n_nationkey || '/item/one' from nation
union all select {CONTROLLER.format('n_nationkey')}, {SERVICE.format('s_suppkey')}, 'java_type_reference', 'Supplier' || s_suppkey || 'Service' from nation join supplier on s_suppkey = n_nationkey
union all select {CONTROLLER.format('n_nationkey')}, {IMPL.format('s_suppkey')}, 'java_interface_or_contract_implementation', 'Supplier' || s_suppkey || 'Service' from nation join supplier on s_suppkey = n_nationkey
union all select {IMPL.format('s_suppkey')}, {SERVICE.format('s_suppkey')}, 'java_type_reference', 'Supplier' || s_suppkey || 'Service' from supplier
union all select {IMPL.format('a.s_suppkey')}, {SERVICE.format('b.s_suppkey')}, 'java_type_reference', 'Supplier' || b.s_suppkey || 'Service' from supplier a join supplier b on b.s_suppkey = 2 * a.s_suppkey + 1
union all select {IMPL.format('a.s_suppkey')}, {IMPL.format('b.s_suppkey')}, 'java_interface_or_contract_implementation', 'Supplier' || b.s_suppkey || 'Service' from supplier a join supplier b on b.s_suppkey = 2 * a.s_suppkey + 1""")
cte("x_other_edges", f"""
select {API.format('n_nationkey')} as src, {CONTROLLER.format('(n_nationkey + 1) % 25')} as dst, 'http_endpoint_to_controller' as kind, 'nation' || ((n_nationkey + 1) % 25) || '/list' as symbol from nation""")
EDGES = query("select src, dst, kind, symbol from x_edges union all select src, dst, kind, symbol from x_other_edges")
cte("x_seed", "select batch_id, split_part(seed, ':', 1) as path from m_code_batches")

def closure_sql() -> str:
    """Levels of a breadth-first walk (these references have no cycle); batches that name only repos/web stay there."""
    base = query("select 1 from x_edges, x_seed, m_code_files")
    ctes = base[base.index("with ") + 5 : base.rindex("select 1 from")]
    return f"""with recursive {ctes.rstrip()},
x_nodes as materialized (select distinct path from m_code_files),
x_walk as (
  select s.batch_id, s.path, 0 as level from x_seed s join x_nodes n on n.path = s.path
  union
  select w.batch_id, e.dst, w.level + 1 from x_walk w join x_edges e on e.src = w.path join m_code_batches b on b.batch_id = w.batch_id
  where b.other is not null or starts_with(e.dst, 'repos/web/'))
select batch_id, path, cast(min(level) as int) as level from x_walk group by batch_id, path"""


CLOSURE = closure_sql()


def closure_stats_sql() -> str:
    """Counts over the walk: its files and levels, and the references of visited files that their batch may follow."""
    head, tail = CLOSURE.rsplit("select batch_id, path, cast(min(level) as int)", 1)
    return f"""{head.rstrip()},
x_reached as (select batch_id, path, cast(min(level) as int){tail}),
x_followed as (
  select r.batch_id, e.kind from x_reached r join x_edges e on e.src = r.path join m_code_batches b on b.batch_id = r.batch_id
  where b.other is not null or starts_with(e.dst, 'repos/web/') or e.kind = 'js_relative_import'),
x_counts as (select batch_id, count(*) as n, string_agg(distinct kind, '|' order by kind) as kinds from x_followed group by batch_id)
select r.batch_id, count(*) as file_count, max(r.level) as levels, coalesce(any_value(c.n), 0) as reference_count, coalesce(any_value(c.kinds), '') as followed_reference_kinds,
  '{V.CLOSURE_POLICY}' as expansion_policy, '{V.CLOSURE_STOPPED}' as stopped_reason
from x_reached r left join x_counts c on c.batch_id = r.batch_id group by r.batch_id"""


CLOSURE_STATS = closure_stats_sql()
SCANNED = query("""
select 'h' || cast(page_id % 5 as varchar) as root_id, 'wiki/d' || cast(page_id % 3 as varchar) || '/p' || cast(page_id as varchar) || '.md' as path,
  cast(strlen(coalesce(html, '')) as bigint) as length, sha256(coalesce(html, '')) as sha256
from pages where page_id % 23 <> 7""")
