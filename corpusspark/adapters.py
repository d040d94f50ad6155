"""Model tables derived from the given tables.

Each adapter is one SQL text that uses only functions Spark and DuckDB share, so the same text defines the
model table for the Spark jobs and for the comparison queries.  ``{name}`` stands for a source table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

# One row per document: page path by role, title, summary and the numbers the other columns are built from.
PAGE_BASE = """
select doc_id, source as root_id, k, up,
       prefix || up || '/' || case when k % 20 = 1 then 'repository-map-' else 'page-' end || cast(doc_id as string) || '.md' as path,
       trim(case when k % 3 = 0 then up || ' ' else '' end
            || translate(split_part(text, chr(10), 1), '[]()|#`:"<>', '') || ' ' || cast(doc_id as string)) as title,
       trim(translate(replace(text, chr(10), ' '), '[]()|#`<>', ''))
            || case when k % 4 = 0 then ' src/main/' || up || 'Service.java' else '' end
            || case when k % 7 = 5 then ' 运行时 消费边界' else '' end as summary,
       text
from (select doc_id, source, text, upper(lang) as up, cast(floor(doc_id / 20) as bigint) as k,
             case cast(floor(doc_id / 20) as bigint) % 10
               when 0 then 'entities/code/features/' when 1 then 'entities/code/modules/' when 2 then 'sources/'
               when 3 then 'entities/product/features/' when 4 then 'entities/data-dictionary/'
               when 5 then 'entities/regulation/requirements/' when 6 then 'concepts/'
               when 7 then 'entities/product/modules/' when 8 then 'entities/solution/' else 'queries/' end as prefix
      from {documents}) d
"""

ROOTS = """
select root_id, case when n % 5 = 4 then 'code ' || root_id else 'kb ' || root_id end as name,
       '/roots/' || root_id as path, root_id <> 'src0' as enabled,
       case when n % 3 = 1 then 'read_only' else 'read_write' end as mode, cast(n as int) as priority,
       n % 5 = 4 as is_code_root
from (select distinct source as root_id, cast(substr(source, 4) as bigint) as n from {documents}) r
"""

# The pages left out of the index (every other hundred of those under queries/) are the case of the rule for unindexed pages.
INDEX_LINES = """
select root_id, cast(doc_id as bigint) as entry_pos, '- [' || title || '](' || path || ') — ' || summary as line
from ({page_base}) b where k % 10 <> 9 or k % 20 = 9
"""

INDEX_ENTRIES = """
select root_id, cast(doc_id as bigint) as entry_pos, title, path, trim(summary) as summary
from ({page_base}) b where k % 10 <> 9 or k % 20 = 9
"""

# Whole pages: front matter (fields missing by rule), sections (missing or placeholder by rule), links, text.
PAGE_TEXTS = """
select root_id, path, doc_id, k, up,
       '---' || chr(10) || 'title: "' || title || '"' || chr(10)
       || case when k % 9 <> 4 then 'type: ' || case when k % 10 = 2 then 'source' when k % 10 = 6 then 'concept' else 'entity' end || chr(10) else '' end
       || case when k % 7 <> 3 then 'created: 2024-01-01' || chr(10) else '' end
       || case when k % 11 <> 5 then 'updated: 2024-02-02' || chr(10) else '' end
       || case k % 4 when 0 then 'sources: [wiki/sources/code/team-runs/r' || cast(k % 3 as string) || '.md, "raw/a.md"]' || chr(10)
                     when 1 then 'sources: []' || chr(10) when 2 then '' else 'sources: [raw/b.md]' || chr(10) end
       || '---' || chr(10) || '# ' || title || chr(10) || chr(10) || text || chr(10) || chr(10)
       || case when k % 10 = 2 then '## Source Snapshot' || chr(10) || 'raw copy' || chr(10) || chr(10) || '## Outline' || chr(10) || '- one' || chr(10) || chr(10)
               || '## Summary' || chr(10) || case when k % 5 < 2 then 'short' else replace(text, chr(10), ' ') end || chr(10) || chr(10) else '' end
       || case when k % 10 = 0 then {sections} else '' end
       || case when k % 10 = 1 then '| 产品模块 | 产品能力 | 对应 Repo | 入口 |' || chr(10) || '| --- | :---: | --- | --- |' || chr(10)
               || '| ' || up || ' | 数据权限 ' || translate(split_part(text, chr(10), 1), '|`', '') || ' | ' || lower(up) || '-team-' || cast(k % 13 as string) || ' | src/App' || cast(doc_id as string) || 'Service.java |' || chr(10)
               || '| other | 导出 | web | `repos/' || lower(up) || '-team-' || cast((k + 2) % 13 as string) || '/src/b.java` |' || chr(10)
               || '| short row |' || chr(10) || chr(10) else '' end
       || '[[page-' || cast(doc_id + 20 as string) || '|next page]] and [again](page-' || cast(doc_id + 200 as string) || '.md#part)' || chr(10)
       || '[up](' || repeat('../', cast(length(path) - length(replace(path, '/', '')) as int)) || 'concepts/' || up || '/page-' || cast(doc_id - doc_id % 200 + 120 + doc_id % 20 as string) || '.md)' || chr(10)
       || '[rooted](entities/product/modules/' || up || '/page-' || cast(doc_id - doc_id % 200 + 140 + doc_id % 20 as string) || '.md) and [[missing ' || cast(doc_id % 50 as string) || ']]' || chr(10)
       as text
from ({page_base}) b
"""


def _sections() -> str:
    from .functions.fixed_values import CODE_FEATURE_REQUIRED_HEADINGS

    parts = []
    for j, heading in enumerate(CODE_FEATURE_REQUIRED_HEADINGS):
        body = (
            f"case when (k + {j}) % 7 = 2 then '- 待补充' when (k + {j}) % 7 = 3 then '- see src/main/' || up || '/Doc' || cast(doc_id as string) "
            f"|| 'Service.java' when (k + {j}) % 7 = 4 then '- short' else '- ' || replace(text, chr(10), ' ') end"
        )
        parts.append(f"case when (k + {j}) % 11 <> 0 then '## {heading}' || chr(10) || {body} || chr(10) || chr(10) else '' end")
    return "(" + " || ".join(parts) + ")"


# Benchmark items as a query log; the suffix makes every intent, operator and selection rule occur.
QUERIES = """
select 'q' || cast(item_id as string) as query_id,
       case when item_id % 24 in (17, 23) then '' else text end
       || case item_id % 24 when 17 then '代码 如何实现' when 23 then '代码 有哪些' when 13 then ' 新增 导出 风险'
            else case item_id % 12 when 0 then '' when 1 then ' 代码' when 2 then ' EN 有哪些能力' when 3 then ' 原文' when 4 then ' FR 有几个应用'
            when 5 then ' 支持哪些事件类型' when 6 then ' 代码地图 哪个仓库' when 7 then ' 如何实现 运行时 生效' when 8 then ' field dictionary'
            when 9 then ' 监管要求' when 10 then ' DE 功能 对比' else ' ES 数据权限策略 prd 设计' end end as query,
       case when item_id % 4 = 1 then 'src' || cast(item_id % 20 as string) end as named_root,
       case item_id % 5 when 3 then 'balanced' when 4 then 'exhaustive' else 'focused' end as mode,
       cast(80 as int) as candidate_limit, cast(case when item_id % 3 = 0 then 5 else 0 end as int) as evidence_budget,
       item_id % 7 = 0 as include_source, item_id % 9 = 0 as include_cross_module,
       case when item_id % 13 = 6 then 'LIST_COLLECTION' end as plan_operator, cast(null as string) as plan_scope,
       case when item_id % 13 = 6 then 'EN' end as plan_subject
from {benchmark}
"""

# Turns of conversations as a second query log, for the text features that need no retrieval.
USER_QUERIES = """
select cast(conv_id as string) || '-' || cast(turn as string) as query_id,
       text || case turn % 4 when 0 then ' 用户想改数据权限策略导出' when 1 then '' when 2 then ' 有哪些应用类型 API' else ' submodule 支撑任务中心现状' end as query
from {conversations}
"""

ROOT_FILES = [
    "wiki/index.md", "wiki/schema.md", "wiki/log.md", "wiki/overview.md", "relations/relation-graph.json",
    "relations/requirement-map.json", "state/run-ledger.json", "wiki/sources/code/team-runs/r0.md", "raw/a.md",
]
FILES_PRESENT = "select root_id, 'wiki/' || path as path from ({page_base}) b" + "".join(
    f"""
union all
select source as root_id, '{name}' as path from (select distinct source from {{documents}}) r{j}
where (cast(substr(source, 4) as bigint) + {j}) % 6 <> 5"""
    for j, name in enumerate(ROOT_FILES)
)

ROOT_REPOS = """
select root_id, lower(up) || '-team-' || cast(k % 13 as string) as repo_id, 'repos/' || lower(up) || '-team-' || cast(k % 13 as string) as path,
       max('https://git.example/' || up || case when k % 2 = 0 then '/the' else '/and' end) as remote
from ({page_base}) b group by root_id, lower(up) || '-team-' || cast(k % 13 as string), 'repos/' || lower(up) || '-team-' || cast(k % 13 as string)
"""

# Repositories: a host is a repository, a page is a file.
REPO_FILES = """
select host as repo_id, 'repos/' || host as repo_path, page_id,
       'repos/' || host || '/' || dirs || case when page_id % 23 = 7 then 'node_modules/' else '' end
         || case when page_id % 17 = 3 then 'package.json' when page_id % 17 = 9 then 'settings.py' when page_id % 17 = 11 then 'config.local'
                 else 'File' || cast(page_id as string) || case page_id % 6 when 0 then '.py' when 1 then '.java' when 2 then '.ts' when 3 then '.vue' when 4 then '.md' else '.go' end end as path,
       'header ' || url || chr(10) || 'class Page' || cast(page_id as string) || ' (Base):' || chr(10) || replace(html, '</p>', '</p>' || chr(10))
         || case when page_id % 3 = 0 then chr(10) || '  def handle_' || cast(page_id as string) || '(self):' || chr(10) || '    @app.route("/x")' || chr(10) || 'app.get("/y")' else '' end
         || chr(10) as content
from (select page_id, url, html, split_part(split_part(url, '://', 2), '/', 1) as host,
             case page_id % 4 when 0 then 'src/main/' when 1 then 'src/test/' when 2 then 'web/views/' else '' end as dirs
      from {pages}) p
"""

# Snapshots: the last order of a customer before and after a cut is the commit of its repository.
SNAPSHOTS = """
select cast(o_custkey as string) as repo_id, 'repos/c' || cast(o_custkey as string) as path, 'o' || cast(max(case when o_orderdate < timestamp '1997-01-01 00:00:00' then o_orderkey end) as string) as previous_commit,
       'o' || cast(max(o_orderkey) as string) as current_commit
from {orders} group by o_custkey
"""

# Two versions of the documents as files of two commits; those that the current one lacks are the deleted files.
FILE_VERSIONS = """
select 'previous' as version, source as repo_id, 'd' || cast(doc_id as string) || '.txt' as path, text as content from {documents}
union all
select 'current' as version, source as repo_id, 'd' || cast(doc_id as string) || '.txt' as path,
       case when doc_id % 7 = 0 then text || ' edited' else text end as content
from {documents} where doc_id % 11 <> 0
"""

# Source code derived from the order tables: a customer is a view, a nation an API module and a controller,
# a supplier a service interface with an implementation.
CODE_FILES = """
select 'repos/web' as repo_id, 'repos/web/src/views/C' || cast(c_custkey as string) || '.vue' as path,
       'import Base from "../Base.vue"' || chr(10) || 'import helper from "@/util/h' || cast(c_custkey % 7 as string) || '"' || chr(10)
       || 'import left from "./C' || cast(2 * c_custkey as string) || '.vue"' || chr(10)
       || 'import right from "./sub/../C' || cast(2 * c_custkey + 1 as string) || '"' || chr(10)
       || 'this.$api.n' || cast(c_nationkey as string) || '.get' || cast(c_custkey % 3 as string) || '()' || chr(10) as content
from {customer}
union all
select 'repos/web', 'repos/web/src/Base.vue', 'export default {{}}' || chr(10) from (select count(*) as n from {nation}) x
union all
select 'repos/web', 'repos/web/src/util/h' || cast(n_nationkey as string) || '.js', 'export const h = 1' || chr(10) from {nation}
union all
select 'repos/web', 'repos/web/src/api/n' || cast(n_nationkey as string) || '.js',
       'export const get0 = () => request({{ url: "/nation' || cast(n_nationkey as string) || '/list" }})' || chr(10)
       || 'export const get1 = () => request({{ url: "/nation' || cast(n_nationkey as string) || '/item/one" }})' || chr(10)
       || 'export const other = () => request({{ url: "/nation' || cast((n_nationkey + 1) % 25 as string) || '/list" }})' || chr(10)
from {nation}
union all
select 'repos/app', 'repos/app/src/main/java/Nation' || cast(n_nationkey as string) || 'Controller.java',
       '@RequestMapping("/nation' || cast(n_nationkey as string) || '")' || chr(10) || 'public class Nation' || cast(n_nationkey as string) || 'Controller {{' || chr(10)
       || '  private Supplier' || cast(n_nationkey as string) || 'Service service;' || chr(10)
       || '  @GetMapping("/list")' || chr(10) || '  public String list() {{ }}' || chr(10) || '  @GetMapping("/item")' || chr(10) || '  public String item() {{ }}' || chr(10) || '}}' || chr(10)
from {nation}
union all
select 'repos/app', 'repos/app/src/main/java/Supplier' || cast(s_suppkey as string) || 'Service.java',
       'public interface Supplier' || cast(s_suppkey as string) || 'Service {{ }}' || chr(10) from {supplier}
union all
select 'repos/app', 'repos/app/src/main/java/impl/Supplier' || cast(s_suppkey as string) || 'ServiceImpl.java',
       'import com.acme.Supplier' || cast(2 * s_suppkey + 1 as string) || 'Service;' || chr(10) || 'import java.util.List;' || chr(10)
       || 'public class Supplier' || cast(s_suppkey as string) || 'ServiceImpl implements Supplier' || cast(s_suppkey as string) || 'Service {{ }}' || chr(10)
from {supplier}
"""

CODE_BATCHES = """
select 'B' || cast(n_nationkey as string) as batch_id, n_nationkey as n,
       'repos/web/src/views/C' || cast(n_nationkey + 1 as string) || '.vue:1' as seed, case when n_nationkey % 3 <> 0 then 'repos/app/src/main/java/Missing.java' end as other
from {nation}
"""

# A labelled document is a finding about a batch (its source); the evidence are the documents of the source.
EVIDENCE_RANGES = """
select source as batch_id, 'E-' || source || '-' || cast(doc_id as string) as evidence_id, 'docs/d' || cast(doc_id as string) || '.txt' as path,
       cast(1 as bigint) as first, cast(length(text) - length(replace(text, chr(10), '')) + 1 as bigint) as last
from {documents}
"""

FINDINGS_JSON = """
select d.source as batch_id, 'F-' || cast(d.doc_id as string) as finding_id, d.doc_id as finding_pos,
  '{{"finding_id": "F-' || cast(d.doc_id as string) || '", "batch_id": "' || d.source || '", "kind": "doc", '
  || case when d.doc_id % 6 <> 1 then '"title": "' || case when d.doc_id % 5 = 0 then 'plain title' else '文档 ' || cast(d.doc_id as string) end || '", ' else '' end
  || '"current_state": "' || case when d.doc_id % 8 = 0 then 'english only' else '现状' end || '", '
  || case d.doc_id % 14 when 3 then '"repairs": [{{"rationale": "fix it", "confidence": 0.5}}], ' when 9 then '"notes": ["english note", {{"reason": "nested reason"}}, ["not a field"]], ' else '' end
  || '"knowledge_level": "' || case d.doc_id % 4 when 0 then 'code_map' when 1 then 'feature_implementation' when 2 then 'coding_playbook' else 'other_level' end || '", '
  || '"confidence": ' || case when d.doc_id % 9 = 0 then '1.5' when d.doc_id % 9 = 4 then '"high"' else '0.' || cast(5 + l.quality * 4 as string) end || ', '
  || '"evidence_refs": ["E-' || d.source || '-' || cast(d.doc_id as string) || '", "docs/d' || cast(d.doc_id as string) || '.txt:1-' || cast(1 + d.doc_id % 12 as string) || '", "docs/d'
       || cast(d.doc_id + 1 as string) || '.txt:1-1"], '
  || '"coverage_claims": [{claims}], '
  || '"blocking_gaps": [' || case when d.doc_id % 10 = 0 then '"缺少证据"' else '' end || '], '
  || '"non_blocking_gaps": [' || case when d.doc_id % 3 = 0 then '{{"detail": "only english"}}, "次要缺口"' else '' end || '], '
  || case when d.doc_id % 7 <> 2 then '"exploration_hints": ["看看 ' || cast(d.doc_id as string) || '"], ' else '' end
  || case when d.doc_id % 15 = 1 then '"gaps": [], ' else '' end
  || case when d.doc_id % 5 <> 1 then '"knowledge_object_candidates": ["' || case when d.doc_id % 3 = 0 then 'entities/code/features/f' || cast(d.doc_id % 30 as string) || '.md'
         when d.doc_id % 3 = 1 then 'wiki/entities/code/features/f' || cast(d.doc_id % 30 as string) || '.md' else 'wiki/entities/code/topic' || cast(d.doc_id % 30 as string) || '.md' end || '"], ' else '' end
  || '"coding_context": {{"change_points": [{{"summary": "改这里", "evidence_refs": ["E-' || d.source || '-' || cast(d.doc_id as string) || '"]}}], "reuse_points": [{{"summary": "reuse", "evidence_refs": []}}], '
  || '"data_contracts": [{{"summary": "", "evidence_refs": ["nowhere.txt:1-2"]}}]}}}}' as line
from {documents} d join {labels} l on d.doc_id = l.doc_id
"""


def _claims() -> str:
    from .functions.fixed_values import CONTRACT_ITEMS

    def item(j: int) -> str:
        names = " ".join(
            f"when {level} then '{CONTRACT_ITEMS[name][j % len(CONTRACT_ITEMS[name])]}'"
            for level, name in enumerate(["code_map", "feature_implementation", "coding_playbook"])
        )
        return f"case d.doc_id % 4 {names} else 'free item {j}' end"

    parts = []
    for j in range(9):
        status = f"case (d.doc_id + {j}) % 13 when 5 then 'not_applicable' when 7 then 'blocking_gap' when 9 then 'unknown' else 'covered' end"
        refs = (
            f"case when d.doc_id % 12 = 1 then '\"E-' || d.source || '-' || cast(d.doc_id as string) || '\"' "
            f"when (d.doc_id + {j}) % 8 = 3 then '' "
            f"else '\"docs/d' || cast(d.doc_id as string) || '.txt:1-' || cast(1 + (d.doc_id + {j}) % 9 as string) || '\"' end"
        )
        lead = "'" if j == 0 else "', "
        piece = (
            f"{lead}{{\"item\": \"' || {item(j)} || '\", \"status\": \"' || {status} || '\", \"evidence_refs\": [' || {refs} || ']}}'"
        )
        parts.append(piece if j < 4 else f"case when d.doc_id % 4 in (1, 2) and (d.doc_id + {j}) % 9 <> 8 then {piece} else '' end")
    return "' || " + " || ".join(parts) + " || '"


# A labelled document asks for changes: a request document with a shard table and an output table.
CHANGE_REQUESTS = """
select 'r' || cast(d.doc_id as string) as request_id, d.doc_id, d.source as root_id,
  split_part(d.text, chr(10), -1) as task, case when d.doc_id % 3 = 0 then 'state/handoffs/r' || cast(d.doc_id as string) || '/handoff/request.md' end as source_path,
  case when d.doc_id % 9 <> 4 then '# Knowledge Manager 维护请求' else '# other' end || chr(10) || '- knowledge_id: ' || d.source || chr(10) || '- team_run_id: run-' || cast(d.doc_id % 50 as string) || chr(10)
  || '- manifest: handoff/manifest.json' || chr(10) || chr(10)
  || '| 分片 | 主题 | 来源批次 |' || chr(10) || '| --- | --- | --- |' || chr(10)
  || '| handoff/shards/H1.md | ' || translate(split_part(d.text, chr(10), 1), '|`', '') || ' | B1-x |' || chr(10)
  || case when l.quality = 1 then '| handoff/shards/H2.md | ' || translate(replace(d.text, chr(10), ' '), '|`', '') || ' | B2-y |' || chr(10) else '' end || chr(10)
  || '| 分片 | 来源摘要页 | 来源摘要蓝图 |' || chr(10) || '| --- | --- | --- |' || chr(10)
  || '| handoff/shards/H1.md | wiki/sources/code/team-runs/r' || cast(d.doc_id % 3 as string) || '.md | handoff/source/H1.md |' || chr(10) || chr(10)
  || case when d.doc_id % 2 = 0 then '| 分片 | 来源摘要页 | 主正式代码页 | 备选候选页 | 知识层级 | 落页蓝图 |' || chr(10) || '| --- | --- | --- | --- | --- | --- |' || chr(10)
       || '| handoff/shards/H1.md | wiki/s1.md | wiki/entities/code/features/data-policy_' || cast(d.doc_id % 40 as string) || '.md | 无 | feature_implementation | handoff/b1.md<br>handoff/b2.md |' || chr(10)
     else '| 分片 | Source summary | 候选正式代码页 | 知识层级 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)
       || '| handoff/shards/H1.md | wiki/s1.md | wiki/entities/code/modules/map.md, wiki/entities/code/features/f' || cast(d.doc_id % 40 as string) || '.md | code_map |' || chr(10) end as text
from {documents} d join {labels} l on d.doc_id = l.doc_id
"""

# Files beside the requests that came as files: manifests (some broken, some missing) and quality reports of their handoffs.
HANDOFF_FILES = """
select root_id, at || 'manifest.json' as path,
  case when doc_id % 5 = 0 then '{{"schema_version": ' else
  '{{"schema_version": "team.handoff_manifest.v1", "knowledge_manager_request": "handoff/km.md", "handoff_quality": "quality.json", "knowledge_id": "'
  || case when doc_id % 2 = 0 then root_id || '-m' else '' end || '", "run_id": "m-' || cast(doc_id % 50 as string) || '", "human_readable_output_language": "zh-CN", "shards": [{{'
  || '"path": "handoff/shards/M1.md", "topic": "' || topic || '", "source_batch": "B1-m", "verified_findings": "batches/b1/findings.jsonl", "analysis": "batches/b1/analysis.md", '
  || '"evidence": "", "source_summary_path": "wiki/s2.md", "source_summary_blueprint": "handoff/source/M1.md", "candidate_wiki_pages": ["wiki/entities/code/features/data-policy_'
  || cast(doc_id % 40 as string) || '.md", "", "wiki/entities/code/modules/alt_' || cast(doc_id % 7 as string) || '.md"], "primary_wiki_pages": ["wiki/entities/code/features/data-policy_' || cast(doc_id % 40 as string)
  || '.md"], "page_blueprints": ["handoff/m1.md", "plan/m2.md"], "knowledge_levels": ["feature_implementation"]}}]}}' end as text
from (select d.doc_id, d.source as root_id, translate(split_part(d.text, chr(10), 1), '|`"' || chr(9) || chr(13) || chr(92), '') as topic,
        'state/handoffs/r' || cast(d.doc_id as string) || case when d.doc_id % 2 = 0 then '/handoff/' else '/handoff/handoff/' end as at
      from {documents} d join {labels} l on d.doc_id = l.doc_id where d.doc_id % 3 = 0 and d.doc_id % 7 <> 0) m
union all
select d.source, 'state/handoffs/r' || cast(d.doc_id as string) || case when d.doc_id % 2 = 0 then '/handoff/' else '/handoff/handoff/' end || 'quality.json',
  case when d.doc_id % 9 = 0 then '{{"schema_version": "team.other.v1"}}'
    else '{{"schema_version": "team.handoff_quality.v1", "passed": ' || case when d.doc_id % 4 = 2 then 'true, "issues": []}}' else 'false, "issues": ["a", "b"]}}' end end
from {documents} d join {labels} l on d.doc_id = l.doc_id where d.doc_id % 3 = 0 and d.doc_id % 7 <> 0 and d.doc_id % 12 <> 0
"""

PLAN_BATCHES = """
select source as batch_id, 's' || source as slug, n_docs, cast(substr(source, 4) as bigint) as n
from (select source, count(*) as n_docs from {documents} group by source) x
"""


def sql_text(name: str, tables: dict[str, str]) -> str:
    """The adapter's SQL over the given table names (or sub-queries)."""
    text = globals()[name.upper()]
    if "{page_base}" in text:
        text = text.replace("{page_base}", PAGE_BASE)
    text = text.replace("{sections}", _sections() if "{sections}" in text else "").replace("{claims}", _claims() if "{claims}" in text else "")
    for table, actual in tables.items():
        text = text.replace("{" + table + "}", actual)
    return text.replace("{{", "{").replace("}}", "}")


def duckdb_sql(name: str) -> str:
    return sql_text(name, {t: t for t in TABLES})


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model table as a DataFrame over the parquet files of ``sf_dir``."""
    text = globals()[name.upper()]
    if "{page_base}" in text:
        text += PAGE_BASE
    views = {}
    for source in (t for t in TABLES if "{" + t + "}" in text):
        views[source] = "corpusspark_" + source
        read(spark, sf_dir, source).createOrReplaceTempView(views[source])
    return spark.sql(sql_text(name, views))


MODEL_TABLES = [n.lower() for n in list(globals()) if re.fullmatch(r"[A-Z_]+", n) and n not in ("TABLES", "MODEL_TABLES", "ROOT_FILES")]
