"""References between source files and their transitive closure from seed files.

``files``: repo_id, path (below the workspace), content.  A file's text is read once: what it names and what it offers
become one row of facts, and everything after works on facts.  Every lookup "is there a file / an endpoint / an export of
that name" is an equality join.  The closure is a semi-naive loop over levels: a turn follows the references of the files
found last.  After a change of files the facts of the changed files are replaced, references are resolved anew from facts,
and a stored closure is brought up to date by deleting, per batch, what lies behind the first changed level and deriving it
again (:func:`updated_closure`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.numbering import numbered
from ..functions.text import (
    any_of, canonical_path, ends_with_any, file_stem, file_suffix, lines_of, parent_path, slashes, strings, strip,
)
from ..session import cut_lineage, new_folder
from .inventory import language
from .search_strings import contained

REF = ["src", "dst", "kind", "symbol"]
#: Workspaces of up to this many files number the files of a turn by one window per batch.
WINDOW_FILES = 1 << 20


def _has_suffix(suffixes: list[str]) -> Column:
    return file_suffix(F.col("path")).isin(suffixes)


def _not_below(directories: list[str]) -> Column:
    return ~any_of(F.concat(F.lit("/"), F.col("path")).contains(f"/{d}/") for d in directories)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


# ---- what a file offers ------------------------------------------------------------------------------------
def normalized_endpoint(value: Column) -> Column:
    v = F.trim(strip(value), F.lit("/"))
    v = F.when(v.contains("://") | v.contains("${"), F.lit("")).otherwise(v)
    return F.trim(F.substring_index(v, "?", 1), F.lit("/"))


MAPPING = r"(?s)@(?:RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping)\s*(?:\((.*?)\))?"


def mapping_paths(text: Column) -> Column:
    quoted = F.flatten(F.transform(_all(text, MAPPING), lambda body: _all(body, "['\"]([^'\"]+)['\"]")))
    return F.filter(F.array_distinct(F.transform(quoted, normalized_endpoint)), lambda v: v != "")


def controller_endpoints(text: Column) -> Column:
    """Mapping paths of a controller, alone and as class path / member path."""
    head = F.regexp_extract(text, r"(?Us)^(.*?)\b(?:class|interface)\s+\w+", 1)
    has_class = text.rlike(r"(?U)\b(?:class|interface)\s+\w+")
    tail = F.regexp_replace(text, r"(?Us)^.*?\b(?:class|interface)\s+\w+", "")
    bases = F.when(has_class, mapping_paths(head)).otherwise(strings([]))
    leaves = F.when(has_class, mapping_paths(tail)).otherwise(strings([]))

    def combine(base: Column, leaf: Column) -> Column:
        return F.when(base == leaf, F.lit("")).when(F.startswith(leaf, F.concat(base, F.lit("/"))), leaf).otherwise(
            F.concat_ws("/", base, leaf)
        )

    combined = F.flatten(F.transform(bases, lambda b: F.transform(leaves, lambda x: combine(b, x))))
    return F.array_distinct(F.concat(mapping_paths(text), F.filter(combined, lambda v: v != "")))


def exported_symbols(text: Column) -> Column:
    found = F.concat(
        _all(text, r"(?U)\bexport\s+(?:const|function|async\s+function)\s+([A-Za-z_]\w*)\b"),
        _all(text, r"(?U)\b([A-Za-z_]\w*)\s*:\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_]\w*)\s*=>"),
        _all(text, r"(?U)\b([A-Za-z_]\w*)\s*\([^)]*\)\s*\{"),
    )
    return F.filter(F.array_distinct(found), lambda s: ~s.isin(V.NON_SYMBOL_WORDS))


def is_api_module(path: Column, text: Column) -> Column:
    in_directory = any_of(path.contains(d) for d in V.API_MODULE_DIRECTORIES)
    calls = text.rlike(r"(?U)\b(?:axios|request|\$axios)\s*\(") & text.rlike(r"(?U)\burl\s*:")
    return _has_suffix(V.API_MODULE_SUFFIXES) & _not_below(V.API_INDEX_IGNORED) & (in_directory | calls)


# ---- references of front-end files -----------------------------------------------------------------------
IMPORT = r"from\s+['\"][^'\"]+['\"]|import\s*\(\s*['\"][^'\"]+['\"]\s*\)|import\s+['\"][^'\"]+['\"]"


def import_specs(text: Column) -> Column:
    return F.transform(_all(text, "(" + IMPORT + ")"), lambda m: F.regexp_extract(m, "['\"]([^'\"]+)['\"]", 1))


def import_refs(facts: DataFrame) -> DataFrame:
    """Relative and ``@/`` imports; the first existing extension wins."""
    all_files = facts.select("path")
    named = facts.select(F.col("path").alias("src"), F.posexplode("imports").alias("pos", "symbol"))
    alias = F.col("symbol").rlike("^~?@/")
    inside = F.concat_ws("/", F.regexp_extract("src", r"^((?:.*/)?src)/", 1), F.regexp_replace("symbol", "^~?@/", ""))
    has_src = F.col("src").rlike(r"(^|/)src/")
    base = F.when(F.col("symbol").startswith("."), F.concat_ws("/", parent_path(F.col("src")), "symbol")).when(alias & has_src, inside)
    based = named.withColumn("base", canonical_path(base))
    # Files outside a source folder use the source folder of their closest ancestor that has one.
    all_parts = F.split("path", "/")
    src_parents = all_files.where(F.col("path").rlike("(^|/)src/")).select(F.explode(F.transform(
        F.filter(F.sequence(F.lit(1), F.size(all_parts) - 1), lambda i: F.element_at(all_parts, i) == "src"),
        lambda i: F.array_join(F.slice(all_parts, F.lit(1), i - 1), "/"),
    )).alias("ancestor")).distinct()
    src_parts = F.split("src", "/")
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(src_parts) - 1),
        lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(src_parts, F.lit(1), i), "/").alias("ancestor")),
    )
    outside = based.where(alias & ~has_src).select("src", "pos", "symbol", F.inline(ancestors)).join(src_parents, "ancestor").groupBy(
        "src", "pos", "symbol").agg(F.max_by("ancestor", "depth").alias("ancestor"))
    outside = outside.select("src", "pos", "symbol", canonical_path(
        F.concat_ws("/", "ancestor", F.lit("src"), F.regexp_replace("symbol", "^~?@/", ""))).alias("base"))
    # A file stands under every base that an extension leads to it from, so an import asks once, not once per extension.
    left = F.filter(F.transform(strings(V.IMPORT_EXTENSIONS), lambda e, i: F.struct(
        i.alias("try_no"), F.when(F.endswith("path", e), F.substring(F.col("path"), F.lit(1), F.char_length("path") - F.char_length(e))).alias("base"))),
        lambda x: x["base"].isNotNull())
    known = all_files.distinct().select(F.col("path").alias("dst"), F.inline(left))
    hits = based.where("base is not null").unionByName(outside).join(known, "base")
    firsts = hits.groupBy("src", "pos", "symbol").agg(F.min(F.struct("try_no", "dst")).alias("f")).select("src", "pos", "symbol", F.col("f.dst").alias("dst"))
    kind = F.when(F.col("symbol").rlike("^~?@/"), "js_alias_import").otherwise("js_relative_import")
    return firsts.select("src", "dst", kind.alias("kind"), "symbol", F.struct(F.lit(0).alias("step"), F.col("pos").cast("long").alias("pos"), F.lit("").alias("name")).alias("ref_pos"))


def api_calls(text: Column) -> Column:
    """ARRAY<STRUCT<module, method>> of API calls, in pattern order, distinct."""

    def pairs(pattern: str, module: str, method: str) -> Column:
        return F.transform(
            _all(text, "(" + pattern + ")"),
            lambda m: F.struct(F.regexp_extract(m, module, 1).alias("module"), F.regexp_extract(m, method, 1).alias("method")),
        )

    word = r"[A-Za-z_]\w*"
    single = F.transform(
        _all(text, rf"(?U)\badpApi\.({word})"), lambda m: F.struct(F.lit("adpApi").alias("module"), m.alias("method"))
    )
    return F.array_distinct(F.concat(
        pairs(rf"(?U)(?:this\.)?\$api\.{word}\.{word}", rf"(?U)\$api\.({word})\.", rf"(?U)\.({word})$"),
        pairs(rf"(?U)(?:this\.)?\$api\[['\"][^'\"]+['\"]\]\.{word}", r"\[['\"]([^'\"]+)['\"]\]", rf"(?U)\.({word})$"),
        pairs(rf"(?U)\bapi\.{word}\.{word}", rf"(?U)^api\.({word})\.", rf"(?U)\.({word})$"),
        single,
    ))


def api_refs(facts: DataFrame) -> DataFrame:
    """API calls to exporting modules: ``module.method`` first, the bare method otherwise."""
    exports = facts.select("path", file_stem(F.col("path")).alias("module"), F.explode("exports").alias("symbol"))
    index = exports.select("path", F.explode(F.array(F.concat_ws(".", "module", "symbol"), F.col("symbol"))).alias("key"))
    calls = facts.select(F.col("path").alias("src"), F.posexplode("calls").alias("pos", "c"))
    keys = calls.select("src", "pos", F.posexplode(F.array(F.concat_ws(".", "c.module", "c.method"), F.col("c.method"))).alias("try_no", "key"))
    hits = keys.join(index.select("key", F.col("path").alias("dst")).distinct(), "key")
    best = hits.withColumn("best", F.min("try_no").over(W.partitionBy("src", "pos"))).where("try_no = best")
    return best.select("src", "dst", F.lit("frontend_api_module_call").alias("kind"), F.col("key").alias("symbol"),
                       F.struct(F.lit(1).alias("step"), F.col("pos").cast("long").alias("pos"), F.col("dst").alias("name")).alias("ref_pos"))


def endpoint_literals(text: Column) -> Column:
    found = _all(text, "['\"`](/(?:[A-Za-z0-9_$:{}.-]+/)+[A-Za-z0-9_$:{}.-]+)['\"`]")
    return F.filter(F.array_distinct(F.transform(found, normalized_endpoint)), lambda v: v != "")


def export_blocks(text: Column) -> Column:
    """ARRAY<STRUCT<symbol, text>>: each exported declaration up to the next one."""
    marked = F.regexp_replace(text, r"(?Um)^(\s*export\s+(?:const|function)\s+[A-Za-z_]\w*\b)", "\u0001$1")
    parts = F.split(marked, "\u0001")
    return F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(F.regexp_extract(p, r"(?U)^\s*export\s+(?:const|function)\s+([A-Za-z_]\w*)", 1).alias("symbol"), p.alias("text")),
    )


def endpoint_targets(facts: DataFrame) -> DataFrame:
    """(path, block_no, symbol, pos, dst): endpoints named in a front-end file's blocks -> controllers, by the longest
    known prefix.  Block 0 is the whole file, the others are its exports."""
    blocks = facts.select("path", F.posexplode("blocks").alias("block_no", "b"))
    named = blocks.select("path", "block_no", F.posexplode("b.endpoints").alias("pos", "symbol"))
    parts = F.filter(F.split("symbol", "/"), lambda p: p != "")
    tries = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "/").alias("endpoint")))
    index = facts.select(F.col("path").alias("dst"), F.explode("mappings").alias("endpoint")).distinct()
    hits = named.select("symbol").distinct().select("symbol", F.inline(tries)).join(index, "endpoint")
    best = hits.withColumn("longest", F.max("n").over(W.partitionBy("symbol"))).where("n = longest").select("symbol", "dst").distinct()
    return named.join(best, "symbol").select("path", "block_no", "symbol", F.col("pos").cast("long").alias("pos"), "dst")


# ---- references of JVM files ---------------------------------------------------------------------------------
def type_names(text: Column) -> Column:
    """Types a file names in imports, signatures and ``implements`` / ``extends``; generic names excluded."""
    imports = F.filter(
        _all(text, r"(?U)(import\s+[\w.]+\.[A-Z]\w+\s*;)"), lambda m: ~m.rlike(r"(?U)^import\s+(?:java|javax|jakarta)\.")
    )
    imported = F.transform(imports, lambda m: F.regexp_extract(m, r"(?U)\.([A-Z]\w+)\s*;$", 1))
    stripped = F.transform(lines_of(text), strip)
    signatures = F.array_join(
        F.filter(
            stripped,
            lambda v: (v != "") & ~v.startswith("*") & ~v.startswith("//")
            & (v.rlike(r"(?U)^(?:private|protected|public)\s+") | v.rlike(r"(?U)\b(?:implements|extends)\b")),
        ),
        "\n",
    )
    fields = _all(signatures, r"(?U)\b(?:private|protected|public)\s+(?:static\s+)?(?:final\s+)?([A-Z]\w+)(?:<[^;=(){}]+>)?\s+\w+\s*(?:[;=,)]|\))")
    parameters = _all(signatures, r"(?U)\b([A-Z]\w+)(?:<[^,(){}]+>)?\s+\w+\s*[,)]")
    parents = _all(text, r"(?U)\b(?:implements|extends)\s+([A-Z]\w+)")
    names = F.array_distinct(F.concat(imported, fields, parameters, parents))
    return F.filter(names, lambda n: ~n.isin(V.GENERIC_ROLE_NAMES + V.COMMON_TYPE_NAMES))


def type_refs(facts: DataFrame) -> DataFrame:
    """Type references, and contract -> implementation references by the name inside the file stem."""
    named = facts.select(F.col("path").alias("src"), F.explode("types").alias("symbol"))
    index = facts.where(_has_suffix(V.FILE_INDEX_SUFFIXES) & _not_below(V.FILE_INDEX_IGNORED)).select(file_stem(F.col("path")).alias("stem"), "path")
    jvm = index.where(_has_suffix(V.JVM_SUFFIXES))

    def order(rank: str) -> Column:
        """By type name, direct references before implementations."""
        return F.struct(F.lit(3).alias("step"), F.lit(0).cast("long").alias("pos"), F.concat_ws("\n", "symbol", F.lit(rank), "dst").alias("name")).alias("ref_pos")

    direct = named.join(jvm.select(F.col("stem").alias("symbol"), F.col("path").alias("dst")), "symbol").where("src <> dst")
    # Contract names that the files use are looked up in every implementation stem in one pass over the stem.
    contracts = named.where(F.col("symbol").rlike("^[A-Z]") & ends_with_any(F.col("symbol"), V.ROLE_SUFFIXES)).select(F.col("symbol").alias("needle")).distinct()
    stems = jvm.where(ends_with_any(F.col("stem"), V.IMPLEMENTATION_SUFFIXES)).select("stem", F.col("path").alias("dst"))
    implementations = contained(contracts, stems, "stem").where("needle <> stem").select("dst", F.col("needle").alias("symbol"))
    implemented = named.join(implementations, "symbol").where("src <> dst")
    return direct.select("src", "dst", F.lit("java_type_reference").alias("kind"), "symbol", order("0")).unionByName(
        implemented.select("src", "dst", F.lit("java_interface_or_contract_implementation").alias("kind"), "symbol", order("1"))
    )


# ---- facts and resolved references -----------------------------------------------------------------------------
def file_facts(files: DataFrame) -> DataFrame:
    """One row per path: everything a file names (imports, calls, endpoints per export block, types) and offers (mapping
    paths, exports).  The only step that reads texts."""
    text, path = F.col("content"), F.col("path")
    frontend, jvm = _has_suffix(V.FRONTEND_SUFFIXES), _has_suffix(V.JVM_SUFFIXES)

    def only(condition: Column, values: Column, empty: str) -> Column:
        return F.when(condition, values).otherwise(F.array().cast(empty))

    whole = F.array(F.struct(F.lit(None).cast("string").alias("symbol"), text.alias("text")))
    blocks = F.transform(F.concat(whole, export_blocks(text)), lambda b: F.struct(b["symbol"].alias("symbol"), endpoint_literals(b["text"]).alias("endpoints")))
    controller = jvm & _not_below(V.ENDPOINT_INDEX_IGNORED) & text.contains("Mapping")
    return files.select("path", "content").dropDuplicates(["path"]).select(
        "path",
        only(frontend, import_specs(text), "array<string>").alias("imports"),
        only(frontend, api_calls(text), "array<struct<module:string,method:string>>").alias("calls"),
        only(frontend & text.rlike("['\"`]/"), blocks, "array<struct<symbol:string,endpoints:array<string>>>").alias("blocks"),
        only(jvm, type_names(text), "array<string>").alias("types"),
        only(controller, controller_endpoints(text), "array<string>").alias("mappings"),
        only(is_api_module(path, text), exported_symbols(text), "array<string>").alias("exports"),
    )


@dataclass(frozen=True)
class CodeIndex:
    """The facts of a workspace and the references that follow from them.

    facts: path, imports, calls, blocks, types, mappings, exports      refs: src, dst, kind, symbol, ref_pos
    endpoints: path, block_no, symbol, pos, dst     blocks: path, block_no, export     symbols: path, symbol (called methods)
    """

    facts: DataFrame
    refs: DataFrame
    endpoints: DataFrame
    blocks: DataFrame
    symbols: DataFrame


def resolved(facts: DataFrame) -> CodeIndex:
    """References between the files of a table of facts."""
    refs = import_refs(facts).unionByName(api_refs(facts)).unionByName(type_refs(facts))
    blocks = facts.select("path", F.posexplode("blocks").alias("block_no", "b")).where("block_no > 0").select("path", "block_no", F.col("b.symbol").alias("export"))
    symbols = facts.select("path", F.explode("calls").alias("c")).select("path", F.col("c.method").alias("symbol")).distinct()
    return CodeIndex(facts, cut_lineage(distinct_refs(refs)), cut_lineage(endpoint_targets(facts)), cut_lineage(blocks), cut_lineage(symbols))


def build_index(files: DataFrame) -> CodeIndex:
    return resolved(cut_lineage(file_facts(files)))


def refreshed_index(index: CodeIndex, changed: DataFrame, files: DataFrame) -> CodeIndex:
    """The index after ``changed`` (path) files were added, rewritten or removed; only their texts are read from ``files``."""
    paths = changed.select("path").distinct()
    kept = index.facts.join(paths, "path", "left_anti")
    return resolved(cut_lineage(kept.unionByName(file_facts(files.join(paths, "path", "left_semi")))))


def distinct_refs(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*REF).agg(F.min("ref_pos").alias("ref_pos"))


def reference_edges(index: CodeIndex) -> DataFrame:
    """All references of all files (endpoints read from whole files)."""
    named = index.endpoints.where("block_no = 0").select(F.col("path").alias("src"), "dst", F.lit("http_endpoint_to_controller").alias("kind"), "symbol")
    return index.refs.select(*REF).unionByName(named.distinct())


# ---- closure ----------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Closure:
    """nodes: batch_id, path, seq, level     edges: batch_id, src, dst, kind, symbol (of visited files)

    ``index``, ``owners`` and ``scope`` are what it was derived from.
    """

    nodes: DataFrame
    edges: DataFrame
    index: CodeIndex
    owners: DataFrame | None = None
    scope: DataFrame | None = None


NODES = "batch_id string, path string, seq long, level int"
FOCUS = "batch_id string, export string, first_seq long"


def seed_files(batches: DataFrame) -> DataFrame:
    """(batch_id, path, seed_no): planned paths and entrypoints without their line part, first ones first."""
    values = F.concat(F.coalesce("paths", strings([])), F.coalesce("entrypoints", strings([])))
    listed = F.array_distinct(F.transform(values, lambda v: slashes(F.substring_index(v, ":", 1))))
    return batches.select("batch_id", F.posexplode(F.filter(listed, lambda v: v != "")).alias("seed_no", "path")).where(
        ~canonical_path(F.col("path")).startswith("..") & ~F.col("path").startswith("/")
    )


def batch_repositories(batches: DataFrame, seeds: DataFrame, repos: DataFrame) -> DataFrame:
    """(batch_id, repo_path): repositories a selector names, by equality or as a path prefix.

    The prefix test is an equality join on the folder prefixes of the selector.
    """
    chosen = batches.select("batch_id", F.explode(F.coalesce("repo_ids", strings([]))).alias("selector")).unionByName(
        seeds.select("batch_id", F.col("path").alias("selector"))
    )
    clean = chosen.select("batch_id", F.trim(slashes(F.col("selector")), F.lit("/")).alias("selector")).where("selector <> ''").distinct()
    parts = F.split("selector", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keys = clean.select("batch_id", F.explode(folders).alias("k"))
    named = repos.select(F.explode(F.array_distinct(F.array("name", "path"))).alias("k"), F.col("path").alias("repo_path"))
    found = keys.join(named, "k").select("batch_id", "repo_path").distinct()
    guessed = seeds.join(found, "batch_id", "left_anti").select(
        "batch_id", F.regexp_extract("path", "^(repos/[^/]+)/?", 1).alias("repo_path")
    ).where("repo_path <> ''").distinct()
    return found.unionByName(guessed)


def file_owners(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """(path, owner): the longest registered repository path that a file lies in."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "/").alias("repo_path")))
    return (
        paths.select("path", F.inline(folders)).join(repos.select(F.col("path").alias("repo_path")).distinct(), "repo_path")
        .groupBy("path").agg(F.max_by("repo_path", "n").alias("owner"))
    )


def _placed(refs: DataFrame, owners: DataFrame | None) -> DataFrame:
    return refs if owners is None else refs.join(owners.withColumnRenamed("path", "dst"), "dst", "left")


def _in_scope(step: DataFrame, scope: DataFrame | None) -> DataFrame:
    """References whose target lies in a repository of their batch, and relative imports, which need no index."""
    if scope is None:
        return step
    allowed = scope.select("batch_id", F.col("repo_path").alias("owner"), F.lit(True).alias("_allowed")).distinct()
    return step.join(allowed, ["batch_id", "owner"], "left").where((F.col("kind") == "js_relative_import") | F.coalesce("_allowed", F.lit(False))).drop("_allowed", "owner")


def in_scope(step: DataFrame, owners: DataFrame, scope: DataFrame) -> DataFrame:
    """The references a batch may follow; ``owners`` (path, owner) and ``scope`` (batch_id, repo_path)."""
    return _in_scope(_placed(step, owners), scope).select(*step.columns)


@dataclass(frozen=True)
class _Rules:
    """The index with the repository of each target, written once per evaluation."""

    refs: DataFrame
    endpoints: DataFrame
    blocks: DataFrame
    symbols: DataFrame
    scope: DataFrame | None
    few: bool  # files

    @classmethod
    def of(cls, index: CodeIndex, owners: DataFrame | None, scope: DataFrame | None) -> _Rules:
        refs, endpoints = _placed(index.refs, owners), _placed(index.endpoints, owners)
        if owners is not None:
            refs, endpoints = cut_lineage(refs), cut_lineage(endpoints)
        return cls(refs, endpoints, index.blocks, index.symbols, scope, index.facts.count() <= WINDOW_FILES)

    def called(self, nodes: DataFrame) -> DataFrame:
        """The exports that files call, with the first caller's place; those of the seeds count from the start."""
        since = F.when(F.col("level") == 0, F.lit(0).cast("long")).otherwise(F.col("seq"))
        return nodes.join(self.symbols, "path").groupBy("batch_id", F.col("symbol").alias("export")).agg(F.min(since).alias("first_seq"))

    def step(self, nodes: DataFrame, focus: DataFrame) -> DataFrame:
        """References of ``nodes``: batch_id, seq, level, src, dst, kind, symbol, ref_pos.

        Endpoints of a file count inside the exports that files before it call; without such an export the whole file counts.
        """
        place = ["batch_id", "seq", "level"]
        plain = nodes.join(self.refs, nodes["path"] == self.refs["src"]).drop("path")
        naming = nodes.join(self.endpoints.select("path").distinct(), "path", "left_semi")
        hit = naming.join(self.blocks, "path").join(focus, ["batch_id", "export"]).where("first_seq <= seq").select(*place, "path", "block_no").distinct()
        rest = naming.join(hit.select("batch_id", "path").distinct(), ["batch_id", "path"], "left_anti").select(*place, "path", F.lit(0).alias("block_no"))
        found = hit.unionByName(rest).join(self.endpoints, ["path", "block_no"])
        owner = [c for c in ("owner",) if c in found.columns]
        first = found.groupBy(*place, "path", "symbol", "dst", *owner).agg(F.min(F.col("block_no").cast("long") * 1_000_000 + F.col("pos")).alias("pos"))
        focused = first.select(
            *place, F.col("path").alias("src"), "dst", F.lit("http_endpoint_to_controller").alias("kind"), "symbol", *owner,
            F.struct(F.lit(2).alias("step"), "pos", F.col("dst").alias("name")).alias("ref_pos"))
        return _in_scope(plain.unionByName(focused), self.scope)

    def number(self, rows: DataFrame, name: str) -> DataFrame:
        """1, 2, 3 ... per batch by the column ``o``; a batch finds at most as many files as there are."""
        if self.few:
            return rows.withColumn(name, F.row_number().over(W.partitionBy("batch_id").orderBy("o")))
        # Range partitions are sampled first, which would compute the turn's joins a second time.
        return numbered(cut_lineage(rows), ["batch_id"], "o", name)


def _first_level(rules: _Rules, index: CodeIndex, seeds: DataFrame) -> DataFrame:
    first = seeds.join(index.facts.select("path"), "path", "left_semi").groupBy("batch_id", "path").agg(F.min("seed_no").alias("o"))
    return cut_lineage(rules.number(first, "seq").select("batch_id", "path", F.col("seq").cast("long").alias("seq"), F.lit(0).alias("level")))


def _derive(rules: _Rules, visited: DataFrame, frontier: DataFrame, max_levels: int | None) -> tuple[DataFrame, DataFrame]:
    """All nodes that ``frontier`` (the last level of each batch in ``visited``) leads to, and the exports they call.

    Each turn appends its files and their calls to tables in the checkpoint folder and goes on from there, so plans stay
    small, and lost executors cost one turn.  Only "were there new files" reaches the driver.
    """
    spark = visited.sparkSession
    folder, turn = new_folder(spark, "closure"), 0
    visited.select("batch_id", "path", "seq", "level").write.parquet(f"{folder}/nodes/turn=0")
    rules.called(visited).write.parquet(f"{folder}/focus/turn=0")

    def told(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/{name}").select(*[c.split()[0] for c in schema.split(", ")])

    while True:
        step = rules.step(frontier, told("focus", FOCUS))
        found = (
            step.groupBy("batch_id", F.col("dst").alias("path")).agg(F.min(F.struct("seq", "ref_pos")).alias("o"), F.max("level").alias("level"))
            .join(told("nodes", NODES).select("batch_id", "path"), ["batch_id", "path"], "left_anti")
        )
        last = frontier.groupBy("batch_id").agg(F.max("seq").alias("last_seq"))
        turn += 1
        rules.number(found, "no").join(last, "batch_id").select(
            "batch_id", "path", (F.col("last_seq") + F.col("no")).alias("seq"), (F.col("level") + 1).alias("level")
        ).write.parquet(f"{folder}/nodes/turn={turn}")
        frontier = spark.read.schema(NODES).parquet(f"{folder}/nodes/turn={turn}")
        if frontier.isEmpty():
            return told("nodes", NODES), told("focus", FOCUS)
        if max_levels is not None and turn >= max_levels:
            raise RuntimeError(f"closure still grows after {max_levels} levels")
        rules.called(frontier).write.parquet(f"{folder}/focus/turn={turn}")


def _edges(rules: _Rules, nodes: DataFrame, focus: DataFrame) -> DataFrame:
    """References of all visited files at once: whether an export counts for a file depends on places alone."""
    first = focus.groupBy("batch_id", "export").agg(F.min("first_seq").alias("first_seq"))
    return rules.step(nodes, first).select("batch_id", *REF)


def _setting(index: CodeIndex, scope: DataFrame | None, repos: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    if scope is None:
        return None, None
    return cut_lineage(file_owners(index.facts.select("path"), repos)), cut_lineage(scope)


def closure(index: CodeIndex, seeds: DataFrame, max_levels: int | None = None, scope: DataFrame | None = None,
            repos: DataFrame | None = None) -> Closure:
    """Breadth-first closure of the references of many batches at once.

    ``seeds``: batch_id, path, seed_no.  ``scope`` (batch_id, repo_path) and ``repos`` (name, path) keep a batch inside
    its repositories; without them all files are open to every batch.  ``max_levels`` ends a longer loop by an error.
    """
    owners, scope = _setting(index, scope, repos)
    rules = _Rules.of(index, owners, scope)
    frontier = _first_level(rules, index, seeds)
    nodes, focus = _derive(rules, frontier, frontier, max_levels)
    return Closure(nodes, cut_lineage(_edges(rules, nodes, focus)), index, owners, scope)


def _differing(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """(path): the values of ``name`` in rows that stand in one of two tables only."""
    both = before.withColumn("_n", F.lit(1)).unionByName(after.withColumn("_n", F.lit(-1)))
    return both.groupBy(*before.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0").select(F.col(name).alias("path")).distinct()


def updated_closure(old: Closure, index: CodeIndex, seeds: DataFrame, max_levels: int | None = None, scope: DataFrame | None = None,
                    repos: DataFrame | None = None) -> Closure:
    """The closure over a refreshed index, equal to one computed from nothing.

    A batch is touched from the lowest level on which a visited file has other references, exports or calls than before:
    files up to that level were found through unchanged references and keep their places; all behind it are deleted and
    derived again.  Other seeds start a batch anew, another scope keeps its seeds.  Untouched batches keep their rows.
    """
    owners, scope = _setting(index, scope, repos)
    rules, former = _Rules.of(index, owners, scope), _Rules.of(old.index, old.owners, old.scope)
    pairs = [(former.refs, rules.refs, "src"), (former.endpoints, rules.endpoints, "path"), (former.blocks, rules.blocks, "path"), (former.symbols, rules.symbols, "path")]
    dirty = _differing(*pairs[0])
    for pair in pairs[1:]:
        dirty = dirty.unionByName(_differing(*pair))
    cuts = old.nodes.join(dirty.distinct(), "path", "left_semi").groupBy("batch_id").agg(F.min("level").alias("cut"))
    if scope is not None and old.scope is not None:
        other = _differing(old.scope.distinct(), scope.distinct(), "batch_id").select(F.col("path").alias("batch_id"), F.lit(0).alias("cut"))
        cuts = cuts.unionByName(other)
    seeded = _first_level(rules, index, seeds)
    started = old.nodes.where("level = 0").select(*seeded.columns)
    anew = _differing(started, seeded, "batch_id").select(F.col("path").alias("batch_id"), F.lit(-1).alias("cut"))
    cuts = cut_lineage(cuts.unionByName(anew).groupBy("batch_id").agg(F.min("cut").alias("cut")))

    kept = old.nodes.join(cuts, "batch_id").where("level <= cut")
    begun = seeded.join(cuts.where("cut = -1"), "batch_id").withColumn("cut", F.lit(0))
    state = cut_lineage(kept.unionByName(begun))
    untouched = old.nodes.join(cuts, "batch_id", "left_anti").select(*seeded.columns)
    nodes, focus = _derive(rules, state.drop("cut"), state.where("level = cut").drop("cut"), max_levels)
    edges = old.edges.join(cuts, "batch_id", "left_anti").unionByName(_edges(rules, nodes, focus))
    return Closure(cut_lineage(untouched.unionByName(nodes)), cut_lineage(edges), index, owners, scope)


def closure_stats(c: Closure) -> DataFrame:
    """One row per batch: counts, followed kinds, policy."""
    n = c.nodes.groupBy("batch_id").agg(F.count("*").alias("file_count"), F.max("level").alias("levels"))
    e = c.edges.groupBy("batch_id").agg(F.count("*").alias("reference_count"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return n.join(e, "batch_id", "left").select(
        "batch_id", "file_count", "levels", F.coalesce("reference_count", F.lit(0)).alias("reference_count"),
        F.coalesce("kinds", strings([])).alias("followed_reference_kinds"), F.lit(V.CLOSURE_POLICY).alias("expansion_policy"),
        F.lit(V.CLOSURE_STOPPED).alias("stopped_reason"),
    )


def repository_of(path: Column) -> Column:
    """Repository of a file outside the registered ones: ``repos/<name>``, else the first path part."""
    parts = F.split(path, "/")
    return F.when((F.size(parts) >= 2) & (parts[0] == "repos"), F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def evidence_rows(c: Closure, files: DataFrame, repos: DataFrame) -> DataFrame:
    """Evidence ids, repository (longest registered prefix), language, line range and hash of visited files."""
    visited = c.nodes.select("path").distinct()
    owner = file_owners(visited, repos)
    lines = lines_of(F.col("content"))
    text = F.array_join(lines, "\n")
    described = files.select("path", "content").dropDuplicates(["path"]).join(visited, "path", "left_semi").select(
        "path", language(F.col("path")).alias("language"), F.greatest(F.size(lines), F.lit(1)).alias("last"),
        F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("hash"),
    )
    number = F.lpad(F.col("seq").cast("string"), 3, "0")
    number = F.when(F.col("seq") > 999, F.col("seq").cast("string")).otherwise(number)
    return c.nodes.join(described, "path").join(owner, "path", "left").select(
        "batch_id", F.concat_ws("-", F.lit("E"), "batch_id", number).alias("evidence_id"), "path",
        F.coalesce("owner", repository_of(F.col("path"))).alias("repo_id"), "language", F.lit(1).alias("first"), "last", "hash",
    )
