"""Relevance of index entries for whole query logs: module aliases, roles, exact scores, top-k candidates.

Scores are integers: fifths of a point while scoring, twentieths in candidate tables (a linked page has
three quarters of its source's score, which is exact in twentieths).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import fixed_values as V
from ..functions.numbering import numbered
from ..functions.sizing import lookup_join
from ..functions.terms import boundary_keys
from ..functions.text import contains_any, drop_suffix, index_path, let, repo_path, strings, strip
from ..session import cut_lineage
from .pair_scores import scored_cell
from .search_strings import found_in

FLAG_COLUMNS = ["wants_code_knowledge", "wants_code_navigation", "wants_runtime_boundary", "wants_source",
                "wants_data_dictionary"]
#: Entries and queries of a cell of pairs, and how many times the limit a root may hold and still be one cell.
BLOCK, QUERIES, FEW = 16_384, 16_384, 8
CLASS_COLUMNS = ["c_features", "c_modules", "c_code_feature", "c_code_module", "c_boundary", "c_source", "c_dictionary"]


# ---- page roles -----------------------------------------------------------------------------------
def page_role(path: Column) -> Column:
    return let(index_path(path), _role_of_index_path)


def _role_of_index_path(p: Column) -> Column:
    return (
        F.when(p.startswith("sources/"), "source")
        .when(p.contains("/data-dictionary/"), "data_dictionary")
        .when(p.contains("/regulation/requirements/"), "regulation_requirement")
        .when(p.contains("/solution/"), "solution")
        .when(p.contains("/features/"), "feature")
        .when(p.contains("/modules/"), "module")
        .when(p.startswith("concepts/"), "concept")
        .when(p.startswith("queries/"), "query")
        .otherwise("unknown")
    )


def page_type(role: Column) -> Column:
    return F.when(role.isin("source", "concept", "query"), role).otherwise("entity")


def is_code_feature(path: Column) -> Column:
    return index_path(path).startswith("entities/code/features/")


def is_code_module(path: Column) -> Column:
    return index_path(path).startswith("entities/code/modules/")


def is_repository_map(path: Column, title: Column) -> Column:
    lowered_path = F.lower(path)
    text = F.concat_ws(" ", lowered_path, F.lower(title))
    return is_code_module(lowered_path) & contains_any(text, V.REPOSITORY_MAP_HINTS)


# ---- module aliases ---------------------------------------------------------------------------------
def module_alias_values(path: Column, title: Column, summary: Column) -> Column:
    def is_segment(part: Column) -> Column:
        cleaned = strip(part)
        return (
            cleaned.rlike("^[A-Za-z][A-Za-z0-9_-]{1,15}$")
            & ~F.lower(cleaned).isin(V.NON_MODULE_TOKENS + V.NON_MODULE_SEGMENTS)
            & ((cleaned == F.upper(cleaned)) | ~cleaned.contains("-"))
        )

    segments = F.filter(F.transform(F.split(index_path(path), "/"), lambda p: drop_suffix(p, ".md")), is_segment)

    def of_text(text: Column) -> Column:
        # The next character is tested first: most places of a text fail there.
        upper = F.regexp_extract_all(text, F.lit("(?=[A-Z])(?<![A-Za-z0-9])([A-Z][A-Z0-9_-]{1,11})(?![A-Za-z0-9])"), F.lit(1))
        pairs = F.when(text.contains("/"), F.regexp_extract_all(
            text, F.lit("(?U)(?=[A-Z])\\b([A-Z][A-Za-z0-9]+(?:/[A-Z][A-Za-z0-9]+)+)\\b"), F.lit(1))).otherwise(strings([]))
        parts = F.flatten(F.transform(pairs, lambda p: F.split(p, "/")))
        return F.filter(F.concat(upper, parts), lambda v: ~F.lower(v).isin(V.NON_MODULE_TOKENS))

    return F.array_distinct(F.concat(segments, of_text(title), of_text(summary)))


def module_aliases(entries: DataFrame) -> DataFrame:
    """(root_id, alias_key, module, alias_rank): the first spelling of a key wins."""
    values = entries.select(
        "root_id", "entry_pos",
        F.posexplode(module_alias_values(F.col("path"), F.col("title"), F.col("summary"))).alias("value_pos", "value"),
    )
    rank = F.struct("entry_pos", "value_pos")
    return values.groupBy("root_id", F.lower("value").alias("alias_key")).agg(
        F.min_by("value", rank).alias("module"), F.min(rank).alias("alias_rank")
    )


def page_modules(pages: DataFrame, aliases: DataFrame, texts: bool = True) -> DataFrame:
    """(root_id, path, modules) for distinct pages: path segments first, then title, then summary."""
    segments = F.split(index_path(F.col("path")), "/")
    path_keys = F.transform(
        segments, lambda p, i: F.struct(F.lower(drop_suffix(strip(p), ".md")).alias("alias_key"), F.lit(0).alias("step"), i.alias("pos"))
    )
    keys = path_keys

    def standing_in(name: str, step: int) -> Column:
        return F.transform(
            boundary_keys(F.lower(name)),
            lambda k: F.struct(k.alias("alias_key"), F.lit(step).alias("step"), F.lit(0).alias("pos")),
        )

    if texts:
        keys = F.concat(path_keys, standing_in("title", 1), standing_in("summary", 2))
    # Most words name no module, so words meet the aliases before anything is shuffled or made distinct.
    exploded = pages.select("root_id", "path", F.inline(keys))
    matched = lookup_join(exploded, aliases.select("root_id", "alias_key", "module", "alias_rank"), ["root_id", "alias_key"], spread=["path"])
    place = [
        "step",
        F.when(F.col("step") == 0, F.col("pos").cast("long")).otherwise(F.col("alias_rank.entry_pos").cast("long")).alias("a"),
        F.when(F.col("step") == 0, F.lit(0)).otherwise(F.col("alias_rank.value_pos")).alias("b"),
    ]
    # The first place of a module counts.  One shuffle brings the different places of a page together, and they are sorted there;
    # a flat struct, for the order of one inside another is built anew for each two that are compared.
    found = F.sort_array(F.collect_set(F.struct(*place, "module")))
    return matched.groupBy("root_id", "path").agg(found.alias("found")).select(
        "root_id", "path", F.array_distinct(F.transform("found", lambda x: x["module"])).alias("page_modules"))


# ---- scoring -------------------------------------------------------------------------------------------
def classified_entries(entries: DataFrame) -> DataFrame:
    path, title, summary = (F.lower(c) for c in ("path", "title", "summary"))
    boundary_text = F.concat_ws(" ", title, summary, path)
    return entries.select(
        "root_id", "entry_pos", "path",
        title.alias("l_title"), summary.alias("l_summary"), path.alias("l_path"),
        path.contains("features/").alias("c_features"),
        path.contains("/modules/").alias("c_modules"),
        is_code_feature(path).alias("c_code_feature"),
        is_code_module(path).alias("c_code_module"),
        (is_code_feature(path) & contains_any(boundary_text, V.RUNTIME_BOUNDARY_PAGE_HINTS)).alias("c_boundary"),
        path.startswith("sources/").alias("c_source"),
        path.contains("data-dictionary").alias("c_dictionary"),
    )


def prior_score() -> Column:
    """The part of the score that does not depend on the words: page class x query flags, in fifths."""

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    feature, module = F.col("c_code_feature"), F.col("c_code_module")
    navigation = F.col("wants_code_navigation")
    preferred = (
        F.when(navigation & module, F.lit(V.W_NAVIGATION_MODULE))
        .when(navigation & feature, F.lit(V.W_NAVIGATION_FEATURE))
        .when(feature, F.lit(V.W_CODE_FEATURE))
        .when(module, F.lit(V.W_CODE_MODULE))
        .otherwise(F.lit(0))
    ) + points(F.col("wants_runtime_boundary") & F.col("c_boundary"), V.W_RUNTIME_BOUNDARY)
    plain = (
        F.when(feature, F.lit(V.W_PLAIN_CODE_FEATURE)).when(module, F.lit(V.W_PLAIN_CODE_MODULE)).otherwise(F.lit(0))
    )
    return (
        points(F.col("c_features"), V.W_FEATURES_PATH)
        + points(F.col("c_modules"), V.W_MODULES_PATH)
        + F.when(F.col("wants_code_knowledge"), preferred).otherwise(plain)
        + points(F.col("c_source") & ~F.col("wants_source"), V.W_UNREQUESTED_SOURCE)
        + points(F.col("c_dictionary") & ~F.col("wants_data_dictionary"), V.W_UNREQUESTED_DICTIONARY)
    )


def dense_ids(rows: DataFrame, name: str) -> DataFrame:
    """Adds 0, 1, 2 ... in no order, as an int: lists of such numbers are half as long as lists of unique longs."""
    placed = cut_lineage(rows.withColumn("_id", F.monotonically_increasing_id()))
    part, row = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row for each task that wrote: a short table.
    offsets = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, (row + F.col("_before")).cast("int")).drop("_id", "_part", "_before")


def query_terms(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words of a query log as numbers: (id, needle), and (query_id, tokens, whole) with the ids of each query's
    tokens and of the query as a whole."""
    q = targets.select("query_id", F.transform("tokens", lambda t: F.lower(t)).alias("tokens"), F.lower("lowered_query").alias("whole")).dropDuplicates(["query_id"])
    words = q.select("query_id", F.explode("tokens").alias("needle"), F.lit("token").alias("kind")).unionByName(
        q.select("query_id", F.col("whole").alias("needle"), F.lit("whole").alias("kind"))).where("needle <> ''")
    needles = cut_lineage(dense_ids(words.select("needle").distinct(), "id"))
    asked = words.join(needles, "needle").groupBy("query_id").agg(
        F.collect_set(F.when(F.col("kind") == "token", F.col("id"))).alias("tokens"),
        F.max(F.when(F.col("kind") == "whole", F.col("id"))).alias("whole"))
    return needles, cut_lineage(asked)


def entry_terms(classified: DataFrame, needles: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each entry with the ids of the words in its title, summary and path; words of the path that name a module of the
    root stand apart.  The texts are read once and go no further."""
    keep = ["root_id", "entry_pos", "path", *CLASS_COLUMNS]
    found = cut_lineage(found_in(needles, classified, ["l_title", "l_summary", "l_path"], keep=keep, value="id"))
    named = aliases.join(needles, aliases["alias_key"] == needles["needle"]).select("root_id", "id")
    in_path = found.select("root_id", "entry_pos", F.explode("l_path_found").alias("id"))
    modules = lookup_join(in_path, named, ["root_id", "id"], spread=["entry_pos"]).groupBy("root_id", "entry_pos").agg(F.collect_set("id").alias("modules"))
    path_modules = F.coalesce("modules", F.array().cast("array<int>"))
    return cut_lineage(found.join(modules, ["root_id", "entry_pos"], "left").select(
        *keep, F.col("l_title_found").alias("in_title"), F.col("l_summary_found").alias("in_summary"),
        F.array_except("l_path_found", path_modules).alias("in_path"), path_modules.alias("in_path_modules")))


FIELDS = [("in_title", V.W_TOKEN_TITLE), ("in_summary", V.W_TOKEN_SUMMARY), ("in_path", V.W_TOKEN_PATH), ("in_path_modules", V.W_MODULE_TOKEN_PATH)]
WHOLE = [("in_title", V.W_QUERY_IN_TITLE), ("in_summary", V.W_QUERY_IN_SUMMARY)]


def word_score() -> Column:
    """Points of a query (tokens, whole) for the words of an entry."""
    shared = [F.coalesce(F.size(F.array_intersect(c, "tokens")), F.lit(0)) * points for c, points in FIELDS]
    whole = F.lit(0)
    for name, points in reversed(WHOLE):
        whole = F.when(F.array_contains(name, F.col("whole")), points).otherwise(whole)
    return sum(shared, whole)


def score20() -> Column:
    """Score of one joined pair; :func:`pruned_scores` gives the same for all pairs of a cell at once."""
    # An array that is null (a query without words) has size null or -1, never points.
    return (F.when(F.col("tokens").isNull(), 0).otherwise(word_score()) + prior_score()) * 4


def _spelled(columns: list[str]) -> Column:
    """The values of some boolean columns, null included, as one text."""
    return F.concat(*[F.coalesce(F.col(c).cast("int").cast("string"), F.lit("-")) for c in columns])


def scored_cells(terms: DataFrame, wanted: DataFrame, size: int, few: int, of_entry: list[str], result: T.StructType) -> DataFrame:
    """What :func:`scored_cell` makes of the cells of all roots: rows of ``result``, with the columns ``of_entry`` of the entries.

    The entries and the queries of a root are dealt into cells of about ``size`` entries (one cell for at most ``few`` of
    them) and ``QUERIES`` queries.  A cell scores all its pairs and keeps the ``k`` best of every query.
    """
    e = terms.where("root_id is not null").withColumn("kind", _spelled(CLASS_COLUMNS))
    q = wanted.where("root_id is not null").withColumn("flags", _spelled(FLAG_COLUMNS))
    # Classes and flags are booleans, so there are few combinations of them however large the tables are.
    kinds, flags = e.select("kind", *CLASS_COLUMNS).distinct(), q.select("flags", *FLAG_COLUMNS).distinct()
    priors = {(r["kind"], r["flags"]): r["prior"] for r in kinds.crossJoin(flags).select("kind", "flags", prior_score().alias("prior")).collect()}

    def pieces(rows: DataFrame, name: str, each: int, whole: int = 0) -> DataFrame:
        n = F.count("*")
        return rows.groupBy("root_id").agg(F.when(n <= whole, 1).otherwise(F.ceil(n / each)).cast("int").alias(name))

    cells = cut_lineage(pieces(e, "n_chunks", size, few).join(pieces(q, "n_parts", QUERIES), "root_id"))
    place = lambda n, *key: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lists = [name for name, _ in FIELDS]
    left = e.join(cells, "root_id").select("root_id", place("n_chunks", "entry_pos", "path").alias("chunk"), every("n_parts").alias("part"), *of_entry, "kind", *lists)
    no_words = F.array().cast("array<int>")
    of_query = [c for c in result.names if c in wanted.columns and c not in ("root_id", "query_id", "k")]
    right = q.join(cells, "root_id").select(
        "root_id", every("n_chunks").alias("chunk"), place("n_parts", "query_id").alias("part"), "query_id", "k", "flags", *of_query,
        F.coalesce("tokens", no_words).alias("tokens"), F.when(F.col("tokens").isNotNull(), F.col("whole")).alias("whole"))
    target = to_arrow_schema(result)

    def scored(a: pa.Table, b: pa.Table) -> pa.Table:
        return scored_cell(a, b, FIELDS, WHOLE, priors, target)

    cell = ["root_id", "chunk", "part"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(scored, result)


def pruned_scores(terms: DataFrame, wanted: DataFrame, size: int, few: int = 0) -> DataFrame:
    """(query_id, root_id, k, entry_pos, path, score20) of all entries that can be among a query's ``k`` best of a root."""
    found = T.StructType([*wanted.select("query_id", "root_id", "k").schema, *terms.select("entry_pos", "path").schema, T.StructField("score", T.IntegerType())])
    return scored_cells(terms, wanted, size, few, ["entry_pos", "path"], found).withColumn("score20", F.col("score") * 4).drop("score")


def top_candidates(entries: DataFrame, targets: DataFrame, aliases: DataFrame, default_limit: int = V.CANDIDATE_LIMIT,
                   block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(query_id, root_id, pos, score20, entry columns): the best entries of every query in every root."""
    return with_entries(ranked_entries(entries, targets, aliases, default_limit, block, few), entries)


def with_entries(ranked: DataFrame, entries: DataFrame) -> DataFrame:
    return ranked.join(entries.select("root_id", "entry_pos", "path", "title", "summary"), ["root_id", "entry_pos"])


def _wanted(entries: DataFrame, targets: DataFrame, aliases: DataFrame, default_limit: int, carry: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Entries and targets as sets of word ids, and the longest limit of a target."""
    targets = targets.withColumn(
        "k", F.when(F.coalesce("candidate_limit", F.lit(0)) > 0, F.col("candidate_limit")).otherwise(F.lit(default_limit))
    )
    longest = targets.agg(F.max("k")).first()[0] or default_limit
    needles, asked = query_terms(targets)
    terms = entry_terms(classified_entries(entries), needles, aliases)
    return terms, cut_lineage(targets.select("query_id", "root_id", "k", *FLAG_COLUMNS, *carry).join(asked, "query_id", "left")), longest


def ranked_entries(entries: DataFrame, targets: DataFrame, aliases: DataFrame, default_limit: int = V.CANDIDATE_LIMIT,
                   block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(query_id, root_id, entry_pos, pos, score20): the best entries of every query in every root, as numbers.

    A pass over the texts turns entries into sets of word ids.  The pairs of a root are scored in cells
    (:func:`scored_cells`) of ``block`` entries, or all entries of a root of at most ``few`` times the limit.
    """
    terms, wanted, longest = _wanted(entries, targets, aliases, default_limit, [])
    scores = pruned_scores(terms, wanted, block, few * longest)
    order = W.partitionBy("query_id", "root_id").orderBy(F.desc("score20"), "path", "entry_pos")
    return (
        scores.withColumn("pos", F.row_number().over(order))
        .where((F.col("pos") <= longest) & (F.col("pos") <= F.col("k")))
        .select("query_id", "root_id", "entry_pos", "pos", "score20")
    )


def ranked_lists(entries: DataFrame, targets: DataFrame, aliases: DataFrame, carry: list[str], default_limit: int = V.CANDIDATE_LIMIT,
                 block: int = BLOCK, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`ranked_entries` as one row per query and root, for logs whose hits are many times their texts.

    First (query_id, root_id, best, the columns ``carry`` of the target), where ``best`` has score and number of each entry
    (:func:`pair_scores.packed`) in the order of ``pos``; then (root_id, no, entry_pos), the entries of the numbers.  Numbers
    follow path and entry_pos within a root.  Targets of one query and root have one limit.
    """
    terms, wanted, longest = _wanted(entries, targets, aliases, default_limit, carry)
    terms = cut_lineage(numbered(terms.where("root_id is not null").withColumn("_order", F.struct("path", "entry_pos")), ["root_id"], "_order", "no").drop("_order"))
    best = T.StructField("best", T.ArrayType(T.LongType()))
    found = scored_cells(terms, wanted, block, few * longest, ["no"], T.StructType([*wanted.select("query_id", "root_id", "k", *carry).schema, best]))
    merged = F.sort_array(F.flatten(F.collect_list("best")))
    lists = found.groupBy("query_id", "root_id").agg(
        F.slice(merged, F.lit(1), F.max("k")).alias("best"), *[F.first(c).alias(c) for c in carry]).where(F.size("best") > 0)
    return lists, terms.select("root_id", "no", "entry_pos")


def narrow_hits(ranked: DataFrame, entries: DataFrame, targets: DataFrame) -> DataFrame:
    """The hits without their summaries: ``topic_found`` has those topic terms of a focused code query that stand in the
    title, summary or path, so a summary is read once per entry and goes no further."""
    topical = F.col("wants_code_knowledge") & ~F.col("wants_code_navigation") & (F.col("mode") == "focused")
    asked = targets.where(topical & (F.size("code_topic_terms") > 0)).groupBy("query_id", "root_id").agg(
        F.array_distinct(F.flatten(F.collect_list("code_topic_terms"))).alias("topic_terms"))
    text = F.lower(F.concat_ws(" ", "title", "summary", repo_path(F.col("path"))))
    found = F.when(F.size("topic_terms") > 0, let(text, lambda whole: F.filter("topic_terms", lambda t: whole.contains(F.lower(t))))).otherwise(strings([]))
    return with_entries(ranked.join(asked, ["query_id", "root_id"], "left"), entries).withColumn("topic_found", found).drop("topic_terms", "summary")


# ---- candidate columns --------------------------------------------------------------------------------
def candidate_columns(top: DataFrame, targets: DataFrame, aliases: DataFrame, entries: DataFrame) -> DataFrame:
    """Candidate table: role, type, modules, signals and the fit columns.  ``top``: see :func:`narrow_hits`."""
    hit = entries.join(top.select("root_id", "entry_pos").distinct(), ["root_id", "entry_pos"], "left_semi")
    modules = page_modules(hit.select("root_id", "path", "title", "summary"), aliases)
    context = targets.select(
        "query_id", "root_id", "modules", "wants_source", "wants_data_dictionary", "wants_regulation",
        "wants_code_navigation", "wants_code_knowledge",
    )
    # What depends on the page alone is computed once per page, however many queries hit it.
    path = F.col("path")
    known_pages = (
        hit.select("root_id", "path").distinct().join(modules, ["root_id", "path"], "left")
        .withColumn("page_modules", F.coalesce("page_modules", strings([]))).withColumn("page_role", page_role(path))
        .select("root_id", "path", "page_modules", "page_role", repo_path(path).alias("repo_path"), is_code_feature(path).alias("code_feature"), is_code_module(path).alias("code_module"))
    )
    c = top.join(known_pages, ["root_id", "path"]).join(context, ["query_id", "root_id"])
    # Lists of modules are long, so they are compared once.
    c = c.withColumn("overlap", F.arrays_overlap("page_modules", "modules"))
    role, overlap = F.col("page_role"), F.col("overlap")
    asked, known = F.size("modules") > 0, F.size("page_modules") > 0
    code_feature, code_module = F.col("code_feature"), F.col("code_module")
    signals = F.array_compact(
        F.array(
            F.when(asked & overlap, F.lit("module_match")),
            F.when(asked & known & ~overlap, F.lit("module_mismatch")),
            F.concat(F.lit("role:"), role),
            F.when(F.col("wants_code_navigation") & code_module, F.lit("code_map_preferred")),
            F.when(F.col("wants_code_knowledge") & ~F.col("wants_code_navigation") & code_feature, F.lit("code_feature_preferred")),
        )
    )
    intent_fit = (
        F.when((role == "module") & F.col("wants_code_navigation"), "navigation_primary")
        .when(role == "source", F.when(F.col("wants_source"), "requested").otherwise("provenance_only"))
        .when(role == "data_dictionary", F.when(F.col("wants_data_dictionary"), "requested").otherwise("supporting"))
        .when(role == "regulation_requirement", F.when(F.col("wants_regulation"), "requested").otherwise("out_of_intent"))
        .otherwise("primary")
    )
    module_fit = (
        F.when(~asked, "not_requested").when(~known, "neutral").when(overlap, "same_module").otherwise("module_mismatch")
    )
    policy = F.when(role != "source", "normal").when(F.col("wants_source"), "requested").otherwise("provenance_only")
    return c.select(
        "query_id", "root_id", "pos", F.col("repo_path").alias("path"), "title",
        page_type(role).alias("type"), "page_role",
        F.coalesce(F.try_element_at("page_modules", F.lit(1)), F.lit("")).alias("module"), "page_modules",
        "topic_found", "score20", signals.alias("signals"), intent_fit.alias("intent_fit"),
        module_fit.alias("module_fit"), policy.alias("source_policy"), F.lit("index.md").alias("source"),
    )


def index_hits(top: DataFrame) -> DataFrame:
    """Hit list per query and root, with the score in points."""
    return top.select(
        "query_id", "root_id", "pos", "title", "path", "summary", (F.col("score20") / 20).alias("score"),
        F.lit("wiki/index.md").alias("source"),
    )
