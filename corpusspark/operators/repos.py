"""Code-map tables of evidence pages, repository ranking and code anchors for whole query logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.numbering import running
from ..functions.sizing import at_most
from ..functions.terms import is_strong_topic_term
from ..functions.text import contains_any, drop_prefix, let, slashes, strings
from ..session import cut_lineage
from . import extract
from .quality import CODE_FEATURES, GROUP
from .search_strings import contained
from .tables import cell_named, table_rows

ROW = ["page_root", "page_path", "row_index"]


def code_map_rows(bundle: DataFrame) -> DataFrame:
    """Rows of the code-map tables of the distinct evidence pages."""
    found = bundle.where("content is not null").select(
        F.col("root_id").alias("page_root"), F.col("path").alias("page_path"), "content"
    ).dropDuplicates(["page_root", "page_path"])
    rows = table_rows(found, ["page_root", "page_path"], "content")
    names = F.lower(F.array_join("headers", " "))
    code_map = contains_any(names, ["repo", "仓库"]) & contains_any(names, ["入口", "路径", "entry"])
    return rows.where(code_map).select(
        *ROW, cell_named(V.CODE_MAP_MODULE_COLUMNS).alias("product_module"),
        cell_named(V.CODE_MAP_CAPABILITY_COLUMNS).alias("capability"), cell_named(V.CODE_MAP_REPO_COLUMNS).alias("repo_text"),
        cell_named(V.CODE_MAP_ENTRY_COLUMNS).alias("entrypoint_text"), cell_named(V.CODE_MAP_JUDGEMENT_COLUMNS).alias("judgement"),
        F.array_join("cells", " ").alias("row_values"),
        F.flatten(F.transform("cells", extract.code_paths)).alias("row_paths"),
    )


def row_relevance(terms: Column, modules: Column) -> Column:
    """Module points plus topic points; rows without a topic term or without a strong one do not count."""
    lowered = F.struct(*[F.lower(c).alias(c) for c in ("row_values", "product_module", "capability", "judgement")])
    alias_table = F.create_map(*[x for k, v in V.CODE_MAP_TERM_ALIASES.items() for x in (F.lit(k), strings(v))])
    strong = lambda t: is_strong_topic_term(t, include_compounds=False)

    def module_points(row: Column, asked: Column) -> Column:
        product, capability, judgement = row["product_module"], row["capability"], row["judgement"]
        return let(F.concat_ws(" ", product, capability, judgement), lambda whole: F.aggregate(
            asked, F.lit(0),
            lambda acc, m: acc + F.when(product.contains(m), 14).when(capability.contains(m), 8).when(judgement.contains(m), 4)
            .when(whole.contains(m), 4).otherwise(0),
        ))

    def matches(text: Column, term: Column) -> Column:
        other = F.coalesce(F.try_element_at(alias_table, term), strings([]))
        return text.contains(term) | F.exists(other, lambda v: text.contains(v))

    def points(row: Column, asked: Column, used: Column, matched: Column) -> Column:
        topic_points = F.aggregate(
            matched, F.lit(0),
            lambda acc, t: acc + F.when(F.char_length(t) >= 6, 12).when(F.char_length(t) >= 4, 7).otherwise(3),
        )
        blocked = F.exists(used, strong) & ~F.exists(matched, strong) & (F.size(matched) < 2)
        return let(topic_points, lambda n: F.when((n > 0) & ~blocked, module_points(row, asked) + n).otherwise(0))

    def of_terms(row: Column, asked: Column, used: Column) -> Column:
        return let(F.filter(used, lambda t: matches(row["row_values"], t)), lambda matched: points(row, asked, used, matched))

    def of_modules(row: Column, asked: Column) -> Column:
        used = F.filter(F.transform(terms, F.lower), lambda t: (t != "") & ~F.array_contains(asked, t))
        return let(used, lambda u: of_terms(row, asked, u))

    return let(lowered, lambda row: let(F.filter(modules, lambda m: m != ""), lambda asked: of_modules(row, asked)))


def code_map_matches(bundle: DataFrame, rows: DataFrame, asks: DataFrame, key: list[str], limit: int | None = None) -> DataFrame:
    """Best code-map rows per ask.  ``asks``: key columns (with query_id), terms, ask_modules."""
    held = bundle.where("content is not null").select(
        "query_id", F.col("root_id").alias("page_root"), F.col("path").alias("page_path")
    ).distinct()
    # Few narrow rows cost much work each, so they are dealt by number, not by their bytes.
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = (
        asks.join(held.repartition(parts, "query_id", "page_root", "page_path"), "query_id").join(rows, ["page_root", "page_path"])
        .withColumn("relevance", row_relevance(F.col("terms"), F.col("ask_modules"))).where("relevance > 0")
    )
    order = W.partitionBy(*key).orderBy(F.desc("relevance"), "page_path", "row_index", "page_root")
    return at_most(scored.withColumn("match_no", F.row_number().over(order)), "match_no", limit)


# ---- repositories ---------------------------------------------------------------------------------------------
def repo_keys(repos: DataFrame) -> DataFrame:
    path = F.trim(slashes(F.col("path")), F.lit("/"))
    return repos.select(
        "root_id", "repo_id", F.trim(slashes(F.col("repo_id")), F.lit("/")).alias("clean_id"), path.alias("clean_path"),
        drop_prefix(path, "repos/").alias("repo_name"),
    )


def prefix_pairs(prefixes: DataFrame, values: DataFrame) -> DataFrame:
    """(prefix, value) of the different strings of two tables where the one begins the other.

    In sorted order the values that a prefix begins are one interval.  Its two ends are found by sorting prefixes and
    values together and counting the values so far, and then only the pairs of the result are written out: no string is
    cut into its prefixes, and work grows with the strings and the result, however many strings share a beginning.
    """
    v = values.select("value").where("value <> ''").distinct()
    p = prefixes.select("prefix").where("prefix <> ''").distinct()
    rows = v.select(F.col("value").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("one"), F.lit(None).cast("string").alias("prefix"))
    for kind, end in ((0, F.lit("")), (2, F.lit("\U0010ffff"))):
        rows = rows.unionByName(p.select(F.concat("prefix", end).alias("at"), F.lit(kind).alias("kind"), F.lit(0).alias("one"), "prefix"))
    counted = cut_lineage(running(rows, [], ["at", "kind"], "one", "so_far"))
    ends = counted.where("kind <> 1").groupBy("prefix").agg(F.min("so_far").alias("low"), F.max("so_far").alias("high")).where("high > low")
    places = ends.select("prefix", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("so_far"))
    return places.join(counted.where("kind = 1").select("so_far", F.col("at").alias("value")), "so_far").select("prefix", "value")


def paths_to_repos(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """(value, repo_id, root_id): a code path belongs to a repository when one is a prefix of the other."""
    value = F.trim(slashes(F.col("value")), F.lit("/"))
    p = paths.select("value", value.alias("v")).where("v <> ''").distinct()
    r = repo_keys(repos).where("clean_path <> ''").select("root_id", "repo_id", "clean_path", "repo_name")
    named = r.select("root_id", "repo_id", F.explode(F.array_distinct(F.array("clean_path", "repo_name"))).alias("k"))
    below = prefix_pairs(named.select(F.col("k").alias("prefix")), p.select(F.col("v").alias("value"))).select(F.col("prefix").alias("k"), F.col("value").alias("v"))
    above = prefix_pairs(p.select(F.col("v").alias("prefix")), r.select(F.col("clean_path").alias("value"))).select(F.col("prefix").alias("v"), F.col("value").alias("clean_path"))
    found = below.join(named, "k").select("v", "root_id", "repo_id").unionByName(above.join(r, "clean_path").select("v", "root_id", "repo_id"))
    return p.join(found.distinct(), "v").select("value", "root_id", "repo_id").distinct()


def row_repositories(rows: DataFrame, repos: DataFrame) -> DataFrame:
    """(row, root_id, repo_id): repositories a code-map row speaks about."""
    r = repo_keys(repos)
    named = r.select("root_id", "repo_id", F.explode(F.array_distinct(F.array(F.lower("repo_name"), F.lower("clean_id")))).alias("needle"))
    texts = rows.select(*ROW, F.lower(slashes(F.col("row_values"))).alias("row_text"))
    by_name = contained(named, texts, "row_text").join(named, "needle").select(*ROW, "root_id", "repo_id")
    tokens = texts.select(*ROW, F.explode(F.array_distinct(F.split("row_text", r"[;；,，、\s`]+"))).alias("k")).where("k <> ''")
    segments = r.select("root_id", "repo_id", F.explode(F.array_distinct(F.split(F.lower("repo_name"), "/"))).alias("k")).where(
        (F.col("k") != "") & ~F.col("k").isin(V.GENERIC_REPO_SEGMENTS)
    )
    by_token = tokens.join(segments, "k").select(*ROW, "root_id", "repo_id")
    values = rows.select(*ROW, F.explode(F.array_distinct("row_paths")).alias("value"))
    by_path = values.join(paths_to_repos(values, repos), "value").select(*ROW, "root_id", "repo_id")
    return by_name.unionByName(by_token).unionByName(by_path).distinct()


def page_path_counts(bundle: DataFrame) -> DataFrame:
    """(page_root, page_path, value, n): source paths named in code feature pages, with their counts."""
    found = bundle.where("content is not null").where(F.col("path").startswith(CODE_FEATURES)).select(
        F.col("root_id").alias("page_root"), F.col("path").alias("page_path"), "content"
    ).dropDuplicates(["page_root", "page_path"])
    values = F.transform(extract.code_paths(F.col("content")), extract.normalized_code_path)
    return found.select("page_root", "page_path", F.explode(values).alias("value")).where("value <> ''").groupBy(
        "page_root", "page_path", "value").agg(F.count("*").alias("n"))


def repo_targets(plans: DataFrame, bundle: DataFrame, rows: DataFrame, repos: DataFrame, limit: int | None = None) -> DataFrame:
    """Best repositories per query and code root, with score and reason.

    ``plans``: query_id, root_id, terms, ask_modules (lower case).  Only repositories with a hit are scored;
    the repositories of the root (the first ``limit``) stand in when there is no positive score.
    """
    held = bundle.where("content is not null").select(
        "query_id", F.col("root_id").alias("page_root"), F.col("path").alias("page_path")
    ).distinct()
    matches = code_map_matches(bundle, rows, plans, GROUP)
    mapped = (
        matches.select(*GROUP, *ROW, "relevance").join(row_repositories(rows, repos), ["root_id", *ROW])
        .groupBy(*GROUP, "repo_id").agg((F.max("relevance") + 30).alias("map_score"))
    )
    counted = page_path_counts(bundle)
    owners = paths_to_repos(counted.select("value"), repos)
    by_page = counted.join(owners, "value").groupBy("page_root", "page_path", "root_id", "repo_id").agg((F.sum("n") * 6).alias("s"))
    pathed = (
        held.join(by_page, ["page_root", "page_path"]).join(plans.select(*GROUP), GROUP, "left_semi")
        .groupBy(*GROUP, "repo_id").agg(F.sum("s").alias("path_score"))
    )
    words = plans.select(*GROUP, F.explode("ask_modules").alias("needle"), F.lit(10).alias("w")).unionByName(
        plans.select(*GROUP, F.explode(F.transform("terms", F.lower)).alias("needle"), F.lit(2).alias("w"))
    ).where("needle <> ''")
    texts = repos.select("root_id", "repo_id", F.lower(F.concat_ws(" ", "repo_id", "path", F.coalesce("remote", F.lit("")))).alias("repo_text"))
    worded = contained(words, texts, "repo_text", ["root_id"]).select("root_id", "repo_id", "needle").join(words, ["root_id", "needle"]).groupBy(
        *GROUP, "repo_id").agg(F.sum("w").alias("word_score"))
    first = W.partitionBy("root_id").orderBy("repo_id")
    stand_in = at_most(repos.select("root_id", "repo_id").withColumn("rn", F.row_number().over(first)), "rn", limit).drop("rn")
    default = plans.join(stand_in, "root_id").select(
        *GROUP, "repo_id", ((F.size("ask_modules") == 0) & (F.size("terms") == 0)).cast("long").alias("base")
    )
    parts = [
        df.select(*GROUP, "repo_id", *[(F.col(c) if c in df.columns else F.lit(0)).cast("long").alias(c)
                                       for c in ("map_score", "path_score", "word_score", "base")])
        for df in (mapped, pathed, worded, default)
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    scored = merged.groupBy(*GROUP, "repo_id").agg(*[F.max(c).alias(c) for c in ("map_score", "path_score", "word_score", "base")])
    hits = F.col("map_score") + F.col("path_score") + F.col("word_score")
    scored = scored.withColumn("score", F.when(hits > 0, hits).otherwise(F.col("base")))
    reason = (
        F.when(F.col("score") <= 0, "code_snapshot_fallback").when(F.col("map_score") > 0, "evidence_code_map_match")
        .when(F.col("word_score") > 0, "module_or_term_match").when(F.col("path_score") > 0, "evidence_code_path_match")
        .otherwise("code_snapshot_fallback")
    )
    # The best score is an aggregate with a partial step; the window after it is cut to the limit per task.
    best = scored.groupBy(*GROUP).agg(F.max("score").alias("best"))
    scored = scored.join(best, GROUP).where("best <= 0 or score > 0")
    ranked = scored.withColumn("target_no", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("score"), "repo_id")))
    return at_most(ranked, "target_no", limit).select(*GROUP, "target_no", "repo_id", "score", reason.alias("selection_reason"))


# ---- anchors ------------------------------------------------------------------------------------------------------
def code_anchors(bundle: DataFrame, matches: DataFrame, targets: DataFrame, limit: int | None = None) -> DataFrame:
    """Anchors per query: paths of the matched code-map rows first, then anchors of the evidence pages.

    A page adds at most ``limit`` distinct anchors to a list of ``limit``, so cutting each page there is exact.
    """
    found = bundle.where("content is not null")
    per_page = found.select("root_id", "path", "content").dropDuplicates(["root_id", "path"]).select(
        "root_id", "path", F.posexplode(extract.anchor_values(F.col("content")) if limit is None else F.slice(extract.anchor_values(F.col("content")), 1, limit)).alias("anchor_pos", "a")
    )
    ordered = found.select("query_id", "root_id", "path", "evidence_pos").join(
        targets.select("query_id", "root_id", "priority"), GROUP
    )
    rank = F.struct((-F.col("priority")).alias("p"), "root_id", "evidence_pos", "anchor_pos")
    firsts = (
        ordered.join(per_page, ["root_id", "path"]).groupBy("query_id", "a.kind", "a.value")
        .agg(F.min_by("path", rank).alias("evidence_page"), F.min(rank).alias("o"))
        .withColumn("rn", F.row_number().over(W.partitionBy("query_id").orderBy("o")))
    )
    firsts = at_most(firsts, "rn", limit)
    has_match = matches.select("query_id", F.lit(True).alias("has_match")).distinct()
    fallback = (
        firsts.join(has_match, "query_id", "left")
        .where(~(F.coalesce("has_match", F.lit(False)) & F.col("evidence_page").startswith("wiki/entities/code/modules/")))
        .select("query_id", F.lit(1).alias("step"), F.col("rn").alias("a"), F.lit(0).alias("b"), "kind", "value", "evidence_page")
    )
    mapped = matches.select("query_id", "match_no", "page_path", F.posexplode("row_paths").alias("b", "value")).select(
        "query_id", F.lit(0).alias("step"), F.col("match_no").alias("a"), "b", F.lit("path").alias("kind"), "value",
        F.col("page_path").alias("evidence_page"),
    )
    both = mapped.unionByName(fallback).withColumn(
        "value", F.when(F.col("kind") == "path", extract.normalized_code_path(F.col("value"))).otherwise(F.col("value"))
    ).where("value <> ''")
    order = F.struct("step", "a", "b")
    distinct = both.groupBy("query_id", "kind", "value").agg(F.min_by("evidence_page", order).alias("evidence_page"), F.min(order).alias("o"))
    numbered = distinct.withColumn("anchor_no", F.row_number().over(W.partitionBy("query_id").orderBy("o")))
    return at_most(numbered, "anchor_no", limit).select("query_id", "anchor_no", "kind", "value", "evidence_page")


def explorations(context: DataFrame, plans: DataFrame, matches: DataFrame, anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per query in code scope: terms, what was found, and the status of the repository targets."""
    found = targets.groupBy("query_id").agg(
        F.count("*").alias("n_repos"), F.max(F.col("selection_reason") != "code_snapshot_fallback").alias("matched")
    )
    n_matches = matches.groupBy("query_id").agg(F.count("*").alias("n_matches"))
    n_anchors = anchors.groupBy("query_id").agg(F.count("*").alias("n_anchors"))
    scoped = plans.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ask_modules")))).alias("modules"))
    joined = context.join(scoped, "query_id")
    for part in (found, n_matches, n_anchors):
        joined = joined.join(part, "query_id", "left")
    status = F.when(F.col("n_repos").isNull(), "none").when(F.col("matched"), "matched").otherwise("snapshot_fallback")
    return joined.select(
        "query_id", F.lit(True).alias("enabled"), F.col("topic_terms").alias("query_terms"), "modules",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_repos", "n_matches", "n_anchors")], status.alias("repo_target_status"),
        (F.size("profiles") > 0).alias("must_execute_before_final"),
    )
