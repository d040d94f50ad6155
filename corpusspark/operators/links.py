"""Page links as an edge table: extraction, resolution, one-hop expansion, broken links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import canonical_path, drop_prefix, file_stem, parent_path, slashes, strings, strip
from ..session import cut_lineage

WIKILINK = r"\[\[[^\]]+\]\]"
MARKDOWN_LINK = r"(?<!!)\[[^\]]+\]\([^)]+\)"


def is_external(target: Column) -> Column:
    return F.lower(target).rlike("^(https?://|mailto:|file:)")


def link_structs(text: Column) -> Column:
    """ARRAY of links in reading order: wikilinks first, then relative links to Markdown pages."""

    def wikilink(raw: Column) -> Column:
        inner = strip(F.substring(raw, F.lit(3), F.char_length(raw) - 4))
        target = strip(F.substring_index(inner, "|", 1))
        label = F.when(
            inner.contains("|"), strip(F.substring(inner, F.locate("|", inner) + 1, F.char_length(inner)))
        ).otherwise(F.lit(""))
        stem = file_stem(F.rtrim(target, F.lit("/")))
        return F.struct(
            raw.alias("raw"), target.alias("target"), F.when(label == "", stem).otherwise(label).alias("label"),
            F.lit("wikilink").alias("link_type"), F.lit(None).cast("string").alias("anchor"),
        )

    def markdown(raw: Column) -> Column:
        label = strip(F.regexp_extract(raw, r"^\[([^\]]+)\]", 1))
        href = strip(F.regexp_extract(raw, r"^\[[^\]]+\]\(([^)]+)\)$", 1))
        target = strip(F.substring_index(href, "#", 1))
        anchor = F.when(href.contains("#"), strip(F.substring(href, F.locate("#", href) + 1, F.char_length(href))))
        return F.struct(
            raw.alias("raw"),
            F.when(~is_external(href) & ~href.startswith("#") & target.endswith(".md"), target).alias("target"),
            label.alias("label"), F.lit("markdown").alias("link_type"), F.nullif(anchor, F.lit("")).alias("anchor"),
        )

    wiki = F.transform(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(0)), wikilink)
    relative = F.transform(F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(0)), markdown)
    return F.concat(wiki, F.filter(relative, lambda x: x["target"].isNotNull()))


def extract_links(pages: DataFrame, text: str = "body") -> DataFrame:
    """Edge table (root_id, src, link_pos, link_type, target, label, raw, anchor).

    The first link of a (type, target) of a page wins.  The duplicates of a page meet in the partial
    aggregate of the task that read the page, so only distinct edges are shuffled.
    """
    exploded = pages.select("root_id", F.col("repo_path").alias("src"), F.posexplode(link_structs(F.col(text))).alias("pos", "l"))
    first = F.min_by(F.struct("l.label", "l.raw", "l.anchor"), F.col("pos"))
    return (
        exploded.groupBy("root_id", "src", "l.link_type", "l.target")
        .agg(F.min("pos").alias("link_pos"), first.alias("f"))
        .select("root_id", "src", "link_pos", "link_type", "target", "f.label", "f.raw", "f.anchor")
    )


def page_suffixes(pages: DataFrame) -> DataFrame:
    """(root_id, suffix, repo_path): every way to name a page by the end of its path."""
    parts = F.split(drop_prefix(F.col("repo_path"), "wiki/"), "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")
    )
    return pages.select("root_id", "repo_path", F.explode(suffixes).alias("suffix"))


def resolve_links(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``dst`` (null = broken).  Tries in order: beside the source page, from the page folder (for
    ``.md`` targets), any page of that name (for the others).  Every try is an equality join and only
    distinct (root, path) pairs are looked up."""
    named = strip(F.substring_index(F.substring_index(F.col("target"), "|", 1), "#", 1))
    normalized = drop_prefix(slashes(named), "wiki/")
    usable = (named != "") & ~is_external(named) & ~normalized.startswith("/")
    is_md = normalized.endswith(".md")
    file = F.when(is_md, normalized).otherwise(F.concat(normalized, F.lit(".md")))
    e = edges.withColumn("_usable", usable).withColumn("_file", F.when(usable, file)).withColumn("_md", is_md)
    e = e.withColumn("_beside", canonical_path(F.concat_ws("/", parent_path(F.col("src")), "_file"))).withColumn(
        "_rooted", F.when(F.col("_md"), canonical_path(F.concat(F.lit("wiki/"), F.col("_file"))))
    )
    known = pages.select("root_id", "repo_path").distinct()
    beside = known.select("root_id", F.col("repo_path").alias("_beside"), F.lit(True).alias("_has_beside"))
    rooted = known.select("root_id", F.col("repo_path").alias("_rooted"), F.lit(True).alias("_has_rooted"))
    names = e.where("_usable and not _md").select("root_id", F.col("_file").alias("suffix")).distinct()
    by_name = (
        page_suffixes(known).join(names, ["root_id", "suffix"])
        .groupBy("root_id", F.col("suffix").alias("_file"), F.lit(False).alias("_md"))
        .agg(F.min("repo_path").alias("_named"))
    )
    joined = (
        e.join(beside, ["root_id", "_beside"], "left")
        .join(rooted, ["root_id", "_rooted"], "left")
        .join(by_name, ["root_id", "_file", "_md"], "left")
    )
    dst = F.when(
        F.col("_usable"),
        F.when(F.col("_has_beside"), F.col("_beside")).when(F.col("_has_rooted"), F.col("_rooted")).otherwise(F.col("_named")),
    )
    return joined.select(*edges.columns, dst.alias("dst"))


def pages_named(pages: DataFrame, names: DataFrame) -> DataFrame:
    """The pages whose (root_id, repo_path) stands in ``names``, written as a filter: it goes below the columns that are built
    from a page's text, where a semi join would stay above them and build the texts of all pages."""
    return pages.where(F.struct("root_id", "repo_path").isin(names.select("root_id", "repo_path")))


def expand_relationships(primaries: DataFrame, pages: DataFrame, limit: int = V.LINK_LIMIT) -> DataFrame:
    """One hop from the primary pages: the first ``limit`` distinct (page, target) links per query and root.

    Bodies are read only for pages that are a primary of some query; their links are extracted once per
    page however many queries chose it.
    """
    chosen = primaries.select("root_id", F.col("path").alias("repo_path")).distinct()
    bodies = pages_named(pages, chosen).select("root_id", "repo_path", "body")
    edges = extract_links(bodies)
    by_target = edges.groupBy("root_id", "src", "target").agg(
        F.min("link_pos").alias("link_pos"),
        F.min_by(F.struct("link_type", "label", "anchor"), "link_pos").alias("l"),
    )
    p = primaries.select("query_id", "root_id", F.col("path").alias("src"), "primary_pos", F.col("score20").alias("src_score20"))
    order = W.partitionBy("query_id", "root_id").orderBy("primary_pos", "link_pos")
    # Written once: the names that are looked up are read from it again, and the page texts are not.
    cut = cut_lineage(
        p.join(by_target, ["root_id", "src"])
        .withColumn("link_no", F.row_number().over(order))
        .where(F.col("link_no") <= limit)
        .select("query_id", "root_id", "src", "src_score20", "link_no", "target", "l.link_type", "l.label",
                F.coalesce("l.anchor", F.lit("")).alias("anchor"))
    )
    resolved = resolve_links(cut, pages)
    return resolved.withColumn("status", F.when(F.col("dst").isNull(), "broken").otherwise("resolved"))


def broken_links(expansion: DataFrame) -> DataFrame:
    return expansion.where("dst is null").select("query_id", "root_id", "src", "target")


def wikilink_targets(text: Column) -> Column:
    """Distinct wikilink targets of a text."""
    inner = F.transform(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(0)), lambda raw: F.substring(raw, F.lit(3), F.char_length(raw) - 4))
    return F.array_distinct(F.transform(inner, lambda v: strip(F.substring_index(strip(v), "|", 1))))


def broken_wikilinks(facts: DataFrame) -> DataFrame:
    """Wikilinks of a whole corpus whose stem and title are unknown in their root.

    ``facts``: root_id, repo_path, title, exempt, wikilinks (targets).
    """
    links = facts.where("not exempt").select("root_id", F.col("repo_path").alias("path"), F.explode("wikilinks").alias("target")).select(
        "root_id", "path", "target", F.col("target").alias("_title"), file_stem(F.rtrim("target", F.lit("/"))).alias("_stem")
    )
    stems = facts.select("root_id", file_stem(F.col("repo_path")).alias("_stem")).distinct()
    titles = facts.select("root_id", F.col("title").alias("_title")).distinct()
    return (
        links.join(stems, ["root_id", "_stem"], "left_anti")
        .join(titles, ["root_id", "_title"], "left_anti")
        .select("root_id", "path", "target")
    )
