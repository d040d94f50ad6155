"""Page texts -> typed columns: front matter, sections, locators, placeholders, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import (
    any_of, collapse_spaces, contains_any, file_stem, has_cjk, let, lines_of, slashes, strings, strip,
)


# ---- front matter ------------------------------------------------------------------------------------
def front_matter_end(text: Column) -> Column:
    """Position of the closing fence, 0 when the text has no front matter."""
    return F.when(text.startswith("---\n"), F.locate("\n---\n", text, 5)).otherwise(F.lit(0))


def front_matter_block(text: Column) -> Column:
    return let(
        front_matter_end(text), lambda end: F.when(end > 0, F.substring(text, F.lit(5), end - 5)).otherwise(F.lit(""))
    )


def body_text(text: Column) -> Column:
    return let(
        front_matter_end(text), lambda end: F.when(end > 0, F.substring(text, end + 5, F.char_length(text))).otherwise(text)
    )


def front_matter(text: Column) -> Column:
    """MAP key -> raw value; the first colon splits, the last line of a key wins."""
    lines = F.filter(lines_of(front_matter_block(text)), lambda line: (strip(line) != "") & line.contains(":"))
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            strip(F.substring_index(line, ":", 1)).alias("k"),
            strip(F.substring(line, F.locate(":", line) + 1, F.char_length(line))).alias("v"),
        ),
    )

    def last_values(found: Column) -> Column:
        return let(
            F.array_distinct(F.transform(found, lambda p: p["k"])),
            lambda keys: F.map_from_arrays(
                keys, F.transform(keys, lambda k: F.element_at(F.filter(found, lambda p: p["k"] == k), -1)["v"])
            ),
        )

    return let(pairs, last_values)


def _unquote(value: Column) -> Column:
    return F.trim(F.trim(value, F.lit('"')), F.lit("'"))


def is_list_value(raw: Column) -> Column:
    return raw.startswith("[") & raw.endswith("]")


def list_value(raw: Column) -> Column:
    """``[a, "b"]`` -> array; null when the value is not a bracketed list."""

    def items(value: Column) -> Column:
        inner = strip(F.substring(value, F.lit(2), F.char_length(value) - 2))
        split = let(
            inner,
            lambda text: F.when(text == "", strings([])).otherwise(F.transform(F.split(text, ","), lambda v: _unquote(strip(v)))),
        )
        return F.when(is_list_value(value), split)

    return let(raw, items)


def scalar_value(raw: Column) -> Column:
    return _unquote(raw)


def first_sentence(body: Column) -> Column:
    return F.left(collapse_spaces(body), F.lit(240))


def parse_pages(pages: DataFrame) -> DataFrame:
    """(root_id, path, text) -> page columns; ``path`` is below the page folder, ``repo_path`` above it."""
    p = pages.withColumn("meta", front_matter(F.col("text"))).withColumn("body", body_text(F.col("text")))

    def scalar(key: str) -> Column:
        return scalar_value(F.try_element_at("meta", F.lit(key)))

    def or_else(value: Column, default: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(default)

    return p.select(
        "root_id", "path", F.concat(F.lit("wiki/"), F.col("path")).alias("repo_path"), "text", "meta", "body",
        or_else(scalar("title"), file_stem(F.col("path"))).alias("title"),
        F.coalesce(scalar("type"), F.lit("")).alias("declared_type"),
        or_else(scalar("type"), F.lit("unknown")).alias("page_type"),
        first_sentence(F.col("body")).alias("summary"),
        F.coalesce(list_value(F.try_element_at("meta", F.lit("aliases"))), strings([])).alias("aliases"),
        list_value(F.try_element_at("meta", F.lit("sources"))).alias("sources"),
    )


# ---- sections -------------------------------------------------------------------------------------------
def sections(content: Column) -> Column:
    """ARRAY<STRUCT<heading, body>> of the ``## `` sections in order; a repeated heading keeps its first
    place and its last body."""
    marked = F.regexp_replace(content, r"(?Umd)^##\s+(.+?)\s*$", "\u0001$1\u0002")

    def pieces(parts: Column) -> Column:
        return F.transform(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda p: F.struct(
                strip(F.substring_index(p, "\u0002", 1)).alias("heading"),
                strip(F.substring(p, F.locate("\u0002", p) + 1, F.char_length(p))).alias("body"),
            ),
        )

    def last_bodies(found: Column) -> Column:
        headings = F.array_distinct(F.transform(found, lambda p: p["heading"]))
        return F.transform(headings, lambda h: F.element_at(F.filter(found, lambda p: p["heading"] == h), -1))

    return let(let(F.split(marked, "\u0001"), pieces), last_bodies)


def has_section(body: Column, heading: Column | str) -> Column:
    return body.contains(F.concat(F.lit("## "), heading if isinstance(heading, Column) else F.lit(heading)))


def section_text(body: Column, heading: Column | str) -> Column:
    """Text from the first ``## heading`` (as a substring) to the next section."""
    marker = F.concat(F.lit("## "), heading if isinstance(heading, Column) else F.lit(heading))
    return let(
        F.instr(body, marker),
        lambda at: F.when(at == 0, F.lit("")).otherwise(
            strip(F.substring_index(F.substring(body, at + F.char_length(marker), F.char_length(body)), "\n## ", 1))
        ),
    )


def normalized_section(text: Column) -> Column:
    plain = F.regexp_replace(text, "`([^`]+)`", "$1")
    plain = F.regexp_replace(plain, r"\[[^\]]+\]\([^)]+\)", "")
    plain = F.regexp_replace(plain, r"(?Umd)^\s*[-*]\s*", "")
    return collapse_spaces(plain)


# ---- predicates over section and page texts ----------------------------------------------------------------
def lint_code_locator(text: Column) -> Column:
    return let(text, lambda t: any_of([
        t.rlike("(?U)" + V.LOCATOR_PATH_PATTERN), t.rlike("`" + V.ENDPOINT_PATTERN + "`"),
        t.rlike("(?U)" + V.LOCATOR_CLASS_PATTERN),
    ]))


def profile_code_locator(text: Column) -> Column:
    return let(text, lambda t: any_of([
        t.rlike("(?U)" + V.LOCATOR_PATH_PATTERN), t.rlike(V.ENDPOINT_PATTERN),
        t.rlike("(?U)" + V.LOCATOR_CLASS_PATTERN),
    ]))


def lint_placeholder(text: Column) -> Column:
    def packed_is_placeholder(packed: Column) -> Column:
        return (packed == "") | contains_any(packed, [p.lower() for p in V.LINT_PLACEHOLDERS])

    return let(
        F.regexp_replace(text, r"(?Umd)^\s*[-*]\s*", ""),
        lambda stripped: let(F.lower(F.regexp_replace(stripped, r"(?U)\s+", "")), packed_is_placeholder)
        | stripped.rlike(r"(?i)(?<![A-Za-z0-9_/.-])(?:TODO|TBD)(?![A-Za-z0-9_/.-])"),
    )


def profile_placeholder(text: Column) -> Column:
    return contains_any(text, V.PROFILE_PLACEHOLDERS)


def attribute_values_present(content: Column) -> Column:
    return any_of([
        content.rlike("`[A-Za-z][A-Za-z0-9_./:-]{2,}`"), content.rlike(r"(?Umd)^\s*[-*]\s+\S+"),
        content.rlike(r"(?Umd)^\s*\d+\.\s+\S+"), content.rlike(r"(?md)^\|.+\|$"),
    ])


def is_thin_source(repo_path: Column, declared_type: Column, body: Column) -> Column:
    return (
        ((declared_type == "source") | repo_path.startswith("wiki/sources/"))
        & body.contains("## Source Snapshot") & body.contains("## Outline")
        & (F.char_length(strip(section_text(body, "Summary"))) < 80)
    )


TRACE_PATTERN = r"^(?:wiki/)?sources/code/[^/]+-runs/"


def normalized_source(item: Column) -> Column:
    return F.ltrim(slashes(item), F.lit("/"))


def is_run_trace(item: Column) -> Column:
    """A front-matter source that points to the summary of a code run."""
    return normalized_source(item).rlike(TRACE_PATTERN)


def markdown_value(text: Column, key: str) -> Column:
    """Value of the first ``- key: value`` line."""
    return F.regexp_extract(text, rf"(?Umd)^\s*-\s+{key}:\s*(.+?)\s*$", 1)


def file_reference(ref: Column) -> Column:
    """``path:start-end`` -> STRUCT<path, first, last>; null when it is not a valid reference."""
    shape = r"(?s)^(.*):\s*\+?(\d+)\s*-\s*\+?(\d+)\s*$"
    parsed = F.struct(
        slashes(F.regexp_extract(ref, shape, 1)).alias("path"), F.regexp_extract(ref, shape, 2).try_cast("bigint").alias("first"),
        F.regexp_extract(ref, shape, 3).try_cast("bigint").alias("last"),
    )
    return let(parsed, lambda p: F.when((p["first"] >= 1) & (p["last"] >= p["first"]), p))


# ---- English sentences in Chinese documents ------------------------------------------------------------------
def is_language_neutral(line: Column) -> Column:
    return (
        (line == "") | line.startswith("|") | line.rlike("^[-:| ]+$")
        | line.rlike(r"(?Us)^[-*]\s+[A-Za-z0-9_ -]+:\s*[^。！？；，、]*$")
    )


def human_part(line: Column) -> Column:
    def after(text: Column, mark: str) -> Column:
        return strip(F.substring(text, F.locate(mark, text) + 1, F.char_length(text)))

    def labelled(plain: Column) -> Column:
        suffix = (
            F.when(~has_cjk(plain), plain).when(plain.contains("："), after(plain, "：")).when(plain.contains(":"), after(plain, ":"))
            .otherwise(F.lit(""))
        )
        return let(suffix, lambda v: F.when(v != "", v).otherwise(plain))

    return let(F.regexp_replace(line, "`[^`]*`", ""), labelled)


def is_english_sentence(text: Column) -> Column:
    normalized = F.regexp_replace(text, r"(?U)\S+=\S+", " ")
    normalized = F.regexp_replace(normalized, r"(?U)\b(covered|not_applicable|blocking_gap)\b", " ")
    words = F.regexp_count(normalized, F.lit(r"(?U)(?<![/_.-])\b[A-Za-z]{2,}\b(?![/_.-])"))
    return (text != "") & ~has_cjk(text) & text.rlike(r"(?U)\s") & (words >= 5)


def english_lines(documents: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, line): lines outside code fences that read as English sentences.

    The fence state of a line is the parity of the fence lines before it; it is carried by running counts
    over the lines of one document, which arrive together because a document is one row.
    """
    lines = F.transform(lines_of(F.col(text)), strip)
    marked = F.transform(lines, lambda v: v.startswith("```"))
    fence_at = F.filter(
        F.transform(marked, lambda m, i: F.when(m, i)), lambda i: i.isNotNull()
    )
    with_fences = documents.select(*key, lines.alias("_lines"), fence_at.alias("_fences"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("_fences") / 2).cast("int")),
        lambda j: F.struct(
            F.when(j == 0, F.lit(-1)).otherwise(F.try_element_at("_fences", F.greatest(2 * j, F.lit(1)))).alias("lo"),
            F.coalesce(F.try_element_at("_fences", 2 * j + 1), F.size("_lines")).alias("hi"),
        ),
    )
    outside = with_fences.select(*key, "_lines", F.explode(pairs).alias("_span")).select(
        *key,
        F.posexplode(
            F.slice("_lines", F.col("_span.lo") + 2, F.greatest(F.col("_span.hi") - F.col("_span.lo") - 1, F.lit(0)))
        ).alias("_i", "_line"),
        F.col("_span.lo").alias("_lo"),
    )
    keep = ~is_language_neutral(F.col("_line")) & is_english_sentence(human_part(F.col("_line")))
    return outside.where(keep).select(*key, (F.col("_lo") + F.col("_i") + 2).alias("line"))


# ---- code anchors ----------------------------------------------------------------------------------------------
def is_searchable_endpoint(value: Column) -> Column:
    def searchable(trimmed: Column) -> Column:
        lowered = F.lower(trimmed)
        parts = F.filter(F.split(lowered, "/"), lambda p: p != "")
        internal = any_of(lowered.startswith(p) for p in V.ENDPOINT_INTERNAL_PREFIXES)
        return (
            (trimmed != "") & ~trimmed.isin(V.ENDPOINT_ROOT_NAMES) & ~trimmed.contains(".") & ~internal
            & ~F.arrays_overlap(parts, strings(V.ENDPOINT_PATH_MARKERS)) & (F.size(parts) >= 2)
        )

    return value.startswith("/") & ~strip(value).endswith("/") & let(F.rtrim(strip(value), F.lit("/")), searchable)


def trim_anchor(value: Column) -> Column:
    return F.trim(value, F.lit(V.ANCHOR_TRIM_CHARACTERS))


def anchor_values(content: Column) -> Column:
    """ARRAY<STRUCT<kind, value>>: source paths, role-suffixed symbols, endpoints; in that order."""

    def of(kind: str, pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(content, F.lit("(?U)(" + pattern + ")"), F.lit(1)), trim_anchor)
        kept = F.filter(F.array_distinct(found), lambda v: F.char_length(v) >= 3)
        if kind == "endpoint":
            kept = F.filter(kept, is_searchable_endpoint)
        return F.transform(kept, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.concat(
        of("path", V.CODE_PATH_PATTERN), of("symbol", V.ANCHOR_SYMBOL_PATTERN), of("endpoint", V.ENDPOINT_PATTERN)
    )


def normalized_code_path(value: Column) -> Column:
    """Code path named in a page; empty when it is a pattern, a lock file or too generic."""

    def shortened(v: Column) -> Column:
        return (
            F.when(v.contains(".../"), F.ltrim(F.substring(v, F.locate(".../", v) + 4, F.char_length(v)), F.lit("/")))
            .when(v.contains("..."), F.element_at(F.split(v, "/"), -1))
            .otherwise(v)
        )

    def kept(v: Column) -> Column:
        name = F.lower(F.element_at(F.split(v, "/"), -1))
        drop = v.contains("*") | name.isin(V.LOCK_FILE_NAMES) | (~v.contains("/") & F.lower(v).isin(V.GENERIC_FILE_NAMES))
        return F.when(drop, F.lit("")).otherwise(v)

    return let(let(F.trim(strip(slashes(value)), F.lit(V.ANCHOR_TRIM_CHARACTERS)), shortened), kept)


def code_paths(content: Column) -> Column:
    """Every occurrence of a source path, trimmed."""
    return F.transform(F.regexp_extract_all(content, F.lit("(?U)(" + V.CODE_PATH_PATTERN + ")"), F.lit(1)), trim_anchor)
