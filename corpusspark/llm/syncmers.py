"""Document fingerprints from closed syncmers; DataFrame functions only.

A text is read as tokens: up to four lower-case letters, or any other character that is no blank.  A run of ``K`` tokens is
an anchor when the smallest hash among its inner runs of ``S`` tokens stands at the first or the last place.  Whether a run
is an anchor depends on nothing outside it, so equal passages have equal anchors wherever they stand, and positions in
both texts line up.  Any ``K - S + 1`` neighbouring runs hold at least one anchor.  A text with tokens but no anchor (fewer
than ``K`` tokens, or a few more) has one for all its tokens; a text without tokens has none.

An anchor is a long: 32 bits of the run's hash above 32 bits of its token position.  A sketch holds the ``SKETCH``
smallest different hashes.  A run's first occurrence counts wherever it stands; each further one counts by its hash and
its stretch of ``STRETCH`` tokens, so that a text of repeated lines is known by where they are and how long they go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ranked

K, S = 6, 2
SKETCH, STRETCH = 64, 64
TOKEN = r"\p{Ll}{1,4}|\S"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, although ``body`` names it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _inner(tokens: Column) -> Column:
    """The hash of the inner run (``S`` tokens) that starts at each token; those past the end are never looked at."""
    return F.transform(tokens, lambda t, i: F.xxhash64(t, *[F.get(tokens, i + j) for j in range(1, S)]))


def _closed(inner: Column) -> Column:
    """The anchors among the runs of ``K`` tokens, given the inner hashes of a text."""
    last = K - S

    def anchor(x: Column, i: Column) -> Column:
        end = F.get(inner, i + last)
        between = F.least(*[F.get(inner, i + j) for j in range(1, last)])
        cover = [F.get(inner, i + j) for j in range(S, last, S)]
        return F.when(F.least(x, end) <= between, F.shiftleft(F.xxhash64(x, *cover, end), 32).bitwiseOR(i.cast("long")))

    found = F.array_compact(F.transform(F.slice(inner, 1, F.greatest(F.size(inner) - (K - 1), F.lit(0))), anchor))
    return _let(found, lambda a: F.when((F.size(a) > 0) | (F.size(inner) == 0), a)
                .otherwise(F.array(F.shiftleft(F.xxhash64(inner), 32))))


def anchors(text: Column) -> Column:
    """All anchors of a text in order of position; null counts as empty."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return _let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: _let(_inner(h), _closed))


def code_of(anchor: Column) -> Column:
    return F.shiftright(anchor, 32).cast("int")


def _least(sorted_anchors: Column) -> Column:
    new = F.filter(sorted_anchors, lambda x, i: (i == 0) | (F.shiftright(x, 32) != F.shiftright(F.get(sorted_anchors, i - 1), 32)))
    return F.slice(new, 1, SKETCH)


def sketch(text: Column) -> Column:
    """The ``SKETCH`` smallest different hashes of the anchors, each above its first position."""
    def placed(x: Column) -> Column:
        position = x.bitwiseAND(F.lit((1 << 32) - 1))
        return F.shiftleft(F.xxhash64(F.shiftright(x, 32), F.floor(position / STRETCH)), 32).bitwiseOR(position)

    def both(a: Column) -> Column:
        again = F.filter(a, lambda x, i: (i > 0) & (F.shiftright(x, 32) == F.shiftright(F.get(a, i - 1), 32)))
        return _let(F.sort_array(F.concat(_least(a), _let(F.sort_array(F.transform(again, placed)), _least))), _least)

    return _let(F.sort_array(anchors(text)), both)


def as_string(sketched: Column) -> Column:
    """Eight hex digits of the hash and eight of the position per anchor."""
    return F.array_join(F.transform(sketched, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def codes(sketched: Column) -> Column:
    return F.transform(sketched, code_of)


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes, 2c / (a + b), in the range that both sketches cover; 1 for two empty ones.

    ``a`` and ``b`` are :func:`codes`.  A full sketch covers the hashes up to its largest, a smaller one covers all.
    """
    top = F.lit((1 << 31) - 1)
    limit = F.least(*[F.when(F.size(s) < SKETCH, top).otherwise(F.element_at(s, -1)) for s in (a, b)])

    def share(m: Column) -> Column:
        known = [F.size(F.filter(s, lambda x: x <= m)) for s in (a, b)]
        common = F.size(F.filter(F.array_intersect(a, b), lambda x: x <= m))
        return F.when(known[0] + known[1] > 0, 2.0 * common / (known[0] + known[1])).otherwise(F.lit(1.0))

    return _let(limit, share)


def anchor_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, code): every anchor of every whole text, for positional matching by a join on ``code``.

    Repeated rows give repeated anchors; null and empty texts give none; an empty table gives an empty result.
    """
    each = F.explode(anchors(F.col(text_col))).alias("anchor")
    return docs.select(F.col(id_col).alias("doc_id"), each).select(
        "doc_id", F.col("anchor").bitwiseAND(F.lit((1 << 32) - 1)).alias("position"), code_of(F.col("anchor")).alias("code"))


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text keeps the first code points and takes the last ``floor(n_chars / 2)`` from the start of the next
    document: descending id, null ids last, ties by SHA-256 of the text; after the last row comes the first.  A row that
    stands in the table several times is followed by its own copies.  A single row is its own next.  Null counts as empty;
    an empty table gives an empty result; other columns are ignored.

    Equal rows (id and text) are one group.  Order and neighbours are found on narrow rows; a group's text is shuffled
    once, then only the part that its neighbour needs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = F.concat_ws(":", F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")), F.sha2(text, 256))
    key = F.coalesce(F.unhex(F.md5(same)), F.lit(bytearray()))  # never null, so that no filter computes it again
    groups = cut_lineage(docs.select(
        key.alias("key"), F.col(id_col).alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("sha"),
    ).groupBy("key", "doc_id", "n_chars", "sha").agg(F.count("*").alias("rows")))
    total = groups.count()
    order = ranked(groups, [F.col("doc_id").desc_nulls_last(), "sha"]).select("key", "doc_id", "n_chars", "rows", "rank")
    owners = order.select(F.col("key").alias("owner"), F.expr("n_chars div 2").alias("need"),
                          F.pmod(F.col("rank") + 1, F.lit(max(total, 1))).alias("rank"))
    near = cut_lineage(order.join(owners, "rank").drop("rank"))

    texts = docs.select(key.alias("key"), F.struct(text.alias("text"), sketch(text).alias("sketch")).alias("body"))
    bodies = texts.groupBy("key").agg(F.first("body").alias("body"))
    own = bodies.join(near.select("key", "doc_id", "n_chars", "rows"), "key")
    start = F.substring(F.col("body.text"), F.lit(1), F.col("need").cast("int"))
    following = bodies.join(near.select("key", "owner", "need"), "key").select(
        F.col("owner").alias("key"), F.struct(start.alias("start"), codes(F.col("body.sketch")).alias("codes"), F.lit(1).cast("long").alias("times")).alias("next"))

    half = F.expr("cast(n_chars div 2 as int)")
    itself = F.struct(F.substring(F.col("body.text"), F.lit(1), half).alias("start"), codes(F.col("body.sketch")).alias("codes"), (F.col("rows") - 1).alias("times"))
    cases = F.when(F.col("rows") > 1, F.array("next", itself)).otherwise(F.array("next"))
    edits = own.join(following, "key").select("doc_id", "n_chars", "body", F.explode(cases).alias("next"))
    kept = F.substring(F.col("body.text"), F.lit(1), (F.col("n_chars") - half).cast("int"))
    edited = edits.select("doc_id", "n_chars", F.col("body.sketch").alias("sketch"), "next.codes", "next.times",
                          F.concat(kept, F.col("next.start")).alias("text"))
    told = edited.select("doc_id", "n_chars", "sketch", "codes", "times", F.sha2("text", 256).alias("edited_sha256"), sketch(F.col("text")).alias("edited"))
    named = told.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("sketch")).alias("fingerprint"), as_string(F.col("edited")).alias("edited_fingerprint"),
        codes(F.col("sketch")).alias("mine"), codes(F.col("edited")).alias("other"), "codes", "times")
    return named.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("mine"), F.col("other")).alias("near_edited"),
        likeness(F.col("mine"), F.col("codes")).alias("near_next"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).drop("copy")
