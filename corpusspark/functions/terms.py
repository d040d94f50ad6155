"""Tokens and topic terms of a query text, as array expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import CJK, grams, let, strings, strip

RUN = f"[a-zA-Z0-9_-]+|[{CJK}]+"
WORD_RUN = f"[A-Za-z][A-Za-z0-9_-]*|[{CJK}]+"
IS_CJK = f"^[{CJK}]+$"


def longest_first(words):
    """Longest words first; equal lengths keep their listed order."""
    return sorted(words, key=len, reverse=True)


def tokens(query: Column) -> Column:
    """Lower-cased ASCII runs; a CJK run gives itself and its 4-, 3- and 2-grams; ordered distinct."""
    runs = F.regexp_extract_all(query, F.lit(f"({RUN})"), F.lit(1))
    return F.array_distinct(
        F.flatten(
            F.transform(
                runs,
                lambda run: F.when(
                    run.rlike(IS_CJK), F.concat(F.array(run), grams(run, 4), grams(run, 3), grams(run, 2))
                ).otherwise(F.array(F.lower(run))),
            )
        )
    )


def _cjk_part_terms(part: Column) -> Column:
    aliases = F.filter(
        strings(V.CODE_SEARCH_ALIASES), lambda alias: (alias != part) & part.contains(alias)
    )
    compounds = F.filter(strings(longest_first(V.CJK_TOPIC_COMPOUNDS)), lambda c: part.contains(c))
    known = F.array_distinct(F.concat(compounds, aliases))
    own = F.when(F.char_length(part) <= 8, F.array(part)).otherwise(strings([]))
    return F.when(F.char_length(part) <= 4, F.concat(F.array(part), aliases)).otherwise(
        F.concat(own, F.when(F.size(known) > 0, known).otherwise(F.concat(grams(part, 4), grams(part, 3))))
    )


def topic_terms(query: Column) -> Column:
    """Business terms of a query: stop words are cut out longest first, the rest is split into terms."""

    def of_run(run: Column) -> Column:
        cleaned = F.aggregate(
            strings(longest_first(V.CJK_TOPIC_STOPWORDS)), run, lambda acc, stop: F.replace(acc, stop, F.lit(" "))
        )
        parts = F.filter(F.split(strip(cleaned), r"\s+"), lambda p: F.char_length(p) >= 2)
        lowered = F.lower(run)
        ascii_terms = F.when(
            ~lowered.isin(V.ALNUM_TOPIC_STOPWORDS) & (F.char_length(lowered) >= 2), F.array(lowered)
        ).otherwise(strings([]))
        return F.when(run.rlike(IS_CJK), F.flatten(F.transform(parts, _cjk_part_terms))).otherwise(ascii_terms)

    runs = F.regexp_extract_all(query, F.lit(f"({WORD_RUN})"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(runs, of_run)))


CODE_STOPWORD_PATTERN = "|".join(re.escape(w) for w in longest_first(V.CODE_TOPIC_STOPWORDS_CJK))


def code_topic_terms(query: Column, module_keys: Column | None = None) -> Column:
    """Terms of a code query; ASCII terms that name a module (``module_keys``) are dropped."""

    def variants(part: Column) -> Column:
        sized = [F.when(F.char_length(part) > n, grams(part, n)).otherwise(strings([])) for n in (4, 3, 2)]
        return F.concat(F.array(part), *sized)

    def of_run(run: Column) -> Column:
        parts = F.filter(
            F.split(F.regexp_replace(run, CODE_STOPWORD_PATTERN, " "), " "), lambda p: F.char_length(p) >= 2
        )
        lowered = F.lower(run)
        keep = ~lowered.isin(V.CODE_TOPIC_STOPWORDS_ALNUM) & (F.char_length(lowered) >= 3)
        if module_keys is not None:
            keep = keep & ~F.array_contains(module_keys, lowered)
        return F.when(run.rlike(IS_CJK), F.flatten(F.transform(parts, variants))).otherwise(
            F.when(keep, F.array(lowered)).otherwise(strings([]))
        )

    runs = F.regexp_extract_all(query, F.lit(f"({WORD_RUN})"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(runs, of_run)))


def is_strong_topic_term(term: Column, include_compounds: bool = True) -> Column:
    strong = term.rlike(IS_CJK) & (F.char_length(term) >= 4)
    return (strong | term.isin(V.CJK_TOPIC_COMPOUNDS)) if include_compounds else strong


def boundary_keys(lowered: Column) -> Column:
    """Every piece of an ASCII run that starts and ends at a boundary.

    An alias key (a-z, 0-9, ``_``, ``-``) stands in a text "with boundaries" exactly when it is one of
    these pieces, so the substring test becomes an equality join on the key.
    """
    def pieces(run: Column) -> Column:
        size = F.char_length(run)
        positions = F.sequence(F.lit(1), size)

        def alnum(i: Column) -> Column:
            return F.substring(run, i, F.lit(1)).rlike("[a-z0-9]")

        starts = F.filter(
            positions,
            lambda i: F.substring(run, i, F.lit(1)).rlike("[a-z]") & ((i == 1) | ~alnum(F.greatest(i - 1, F.lit(1)))),
        )
        ends = F.filter(positions, lambda i: (i == size) | ~alnum(i + 1))
        return F.flatten(
            F.transform(
                starts,
                lambda s: F.transform(
                    F.filter(ends, lambda e: e > s),
                    lambda e: F.substring(run, s, e - s + 1),
                ),
            )
        )

    def of_runs(runs: Column) -> Column:
        cut = lambda run: run.contains("_") | run.contains("-")
        return F.concat(F.filter(runs, lambda run: ~cut(run)), F.flatten(F.transform(F.filter(runs, lambda run: cut(run) & run.rlike("[a-z]")), pieces)))

    # The different runs of a text are far fewer than its runs, and only those with a boundary inside have pieces.
    return F.array_distinct(let(F.array_distinct(F.regexp_extract_all(lowered, F.lit("([a-z0-9_-]+)"), F.lit(1))), of_runs))
