"""Helpers to put comparison queries together from named common table expressions."""

from __future__ import annotations

import re

from corpusspark import adapters
from corpusspark.functions import fixed_values as V
from corpusspark.functions.terms import longest_first

CTES: dict[str, str] = {}

for _name in ("roots", "index_entries", "index_lines", "page_texts", "queries", "user_queries", "files_present", "repo_files", "snapshots",
              "file_versions", "code_files", "code_batches", "root_repos", "evidence_ranges", "findings_json", "plan_batches", "change_requests", "handoff_files"):
    CTES["m_" + _name] = adapters.duckdb_sql(_name)


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def query(sql: str, override: dict[str, str] | None = None) -> str:
    """The statement with every common table expression it needs; ``override`` swaps some of them."""
    known = {**CTES, **(override or {})}
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, known), key=len, reverse=True)) + r")\b")
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for other in dict.fromkeys(pattern.findall(known[name])):
            if other != name:
                visit(other)
        done.append(name)

    for name in dict.fromkeys(pattern.findall(sql)):
        visit(name)
    parts = [f"{name} as materialized ({known[name].strip()})" for name in done]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + sql.strip()


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def has_any(text: str, needles) -> str:
    return "(" + " or ".join(f"contains({text}, {lit(n)})" for n in needles) + ")"


def grams(value: str, size: int) -> str:
    return f"list_transform(range(1, length({value}) - {size - 2}), lambda gi: substr({value}, gi, {size}))"


def keep_order(values: str) -> str:
    """Distinct list entries in their first order."""
    return f"list_filter({values}, lambda ov, oi: list_position({values}, ov) = oi)"


CJK_RUN = "[一-鿿]+"
